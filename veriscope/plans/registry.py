"""Every query of the reference operators with its DuckDB equivalent."""

from __future__ import annotations

from . import answering, chains, comparing, judging, reading, resuming, running, screening, screening_chain, summarizing


def queries() -> dict:
    return {name: f for part in (reading, screening, judging, comparing, chains, running, resuming, screening_chain, answering, summarizing) for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in (reading, screening, judging, comparing, chains, running, resuming, screening_chain, answering, summarizing) for name, (_, sql) in part.QUERIES.items() if sql}
