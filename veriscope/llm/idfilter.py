"""A bitmap of fixed size over a column of long ids: a cheap test before a shuffle, never a decision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix
from .store import small_batches

_BLOCK = 1 << 16


def cells(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def counts(batches_of_cells: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of cells in one partition, as sparse blocks (block, at, n)."""
    held = np.zeros(1 << bits, np.uint16)
    for got in batches_of_cells:
        cell, n = np.unique(got, return_counts=True)
        held[cell] = np.minimum(held[cell] + n, 0xFFFF).astype(np.uint16)
    full = np.flatnonzero(held)
    block = full // _BLOCK
    edges = np.flatnonzero(np.diff(block, prepend=-1))
    blocks, ats, ns = [], [], []
    for a, b in zip(edges, np.append(edges[1:], len(full)), strict=False):
        blocks.append(int(block[a]))
        ats.append((full[a:b] % _BLOCK).astype(np.uint16).tobytes())
        ns.append(held[full[a:b]].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(ats, pa.binary()), pa.array(ns, pa.binary())], ["block", "at", "n"])


SPARSE = "block int, at binary, n binary"


def step(count: np.ndarray) -> np.ndarray:
    """Counts as one byte each: exact below 200, then four steps to a doubling."""
    high = 200 + np.floor(4 * np.log2(np.maximum(count, 200) / 200))
    return np.where(count < 200, count, np.minimum(high, 255)).astype(np.uint8)


def _summed(pdf: pd.DataFrame) -> np.ndarray:
    total = np.zeros(_BLOCK, np.int64)
    for at, n in zip(pdf["at"], pdf["n"], strict=True):
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
    return total


def merged(sparse: DataFrame, bits: int, fan_in: int = 64) -> Broadcast:
    """Sum the partitions' blocks as Spark groups; 2**bits bytes, whatever the data, reach the driver and the executors.

    Blocks of at most ``fan_in`` partitions meet in one group first, and their sums after that, so that no task reads a
    share of all partitions.
    """

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.minimum(_summed(pdf), 0xFFFF)
        at = np.flatnonzero(total)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "at": [at.astype(np.uint16).tobytes()], "n": [total[at].astype(np.uint16).tobytes()]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "n": [step(_summed(pdf)).tobytes()]})

    table = np.zeros(1 << bits, np.uint8)
    with small_batches(sparse.sparkSession):
        parts = sparse.withColumn("part", F.floor(F.spark_partition_id() / fan_in)).groupBy("block", "part").applyInPandas(some, SPARSE)
        for row in parts.groupBy("block").applyInPandas(whole, "block int, n binary").collect():  # at most 2**bits bytes
            table[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["n"], np.uint8)[: 1 << bits]
    return sparse.sparkSession.sparkContext.broadcast(table)


def id_filter(ids: DataFrame, column: str, bits: int = 22) -> Broadcast:
    """A bitmap of 2**bits cells over the ids; test with ``table.value[cells(ids, bits)] > 0``.

    More ids than cells only let more rows through: an exact join follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counts((cells(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits) for b in batches if b.num_rows), bits)

    return merged(ids.select(column).where(f"{column} is not null").mapInArrow(run, SPARSE), bits)
