"""Queries on validated answers: attributed claims, discovered claims, adjudication in one or two looks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import answers
from ..sources import testdata as td

_WHOLE = {"ignoreNullFields": "false"}
_LEVELS = ("high", "medium", "low")


def _calls(spark, sf):
    """One answer for each pair of papers; of twelve citing papers one has no call, one a failed one, and five an answer with a fault."""
    k, ord_ = F.col("citing"), F.col("ord")
    inside = ord_ % 4 != 3
    sure = F.when((k % 12 == 3) & (ord_ == 0), "sure").otherwise(td._pick(_LEVELS, (k + ord_) % 3))
    def entry(flag):
        return F.struct(
            F.concat_ws(":", k.cast("string"), ord_.cast("string")).alias("mentionId"), flag.alias("inScopeEmpiricalAttribution"), F.when(inside, F.col("context")).alias("attributedClaimText"),
            F.when(inside, F.col("marker")).alias("supportSpanText"), F.when(inside, sure).alias("confidence"), F.when(~inside, "methodological reference only").alias("reasonIfExcluded"),
        )

    top = F.max("ord").over(Window.partitionBy("citing", "cited"))
    m = td.mentions(spark, sf).where(k % 12 != 0).withColumn("top", top)
    plain, flipped = F.to_json(entry(inside), _WHOLE), F.to_json(entry(~inside), _WHOLE)
    gone = F.to_json(entry(inside).dropFields("inScopeEmpiricalAttribution"), _WHOLE)
    said = F.when((k % 12 == 4) & (ord_ == F.col("top")), gone).when((k % 12 == 5) & (ord_ % 2 == 1), None).when(k % 12 == 6, F.concat_ws(",", flipped, plain)).otherwise(plain)
    listed = m.select("citing", F.col("cited").alias("seed"), F.struct("ord", said.alias("said")).alias("e")).where("e.said is not null").groupBy("citing", "seed").agg(F.array_sort(F.collect_list("e")).alias("e"))
    text = F.concat(F.lit('{"extractions": ['), F.array_join(F.col("e.said"), ","), F.lit("]}"))
    text = F.when(k % 12 == 2, "I cannot answer").when(k % 12 == 7, F.concat(F.lit("Here it is:\n```json\n"), text, F.lit("\n```"))).otherwise(text)
    return listed.select("citing", "seed", F.lit("alpha-small").alias("model"), text.alias("response_text"), F.when(k % 12 == 1, "HTTP 529").alias("failure"))


def attributed_claims(spark, sf):
    m = td.mentions(spark, sf).select(F.concat_ws(":", F.col("citing").cast("string"), F.col("ord").cast("string")).alias("mention_id"), "citing", F.col("cited").alias("seed"))
    out = answers.attributed_claims(m, _calls(spark, sf))
    return out.select("record_id", "seed", "model", "in_scope", F.md5("claim").alias("claim"), "support", "confidence", "reason")


def attribution_problems(spark, sf):
    out = answers.validated(_calls(spark, sf), answers.ATTRIBUTIONS)
    return out.groupBy(F.regexp_replace("problem", r"\d+", "#").alias("problem")).agg(F.count("*").alias("n"), F.count("answer").alias("n_answers"))


def _discovery(spark, sf):
    k = F.col("paper_id")
    d = td.read(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.coalesce("text", F.lit("")).alias("text"))
    papers = d.select("paper_id", F.concat(F.lit("Paper "), k.cast("string")).alias("title"), F.when(k % 10 != 0, F.col("text")).otherwise("").alias("manuscript"))
    lines = d.withColumn("lines", F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0), 1, 4)).withColumn("top", F.size("lines") - 1)
    false = F.concat(F.lit("never in the text of "), k.cast("string"), F.lit("§"))
    def claim(x, i):
        spans = F.when((k % 10 == 4) & (i == F.col("top")), F.array().cast("array<string>")).when(k % 5 == i, F.array(false)).otherwise(F.array(x, false))
        kind = F.when((k % 10 == 3) & (i == 0), "guess").otherwise(td._pick(answers.CLAIM_TYPES, i % 3))
        return F.struct(
            F.concat(F.lit("C"), i.cast("string")).alias("claimText"), spans.alias("sourceSpans"), F.lit("Results").alias("section"), F.array(F.lit("[1]")).alias("citedReferences"),
            kind.alias("claimType"), F.when(i % 2 == 0, "high").otherwise("medium").alias("confidence"),
        )

    said = F.to_json(F.struct(F.transform("lines", claim).alias("claims")), _WHOLE)
    calls = lines.where(k % 10 != 1).select("paper_id", said.alias("response_text"), F.when(k % 10 == 2, "HTTP 529").alias("failure"))
    return papers, calls


def discovered_claims(spark, sf):
    out = answers.discovered_claims(*_discovery(spark, sf))
    held = F.array_join(F.transform("claims", lambda c: F.concat(c["claimText"], F.lit("="), F.array_join(c["sourceSpans"], "|"))), "\n")
    return out.select("paper_id", "status", "detail", "n_claims", "n_findings", F.md5(held).alias("held"))


def _looks(spark, sf):
    k = F.col("task_id")
    records = td.audit_base(spark, sf).select("task_id", "excluded", (k % 4 == 0).alias("bundled"))
    def said(verdict, why):
        return F.to_json(F.struct(F.lit("A, B").alias("comparison"), verdict.alias("verdict"), why.alias("rationale"), td._pick(_LEVELS, k % 2).alias("retrievalQuality"), td._pick(_LEVELS, (k + verdict_shift) % 3).alias("judgeConfidence")), _WHOLE)

    verdict_shift = 0
    odd = F.when(k % 13 == 1, "maybe").otherwise(td._pick(answers.VERDICTS, k % 5))
    text = F.when(k % 13 == 3, said(odd, F.lit(4))).otherwise(said(odd, F.lit("because")))
    first = records.where(k % 13 != 2).select("task_id", F.lit("alpha-small").alias("model"), text.alias("response_text"), F.when(k % 13 == 0, "HTTP 529").alias("failure"))
    verdict_shift = 1
    text = said(td._pick(answers.VERDICTS, (k + 1) % 5), F.lit("on reflection"))
    second = records.select("task_id", F.lit("alpha-large").alias("model"), text.alias("response_text"), F.when(k % 7 == 0, "HTTP 500").alias("failure"))
    return records, first, second


def adjudication_one_look(spark, sf):
    records, first, _ = _looks(spark, sf)
    return answers.adjudicate(records, first).select("task_id", "verdict", "rationale", "confidence", "adjudicator", "passes")


def adjudication_two_looks(spark, sf):
    return answers.adjudicate(*_looks(spark, sf)).select("task_id", "verdict", "rationale", "quality", "confidence", "adjudicator", "successful", "passes")


def _grounded(spark, sf):
    """Families with an answer for each document: up to nine quotes, of some documents one that the text does not hold."""
    k = F.col("family_id")
    d = td.read(spark, sf, "documents").select(F.col("doc_id").alias("family_id"), F.coalesce("text", F.lit("")).alias("text"))
    families = d.select("family_id", F.concat(F.lit("  claim "), k.cast("string"), F.lit(" ")).alias("tracked"), F.when(k % 10 != 0, F.col("text")).otherwise("").alias("manuscript"))
    lines = d.withColumn("lines", F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0), 1, 9))
    hint = lambda i: F.when(i % 3 == 0, " Results ").when(i % 3 == 1, " ")
    quotes = F.transform("lines", lambda x, i: F.struct(F.when((k % 4 == 1) & (i == 1), F.lit("§ never there")).otherwise(x).alias("verbatimQuote"), hint(i).alias("sectionHint")))
    status = F.when(k % 10 == 3, "maybe").otherwise(td._pick(("grounded", "ambiguous", "not_found"), k % 3))
    # null hints are left out, as optional fields are
    said = F.to_json(F.struct(status.alias("status"), F.when(k % 6 == 1, " ").otherwise("as claimed").alias("normalizedClaim"), quotes.alias("supportSpans"), F.lit("seen").alias("detailReason")))
    calls = lines.where(k % 10 != 1).select("family_id", said.alias("response_text"), F.when(k % 10 == 2, "HTTP 529").alias("failure"))
    return families, calls


def grounded_claims(spark, sf):
    out = answers.ground_claims(*_grounded(spark, sf))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["text"], F.lit("@"), F.coalesce(s["section"], F.lit("")))), "\n")
    return out.select("family_id", "status", "normalized", F.md5(spans).alias("spans"), F.size("failures").alias("n_failures"), "blocks", "detail")


def claim_clusters(spark, sf):
    f = td.mentions(spark, sf).where("ord < 4").select(F.col("citing").alias("seed"), F.col("ord").cast("long").alias("index"))
    n = F.count("*")
    listed = F.when(F.col("n") > 2, F.concat(F.lit('{"cluster": 1, "memberIndices": [0, 2], "representativeIndex": 2, "reasoning": "same"}, {"cluster": 2, "memberIndices": ['), F.when(F.col("n") > 3, "1, 3").otherwise("1"), F.lit('], "representativeIndex": 1, "reasoning": "rest"}')))
    listed = listed.otherwise('{"cluster": 1, "memberIndices": [0, 1], "representativeIndex": 0, "reasoning": "both"}')
    calls = f.groupBy("seed").agg(n.alias("n")).where("n > 1").select("seed", F.concat(F.lit('Well: {"clusters": ['), listed, F.lit("]}")).alias("response_text"), F.lit(None).cast("string").alias("failure"))
    return answers.claim_clusters(f, calls)


_BAD = "LLM returned invalid JSON: "
_OPTIONS = 'Invalid option: expected one of "high"|"medium"|"low"'
_ATTRIBUTED = f"""{td.MENTIONS}, a AS (SELECT *, max(ord) OVER (PARTITION BY citing, cited) AS top, ord % 4 <> 3 AS inside FROM mentions),
  r AS (SELECT *, CASE citing % 12 WHEN 0 THEN 'No call covers this mention' WHEN 1 THEN 'HTTP 529' WHEN 2 THEN '{_BAD}No valid JSON found in LLM response (15 chars). First 200 chars: I cannot answer'
      WHEN 3 THEN '{_BAD}extractions.0.confidence: {_OPTIONS}' WHEN 4 THEN '{_BAD}extractions.' || top || '.inScopeEmpiricalAttribution: Invalid input: expected boolean, received undefined'
      WHEN 5 THEN CASE WHEN ord % 2 = 1 THEN 'LLM did not return a result for this mention' END END AS problem FROM a),
  s AS (SELECT *, problem IS NULL AND inside AS ok FROM r)"""
_KEPT = "paper_id % 5 <> i"
_DISCOVERED = f"""d AS (SELECT doc_id AS paper_id, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')[1:4] AS lines FROM documents),
  e AS (SELECT paper_id, lines, list_filter(range(len(lines)), lambda i: {_KEPT}) AS kept,
    CASE WHEN paper_id % 10 = 0 OR text = '' THEN 'no_fulltext' WHEN paper_id % 10 IN (1, 2) OR (paper_id % 10 IN (3, 4) AND len(lines) > 0) THEN 'llm_failed' ELSE 'completed' END AS status FROM d),
  f AS (SELECT paper_id, status, lines, CASE WHEN status = 'completed' THEN kept ELSE [] END AS kept FROM e),
  g AS (SELECT *, len(kept)::INT AS n_claims, len(list_filter(kept, lambda i: i % 3 = 0))::INT AS n_findings FROM f)"""
_FIRST = f"""b AS (SELECT o_orderkey AS k, o_orderkey % 11 = 0 AS excluded, o_orderkey % 4 = 0 AS bundled FROM {td._tasks_sql(13, 1)}),
  one AS (SELECT *, CASE k % 13 WHEN 0 THEN 'HTTP 529' WHEN 1 THEN '{_BAD}verdict: Invalid option: expected one of {"|".join(f'"{v}"' for v in answers.VERDICTS)}' WHEN 2 THEN 'No call covers this record'
      WHEN 3 THEN '{_BAD}rationale: Invalid input: expected string, received number' END AS p1 FROM b),
  f AS (SELECT *, CASE WHEN p1 IS NULL THEN {td._sql_list(answers.VERDICTS)}[(k % 5 + 1)::INT] ELSE 'cannot_determine' END AS v1, CASE WHEN p1 IS NULL THEN 'because' ELSE 'LLM error: ' || p1 END AS r1,
      CASE WHEN p1 IS NULL THEN {td._sql_list(_LEVELS)}[(k % 3 + 1)::INT] END AS c1, CASE WHEN p1 IS NULL THEN {td._sql_list(_LEVELS)}[(k % 2 + 1)::INT] END AS q1 FROM one)"""
_WHO = "CASE WHEN k % 13 = 2 THEN 'llm:none:error' ELSE 'llm:alpha-small{}' || CASE WHEN p1 IS NULL THEN '' ELSE ':error' END END"

QUERIES = {
    "attributed_claims": (
        attributed_claims,
        f"""WITH {_ATTRIBUTED} SELECT 'rec-' || citing || ':' || ord AS record_id, cited AS seed, CASE WHEN citing % 12 <> 0 THEN 'alpha-small' END AS model, ok AS in_scope, CASE WHEN ok THEN md5(context) END AS claim, CASE WHEN ok THEN marker END AS support,
          CASE WHEN ok THEN {td._sql_list(_LEVELS)}[((citing + ord) % 3 + 1)::INT] END AS confidence, coalesce(problem, CASE WHEN NOT inside THEN 'methodological reference only' END) AS reason FROM s""",
    ),
    "attribution_problems": (
        attribution_problems,
        f"""WITH {_ATTRIBUTED}, c AS (SELECT DISTINCT citing, cited, CASE WHEN citing % 12 <> 5 THEN problem END AS problem FROM s WHERE citing % 12 <> 0)
          SELECT regexp_replace(problem, '\\d+', '#', 'g') AS problem, count(*) AS n, count(*) FILTER (WHERE problem IS NULL) AS n_answers FROM c GROUP BY 1""",
    ),
    "discovered_claims": (
        discovered_claims,
        f"""WITH {_DISCOVERED} SELECT paper_id, status, n_claims, n_findings, md5(array_to_string(list_transform(kept, lambda i: 'C' || i || '=' || lines[i + 1]), chr(10))) AS held,
          CASE WHEN status = 'no_fulltext' THEN 'No claim-bearing text blocks found in parsed document.' WHEN status = 'completed' THEN 'Extracted ' || n_claims || ' claims (' || n_findings || ' findings) from Paper ' || paper_id || '.'
            WHEN paper_id % 10 = 1 THEN 'No call covers this paper' WHEN paper_id % 10 = 2 THEN 'HTTP 529' WHEN paper_id % 10 = 3 THEN '{_BAD}claims.0.claimType: Invalid option: expected one of "finding"|"interpretation"|"methodological"'
            ELSE '{_BAD}claims.' || (len(lines) - 1) || '.sourceSpans: Too small: expected array to have >=1 items' END AS detail FROM g""",
    ),
    "grounded_claims": (
        grounded_claims,
        """WITH d AS (SELECT doc_id AS family_id, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')[1:9] AS lines FROM documents),
          e AS (SELECT *, family_id % 10 = 0 OR text = '' AS empty, family_id % 10 NOT IN (1, 2, 3) AS valid FROM d),
          f AS (SELECT *, NOT empty AND valid AS ok, NOT empty AND valid AND family_id % 4 = 1 AND len(lines) > 1 AS lost FROM e),
          g AS (SELECT *, CASE WHEN empty THEN 'no_seed_fulltext' WHEN NOT ok THEN 'not_attempted' WHEN family_id % 3 = 0 THEN CASE WHEN lost THEN 'ambiguous' ELSE 'grounded' END WHEN family_id % 3 = 1 THEN 'ambiguous' ELSE 'not_found' END AS status FROM f)
          SELECT family_id, status, CASE WHEN ok AND family_id % 6 <> 1 THEN 'as claimed' ELSE 'claim ' || family_id END AS normalized,
            md5(array_to_string(CASE WHEN ok THEN list_transform(range(least(len(lines), 8)), lambda i: CASE WHEN family_id % 4 = 1 AND i = 1 THEN '§ never there' WHEN length(lines[i + 1]) > 800 THEN lines[i + 1][1:797] || '...' ELSE lines[i + 1] END || '@' || CASE WHEN i % 3 = 0 THEN 'Results' ELSE '' END) ELSE [] END, chr(10))) AS spans,
            lost::INT AS n_failures, status IN ('no_seed_fulltext', 'not_attempted') AS blocks,
            CASE WHEN empty THEN 'No manuscript text to send to the LLM (empty parsed document).' WHEN ok THEN 'seen' || CASE WHEN lost THEN ' (verification: a quoted passage was not found verbatim in the manuscript — possible paraphrase or model error; first issue: Not found as a contiguous substring of the manuscript text.)' ELSE '' END
              WHEN family_id % 10 = 1 THEN 'LLM claim grounding failed: No call covers this family' WHEN family_id % 10 = 2 THEN 'LLM claim grounding failed: HTTP 529'
              ELSE 'LLM returned invalid grounding JSON: status: Invalid option: expected one of "grounded"|"ambiguous"|"not_found"' END AS detail FROM g""",
    ),
    "claim_clusters": (
        claim_clusters,
        f"""WITH {td.MENTIONS}, m AS (SELECT citing AS seed, ord::BIGINT AS index, count(*) OVER (PARTITION BY citing) AS n FROM mentions WHERE ord < 4)
          SELECT seed, index, CASE WHEN n > 2 AND index % 2 = 1 THEN 2 ELSE 1 END::BIGINT AS cluster, CASE WHEN n > 2 THEN index IN (1, 2) ELSE index = 0 END AS representative,
            CASE WHEN n = 1 THEN 'Single family — no consolidation needed.' WHEN n = 2 THEN 'both' WHEN index % 2 = 0 THEN 'same' ELSE 'rest' END AS reasoning FROM m""",
    ),
    "adjudication_one_look": (
        adjudication_one_look,
        f"WITH {_FIRST} SELECT k AS task_id, CASE WHEN NOT excluded THEN v1 END AS verdict, CASE WHEN NOT excluded THEN r1 END AS rationale, CASE WHEN NOT excluded THEN c1 END AS confidence, CASE WHEN NOT excluded THEN {_WHO.format('')} END AS adjudicator, (NOT excluded)::INT AS passes FROM f",
    ),
    "adjudication_two_looks": (
        adjudication_two_looks,
        f"""WITH {_FIRST}, g AS (SELECT *, NOT excluded AND (coalesce(c1 = 'low', false) OR v1 = 'cannot_determine' OR (bundled AND coalesce(c1 = 'medium', false))) AS again, k % 7 = 0 AS p2 FROM f)
          SELECT k AS task_id, CASE WHEN excluded THEN NULL WHEN again THEN CASE WHEN p2 THEN 'cannot_determine' ELSE {td._sql_list(answers.VERDICTS)}[((k + 1) % 5 + 1)::INT] END ELSE v1 END AS verdict,
            CASE WHEN excluded THEN NULL WHEN again THEN CASE WHEN p2 THEN 'LLM error: HTTP 500' ELSE 'on reflection' END ELSE r1 END AS rationale,
            CASE WHEN excluded THEN NULL WHEN again THEN CASE WHEN NOT p2 THEN {td._sql_list(_LEVELS)}[(k % 2 + 1)::INT] END ELSE q1 END AS quality,
            CASE WHEN excluded THEN NULL WHEN again THEN CASE WHEN NOT p2 THEN {td._sql_list(_LEVELS)}[((k + 1) % 3 + 1)::INT] END ELSE c1 END AS confidence,
            CASE WHEN excluded THEN NULL WHEN again THEN 'llm:alpha-large' || CASE WHEN p2 THEN ':error' ELSE '' END ELSE {_WHO.format(':thinking')} END AS adjudicator,
            CASE WHEN excluded THEN NULL WHEN again THEN NOT p2 ELSE p1 IS NULL END AS successful, CASE WHEN excluded THEN 0 WHEN again THEN 2 ELSE 1 END AS passes FROM g""",
    ),
}
