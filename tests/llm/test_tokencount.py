"""Token counts against the libraries themselves, and what the cache keeps, reuses and drops."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veriscope.llm import tokencount as tc
from veriscope.llm.queries import queries

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "\n\n", "it's <|endoftext|> we'll<|endoftext|>", "a  b\tc", "é è ß 😀👍🏽 漢字かな", "x" * 5000, "no blank" * 40, "Ein Satz mit Umläuten äöü und 12 345 Zahlen!", "one", "one", "<|startoftext|> UP down"]
SCHEMA = "doc_id long, text string, digest string, n int, n_tokens string, id long"


def plain(path, text):
    if path.endswith(".model"):
        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))
    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


def frame(spark, texts):
    rows = [(k, t, "x", 1, "y", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "without id", None, None, None, None), rows[-1]], SCHEMA)


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_counts_of_the_libraries(spark, path, tmp_path):
    got = tc.token_counts(frame(spark, ODD), path, f"{tmp_path}/c", limit=4).collect()
    texts = {**dict(enumerate(ODD)), None: "without id"}
    assert sorted(map(repr, (texts[r["doc_id"]] for r in got))) == sorted(map(repr, [*ODD, "without id", ODD[-1]]))
    for r in got:
        n = plain(path, texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 4)


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    coder = Tokenizer.from_file(BYTES)
    got = queries()["op12_token_counts"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(coder.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 1024)


def stored(spark, cache, path=BYTES):
    return spark.read.parquet(f"{cache}/version={tc.tokenizer_version(path)}")


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache, first = f"{tmp_path}/c", ["a a", "b b", "a a", "", None, "c"]
    tc.token_counts(frame(spark, first), BYTES, cache).collect()
    assert stored(spark, cache).count() == 5  # a a, b b, the empty text, c, without id
    tc.token_counts(frame(spark, first), BYTES, cache).collect()
    assert stored(spark, cache).select("batch").distinct().count() == 1
    tc.token_counts(frame(spark, [*first, "d", "d", "e"]), BYTES, cache).collect()
    assert sorted(r["count"] for r in stored(spark, cache).groupBy("batch").count().collect()) == [2, 5]
    tc.token_counts(frame(spark, first), WORDS, cache).collect()  # another version is another cache
    assert stored(spark, cache, WORDS).count() == 5 and stored(spark, cache).count() == 7
    # the stored counts are what is returned
    spark.createDataFrame([("z" * 9, 77)], "text string, n_tokens long").select(F.unhex(F.sha2("text", 256)).alias("digest"), "n_tokens").write.parquet(f"{cache}/version={tc.tokenizer_version(BYTES)}/batch=planted")
    assert {r["n_tokens"] for r in tc.token_counts(frame(spark, ["z" * 9]), BYTES, cache).where("doc_id = 0").collect()} == {77}


def test_appends_that_meet_and_compaction(spark, tmp_path):
    cache, version = f"{tmp_path}/c", tc.tokenizer_version(BYTES)
    docs = frame(spark, ["a a", "b b"])
    wanted = sorted(map(repr, tc.token_counts(docs, BYTES, cache).collect()))
    counts = tc.stored_counts(spark, cache, version)
    rows = spark.createDataFrame(counts.collect(), counts.schema)
    for _ in range(3):
        tc.append_counts(rows, cache, version)
    assert stored(spark, cache).count() == 12
    assert sorted(map(repr, tc.token_counts(docs, BYTES, cache).collect())) == wanted
    tc.compact_counts(spark, cache, version)
    assert stored(spark, cache).count() == 3 and stored(spark, cache).select("batch").distinct().count() == 1
    assert sorted(map(repr, tc.token_counts(docs, BYTES, cache).collect())) == wanted
    tc.compact_counts(spark, f"{tmp_path}/none", version)


def test_frequent_contents_take_the_broadcast(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    texts = ["the hot text"] * 300 + [f"text {rng.randrange(60)}" for _ in range(300)]
    wanted = sorted(map(repr, tc.token_counts(frame(spark, texts), BYTES, f"{tmp_path}/a").collect()))
    monkeypatch.setattr(tc, "HOT", 3)
    assert sorted(map(repr, tc.token_counts(frame(spark, texts), BYTES, f"{tmp_path}/b").collect())) == wanted and len(wanted) == 602


def test_cut_texts_count_as_whole_ones():
    rng = random.Random(7)
    pieces = ["word", "it's", " ", "  ", "\n", "12", "né", "!?", "<|endoftext|>", "'ll", "日本", "a", " b", "ß "]
    assert tc.cuts_at_blanks(BYTES) and not tc.cuts_at_blanks(WORDS) and not tc.cuts_at_blanks(PIECES)
    coder = Tokenizer.from_file(BYTES)
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60)))
        for most in (1, 7, 30):
            parts = list(tc.portions(text, most))
            assert "".join(parts) == text
            assert sum(len(coder.encode(p).ids) for p in parts) == len(coder.encode(text).ids)


def test_long_texts_in_portions(monkeypatch):
    monkeypatch.setattr(tc, "PORTION", 50)
    texts = ["", "a b c " * 100, "short", "", "one two three " * 20, "x" * 300, "end"]
    coder = Tokenizer.from_file(BYTES)
    for cut in (True, False):
        assert list(tc.count_texts(iter(texts), BYTES, cut)) == [len(coder.encode(t).ids) for t in texts]
    assert list(tc.count_texts(iter([]), BYTES, True)) == []


def test_normalised_content(spark, tmp_path):
    texts = ["a  b\n c", "a b c", " a b\tc "]
    got = tc.token_counts(frame(spark, texts), WORDS, f"{tmp_path}/c", normalise=tc.single_blanks).where("doc_id < 3").collect()
    assert {r["n_tokens"] for r in got} == {3} and {r["n_bytes"] for r in got} == {7, 5}
    assert stored(spark, f"{tmp_path}/c", WORDS).count() == 2


def test_no_rows(spark, tmp_path):
    assert tc.token_counts(spark.createDataFrame([], SCHEMA), BYTES, f"{tmp_path}/c").count() == 0
