"""Near-duplicates, line deduplication, fingerprints, packing and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veriscope.llm import decontaminate, fingerprint, hashing, linededup, minhash, packing
from veriscope.llm.queries import tokenizer_file

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "a b", "a b c d e", "A B C D E", "x " * 3000, "é ñ ü ß 😀 words here too", "line one is long enough here\nline one is long enough here"]
SCHEMA = "doc_id long, text string, lang string, score double, id long, bucket string, n int"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, "xx", 0.5, 7, "b", 1) for k, t in enumerate(texts)], SCHEMA)


def corpus(seed=1, n=120):
    """Random texts with exact copies, near copies of several degrees, a large loose group, shared lines, odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda m: " ".join(rng.choice(vocabulary) + ("\n" if rng.random() < 0.06 else "") for _ in range(m))
    out = [text(rng.randint(1, 160)) for _ in range(n)]
    base = out[5] + " " + text(150)
    for k in range(60):
        words = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(words))
    out += [out[3], out[3], out[7].upper(), out[9] + " tail"]
    shared = "this very common passage stands in many of the documents here"
    out += [f"{shared}\n{text(40)}" for _ in range(40)] + ODD + [out[-1]]
    rng.shuffle(out)
    return out


def shingle_set(text, size=5):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


class Classes:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.mark.parametrize("large", [16, 3])
def test_near_duplicates(spark, large):
    texts = corpus()
    sets = [shingle_set(t) for t in texts]
    c = Classes(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                c.join(a, b)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts), large=large).collect()}
    assert len(got) == len(texts)
    for k in got:
        assert got[k]["n_shingles"] == len(sets[k])
        assert got[k]["component_id"] == c.find(k), k
        assert got[k]["kept"] == (c.find(k) == k)
    assert len({c.find(k) for k in got}) < len(texts) - 30


def test_near_duplicates_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [((False, 2), 2, True), ((False, 4), 4, True), ((False, 4), 4, True), ((False, 9), 4, False), ((True, 0), None, True)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    sa, sb = minhash.circulant_signature(a, 1024), minhash.circulant_signature(b, 1024)
    assert abs((sa == sb).mean() - 700 / 1300) < 0.06
    assert (minhash.circulant_signature(np.tile(a, 5), 64) == sa[:64]).all()


def line_classes(texts, threshold=80, least=5):
    seen = {}
    for d, t in enumerate(texts):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            s = frozenset(WORD.findall(line.encode().lower()))
            if len(s) >= least:
                seen.setdefault(s, []).append((d, k))
    sets = list(seen)
    c = Classes(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
                c.join(a, b)
    first = {}
    for k, s in enumerate(sets):
        first[c.find(k)] = min(first.get(c.find(k), (10**9, 0)), min(seen[s]))
    gone = defaultdict(set)
    for k, s in enumerate(sets):
        for d, n in seen[s]:
            if (d, n) != first[c.find(k)]:
                gone[d].add(n)
    return gone


@pytest.mark.parametrize("few", [200, 3])
def test_line_dedup(spark, few):
    texts = corpus(2) + ["p q r s t u v w x y\np q r s t u v w x z\nshort line"] * 3
    gone = line_classes(texts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, texts), limits=linededup.Limits(few=few)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        wanted = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k])
        assert got[k]["text"] == wanted, k
        assert got[k]["removed_count"] == len(gone[k])
        assert (got[k]["lang"], got[k]["bucket"], got[k]["n"]) == ("xx", "b", 1)
    assert sum(map(len, gone.values())) > 40


def test_piece_boundaries_do_not_matter(monkeypatch):
    import pyarrow as pa

    texts = pa.array([t for t in corpus(4)])
    whole = [x.tolist() for x in hashing.shingle_sets(texts)]
    monkeypatch.setattr(hashing, "PIECE", 97)
    assert [x.tolist() for x in hashing.shingle_sets(texts)] == whole
    assert [x.tolist() for x in hashing.shingle_sets(pa.concat_arrays([pa.array(["zz"]), texts]).slice(1))] == whole


def test_fingerprints(spark):
    texts = corpus(5)
    rows = fingerprint.edited_likeness(frame(spark, texts), rows_a_bucket=17).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    errors = []
    for k, t in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingle_set(t), shingle_set(edited), shingle_set(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        errors += [abs(r["near_edited"] - like(a, b)), abs(r["near_next"] - like(a, c))]
        if len(a | b) <= fingerprint.SIZE:
            assert r["near_edited"] == pytest.approx(like(a, b))
            assert r["contained_edited"] == pytest.approx(len(a & b) / len(a) if a else 1.0)
        assert r["distinct_shingles"] == pytest.approx(len(a), rel=0.35)
    assert max(errors) < 0.2
    same = defaultdict(set)
    for k, t in enumerate(texts):
        same[t or ""].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_merge_as_unions(spark):
    texts = [t for t in corpus(6) if t]
    df = frame(spark, texts).selectExpr("doc_id", "text", "doc_id % 3 as part")
    prints = fingerprint.fingerprints(df).join(df.select("doc_id", "part"), "doc_id")
    whole = {k: set().union(*(shingle_set(t) for i, t in enumerate(texts) if i % 3 == k)) for k in range(3)}
    for r in fingerprint.merge_fingerprints(prints, "part").collect():
        assert r["distinct_shingles"] == pytest.approx(len(whole[r["part"]]), rel=0.35)
    a, b = (next(hashing.shingle_sets(__import__("pyarrow").array([" ".join(texts[s::2])]))) for s in (0, 1))
    assert (fingerprint.merge(a[:128], b[:128]) == np.union1d(a, b)[:128]).all()


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = corpus(7) + ["word " * 5000, "<|endoftext|> kept <|ENDOFTEXT|>", "don't, won't! x.y/z café\u00a0été"]
    coder = Tokenizer.from_file(tokenizer_file())
    rows = packing.pack_documents(frame(spark, texts), tokenizer_file(), rows_a_group=10, with_ids=True).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for k, t in enumerate(texts):
        wanted = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [i for r in parts for i in r["ids"]] == wanted
        assert [r["piece"] for r in parts] == list(range(len(parts))) and all(r["length"] == 2048 for r in parts[:-1])
        for r in parts:
            assert r["start"] == 2048 * r["piece"] and r["length"] == len(r["ids"])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_plan_places_every_count_once():
    rng = random.Random(1)
    histogram = {rng.randint(1, 300): rng.randint(1, 50) for _ in range(120)}
    segments = packing.plan(histogram, 300)
    assert Counter({k: sum(s[2] for s in segments if s[0] == k) for k in histogram}) == Counter(histogram)
    room = Counter()
    for length, _, many, first, _ in segments:
        for s in range(first, first + many):
            room[s] += length
    assert max(room.values()) <= 300 and len(room) <= 1.05 * sum(k * n for k, n in histogram.items()) / 300 + 1


def test_decontamination(spark):
    rng = random.Random(9)
    words = [f"q{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(12, 30)))) for k in range(8)]
    items += [(20, "A train leaves Paris at 60 km and reaches Lyon after 3 hours of slow travel."), (21, None), (22, ""), (25, "too few words"), (24, "quite plain words only"), (20, "A train leaves Paris at 60 km and reaches Lyon after 3 hours of slow travel.")]
    filler = lambda: " ".join(rng.choice(words) for _ in range(200))
    docs = [filler() for _ in range(20)]
    docs += [f"{filler()} {items[2][1]} {filler()}", items[5][1], f"{filler()}. A train leaves Rome at 75.5 km and reaches Milan after 12 hours of slow travel. {filler()}"]
    docs += ["A train leaves Paris at 1 km and reaches Paris after 1 hours of slow travel.", "It says quite plain words only here", *ODD]
    df = frame(spark, docs)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(20, 2), (21, 5), (22, 20), (23, 20), (24, 24)}
    assert got[22, 20]["changed"] > 0 and got[20, 2]["changed"] == 0
    twisted = spark.createDataFrame([(1, "A train leaves Rome at 75 km and reaches Milan after 12 hours of slow travel and Rome has 4 km and Oslo 9 km of it.")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "A train leaves Paris at 60 km and reaches Lyon after 60 hours of slow travel and Paris has 60 km and Paris 60 km of it.")], "item_id long, text string")
    assert decontaminate.find_leaks(twisted, item).count() == 0
    assert decontaminate.drop_leaks(df, spark.createDataFrame(items, "item_id long, text string")).count() == len(docs) - 5


def test_empty_tables(spark):
    empty = frame(spark, ["x"]).where("doc_id < 0")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    assert linededup.dedup_lines(empty).count() == 0
    assert fingerprint.edited_likeness(empty).count() == 0
    assert packing.pack_documents(empty, tokenizer_file()).count() == 0
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(frame(spark, ["a b c d e f g h"]), bench).count() == 0
