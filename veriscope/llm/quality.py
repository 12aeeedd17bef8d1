"""Quality scores by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import pieces, shingles, text_buffers, words
from .store import keep, small_batches

FEATURES = ("log_words", "mark_share", "upper_share", "digit_share", "wide_share", "space_share", "distinct_share", "twin_share", "double_mark_share", "bare_mark_share", "stop_share", "top_share", "fresh_share", "word_length", "line_share")


def _flags(test) -> np.ndarray:
    return np.array([bool(test(c)) for c in range(256)])


_UPPER = _flags(lambda c: 65 <= c <= 90)
_LOWER = _flags(lambda c: 97 <= c <= 122)
_DIGIT = _flags(lambda c: 48 <= c <= 57)
_WIDE = _flags(lambda c: c >= 128)
_BLANK = _flags(lambda c: c in (9, 10, 11, 12, 13, 32))
_MARK = _flags(lambda c: 33 <= c < 127 and not chr(c).isalnum())
_STOP = _flags(lambda c: chr(c) in ".?")
_ODD = _flags(lambda c: 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-")
_CODES = np.select([_UPPER, _LOWER, _DIGIT, _WIDE, _BLANK, _ODD], [1, 2, 3, 4, 5, 6], 0).astype(np.uint8)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Arrays (rows, features) over the whole texts of a string column."""
    data, at = text_buffers(column)
    for i, j in pieces(data, at):
        rows, lo = j - i, int(at[i])
        bounds = at[i : j + 1] - lo
        codes = _CODES[data[lo : int(at[j])]]
        size = np.maximum(np.diff(bounds), 1)

        def total(flag: np.ndarray, where: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
            return np.diff(sums[where])

        count = [total(codes == k, bounds) for k in range(1, 7)]
        letters = np.maximum(count[0] + count[1] + count[3] // 2, 1)
        hashes, starts, ends = words(data, at[i : j + 1])
        held = np.searchsorted(starts, at[i : j + 1])
        n = np.diff(held)
        many = np.maximum(n, 1)
        row = np.repeat(np.arange(rows), n)
        last, one = data[ends - 1] if len(ends) else data[:0], ends - starts == 1
        before = data[np.maximum(ends - 2, 0)] if len(ends) else data[:0]
        twin = np.zeros(len(hashes), bool)
        twin[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])

        def runs(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distinct values of each row and the count of its most frequent one."""
            key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            owner = (key[first] >> np.uint64(40)).astype(np.int64)
            top = np.zeros(rows, np.int64)
            np.maximum.at(top, owner, np.diff(np.append(first, len(key))))
            return np.bincount(owner, minlength=rows), top

        distinct, top = runs(hashes, row)
        made, made_at = shingles(hashes, held, 5)
        fresh, _ = runs(made, np.repeat(np.arange(rows), np.diff(made_at)))
        table = np.stack(
            [
                np.log1p(n),
                count[5] / size,
                count[0] / letters,
                count[2] / size,
                count[3] / size,
                count[4] / size,
                distinct / many**0.85,
                total(twin, held) / many,
                total(_MARK[last] & _MARK[before] & ~one, held) / many,
                total(_MARK[last] & one, held) / many,
                total(_STOP[last] & ~_MARK[before], held) / many,
                np.where(n > 0, top / many, 0),
                np.where(n > 0, fresh / np.maximum(np.diff(made_at), 1), 1),
                np.minimum(np.diff(bounds) / many, 40),
                total(data[lo : int(at[j])] == 10, bounds) / many,
            ],
            axis=1,
        )
        yield table


def _place(docs: DataFrame) -> Column:
    """Names a row by its doc_id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, place, one column for each of FEATURES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(features(batch.column(2)))
            table = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in table.T]], ["doc_id", "place", *FEATURES])

    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _place(docs).alias("place"), text.alias("text"))
    return docs.mapInArrow(run, "doc_id long, place long, " + ", ".join(f"{c} double" for c in FEATURES))


def _feature_struct(text: pa.Array) -> pa.Array:
    """The features of each text as a struct, for rows that are to keep their other columns."""
    parts = list(features(text))
    table = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
    return pa.StructArray.from_arrays([pa.array(c) for c in table.T], list(FEATURES))


@dataclass
class Model:
    """score = sigmoid(bias + weights . [z, z * z]) of features standardised and cut at +-4."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate([z, z * z], axis=1)

    def score(self, of: Callable[[str], Column] = F.col) -> Column:
        """The score as a Spark expression on the feature columns, which ``of`` gives by name."""
        total = F.lit(float(self.bias))
        k = len(FEATURES)
        for c, m, s, a, b in zip(FEATURES, self.mean, self.scale, self.weights[:k], self.weights[k:], strict=True):
            z = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (of(c) - float(m)) / float(s)))
            total = total + z * float(a) + z * z * float(b)
        return 1 / (1 + F.exp(-total))


def _descend(x: np.ndarray, gradient, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero; the last column of ``x`` is the constant."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of upper tails of a score that tells them apart.

    Above any threshold the unlabelled are at least prior times as frequent as the positives.
    """
    cuts = np.quantile(positive, np.linspace(0.02, 0.5, 25))
    tail = lambda s: np.array([(s >= c).mean() for c in cuts])
    over = tail(unlabelled) / np.maximum(tail(positive), 1e-9)
    return float(np.clip(np.min(over), 0.05, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, decay: float = 1e-3) -> Model:
    """Minimise the non-negative unbiased risk with the sigmoid loss."""
    both = np.concatenate([positive, unlabelled])
    model = Model(both.mean(0), both.std(0) + 1e-6, np.zeros(2 * len(FEATURES)), 0.0, 0.5)
    p, u = (np.column_stack([model.expand(x), np.ones(len(x))]) for x in (positive, unlabelled))
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))

    def apart(w: np.ndarray) -> np.ndarray:
        """Gradient of the logistic loss of positives against unlabelled."""
        return -(p.T @ (1 - sigmoid(p @ w))) / len(p) + u.T @ sigmoid(u @ w) / len(u) + decay * w

    first = _descend(p, apart, steps // 2)
    model.prior = prior = class_prior(p @ first, u @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        dp, du = sp * (1 - sp), su * (1 - su)
        # losses: 1 - s for label 1, s for label 0
        plus = -prior * (p.T @ dp) / len(p)
        minus = u.T @ du / len(u) - prior * (p.T @ dp) / len(p)
        if su.mean() - prior * sp.mean() < 0:  # the risk of the negatives fell below zero: step back up
            return -minus + decay * w
        return plus + minus + decay * w

    w = _descend(p, risk, steps)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, the same ones whatever the partitions: those whose hashed doc_id is low."""
    n = rows.count()
    share = min(1.0, most / max(1, n))
    return rows.where(F.xxhash64(F.lit(17), "doc_id") < F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else rows


def held_out(modulus: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest


def score_quality(docs: DataFrame, labels: DataFrame, trusted: Column | None = None, most: int = 20_000) -> DataFrame:
    """(doc_id, place, score): how likely the whole text of each row of ``docs`` is of quality 1; place is a hash of doc_id and text.

    ``labels`` (doc_id, quality): only rows of quality 1 (and for which ``trusted`` holds) are used,
    as trusted positives; the unlabelled sample comes from ``docs`` and the class prior is
    estimated. Both samples are bounded by ``most`` rows (a documented bound of the fit alone).
    Inputs of the score are counts over the text only.

    Defined cases: null, empty and blank texts have the features of an empty text; without any
    positive or any text the score is 0.5; a null doc_id is scored but never used to fit; repeated
    rows are each scored; other columns are ignored; an empty table gives an empty table.
    """
    table = keep(feature_table(docs))
    good = trusted_ids(labels, trusted)
    model = fit(table.join(_sample(good, most), "doc_id", "left_semi"), _sample(table.where("doc_id is not null"), most))
    return table.select("doc_id", "place", (F.lit(0.5) if model is None else model.score()).alias("score"))


def trusted_ids(labels: DataFrame, trusted: Column | None = None) -> DataFrame:
    """(doc_id) of the rows of ``labels`` of quality 1 for which ``trusted`` holds."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality = 1 and doc_id is not null")
    return (good.where(trusted) if trusted is not None else good).select("doc_id").distinct()


def fit(positive: DataFrame, unlabelled: DataFrame) -> Model | None:
    """The model of two samples of feature rows; none if one of them is empty."""
    p, u = (df.select(*FEATURES).toPandas().to_numpy(np.float64) for df in (positive, unlabelled))
    return train(p, u) if len(p) and len(u) else None


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of rows with crc32(doc_id) mod 3 = 1 are never used."""
    scored = score_quality(docs, labels, ~held_out(3, 1))
    return scored.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores under ``threshold``; all columns as they were.

    Each row is judged by its own text, also where rows share a doc_id or have none; null and empty texts are scored as in
    :func:`score_quality`; an empty table stays empty. Rows are scored where they are, so texts are never shuffled: only the
    samples of the fit are read before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    most = 20_000
    good = F.broadcast(_sample(trusted_ids(labels, ~held_out(3, 1)), most))  # bounded by ``most``
    with small_batches(docs.sparkSession):
        model = fit(feature_table(rows.join(good, "doc_id", "left_semi")), feature_table(_sample(rows.where("doc_id is not null"), most)))
    if model is None:
        return docs.where(F.lit(0.5 >= threshold))
    struct = F.arrow_udf(_feature_struct, "struct<" + ",".join(f"{c}:double" for c in FEATURES) + ">")
    found = struct(F.col("text").cast("string"))
    return docs.where(model.score(lambda c: found[c]) >= threshold)
