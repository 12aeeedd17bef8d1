"""Verified links between the sets of candidate buckets, and connected components.

No step emits the pairs of a bucket. Each bucket first compares its members with one centre, and components
follow. Members of a bucket that are then in different components are compared in blocks inside tasks: first on
bitmaps and sizes, which leaves those that may have a partner, then on their whole sets; what leaves a task is a spanning
forest of its links. So whatever link exists inside a bucket ends up inside one component, and a bucket of n members gives at
most n rows for each block of members, whatever the number of its links.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, keep


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); the component is its smallest id.

    Large-star and small-star rounds on DataFrames: each round is two aggregations and two joins,
    the number of edges never grows, and only a count and a checksum reach the driver.
    """
    edges = keep(_distinct_edges(edges))
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(edges)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def shared(left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> np.ndarray:
    """Common elements of each two sets, as a product of 0-1 matrices over the elements that two or more sets have."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    if not n.sum() or not m.sum():
        return np.zeros((len(n), len(m)), np.float32)
    values, place, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    out = []
    for sizes, own in ((n, column[: n.sum()]), (m, column[n.sum() :])):
        matrix = np.zeros((len(sizes), int((times > 1).sum())), np.float32)
        matrix[np.repeat(np.arange(len(sizes)), sizes)[own >= 0], own[own >= 0]] = 1
        out.append(matrix)
    return out[0] @ out[1].T


def similar(left: Sequence[np.ndarray], right: Sequence[np.ndarray], threshold: int) -> np.ndarray:
    """Which sets of ``left`` and ``right`` have a Jaccard similarity of ``threshold`` % or more."""
    both = shared(left, right)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return (100 * both >= threshold * (total - both)) & (both > 0)


def forest(x: np.ndarray, y: np.ndarray, linked: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, number of links, root) of the ids ``x`` and ``y``, of which ``linked`` says which have links; root is one name for each component.

    same: y is x, and ``linked`` holds each link twice.
    """
    ids = x if same else np.concatenate([x, y])
    at_x, at_y = np.arange(len(x)), np.arange(len(y)) + (0 if same else len(x))
    label = np.arange(len(ids))
    while True:
        before = label
        label = label.copy()
        label[at_x] = np.minimum(label[at_x], np.where(linked, before[at_y][None, :], len(ids)).min(axis=1, initial=len(ids)))
        label[at_y] = np.minimum(label[at_y], np.where(linked, label[at_x][:, None], len(ids)).min(axis=0, initial=len(ids)))
        label = label[label]
        if (label == before).all():
            break
    links = linked.sum(axis=1) if same else np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
    return ids, links, ids[label]


def _dealt(rows: DataFrame, stranger: Column, weight: Column, limit: int) -> DataFrame:
    """``rows`` (bucket, ...) with i, j and side: block i of a bucket's strangers (side 0) meets block j of all its members (side 1), each of about ``limit`` weight."""
    sizes = rows.groupBy("bucket").agg(*[F.greatest(F.lit(1), F.ceil(F.sum(x) / limit)).cast("int").alias(c) for c, x in (("left", F.when(stranger, weight)), ("right", weight))])
    sizes = sizes.where("left is not null")
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_left = F.when(stranger, F.transform(upto("right"), lambda j: F.struct(own("left").alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    as_right = F.transform(upto("left"), lambda i: F.struct(i.alias("i"), own("right").alias("j"), F.lit(1).alias("side")))
    places = F.concat(F.coalesce(as_left, F.array().cast("array<struct<i:int,j:int,side:int>>")), as_right)
    return rows.join(sizes, "bucket").withColumn("at", F.explode(places)).select(*rows.columns, "at.*")


def _possible(pdf: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """(bucket, id, label, core) of the rows of two blocks that have a possible partner of another label in the other block."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    maps = [np.stack([*x["bitmap"], np.zeros(len(pdf["bitmap"].iloc[0]), np.int64)])[:-1].view(np.uint64) for x in (left, right)]
    (n, u, label), (m, v, other) = ([x[c].to_numpy() for c in ("n", "u", "label")] for x in (left, right))
    hit_left, hit_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for k in range(0, len(left), 64):
        s = slice(k, k + 64)
        total = n[s, None] + m[None, :]
        ok = label[s, None] != other[None, :]
        ok &= 100 * np.minimum((n - u)[s, None], (m - v)[None, :]) >= threshold * np.maximum(n[s, None] + v[None, :], m[None, :] + u[s, None])
        apart = total - 2 * -(-threshold * total // (100 + threshold))
        a, b = np.nonzero(ok)
        near = np.bitwise_count(maps[0][a + k] ^ maps[1][b]).sum(axis=1) <= apart[a, b]
        hit_left[a[near] + k] = True
        hit_right[b[near]] = True
    return pd.concat([left[hit_left], right[hit_right]])[["bucket", "id", "label", "core"]]


def connect(members: DataFrame, sets: DataFrame, threshold: int, block: int = 2048, elements: int = 65_536, little: int = 24) -> DataFrame:
    """Components (id, component) of ``members`` (bucket, id, n, u, bitmap), of which ``sets`` (id, shingles) has the sets.

    Two members of a bucket are linked if their sets have a Jaccard similarity of ``threshold`` % or more. n is a set's size,
    u how many of its elements no other set has, bitmap an exclusive or of one bit for each element. The member with the least share
    u / n is its bucket's centre. block and elements bound what a task compares at once: members by bitmaps, elements of whole sets. Buckets of at most ``little``
    members are compared on bitmaps by a join instead.
    """
    features = ("n", "u", "bitmap")
    centres = members.groupBy("bucket").agg(F.min_by(F.struct("id", *features), F.struct(F.col("u") / F.col("n"), F.col("id"))).alias("c"), F.count("*").alias("size"), F.min("u").alias("low"))
    centres = keep(centres.where("size > 1"))
    ours = members.join(centres.select("bucket", "c", "low", "size"), "bucket").where(100 * (F.col("n") - F.col("u")) >= threshold * (F.col("n") + F.col("low")))
    width = len(members.select("bitmap").head(1)[0][0]) if members.head(1) else 0

    def possible(x, y) -> Column:
        n, m, u, v = x("n"), y("n"), x("u"), y("u")
        apart = sum((F.bit_count(F.get(x("bitmap"), F.lit(k)).bitwiseXOR(F.get(y("bitmap"), F.lit(k)))) for k in range(width)), F.lit(0))
        return (100 * F.least(n - u, m - v) >= threshold * F.greatest(n + v, m + u)) & (apart <= n + m - 2 * F.ceil(threshold * (n + m) / F.lit(100 + threshold)))

    close = (F.col("id") != F.col("c.id")) & possible(F.col, lambda c: F.col(f"c.{c}"))
    ours = keep(ours.select("bucket", "id", *features, "size", F.col("c.id").alias("centre"), close.alias("close")))
    discard(centres)

    star = ours.where("close").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    both = star.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = keep(both.where(100 * common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    found = keep(components(links))

    labelled = ours.select("bucket", "id", *features, "size", "centre").join(found, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    labelled = labelled.join(found.select(F.col("id").alias("centre"), F.col("component").alias("core")), "centre", "left")
    labelled = labelled.withColumn("core", F.coalesce("core", "centre"))
    mixed = keep(labelled.join(labelled.where("label <> core").select("bucket").distinct(), "bucket", "left_semi").select("bucket", "id", "label", "core", "size", *features))
    discard(ours)
    stranger = F.col("label") != F.col("core")
    dealt = _dealt(mixed.where(F.col("size") > little).drop("size"), stranger, F.lit(1), block)
    large = dealt.groupBy("bucket", "i", "j").applyInPandas(lambda pdf: _possible(pdf, threshold), "bucket long, id long, label long, core long")
    few = mixed.where(F.col("size") <= little)
    met = few.where(stranger).alias("x").join(few.alias("y"), "bucket").where((F.col("x.label") != F.col("y.label")) & possible(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
    small = met.select("bucket", F.explode(F.array(*[F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("id", "label", "core")]) for s in "xy"])).alias("m")).select("bucket", "m.*")
    maybe = keep(large.unionByName(small).distinct())
    discard(mixed)
    whole = _dealt(maybe.join(sets.select("id", F.size("shingles").alias("n")), "id"), stranger, F.col("n"), elements)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        linked = similar(left["shingles"], right["shingles"], threshold) & (left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :])
        ids, links, root = forest(x, y, linked)
        return pd.DataFrame({"a": ids, "b": root})[(links > 0) & (ids != root)]

    more = keep(whole.join(sets, "id").groupBy("bucket", "i", "j").applyInPandas(verify, "a long, b long").distinct())
    discard(maybe)
    if more.isEmpty():
        return found
    return keep(components(links.unionByName(more)))
