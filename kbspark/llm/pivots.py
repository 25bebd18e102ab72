"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its PREFIX nearest reference points (pivots), in
order. An inverted list per pivot holds the vectors that name it. Two vectors
are candidates if they share SHARED pivots or more, and are then compared in
double precision. A pair is looked at in the list of the first pivot they
share by number, so once. What leaves a list is linear in it: per vector the
number of links found there and one link to a smaller member of its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import connected_components, materialize

THRESHOLD = 0.9
PREFIX = 8
SHARED = 1

#: Pivots: one for every LIST distinct vectors, within these bounds (at most so many are broadcast).
LIST = 8
LEAST_PIVOTS, MOST_PIVOTS = 64, 16_384

#: Largest cosine between two pivots.
APART = 0.7

#: Members of a list that one task compares with as many others; longer lists are dealt out in pairs of such blocks.
BLOCK = 2_048


def nearest(units: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    sims = units @ pivots.T
    k = min(prefix, len(pivots))
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(-sims, part, axis=1), axis=1, kind="stable"), axis=1)


def spread(points: np.ndarray, apart: float) -> np.ndarray:
    """Greedy thinning: keep each point whose cosine with all kept before is below `apart`.

    Else a crowd of near vectors would hold many pivots, and its members would name different ones.
    """
    kept = np.zeros((0, points.shape[1]))
    for lo in range(0, len(points), 256):
        some = points[lo : lo + 256]
        some = some[(some @ kept.T).max(axis=1, initial=-1) < apart]
        close = some @ some.T >= apart
        chosen: list[int] = []
        for i in range(len(some)):
            if not close[i, chosen].any():
                chosen.append(i)
        kept = np.concatenate([kept, some[chosen]])
    return kept


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's class under the links a - b."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def link(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    Vectors of different lengths never link. Equal vectors are one entry of
    the index and link with each other by that (cosine 1). Vectors that are
    null, zero or hold a null or a non-finite component have no links. A null
    vec_id counts as a partner, but names no component while another is there.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    fit = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    peak = F.array_max(F.transform("e", F.abs))
    rows = rows.withColumn("peak", F.when(fit, peak)).withColumn("e", F.when(F.col("peak") > 0, F.transform("e", lambda x: x / F.col("peak"))))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", norm).select("vec_id", F.transform("e", lambda x: x / F.col("norm")).alias("unit"))
    # equal directions have one key; it is a digest of the rounded components, so only copies share it
    rows = materialize(rows.withColumn("key", F.when(F.col("unit").isNotNull(), F.sha2(F.to_json("unit"), 256))), "pivot-vectors")
    entries = rows.where("key is not null").groupBy("key").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    entries = materialize(entries.withColumn("entry", F.monotonically_increasing_id()), "pivot-entries")
    n = entries.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, n // LIST))
    # pivots: a bounded draw by key, per length of vector
    drawn = entries.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < 1_000_000 * min(1.0, 1.2 * wanted / max(1, n))).orderBy("key").limit(wanted).select("unit").collect()
    pivots: dict[int, np.ndarray] = {}
    for size in {len(r.unit) for r in drawn}:
        pivots[size] = spread(np.array([r.unit for r in drawn if len(r.unit) == size]), APART)
    shared = spark.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit").to_pylist()
            for size in sorted({len(u) for u in units}):
                at = [i for i, u in enumerate(units) if len(u) == size]
                own = shared.value.get(size)
                for lo in range(0, len(at), 1000):
                    some = at[lo : lo + 1000]
                    x = np.array([units[i] for i in some])
                    # lengths that no pivot has share one list
                    near = nearest(x, own, PREFIX) if own is not None else np.zeros((len(some), 1), np.int64)
                    which = np.repeat(np.arange(len(some)), near.shape[1])
                    taken = pa.array([some[i] for i in which])
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64) + (size << 32)), batch.column("entry").take(taken), pa.array(list(np.sort(near, axis=1).astype(np.int32)[which]), pa.list_(pa.int32()))], names=["pivot", "entry", "near"])

    lists = materialize(entries.select("entry", "unit").mapInArrow(describe, "pivot bigint, entry bigint, near array<int>"), "pivot-lists")
    length = lists.groupBy("pivot").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = lists.join(length, "pivot").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
    # a block meets every block of its list once, itself included
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y")))
    dealt = placed.select("pivot", "block", "entry", "near", F.explode(meets).alias("m")).join(entries.select("entry", "unit", "copies"), "entry").select("pivot", "m.x", "m.y", "block", "entry", "near", "unit", "copies")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None

        def done() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            entry = np.array([r[1] for r in held])
            order = np.argsort(entry)
            entry = entry[order]
            block = np.array([r[0] for r in held])[order]
            near = np.array([held[i][2] for i in order])
            unit = np.array([held[i][3] for i in order])
            copies = np.array([held[i][4] for i in order], np.int64)
            pivot = key[0] & 0xFFFFFFFF
            links, found = np.zeros(len(entry), np.int64), [[], []]
            for lo in range(0, len(entry), 512):
                cos = unit[lo : lo + 512] @ unit.T
                i, j = np.nonzero(cos >= threshold - 1e-9)
                i += lo
                keep = i < j
                if key[1] != key[2]:
                    keep &= block[i] != block[j]
                i, j = i[keep], j[keep]
                exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[exact], j[exact]
                same = (near[i][:, :, None] == near[j][:, None, :]).any(2) if len(i) else np.zeros((0, near.shape[1]), bool)
                first = np.where(same, near[i], 1 << 40).min(axis=1) if len(i) else np.zeros(0)
                keep = (same.sum(1) >= SHARED) & (first == pivot)
                i, j = i[keep], j[keep]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                found[0].append(i)
                found[1].append(j)
            root = _local_roots(len(entry), np.concatenate(found[0]), np.concatenate(found[1]))
            out = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(entry[out]), pa.array(entry[root[out]]), pa.array(links[out])], names=["entry", "root", "links"])

        for batch in batches:
            for pivot, x, y, *rest in zip(*(batch.column(c).to_pylist() for c in ("pivot", "x", "y", "block", "entry", "near", "unit", "copies"))):
                if (pivot, x, y) != key:
                    if (out := done()) is not None:
                        yield out
                    held, key = [], (pivot, x, y)
                held.append(rest)
        if (out := done()) is not None:
            yield out

    found = materialize(dealt.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y").mapInArrow(compare, "entry bigint, root bigint, links bigint"), "pivot-links")
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("entry").alias("a"), F.col("root").alias("b")), "pivot-components")
    named = entries.select("key", "entry", "copies", "least").join(links, "entry", "left").join(classes.withColumnRenamed("id", "entry"), "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_key = named.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(per_key, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_pivots(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_pivots": op7_pivots}
SQL: dict[str, str] = {}
