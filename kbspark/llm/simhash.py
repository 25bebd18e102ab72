"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Fingerprints at three
or fewer differing bits differ by at most one bit in one of the segments, so
each fingerprint looks up, per segment, its own value and the 32 values at one
bit's distance in a table of all fingerprints by segment; the full distance of
what is found is then verified. Work and rows are a fixed multiple of the
distinct fingerprints; equal fingerprints are one entry however many texts
have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import connected_components, materialize

SEED = 42
SHINGLE = 3
BITS = 32
MAX_DISTANCE = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer.

    A-Z are lower-cased, words are runs without ASCII white space; every run of
    `shingle` words, repeats included, gives one XXH64 (the whole sequence if
    there are fewer words). A bit is set if it is set in over half of the
    hashes; without words, and for null, the fingerprint is zero.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[-n:])), dtype="<u8", count=n)
    set_bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "simhash") -> DataFrame:
    """Add the fingerprint of every whole text as a long; the column is replaced if it exists."""
    df = docs.drop(to)
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema] + [f"{to} bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(x.as_py()) for x in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, to])

    return df.mapInArrow(run, schema)


def _segments(x: Column) -> tuple[Column, Column]:
    """Both halves, each in a key space of its own."""
    low = F.lit((1 << BITS) - 1)
    return F.shiftrightunsigned(x, BITS), x.bitwiseAND(low) + F.lit(1 << BITS)


def linked_fingerprints(fps: DataFrame, column: str = "simhash") -> DataFrame:
    """Pairs a < b of distinct fingerprints at MAX_DISTANCE or fewer differing bits. fps holds each value once, without nulls."""
    a = F.col(column)
    table = fps.select(a.alias("b"), F.explode(F.array(*_segments(a))).alias("key"))
    near = [0, *(1 << i for i in range(BITS))]
    probes = fps.select(a.alias("a"), F.explode(F.array(*(s.bitwiseXOR(F.lit(d)) for s in _segments(a) for d in near))).alias("key"))
    return probes.join(table, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links, itself included) of every row.

    Rows without words share the fingerprint zero and are linked like others.
    A null doc_id never names a component unless all its rows lack one; rows
    that repeat are returned as often as they occur; other columns are not read.
    """
    own = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "simhash"), "simhash")
    classes = component_of_fingerprint(own)
    return own.join(classes, "simhash").select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def component_of_fingerprint(own: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """simhash and component_id for each distinct fingerprint of a table of (doc_id, simhash)."""
    fps = own.groupBy("simhash").agg(F.min(doc_id).alias("least"))
    parts = connected_components(linked_fingerprints(fps.select("simhash")), "simhash-links")
    named = materialize(fps.join(parts.withColumnRenamed("id", "simhash"), "simhash", "left").select("simhash", "least", "component"), "simhash-classes")
    linked = named.where("component is not null")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    return linked.join(least, "component").select("simhash", "component_id").unionByName(named.where("component is null").select("simhash", F.col("least").alias("component_id")))


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, with one row of each component left: the one of smallest doc_id (nulls last), of equal ones the first written.

    Rows are numbered once in a written table, so that repeated rows are told apart.
    """
    whole = materialize(with_fingerprint(docs, text, "_simhash").withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    own = whole.select(F.col(doc_id).alias("doc_id"), F.col("_simhash").alias("simhash"), "_row")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    first = own.groupBy("simhash").agg(F.min(rank).alias("rank"))
    links = connected_components(linked_fingerprints(first.select("simhash")), "simhash-links")
    stays = first.join(links.withColumnRenamed("id", "simhash"), "simhash", "left").groupBy(F.coalesce("component", "simhash")).agg(F.min("rank").alias("rank")).select(F.col("rank._row").alias("_row"))
    return whole.join(stays, "_row", "left_semi").drop("_row", "_simhash")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_simhash": op2_simhash}
SQL: dict[str, str] = {}
