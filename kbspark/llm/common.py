"""What the operators share: scratch tables, tables' sizes, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts of the operators have it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and leave every other character."""
    return F.translate(c, _UPPER, _UPPER.lower())


#: The same for Python strings, as str.translate wants it.
LOWER_ASCII = {ord(x): x.lower() for x in _UPPER}


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset, and gets a temporary one, the same for the whole session."""
    got = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return got.rstrip("/")


def materialize(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts the lineage and survives lost executors. rows: how many a file may hold, where rows are large."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, total: int, each: int, least: int = 1) -> int:
    """How many partitions of about `each` units `total` units make, at least as many as the session's shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each))


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that occurs in an edge.

    edges: columns a, b of one orderable type; loops and repeats are allowed,
    rows with a null end are ignored. Returns columns id, component.

    Alternates the large-star and small-star steps on edges alone, so no step
    holds a node's neighbours together: each takes a minimum per node, which
    is combined before the shuffle, and joins it back. Each pair of steps is
    written to the shared folder; it ends when a pair changes nothing.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, name)
    before = None
    for _ in range(max_rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        e = materialize(small, name)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
