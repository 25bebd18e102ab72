"""Lineage cuts, row numbers and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset, and gets a temporary one."""
    got = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, where later steps read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column], to: str) -> DataFrame:
    """Add the place of each row in an order as a long, from 1. Rows are dealt by ranges of the order and numbered within them; only the sizes of the partitions meet in one place."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged.withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1), "numbered")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").withColumn(to, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, root of every node: the smallest id it is linked to. nodes: id; edges: a, b.

    Smallest labels travel along the edges and then along the labels
    themselves, so paths halve each round; it ends when nothing changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = written(nodes.select("id", F.col("id").alias("root")))
    for _ in range(rounds):
        low = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("low"))
        step = label.join(low, F.col("id") == F.col("a"), "left").select("id", "root", F.least("root", F.coalesce("low", "root")).alias("next"))
        jump = step.select(F.col("id").alias("k"), F.col("next").alias("beyond"))
        moved = written(step.join(jump, F.col("next") == F.col("k"), "left").select("id", F.col("root").alias("was"), F.least("next", F.coalesce("beyond", "next")).alias("root")))
        label = moved.select("id", "root")
        if moved.where("was <> root").limit(1).count() == 0:
            return label
    raise RuntimeError(f"no fixed point after {rounds} rounds")
