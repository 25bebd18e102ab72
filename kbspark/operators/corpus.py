"""Corpus bookkeeping: edges, counts, listings, upserts and cascades, all as joins and aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(spec: str, allowed: list[str]) -> list[Column]:
    """Columns for orderBy from a text like "created desc, id"; anything but known names and directions is refused."""
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*([A-Za-z_][A-Za-z0-9_]*)(?:\s+(asc|desc))?\s*", part, re.I)
        if not m or m[1] not in allowed:
            raise ValueError(f"cannot order by {part.strip()!r}")
        out.append(F.desc(m[1]) if (m[2] or "").lower() == "desc" else F.asc(m[1]))
    return out


def linked(edges: DataFrame, entities: DataFrame, edge_key: str, key: str = "id") -> DataFrame:
    """Entities at the other end of the edges, with the edge's columns."""
    return edges.join(entities, F.col(edge_key) == F.col(key)).drop(key if key != edge_key else "_none")


def with_count(entities: DataFrame, children: DataFrame, parent: str, to: str, key: str = "id") -> DataFrame:
    """Add the number of children, zero where there are none."""
    n = children.groupBy(F.col(parent).alias("_parent")).agg(F.count("*").alias("_n"))
    return entities.join(n, F.col(key) == F.col("_parent"), "left").withColumn(to, F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_parent", "_n")


def with_status(rows: DataFrame, jobs: DataFrame, key: str, missing: str = "unknown") -> DataFrame:
    """Add the status of a referenced job; a reference that leads nowhere is `missing`, no reference is null."""
    j = jobs.select(F.col("job_id").alias("_job"), F.col("status").alias("_status"))
    return rows.join(j, F.col(key) == F.col("_job"), "left").withColumn("status", F.when(F.col(key).isNull(), None).otherwise(F.coalesce("_status", F.lit(missing)))).drop("_job", "_status")


def with_children(entities: DataFrame, children: DataFrame, parent: str, fields: list[str], to: str, key: str = "id") -> DataFrame:
    """Add an ordered list of child structs, empty where there are none."""
    c = children.groupBy(F.col(parent).alias("_parent")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(to))
    kind = c.schema[to].dataType
    return entities.join(c, F.col(key) == F.col("_parent"), "left").withColumn(to, F.coalesce(to, F.array().cast(kind))).drop("_parent")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Patch rows by key: new values where given, old ones elsewhere, new keys added."""
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    j = old.join(n, F.col(key) == F.col("_key"), "full_outer")
    return j.select(*[F.coalesce("_key", key).alias(key) if c == key else (F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c)) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of new whose key is not stored yet, the first of each key."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(old.select(*keys).distinct(), keys, "left_anti")


def keep_first(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """Rows with `duplicate`: whether an earlier row has the same key."""
    return rows.withColumn("_key", key).withColumn("duplicate", F.row_number().over(Window.partitionBy("_key").orderBy(*order)) > 1).drop("_key")


def backfill(rows: DataFrame, lookup: DataFrame, name: str, to: str) -> DataFrame:
    """Set `to` from a match by name in a table of (name, value) where it is missing."""
    m = lookup.select(F.col("name").alias("_name"), F.col("value").alias("_value"))
    return rows.join(m, F.col(name) == F.col("_name"), "left").withColumn(to, F.coalesce(to, "_value") if to in rows.columns else F.col("_value")).drop("_name", "_value")


def strip_prefix(c: Column, roots: list[str]) -> Column:
    """Cut the first of the known roots that matches, once."""
    out = c
    for r in reversed(roots):
        out = F.when(c.startswith(r), F.substring(c, len(r) + 1, 1 << 30)).otherwise(out)
    return out


def without_orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_semi")


def cascade(children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str = "id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Child tables without rows of the deleted parents, and how many rows of each go."""
    k = gone.select(F.col(key).alias("_gone")).distinct()
    left = {n: df.join(k, F.col(c) == F.col("_gone"), "left_anti") for n, (df, c) in children.items()}
    counts = None
    for n, (df, c) in children.items():
        one = df.join(k, F.col(c) == F.col("_gone"), "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(n).alias("table"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return left, counts


def exclusive_sources(edges: DataFrame, notebook: Column) -> DataFrame:
    """Per notebook how many of its sources no other notebook has, and how many are shared."""
    n = edges.groupBy("source_id").agg(F.count_distinct("notebook_id").alias("_n"))
    return edges.distinct().join(n, "source_id").groupBy(notebook.alias("notebook_id")).agg(F.count_if(F.col("_n") == 1).alias("exclusive"), F.count_if(F.col("_n") > 1).alias("shared"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def progress(processed: Column, total: Column, status: Column) -> Column:
    """Percent to one decimal; completed is 100, an unknown total is null."""
    return F.when(status == "completed", F.lit(100.0)).when(total > 0, F.round(processed * 100.0 / total, 1))


def stale(jobs: DataFrame, as_of: Column, lease: int = 1800) -> DataFrame:
    """Status of each job from its log (job_id, ts, status): running without activity for `lease` seconds is failed; new jobs and jobs without a time stay."""
    last = jobs.groupBy("job_id").agg(F.max("ts").alias("last_ts"), F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    quiet = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) > lease * 1_000_000
    return last.select("job_id", F.when((F.col("status") == "running") & quiet, "failed").otherwise(F.col("status")).alias("status"), ((F.col("status") == "running") & F.coalesce(quiet, F.lit(False))).alias("flipped"))
