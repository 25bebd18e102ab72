"""Reading record reports: column mapping, coercion, ids, import validation, unions, and the versioned knowledge base on disk."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.graph import numbered
from kbspark.functions.text import placeholder_to_null


def resolve(headers: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Canonical field to header: fields in declared order each take their first alias that no earlier field took."""
    key = lambda h: re.sub(r"\s+", " ", h).strip().lower()
    free = {key(h): h for h in reversed(headers)}
    out = {}
    for field, names in aliases.items():
        for n in names:
            if key(n) in free:
                out[field] = free.pop(key(n))
                break
    return out


def map_columns(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical columns (null where a field has no header) and all other headers in one map column, extra."""
    got = resolve(rows.columns, aliases)
    rest = [c for c in rows.columns if c not in got.values()]
    extra = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(f"`{c}`").cast("string") for c in rest])) if rest else F.create_map().cast("map<string,string>")
    return rows.select(*[F.col(f"`{got[f]}`").alias(f) if f in got else F.lit(None).cast("string").alias(f) for f in aliases], extra.alias("extra"))


def schema_report(rows: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """name, header, finding, filled: fields with their header (mapped, or missing_required, missing_optional without one) and headers that map to nothing (unmapped), each with how many rows hold a value that is neither blank nor a placeholder. One pass counts all headers."""
    got = resolve(rows.columns, aliases)
    found = [(f, got.get(f), "mapped" if f in got else "missing_required" if f in required else "missing_optional") for f in aliases]
    found += [(h, h, "unmapped") for h in rows.columns if h not in got.values()]
    value = lambda h: placeholder_to_null(F.col(f"`{h}`").cast("string"))
    counts = rows.agg(*[F.count_if(F.coalesce(F.trim(value(h)), F.lit("")) != "").alias(f"_{i}") for i, (_, h, _) in enumerate(found) if h])
    made = [F.struct(F.lit(n).alias("name"), F.lit(h).cast("string").alias("header"), F.lit(w).alias("finding"), (F.col(f"_{i}") if h else F.lit(0)).cast("bigint").alias("filled")) for i, (n, h, w) in enumerate(found)]
    return counts.select(F.explode(F.array(*made)).alias("x")).select("x.*")


def record_id(prefix: Column, number: Column, sheet: Column, row: Column) -> Column:
    """prefix-number, or ROW-sheet-row where either is blank."""
    p, n = F.nullif(F.trim(prefix), F.lit("")), F.nullif(F.trim(number), F.lit(""))
    return F.coalesce(F.when(p.isNotNull() & n.isNotNull(), F.concat_ws("-", p, n)), F.concat(F.lit("ROW-"), sheet, F.lit("-"), row.cast("string")))


def blank_row(columns: list[str]) -> Column:
    """Whether all cells are null, blank or a placeholder."""
    out = F.lit(True)
    for c in columns:
        v = placeholder_to_null(F.col(c).cast("string"))
        out = out & (v.isNull() | (F.trim(v) == ""))
    return out


def input_report(rows: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """total, empty, built and fallback counts."""
    return rows.agg(F.count("*").alias("total"), F.count_if(blank_row(columns)).alias("empty"), F.count_if(~blank_row(columns)).alias("built"), F.count_if(~blank_row(columns) & F.col(id_column).startswith("ROW-")).alias("fallback"))


def union_reports(reports: dict[str, DataFrame], order: str) -> tuple[DataFrame, DataFrame]:
    """All rows under the union of headers, with report and row number, and a manifest of each report's rows."""
    out = None
    for name, df in reports.items():
        one = df.withColumn("report", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    # numbered in one order over all reports, less the rows of the reports before
    place = numbered(out, [F.col("report"), F.col(order)], "_place")
    first = place.groupBy("report").agg(F.min("_place").alias("_first"))  # a row per report
    out = place.join(F.broadcast(first), "report").withColumn("row", F.col("_place") - F.col("_first") + 1).drop("_place", "_first")
    return out, out.groupBy("report").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("row_count"))


def preview(rows: DataFrame, columns: list[str], order: str, limit: int = 10, most: int = 2000) -> DataFrame:
    """The first rows that are not empty, cells cut, with a flag whether any was."""
    cut = F.lit(False)
    for c in columns:
        cut = cut | (F.char_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) > most)
    return rows.where(~blank_row(columns)).orderBy(order).limit(limit).select(order, *[F.substring(F.col(c).cast("string"), 1, most).alias(c) for c in columns if c != order], cut.alias("truncated"))


def validate_import(rows: DataFrame, keys: list[str], order: str, stored: DataFrame | None = None) -> DataFrame:
    """Add issue: missing key, duplicate in the file (the first stays), exists already, or null for rows that may be stored."""
    from pyspark.sql import Window

    folded = [F.upper(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys]
    x = rows.withColumn("_key", F.concat_ws("\0", *folded))
    missing = F.lit(False)
    for f in folded:
        missing = missing | (f == "")
    x = x.withColumn("_missing", missing).withColumn("_n", F.row_number().over(Window.partitionBy("_missing", "_key").orderBy(order)))
    issue = F.when(F.col("_missing"), "missing").when(F.col("_n") > 1, "duplicate")
    if stored is not None:
        s = stored.select(F.concat_ws("\0", *[F.upper(F.trim(F.col(k).cast("string"))) for k in keys]).alias("_key"), F.lit(True).alias("_stored")).distinct()
        x = x.join(s, "_key", "left")
        issue = F.when(F.col("_missing"), "missing").when(F.col("_stored"), "exists").when(F.col("_n") > 1, "duplicate")
    return x.withColumn("issue", issue).drop("_key", "_missing", "_n", "_stored")


def accept(rows: DataFrame, text: str = "text", title: str = "title", sentinel: str = "error:", judged: str | None = None) -> DataFrame:
    """Rows with content that is no error note; a title stays unless it is blank or a placeholder. judged: another column whose content decides."""
    own = placeholder_to_null(F.nullif(F.trim(F.col(title)), F.lit("")))
    # white space as SQL has it: runs of ASCII blanks (no vertical tab) are one, and any blank goes from the ends
    line = F.regexp_replace(F.regexp_replace(F.col(text), r"[ \t\n\f\r]+", " "), r"^\p{Zs}+|\p{Zs}+$", "")
    content = F.col(judged or text)
    ok = (F.trim(F.coalesce(content, F.lit(""))) != "") & ~F.lower(F.ltrim(content)).startswith(sentinel)
    return rows.where(ok).withColumn(title, F.coalesce(own, F.substring(line, 1, 40)))


def replace_chunks(old: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """Chunks after a rewrite: those of rewritten sources are replaced, so writing twice changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def integrity(tables: dict[str, DataFrame], foreign: list[tuple[str, str, str, str]], counts: dict[str, int] | None = None) -> DataFrame:
    """check, violations: rows whose reference leads nowhere, and tables whose count is not as expected."""
    out = None
    for child, column, parent, key in foreign:
        c = tables[child].where(F.col(column).isNotNull())
        bad = c.join(tables[parent].select(F.col(key).alias("_k")).hint("merge"), F.col(column) == F.col("_k"), "left_anti").agg(F.count("*").alias("violations")).select(F.lit(f"{child}.{column}").alias("check"), "violations")
        out = bad if out is None else out.unionByName(bad)
    for name, n in (counts or {}).items():
        one = tables[name].agg((F.abs(F.count("*") - F.lit(n))).cast("bigint").alias("violations")).select(F.lit(f"{name} rows").alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


class Conflict(RuntimeError):
    """Another writer has published since the version that a writer started from."""


class KnowledgeBase:
    """Tables of one version in a folder; numbered pointer files name the versions, and readers see the one of the highest number.

    A version is written beside the others and checked before its pointer is
    made, so readers see the old one or the new one, whole. A pointer's number
    is one above the version that its writer started from, and the file system
    makes a file of one name for one writer only: of two writers that start
    from the same version the second to publish gets a Conflict, and its tables
    are never seen.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def number(self) -> int:
        """The current version's number, 0 before the first."""
        path, fs = self._path("versions")
        if not fs.exists(path):
            return 0
        # a pointer that its writer has not filled yet does not count
        return max((int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit() and x.getLen() > 0), default=0)

    def write(self, tables: dict[str, DataFrame], foreign: list[tuple[str, str, str, str]] = (), base: int | None = None) -> str:
        """Stage, check and publish a version; base is the number it started from, the current one if none is given."""
        base = self.number() if base is None else base
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.folder}/{version}/{name}")
        stored = {n: self.spark.read.parquet(f"{self.folder}/{version}/{n}") for n in tables}
        if foreign and integrity(stored, list(foreign)).where("violations > 0").limit(1).count():
            raise ValueError("a reference leads nowhere; the version is not published")
        path, fs = self._path(f"versions/{base + 1:09d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise Conflict(f"version {base + 1} was published by another writer") from e
            raise
        out.write(bytearray(version.encode()))
        out.close()
        return version

    def current(self) -> str:
        number = self.number()
        if not number:
            raise LookupError("nothing is published yet")
        return self.spark.read.text(f"{self.folder}/versions/{number:09d}").first()["value"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.current()}/{name}")
