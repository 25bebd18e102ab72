"""Preparing and validating batches for language models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import digest_id, word_estimate, words_estimate

RECORDS, TOKENS = 12, 6000
LARGE = 105_000
#: Transformations that are applied at once, as each document meets each of them.
MOST_TRANSFORMATIONS = 1_000


def plan_batches(records: DataFrame, records_most: int = RECORDS, tokens_most: int = TOKENS, words: Column | None = None) -> DataFrame:
    """Add batch_index, batch_id, oversized: records of one (equipment, failure_mode) packed in order of source_record_id until a batch is full.

    A record that is too large alone is a batch of its own. words: the number of
    words of source_text where it is known (null: none), else it is counted. Only ids and token
    counts travel, not the texts: sorted by group and id they pass each task in
    a stream that carries the open batch from one Arrow batch to the next, so a
    group of any size needs no more memory than a small one.
    """
    keys = ["equipment", "failure_mode"]
    lean = records.select(*keys, "source_record_id", (word_estimate(F.col("source_text")) if words is None else words_estimate(F.coalesce(words, F.lit(0)))).alias("tokens"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index, n, total = object(), 0, 0, 0
        for batch in batches:
            out = []
            for *key, tokens in zip(*(batch.column(c).to_pylist() for c in (*keys, "tokens"))):
                if key != group:
                    group, index, n, total = key, 0, 0, 0
                elif n >= records_most or total + tokens > tokens_most:
                    index, n, total = index + 1, 0, 0
                n, total = n + 1, total + tokens
                out.append(index)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "batch_index"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.schema) + ", batch_index int"
    out = lean.repartition(*keys).sortWithinPartitions(*keys, "source_record_id").mapInArrow(pack, schema)
    return out.withColumn("oversized", F.col("tokens") > tokens_most).withColumn("batch_id", F.concat_ws("-", digest_id(F.col("equipment").cast("string"), F.coalesce(F.col("failure_mode").cast("string"), F.lit(""))), F.format_string("%04d", "batch_index")))


def plan_scopes(records: DataFrame) -> DataFrame:
    """One row per (equipment, failure_mode) with its ids in order; rows without any text are left out."""
    r = records.where(F.trim(F.coalesce("source_text", F.lit(""))) != "")
    return r.groupBy("equipment", "failure_mode").agg(F.sort_array(F.collect_list("source_record_id")).alias("ids"))


def serialize(fields: dict[str, Column]) -> Column:
    """Lines of "header: value", missing values empty."""
    return F.concat_ws("\n", *[F.concat(F.lit(k + ": "), F.coalesce(c.cast("string"), F.lit(""))) for k, c in fields.items()])


def generate(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """Add output and error: the model's answers, or what went wrong for the rows of a failed call."""
    schema = rows.withColumns({"output": F.lit(""), "error": F.lit("")}).schema
    for f in schema:
        f.nullable = True

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out, err = [], []
            for i in range(0, len(pdf), batch):
                some = pdf[prompt].iloc[i : i + batch].tolist()
                try:
                    got = model(some)
                    if len(got) != len(some):
                        raise ValueError("wrong number of answers")
                    out, err = out + got, err + [None] * len(some)
                except Exception as e:
                    out, err = out + [None] * len(some), err + [str(e)] * len(some)
            yield pdf.assign(output=out, error=err)

    return rows.mapInPandas(run, schema)


# fixed values: fields of a package, of its records and of its categories
PACKAGE_FIELDS = ["equipment", "failure_mode", "record_count", "records", "focus_categories", "recurring_patterns", "unresolved_cases"]
RECORD_LISTS = ["symptoms", "observations", "diagnostic_checks", "corrective_actions", "verification"]
RECORD_TEXTS = ["primary_focus", "mechanism", "cause"]
CATEGORY_LISTS = ["subsystems", "symptoms", "components", "historical_actions", "verification_patterns"]


def _field(v: Column, name: str) -> Column:
    """A field of an object as a variant, null where it is missing (a JSON null is none)."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _is(v: Column, *kinds: str) -> Column:
    """Whether a variant is of one of these kinds; false where it is missing."""
    found = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.coalesce(found.isin(*kinds), F.lit(False))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column) -> Column:
    return F.transform(_items(v), lambda x: F.try_variant_get(x, "$", "string"))


def _fault(where: Column, what: str) -> Column:
    return F.concat(F.lit("invalid_field: "), where, F.lit(what))


def _list_fault(v: Column, where: Column) -> Column:
    """What is wrong with an optional list of strings; missing and null are right."""
    absent = v.isNull() | F.is_variant_null(v)
    return F.when(absent, None).when(~_is(v, "ARRAY"), _fault(where, " is not a list")).when(F.exists(_items(v), lambda x: ~_is(x, "STRING")), _fault(where, " has a non-string entry"))


def _at(kind: str, i: Column, field: str = "") -> Column:
    return F.concat(F.lit(f"{kind}["), i.cast("string"), F.lit("]" + field))


def _record_faults(x: Column, i: Column) -> Column:
    own, solved = _field(x, "record_id"), _field(x, "unresolved")
    rid = F.try_variant_get(own, "$", "string")
    stranger = ~_is(own, "STRING") | (F.trim(F.coalesce(rid, F.lit(""))) == "") | ~F.coalesce(F.array_contains("ids", rid), F.lit(False))
    found = [F.when(stranger, _fault(_at("records", i, ".record_id"), " is not a batch member"))]
    found += [_list_fault(_field(x, f), _at("records", i, f".{f}")) for f in RECORD_LISTS]
    found += [F.when(_field(x, f).isNotNull() & ~_is(_field(x, f), "STRING", "VOID"), _fault(_at("records", i, f".{f}"), " is not a string")) for f in RECORD_TEXTS]
    found += [F.when(solved.isNotNull() & ~_is(solved, "BOOLEAN"), _fault(_at("records", i, ".unresolved"), " is not a boolean"))]
    return F.when(~_is(x, "OBJECT"), F.array(_fault(_at("records", i), " is not an object"))).otherwise(F.array_compact(F.array(*found)))


def _category_faults(x: Column, i: Column) -> Column:
    name, ids, count, share = (_field(x, f) for f in ("name", "record_ids", "record_count", "percentage"))
    at = lambda f: _at("focus_categories", i, f)
    no_ids = ids.isNotNull() & (~_is(ids, "ARRAY") | F.exists(_items(ids), lambda v: ~_is(v, "STRING")))
    found = [
        F.when(name.isNotNull() & ~_is(name, "STRING", "VOID"), _fault(at(".name"), " is not a string")),
        F.when(no_ids, _fault(at(".record_ids"), " is not a string list")).when(F.size(F.array_except(_texts(ids), "ids")) > 0, _fault(at(".record_id"), " references outside the batch")),
        F.when(count.isNotNull() & ~_is(count, "BIGINT"), _fault(at(".record_count"), " is not an integer")),
        F.when(share.isNotNull() & ~_is(share, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), _fault(at(".percentage"), " is not a number")),
    ]
    found += [_list_fault(_field(x, f), at(f".{f}")) for f in CATEGORY_LISTS]
    return F.when(~_is(x, "OBJECT"), F.array(_fault(at(""), " is not an object"))).otherwise(F.array_compact(F.array(*found)))


def validate_packages(rows: DataFrame) -> DataFrame:
    """Add errors: all that is wrong with a package (JSON in output) for its batch's ids (array of string), in the order of its fields, and error, the first of them or null.

    JSON alone is taken, nothing is stripped or repaired, and fields beyond the
    known ones are let pass. What makes later checks meaningless ends them: no
    answer, no JSON, no object, a missing field.
    """
    v = F.col("_v")
    x = rows.withColumn("_v", F.try_parse_json("output"))
    head = F.when(F.col("output").isNull(), "empty_response").when(v.isNull(), "malformed_json").when(~_is(v, "OBJECT"), "unexpected_output_shape: expected JSON object")
    missing = F.array_compact(F.array(*[F.when(_field(v, f).isNull(), F.lit(f"missing_required_field: {f}")) for f in PACKAGE_FIELDS]))
    x = x.withColumn("_head", F.when(head.isNotNull(), F.array(head)).otherwise(missing))
    records, categories = _field(v, "records"), _field(v, "focus_categories")
    counted = F.aggregate(_items(categories), F.lit(0).cast("bigint"), lambda s, c: s + F.coalesce(F.try_variant_get(c, "$.record_count", "bigint"), F.lit(0)))
    size = F.size(F.array_distinct("ids"))
    one = lambda when, text: F.when(when, F.lit(text))
    body = F.concat(
        F.array_compact(F.array(one(~_is(_field(v, "equipment"), "STRING") | ~_is(_field(v, "failure_mode"), "STRING"), "invalid_field: equipment/failure_mode must be strings"), one(~_is(_field(v, "record_count"), "BIGINT"), "invalid_field: record_count is not an integer"), one(~_is(records, "ARRAY"), "invalid_field: records is not a list"))),
        F.flatten(F.transform(_items(records), _record_faults)),
        F.array_compact(F.array(one(~_is(categories, "ARRAY"), "invalid_field: focus_categories is not a list"))),
        F.flatten(F.transform(_items(categories), _category_faults)),
        F.array_compact(F.array(F.when(counted > size, F.concat(F.lit("count_inconsistency: category record_counts sum to "), counted.cast("string"), F.lit(" over "), size.cast("string"), F.lit(" batch records"))), *[_list_fault(_field(v, f), F.lit(f)) for f in ("recurring_patterns", "unresolved_cases")])),
    )
    return x.withColumn("errors", F.when(F.size("_head") > 0, F.col("_head")).otherwise(body)).withColumn("error", F.get("errors", 0)).drop("_v", "_head")


def validate_guides(rows: DataFrame, sections: list[str]) -> DataFrame:
    """Add error: a missing section, or a reference to a record outside ids."""
    missing = F.array_compact(F.array(*[F.when(~F.col("guide").contains(s), F.lit(s)) for s in sections]))
    refs = F.regexp_extract_all("guide", F.lit(r"\[rec:([A-Za-z0-9_-]+)\]"), 1)
    unknown = F.array_except(refs, F.col("ids"))
    return rows.withColumn("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))).when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(unknown), ","))))


def share_table_errors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, total of markdown tables whose share column does not add up to 97-103."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n"))).withColumn("is_row", F.trim("col").startswith("|"))
    w = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("starts", F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False))).withColumn("table_no", F.sum(F.col("starts").cast("int")).over(w))
    cells = lines.where("is_row").withColumn("cells", F.transform(F.split(F.trim(F.regexp_replace("col", r"^\s*\||\|\s*$", "")), r"\|"), lambda x: F.trim(x)))
    head = cells.where("starts").select(key, "table_no", F.expr("array_position(transform(cells, x -> lower(x)), 'share')").alias("at")).where("at > 0")
    v = cells.where("not starts").join(head, [key, "table_no"]).withColumn("v", F.regexp_extract(F.get("cells", (F.col("at") - 1).cast("int")), r"^(\d+(?:\.\d+)?)", 1)).where("v <> ''")
    return v.groupBy(key, "table_no").agg(F.sum(F.col("v").cast("double")).alias("total")).where("total < 97 or total > 103")


def merge_batches(items: DataFrame) -> DataFrame:
    """Items of all batches of a scope, exact repeats once: first batch, support ids united.

    items: scope, batch_index, field, text, basis, support_ids.
    """
    return items.groupBy("scope", "field", "text", "basis").agg(F.min("batch_index").alias("first_batch"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("support_ids")))).alias("support_ids"))


def build_status(rows: DataFrame, key: str, ok: Column) -> DataFrame:
    n, good = F.count("*"), F.count_if(ok)
    return rows.groupBy(key).agg(F.when(good == n, "completed").when(good > 0, "partial").otherwise("failed").alias("status"))


def model_for(tokens: Column, explicit: Column, default: str, large: str) -> Column:
    return F.when(tokens > LARGE, F.lit(large)).otherwise(F.coalesce(explicit, F.lit(default)))


def eligible(batches: DataFrame, done: DataFrame) -> DataFrame:
    """Scopes of which no batch failed and that are not done, with their distinct ids in order. batches: scope, failed, ids."""
    g = batches.groupBy("scope").agg(F.bool_or("failed").alias("failed"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return g.where("not failed").join(done.select("scope"), "scope", "left_anti").drop("failed")


def apply_transformations(docs: DataFrame, transformations: DataFrame, model, text: str) -> DataFrame:
    """Every document with every transformation (a small table by contract, name and prompt), answered by the model; blank inputs and outputs are left out."""
    d = docs.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    if transformations.limit(MOST_TRANSFORMATIONS + 1).count() > MOST_TRANSFORMATIONS:
        raise ValueError(f"more than {MOST_TRANSFORMATIONS} transformations; apply them in parts")
    x = d.crossJoin(F.broadcast(transformations.select("name", "prompt"))).withColumn("full_prompt", F.concat("prompt", F.lit("\n"), F.col(text)))
    return generate(x, "full_prompt", model).where("error is null and trim(output) <> ''")


def budgeted_context(sources: DataFrame, budget: int) -> DataFrame:
    """id, context, tokens: the full text if it fits, then insights in order while they fit; else the text cut to four fifths of the budget, with a notice.

    sources: id, full_text, insights (array of string). Rows are independent.
    """
    kind = sources.schema["id"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        est = lambda t: len(t.split()) * 13 // 10
        for pdf in it:
            rows = []
            for i, text, insights in zip(pdf["id"], pdf["full_text"].fillna(""), pdf["insights"]):
                room = budget
                if est(text) > budget:
                    words = text.split()
                    text, room = " ".join(words[: budget * 8 // 13]) + " [cut]", budget
                parts, used = [text], est(text)
                for x in insights if insights is not None else ():
                    if used + est(x) <= room:
                        parts.append(x)
                        used += est(x)
                rows.append((i, "\n\n".join(parts), used))
            yield pd.DataFrame(rows, columns=["id", "context", "tokens"])

    return sources.select("id", "full_text", "insights").mapInPandas(run, f"id {kind}, context string, tokens int")


def table_preview(text: Column, most: int = 5) -> Column:
    """The first markdown table of a text: header, separator and `most` rows."""
    table = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)((?:^\|.*\|[ \t]*(?:\n|\z))+)", 1)
    return F.array_join(F.slice(F.split(F.regexp_replace(table, r"\s+$", ""), "\n"), 1, most + 2), "\n")
