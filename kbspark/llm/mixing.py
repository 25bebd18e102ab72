"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Words are the tokens. The mix is as large as the input and is dealt in blocks
of equal size. Each source's share of the blocks, and within a source each
shard's, is set by highest quotients target / (2 k - 1). A shard's documents
are put in an order drawn from a seed; the mix takes the blocks at its front,
after as many whole rounds as the quota holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import WORD, materialize

#: Words of a block, words (or rows) of a shard, the seed of the order, and how often a document may be taken.
BLOCK = 16
SHARD = 1_000_000
SEED = 7
MOST = 3


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add target (double) to a table of source, source_size.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the
    sum of sizes; none gets more than MOST times its size, and what is over
    is shared anew by weight. With the sources ordered by cap / weight the
    capped ones are a prefix, so running sums give the level without a loop.
    One row per source stands in one window; that is a small table by nature.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    x = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * MOST)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    x = x.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    x = x.withColumn("before_cap", F.sum("cap").over(upto) - F.col("cap")).withColumn("before_weight", F.sum("weight").over(upto) - F.col("weight"))
    level = (F.col("total") - F.col("before_cap")) / (F.col("weights") - F.col("before_weight"))
    # the first source whose cap is not below its share at the level that is left gives the level of all behind it
    free = F.when(F.col("cap") >= level * F.col("weight"), level)
    x = x.withColumn("level", F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return x.select(*sources.columns, F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, votes: str, seats: str, to: str, group: list[str], order: list[Column]) -> DataFrame:
    """Add `to`: the seats of each party, by highest quotients votes / (2 k - 1), within each group.

    seats: a column, the same in all rows of a group. Ties go by `order`.
    Only quotients near the fair share are ranked: the final divisor moves a
    party's share by at most half the number of parties over twice the seats,
    so all seats below that range are sure and those above it are out of
    reach. The candidates are a few rows for each party, however many seats.
    """
    w = Window.partitionBy(*group)
    x = parties.withColumn("_n", F.count("*").over(w)).withColumn("_sum", F.sum(F.col(votes)).over(w))
    fair = F.when(F.col("_sum") > 0, F.col(votes) / F.col("_sum") * F.col(seats)).otherwise(F.lit(0.0))
    x = x.withColumn("_fair", fair)
    reach = F.ceil(F.col("_fair") * F.col("_n") / F.greatest(F.col(seats) * 2, F.lit(1))) + 2
    x = x.withColumn("_sure", F.greatest(F.floor("_fair") - reach, F.lit(0)).cast("long")).withColumn("_upto", (F.floor("_fair") + reach).cast("long"))
    x = x.withColumn("_open", (F.col(seats) - F.sum("_sure").over(w)).cast("long"))
    ranked = x.where(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.col("_upto"))))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("_k") - 1)), *order, F.col("_k"))
    won = ranked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col("_open"))
    keys = [c for c in parties.columns]
    more = won.groupBy(*keys).agg(F.count("*").alias("_more"))
    on = None
    for c in keys:
        same = F.col(f"x.`{c}`").eqNullSafe(F.col(f"m.`{c}`"))
        on = same if on is None else on & same
    return x.alias("x").join(more.alias("m"), on, "left").select(*[F.col(f"x.`{c}`") for c in keys], (F.col("x._sure") + F.coalesce(F.col("m._more"), F.lit(0))).cast("long").alias(to))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, and nothing else.

    size: words of the text, 0 for null or empty texts, which are never taken
    from. A null source is a source of its own, last in order. The order
    within a shard is by MD5 of doc_id and the seed, ties by doc_id and then
    size, so reruns agree; rows that repeat take blocks one after another.
    A hot source is cut into shards of about SHARD words or rows, whichever
    makes more, by the same digest, so no window holds more than one shard,
    of a source of empty texts either.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    return mix_sizes(materialize(d, "mix-sizes"), seed)


def mix_sizes(d: DataFrame, seed: int = SEED) -> DataFrame:
    """As mix(), from doc_id, source, size; further columns stay."""
    per_source = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    per_source = per_source.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / SHARD), F.ceil(F.col("rows") / SHARD)).cast("long")).drop("rows").withColumn("seats", F.round(F.sum("source_size").over(Window.partitionBy()) / BLOCK).cast("long"))
    quota = apportion(per_source, "target", "seats", "quota", [], [F.col("source").asc_nulls_last()])
    drawn = F.md5(F.concat_ws(":", F.coalesce(F.col("d.doc_id").cast("string"), F.lit("null")), F.lit(str(seed))))
    x = d.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))).select("d.*", "source_size", "target", "shards", "quota", drawn.alias("drawn"))
    x = x.withColumn("shard", F.pmod(F.conv(F.substring("drawn", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shards = x.groupBy("source", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    dealt = apportion(shards, "shard_size", "quota", "blocks", ["source"], [F.col("shard")]).select("source", "shard", "shard_size", "blocks")
    y = x.alias("x").join(dealt.alias("s"), F.col("x.source").eqNullSafe(F.col("s.source")) & (F.col("x.shard") == F.col("s.shard"))).select("x.*", "shard_size", "blocks")
    order = Window.partitionBy("source", "shard").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.least(F.col("blocks") * BLOCK, F.col("shard_size") * MOST)
    y = y.withColumn("start", F.sum("size").over(order) - F.col("size")).withColumn("words", words)
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    y = y.withColumn("rounds", rounds)
    rest = F.least(F.greatest(F.col("words") - F.col("rounds") * F.col("shard_size") - F.col("start"), F.lit(0)), F.col("size"))
    taken = (F.col("rounds") * F.col("size") + rest).cast("long")
    return y.select(*d.columns, "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs, all columns, as often as the mix takes it (words taken over its size, rounded half up)."""
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    # sizes and shares are computed from narrow rows; the whole rows are joined to the copies by a number written once
    whole = materialize(d.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    copies = mix_sizes(whole.select("_row", "doc_id", "source", "size")).select("_row", F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(F.lit(0)).cast("int").alias("copies"))
    return whole.join(copies.where("copies > 0"), "_row").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows for DuckDB, with the constants above.
SQL_OP10 = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS rows FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s
), r AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         sum(cap) OVER o - cap AS before_cap, sum(weight) OVER o - weight AS before_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), v AS (
  SELECT *, (total - before_cap) / (weights - before_weight) AS lv FROM r
), l AS (
  SELECT arg_min(lv, cap / weight) FILTER (cap >= lv * weight) AS level FROM v
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target,
         greatest(CAST(ceil(source_size / 1000000) AS BIGINT), CAST(ceil(rows / 1000000) AS BIGINT)) AS shards, CAST(round(total / 16) AS BIGINT) AS seats
  FROM v, l
), f AS (
  SELECT *, CASE WHEN sum(target) OVER () > 0 THEN target / sum(target) OVER () * seats ELSE 0 END AS fair, count(*) OVER () AS n FROM t
), b AS (
  SELECT *, greatest(CAST(floor(fair) - ceil(fair * n / greatest(seats * 2, 1)) - 2 AS BIGINT), 0) AS sure,
         CAST(floor(fair) + ceil(fair * n / greatest(seats * 2, 1)) + 2 AS BIGINT) AS upto FROM f
), q AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS place, seats - (SELECT sum(sure) FROM b) AS open
  FROM (SELECT *, unnest(range(sure + 1, upto + 1)) AS k FROM b WHERE target > 0)
), g AS (
  SELECT b.source, b.source_size, b.target, b.shards, b.sure + (SELECT count(*) FROM q WHERE q.source IS NOT DISTINCT FROM b.source AND place <= open) AS quota FROM b
), x AS (
  SELECT d.*, g.source_size, g.target, g.quota, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7') AS drawn, g.shards FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), y AS (
  SELECT *, CAST('0x' || substr(drawn, 1, 8) AS BIGINT) % shards AS shard FROM x
), h AS (
  SELECT source, shard, quota, CAST(sum(size) AS BIGINT) AS shard_size FROM y GROUP BY ALL
), hf AS (
  SELECT *, CASE WHEN sum(shard_size) OVER p > 0 THEN shard_size / sum(shard_size) OVER p * quota ELSE 0 END AS fair, count(*) OVER p AS n FROM h WINDOW p AS (PARTITION BY source)
), hb AS (
  SELECT *, greatest(CAST(floor(fair) - ceil(fair * n / greatest(quota * 2, 1)) - 2 AS BIGINT), 0) AS sure, CAST(floor(fair) + ceil(fair * n / greatest(quota * 2, 1)) + 2 AS BIGINT) AS upto FROM hf
), ho AS (
  SELECT *, quota - sum(sure) OVER (PARTITION BY source) AS open FROM hb
), hq AS (
  SELECT source, shard, open, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k - 1) DESC, shard, k) AS place
  FROM (SELECT *, unnest(range(sure + 1, upto + 1)) AS k FROM ho WHERE shard_size > 0)
), hw AS (
  SELECT source, shard, count(*) AS more FROM hq WHERE place <= open GROUP BY ALL
), z AS (
  SELECT y.*, ho.shard_size, least((ho.sure + coalesce(hw.more, 0)) * 16, ho.shard_size * 3) AS words
  FROM y JOIN ho ON y.source IS NOT DISTINCT FROM ho.source AND y.shard = ho.shard
  LEFT JOIN hw ON hw.source IS NOT DISTINCT FROM ho.source AND hw.shard = ho.shard
), e AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY drawn, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start,
         CASE WHEN shard_size > 0 THEN CAST(words // shard_size AS BIGINT) ELSE 0 END AS rounds FROM z
)
SELECT doc_id, size, source_size, target, CAST(rounds * size + least(greatest(words - rounds * shard_size - start, 0), size) AS BIGINT) AS taken FROM e
"""

QUERIES = {"op10_mixing": op10_mixing}
SQL = {"op10_mixing": SQL_OP10}
