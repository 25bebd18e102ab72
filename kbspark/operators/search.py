"""Vector and text retrieval as table-valued functions: one lazy plan per call."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def cosine(e: Column, query: list[float]) -> Column:
    """Cosine of a vector column with a query in double precision; zero vectors give null."""
    norm = float(np.linalg.norm(np.array(query, np.float64)))
    terms = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(e, terms, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(own * F.lit(norm), F.lit(0.0))


def branch(rows: DataFrame, query: list[float], k: int, least: float) -> DataFrame:
    """The k nearest rows of one kind: only vectors of the query's length and similarity from `least` on."""
    scored = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") == len(query))).withColumn("similarity", cosine(F.col("embedding"), query))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "hit").limit(k)


def vector_search(kinds: list[DataFrame], query: list[float], k: int = 10, least: float = 0.2) -> DataFrame:
    """id, parent_id, title, similarity, matches of the nearest entities.

    Each kind has id, parent_id, title, content, embedding and hit, a key that
    decides ties. Each is cut to its k nearest before they meet; hits of one
    entity then become one row with the best similarity and all matches.
    """
    cut = [branch(x, query, k, least).select("id", "parent_id", "title", "content", "similarity") for x in kinds]
    both = cut[0]
    for x in cut[1:]:
        both = both.unionByName(x)
    hits = both.distinct().groupBy("id", "parent_id", "title").agg(F.max("similarity").alias("similarity"), F.sort_array(F.collect_set("content")).alias("matches"))
    return hits.orderBy(F.desc("similarity"), "id").limit(k)


def terms(text: Column) -> Column:
    """Lower-case words, split at case changes too."""
    split = F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.regexp_extract_all(F.lower(split), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _is(word: str):
    """A lambda that marks one word; Spark counts a lambda's parameters, so the word cannot be one."""
    return lambda x: F.when(x == word, 1).otherwise(0)


def bm25(docs: DataFrame, query: list[str], text: str, key: list[str]) -> DataFrame:
    """Relevance of the rows that hold all query terms.

    Only query terms reach the shuffle: frequencies are counted per row while
    scanning, statistics are one row of sums.
    """
    t = F.col("_terms")
    counts = [F.size(F.array_compact(F.array_remove(F.transform(t, _is(w)), F.lit(0)))) for w in query]
    scanned = docs.where(F.col(text).isNotNull()).withColumn("_terms", terms(F.col(text))).select(*key, F.size("_terms").alias("_len"), *[c.alias(f"_tf{i}") for i, c in enumerate(counts)])
    stats = scanned.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(query))])
    all_in = scanned.where(" and ".join(f"_tf{i} > 0" for i in range(len(query))))
    score = F.lit(0.0)
    for i in range(len(query)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        score = score + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return all_in.crossJoin(F.broadcast(stats)).select(*key, score.alias("relevance"))


@dataclass
class TextIndex:
    """A written index of several kinds of texts.

    postings: kind, term, doc, tf, len in folders by bucket of the term; docs:
    kind, doc, id, parent_id, title, scope; stats: kind, n, avg_len. normal is
    applied to the terms of texts and queries alike (a stemmer, say).
    """

    postings: DataFrame
    docs: DataFrame
    stats: DataFrame
    buckets: int
    normal: Callable[[Column], Column] | None = None


#: Least number of files of one bucket, so that a term in every text is not one task's work; a session with more partitions than files has more of them.
SPLITS = 4


def term_counts(found: Column) -> Column:
    """term, tf of each different word of an array. A text's words are counted in its own row: sorted, the places where they change say how often each stands there."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("bigint").alias("tf")))
    both = F.transform(F.array(F.sort_array(found)), lambda s: F.struct(s.alias("s"), starts(s).alias("at")))
    return F.when(F.size(found) > 0, F.get(F.transform(both, lambda x: runs(x["s"], x["at"])), 0))


def postings(rows: DataFrame, buckets: int) -> DataFrame:
    """kind, doc, len, term, tf, bucket of texts (kind, doc, terms), dealt by bucket and document and in order of terms: each posting is shuffled once."""
    splits = max(SPLITS, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets))
    counted = rows.select("kind", "doc", F.size("terms").alias("len"), F.explode(term_counts(F.col("terms"))).alias("c")).select("kind", "doc", "len", "c.*")
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int")
    return counted.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(splits))).sortWithinPartitions("bucket", "term", "kind")


def write_index(kinds: dict[str, tuple[DataFrame, str]], folder: str, buckets: int = 16, normal: Callable[[Column], Column] | None = None) -> TextIndex:
    """Index the texts of each kind: rows with doc (their own key), id, parent_id, title, scope, and the column to search. Null texts are no documents. A bucket's files hold its terms in order, so a query reads the row groups of its own terms."""
    rows = None
    for kind, (df, column) in kinds.items():
        one = df.where(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), "doc", "id", "parent_id", "title", "scope", F.col(column).alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    found = terms(F.col("text"))
    rows = rows.withColumn("terms", F.transform(found, lambda t: normal(t)) if normal else found)
    spark = rows.sparkSession
    dealt = postings(rows, buckets)
    dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
    rows.select("kind", "doc", "id", "parent_id", "title", "scope", F.size("terms").alias("len")).write.option("compression", "zstd").parquet(f"{folder}/docs")
    docs = spark.read.parquet(f"{folder}/docs")
    docs.groupBy("kind").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).write.parquet(f"{folder}/stats")
    return TextIndex(spark.read.schema(dealt.schema).parquet(f"{folder}/postings"), docs, spark.read.parquet(f"{folder}/stats"), buckets, normal)


def index_bm25(index: TextIndex, query: list[str], kinds: list[str] | None = None) -> DataFrame:
    """kind, doc, id, parent_id, title, scope, relevance of the documents that hold all query terms. Only the buckets of these terms are read; a term's frequency is the number of its postings, over all documents of the kind."""
    words = list(dict.fromkeys(query))
    if index.normal:
        one = index.docs.sparkSession.range(1).select(F.transform(F.array(*map(F.lit, words)), lambda t: index.normal(t)).alias("w"))
        words = list(dict.fromkeys(one.first()["w"]))
    where = sorted({zlib.crc32(w.encode()) % index.buckets for w in words})
    p = index.postings.where(F.col("bucket").isin(where) & F.col("term").isin(words))
    if kinds is not None:
        p = p.where(F.col("kind").isin(kinds))
    df = F.broadcast(p.groupBy("kind", "term").agg(F.count("*").alias("df")))  # a row per kind and query term
    x = p.join(df, ["kind", "term"]).join(F.broadcast(index.stats), "kind")  # a row per kind
    score = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    found = x.groupBy("kind", "doc").agg(F.sum(score).alias("relevance"), F.count("*").alias("_held")).where(F.col("_held") == len(words)).drop("_held")
    return found.join(index.docs.drop("len"), ["kind", "doc"])


def text_search(index: TextIndex, query: list[str], k: int = 10, kinds: list[str] | None = None, within: DataFrame | None = None, parent: Column | None = None) -> DataFrame:
    """id, parent_id, title, relevance: the best hits of all kinds. within (scope) leaves only documents of these scopes, after they were scored among all; parent replaces the parent id."""
    found = index_bm25(index, query, kinds)
    if within is not None:
        found = found.join(within.select("scope").distinct(), "scope", "left_semi")
    if parent is not None:
        found = found.withColumn("parent_id", parent)
    best = found.groupBy("id", "parent_id", "title").agg(F.max("relevance").alias("relevance"))
    return best.orderBy(F.desc("relevance"), "id").limit(k)


def in_scope(rows: DataFrame, edges: DataFrame, notebooks: list[str], key: str = "id") -> DataFrame:
    """Rows reachable from the notebooks; an empty scope is everything."""
    if not notebooks:
        return rows
    reach = edges.where(F.col("notebook_id").isin(notebooks)).select(F.col("source_id").alias("_id")).distinct()
    return rows.join(reach, F.col(key) == F.col("_id"), "left_semi")


def merge_hits(vector: DataFrame, text: DataFrame) -> DataFrame:
    """Vector hits, and text hits whose id and parent are both new."""
    v = vector.select("id", "parent_id", F.lit("vector").alias("found_by"))
    t = text.select("id", "parent_id", F.lit("text").alias("found_by"))
    new = t.join(v.select("id"), "id", "left_anti").join(v.select("parent_id"), "parent_id", "left_anti")
    return v.unionByName(new.select("id", "parent_id", "found_by"))


def multi_query(vectors: DataFrame, queries: DataFrame, k: int = 10, most: int = 1_000) -> DataFrame:
    """query_id, rank, id, similarity: k nearest vectors of each query.

    queries (query_id, embedding) are few by contract and checked: more than
    `most` are refused. Their matrix is broadcast; each Arrow batch is one
    matrix product and keeps its own k best, which a window then merges.
    """
    rows = queries.select("query_id", "embedding").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} queries; split them")
    ids = [r.query_id for r in rows]
    matrix = np.array([r.embedding for r in rows], np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("embedding").to_pylist(), np.float64)
            sims = (matrix @ x.T) / np.maximum(norms[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-300)
            own = b.column("id").to_pylist()
            out = [(ids[q], own[j], float(sims[q, j])) for q in range(len(ids)) for j in np.lexsort((own, -sims[q]))[:k]]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["query_id", "id", "similarity"]), preserve_index=False)

    found = vectors.select("id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") == matrix.shape[1])).mapInArrow(run, f"query_id {kind}, id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
