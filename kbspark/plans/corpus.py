"""Queries of corpus bookkeeping, listings, set operations and retrieval (sections A, E, F, G, H, I, K, M)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.operators import corpus as C
from kbspark.operators import search as S
from kbspark.operators.graph import numbered, shared_folder
from kbspark.plans.projections import logical, with_tables
from kbspark.plans.registry import query


@query("a14_upsert", "SELECT c.c_custkey, coalesce('VIP', c.c_mktsegment) AS c_mktsegment, c.c_acctbal FROM customer c WHERE c.c_custkey % 10 = 0 UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT -s_suppkey - 1, 'NEW', NULL FROM supplier")
def _(spark, d):
    c, s = logical(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), logical(spark, d, "supplier")
    new = c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("VIP").alias("c_mktsegment")).unionByName(s.select((-F.col("s_suppkey") - 1).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")))
    return C.upsert(c, new, "c_custkey")


@query("a15_insert_ignore", with_tables("SELECT l_partkey, min(record_id) AS record_id FROM report_row WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey"))
def _(spark, d):
    old = logical(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return C.insert_new(old, logical(spark, d, "report_row").select("l_partkey", "record_id"), ["l_partkey"], ["record_id"])


@query("a21_backfill", "SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3")
def _(spark, d):
    n = logical(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("value"))
    return C.backfill(logical(spark, d, "supplier"), n, "s_nationkey", "nation").select("s_suppkey", "nation")


@query("a22_strip_prefix", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS path FROM pages")
def _(spark, d):
    return logical(spark, d, "pages").select("page_id", C.strip_prefix(F.col("url"), ["https://", "http://"]).alias("path"))


@query("a23_default_backfill", with_tables("SELECT record_id, coalesce(cause, 'unknown') AS cause FROM record"))
def _(spark, d):
    return logical(spark, d, "record").select("record_id", F.coalesce("cause", F.lit("unknown")).alias("cause"))


@query("a24_orphans", with_tables("SELECT id, source_id FROM chunk WHERE source_id IN (SELECT id FROM source WHERE lang = 'en')"))
def _(spark, d):
    return C.without_orphans(logical(spark, d, "chunk").select("id", "source_id"), logical(spark, d, "source").where("lang = 'en'"), "source_id")


@query("a25_cascade", with_tables("@g AS (SELECT id FROM source WHERE lang = 'fr') SELECT 'chunk' AS table, count(*) AS deleted FROM chunk WHERE source_id IN (SELECT id FROM g) UNION ALL SELECT 'insight', count(*) FROM insight WHERE source_id IN (SELECT id FROM g) UNION ALL SELECT 'reference', count(*) FROM reference WHERE source_id IN (SELECT id FROM g)"))
def _(spark, d):
    kids = {n: (logical(spark, d, n), "source_id") for n in ("chunk", "insight", "reference")}
    return C.cascade(kids, logical(spark, d, "source").where("lang = 'fr'"))[1]


@query("a26_insight_to_note", with_tables("SELECT i.id, i.insight_type || ' from source ' || s.title AS title, i.content FROM insight i JOIN source s ON s.id = i.source_id"))
def _(spark, d):
    s = logical(spark, d, "source").select(F.col("id").alias("sid"), "title")
    return logical(spark, d, "insight").join(s, F.col("source_id") == F.col("sid")).select("id", F.concat("insight_type", F.lit(" from source "), "title").alias("title"), "content")


@query("f1_notebook_sources", with_tables("SELECT r.notebook_id, s.id, s.title FROM reference r JOIN source s ON s.id = r.source_id"))
def _(spark, d):
    s = logical(spark, d, "source").select("id", "title")
    return logical(spark, d, "reference").join(s, F.col("source_id") == F.col("id")).select("notebook_id", "id", "title")


@query("f2_sessions", with_tables("SELECT n.id AS notebook_id, s.id AS session_id, s.messages FROM notebook n JOIN session s ON s.notebook_id = n.id"))
def _(spark, d):
    n = logical(spark, d, "notebook").select(F.col("id").alias("notebook_id"))
    return n.join(logical(spark, d, "session").withColumnRenamed("id", "session_id"), "notebook_id").select("notebook_id", "session_id", "messages")


@query("f3_dangling_status", with_tables("@j AS (SELECT job_id, arg_max(status, event_id) AS status FROM job GROUP BY job_id) SELECT s.id, CASE WHEN s.id % 3 = 0 THEN NULL ELSE coalesce(j.status, 'unknown') END AS status FROM source s LEFT JOIN j ON j.job_id = s.id AND s.id % 3 <> 0"))
def _(spark, d):
    jobs = logical(spark, d, "job").groupBy("job_id").agg(F.max_by("status", "event_id").alias("status"))
    s = logical(spark, d, "source").select("id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("command"))
    return C.with_status(s, jobs, "command").select("id", "status")


@query("f4_child_fetch", with_tables("SELECT s.id, coalesce(string_agg(i.insight_type, ',' ORDER BY i.id), '') AS insights FROM source s LEFT JOIN insight i ON i.source_id = s.id GROUP BY s.id"))
def _(spark, d):
    kids = logical(spark, d, "insight").withColumnRenamed("id", "insight_id")
    return C.with_children(logical(spark, d, "source").select("id"), kids, "source_id", ["insight_id", "insight_type"], "kids").select("id", F.array_join(F.col("kids.insight_type"), ",").alias("insights"))


@query("f5_enrich_jobs", with_tables("@e AS (SELECT job_id, unnest([job_id, job_id + 1]) AS report FROM (SELECT DISTINCT job_id FROM job)) SELECT e.job_id, string_agg(s.title, ' | ' ORDER BY s.id) AS titles FROM e JOIN source s ON s.id = e.report GROUP BY e.job_id"))
def _(spark, d):
    e = logical(spark, d, "job").select("job_id").distinct().select("job_id", F.explode(F.array("job_id", F.col("job_id") + 1)).alias("report"))
    s = logical(spark, d, "source").select("id", "title")
    return e.join(s, F.col("report") == F.col("id")).groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("id", "title"))).title, " | ").alias("titles"))


@query("f6_display_lookup", "SELECT o_orderkey, c_name AS customer, n_name AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    o, c, n = (logical(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", F.col("c_name").alias("customer"), F.col("n_name").alias("nation"))


@query("g1_notebook_counts", with_tables("SELECT n.id, (SELECT count(*) FROM reference r WHERE r.notebook_id = n.id) AS sources, (SELECT count(*) FROM note t WHERE t.notebook_id = n.id) AS notes FROM notebook n"))
def _(spark, d):
    n = logical(spark, d, "notebook").select("id")
    return C.with_count(C.with_count(n, logical(spark, d, "reference"), "notebook_id", "sources"), logical(spark, d, "note"), "notebook_id", "notes")


@query("g2_source_counts", with_tables("SELECT s.id, (SELECT count(*) FROM insight i WHERE i.source_id = s.id) AS insights, EXISTS (SELECT 1 FROM chunk c WHERE c.source_id = s.id) AS embedded FROM source s"))
def _(spark, d):
    s = C.with_count(logical(spark, d, "source").select("id"), logical(spark, d, "insight"), "source_id", "insights")
    return C.with_count(s, logical(spark, d, "chunk"), "source_id", "chunks").select("id", "insights", (F.col("chunks") > 0).alias("embedded"))


@query("g3_chunk_count", with_tables("SELECT source_id, count(*) AS chunks FROM chunk GROUP BY source_id"))
def _(spark, d):
    return logical(spark, d, "chunk").groupBy("source_id").agg(F.count("*").alias("chunks"))


@query("g4_delete_preview", with_tables("@c AS (SELECT source_id, count(DISTINCT notebook_id) AS n FROM reference GROUP BY source_id) SELECT r.notebook_id, count(*) FILTER (c.n = 1) AS exclusive, count(*) FILTER (c.n > 1) AS shared FROM (SELECT DISTINCT source_id, notebook_id FROM reference) r JOIN c USING (source_id) GROUP BY r.notebook_id"))
def _(spark, d):
    return C.exclusive_sources(logical(spark, d, "reference"), F.col("notebook_id"))


@query("g5_count_by_type", "SELECT t.kind, count(e.event_id) AS n FROM (SELECT unnest(['click', 'view', 'purchase', 'refund']) AS kind) t LEFT JOIN events e ON lower(e.event_type) = t.kind GROUP BY t.kind")
def _(spark, d):
    kinds = spark.createDataFrame([(k,) for k in ("click", "view", "purchase", "refund")], "kind string")
    n = logical(spark, d, "events").groupBy(F.lower("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("g29_progress", with_tables("SELECT job_id, CASE WHEN max(event_id) % 2 = 0 THEN 100.0 ELSE round(count(*) FILTER (status <> 'new') * 100.0 / count(*), 1) END AS percent FROM job GROUP BY job_id"))
def _(spark, d):
    j = logical(spark, d, "job").groupBy("job_id").agg(F.count_if(F.col("status") != "new").alias("done"), F.count("*").alias("n"), F.max("event_id").alias("e"))
    return j.select("job_id", C.progress(F.col("done"), F.col("n"), F.when(F.col("e") % 2 == 0, "completed").otherwise("running")).alias("percent"))


@query("h6_keep_first", with_tables("SELECT record_id, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) > 1 AS duplicate FROM report_row"))
def _(spark, d):
    return C.keep_first(logical(spark, d, "report_row"), F.col("l_partkey"), ["l_orderkey", "l_linenumber"]).select("record_id", "l_partkey", "duplicate")


@query("h8_latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, d):
    return C.latest(logical(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("h9_recent_live_job", with_tables("SELECT job_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id) AS n FROM job WHERE status IN ('new', 'running')) WHERE n = 1"))
def _(spark, d):
    live = logical(spark, d, "job").where("status in ('new', 'running')").withColumn("at", F.greatest("ts", "ts"))
    return C.latest(live, "job_id", [F.desc("at"), F.asc("event_id")]).select("job_id", "event_id", "status")


@query("i1_pagination", with_tables("SELECT id, title FROM source ORDER BY lower(title), id LIMIT 20 OFFSET 40"))
def _(spark, d):
    return C.page(logical(spark, d, "source").select("id", "title"), [F.lower("title"), F.asc("id")], 20, 40)


@query("i2_recently_viewed", "SELECT kind, id FROM (SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS seen FROM orders ORDER BY seen DESC, id LIMIT 12) UNION ALL SELECT * FROM (SELECT 'event' AS kind, event_id AS id, ts AS seen FROM events ORDER BY seen DESC, id LIMIT 12)) ORDER BY seen DESC, kind, id LIMIT 12")
def _(spark, d):
    a = logical(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("seen")).orderBy(F.desc("seen"), "id").limit(12)
    b = logical(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("seen")).orderBy(F.desc("seen"), "id").limit(12)
    return a.unionByName(b).orderBy(F.desc("seen"), "kind", "id").limit(12).select("kind", "id")


@query("i3_task_feed", with_tables("SELECT job_id, event_id, status FROM job ORDER BY ts DESC, event_id DESC LIMIT 50"))
def _(spark, d):
    j = logical(spark, d, "job")
    families = [j.where(F.col("status").isin(s)) for s in (["new", "running"], ["completed"], ["failed"])]
    return families[0].unionByName(families[1]).unionByName(families[2]).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("job_id", "event_id", "status")


@query("i4_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 8")
def _(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return logical(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 8").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("k1_distinct_union", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)")
def _(spark, d):
    return logical(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(logical(spark, d, "customer").select("c_custkey")).distinct()


@query("k2_header_union", "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    a = logical(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = logical(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("k3_intersection", "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier")
def _(spark, d):
    return logical(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(logical(spark, d, "supplier").select("s_suppkey"))


@query("k4_difference", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    o = logical(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct()
    return logical(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(o, "k", "left_anti")


@query("m2_stale_jobs", with_tables("@l AS (SELECT job_id, max(ts) AS last_ts, arg_max(status, (ts, event_id)) AS status FROM job GROUP BY job_id), m AS (SELECT max(ts) AS now_ts FROM job) SELECT job_id, CASE WHEN status = 'running' AND now_ts - last_ts > INTERVAL 1800 SECOND THEN 'failed' ELSE status END AS status, status = 'running' AND now_ts - last_ts > INTERVAL 1800 SECOND AS flipped FROM l, m"))
def _(spark, d):
    j = logical(spark, d, "job")
    return C.stale(j, F.lit(j.agg(F.max("ts")).first()[0]))


# --- retrieval


def query_vector(spark, d) -> list[float]:
    return [float(x) for x in logical(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), q.v) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.v, q.v)))"
QV = "(SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) q"


@query("e1_cosine", f"SELECT e.vec_id, round({COS}, 9) AS similarity FROM embeddings e, {QV}")
def _(spark, d):
    return logical(spark, d, "embeddings").select("vec_id", F.round(S.cosine(F.col("embedding"), query_vector(spark, d)), 9).alias("similarity"))


@query("b4_usable_embedding", f"SELECT e.vec_id FROM embeddings e, {QV} WHERE {COS} >= 0.05")
def _(spark, d):
    q = query_vector(spark, d)
    return logical(spark, d, "embeddings").where(F.size("embedding") == len(q)).where(S.cosine(F.col("embedding"), q) >= 0.05).select("vec_id")


@query("e2_branch_top_k", f"SELECT e.vec_id AS hit, round({COS}, 9) AS similarity FROM embeddings e, {QV} WHERE {COS} >= -1 ORDER BY {COS} DESC, e.vec_id LIMIT 25")
def _(spark, d):
    rows = logical(spark, d, "embeddings").withColumnRenamed("vec_id", "hit")
    return S.branch(rows, query_vector(spark, d), 25, -1.0).select("hit", F.round("similarity", 9).alias("similarity"))


def vector_rows(spark, d):
    """The three kinds that hold vectors: chunks (each under its source), insights and notes. source_id is null for notes."""
    s = logical(spark, d, "source").select(F.col("id").alias("sid"), F.col("title").alias("source_title"), "equipment_code")
    c = logical(spark, d, "chunk").join(s, F.col("source_id") == F.col("sid"))
    chunks = c.select(F.col("source_id").alias("id"), F.col("source_id").alias("parent_id"), F.col("source_title").alias("title"), F.col("ord").cast("string").alias("content"), "embedding", F.col("id").alias("hit"), "source_id", "equipment_code")
    i = logical(spark, d, "insight").join(logical(spark, d, "insight_vector"), "id").join(s, F.col("source_id") == F.col("sid"))
    insights = i.select("id", F.col("source_id").alias("parent_id"), F.concat("insight_type", F.lit(" - "), F.coalesce("source_title", F.lit(""))).alias("title"), F.substring("content", 1, 20).alias("content"), "embedding", F.col("id").alias("hit"), "source_id", "equipment_code")
    n = logical(spark, d, "note").join(logical(spark, d, "note_vector"), "id")
    own = (-F.col("id") - 1).alias("id")
    notes = n.select(own, own.alias("parent_id"), "title", F.substring("content", 1, 20).alias("content"), "embedding", F.col("id").alias("hit"), F.lit(None).cast("bigint").alias("source_id"), F.lit(None).cast("string").alias("equipment_code"))
    return [chunks, insights, notes]


def vector_sql(where: str, k: int, notes: str = "true") -> str:
    cos = COS.replace("e.embedding", "x.embedding")
    kinds = {
        "ch": f"SELECT c.source_id AS id, c.source_id AS parent_id, s.title, CAST(c.ord AS VARCHAR) AS content, c.embedding, c.id AS hit FROM chunk c JOIN source s ON s.id = c.source_id WHERE {where.format('c.source_id')}",
        "ki": f"SELECT i.id, i.source_id, i.insight_type || ' - ' || coalesce(s.title, ''), substr(i.content, 1, 20), v.embedding, i.id FROM insight i JOIN insight_vector v ON v.id = i.id JOIN source s ON s.id = i.source_id WHERE {where.format('i.source_id')}",
        "kn": f"SELECT -n.id - 1, -n.id - 1, n.title, substr(n.content, 1, 20), v.embedding, n.id FROM note n JOIN note_vector v ON v.id = n.id WHERE {notes}",
    }
    ctes = ", ".join(f"{name} AS (SELECT id, parent_id, title, content, {cos} AS sim FROM ({sql}) x(id, parent_id, title, content, embedding, hit), {QV} WHERE {cos} >= 0.0 ORDER BY sim DESC, hit LIMIT {k})" for name, sql in kinds.items())
    return with_tables(f"@{ctes}, u AS (SELECT * FROM ch UNION SELECT * FROM ki UNION SELECT * FROM kn) SELECT id, parent_id, title, round(max(sim), 9) AS similarity, string_agg(DISTINCT content, ',' ORDER BY content) AS matches FROM u GROUP BY id, parent_id, title ORDER BY max(sim) DESC, id LIMIT {k}")


def found_vectors(spark, d, kinds, k=10):
    return S.vector_search(kinds, query_vector(spark, d), k, 0.0).select("id", "parent_id", "title", F.round("similarity", 9).alias("similarity"), F.array_join("matches", ",").alias("matches"))


E3_SQL = vector_sql("true", 10)


@query("e3_vector_search", E3_SQL)
def _(spark, d):
    return found_vectors(spark, d, vector_rows(spark, d))


@query("e7_notebook_scope", vector_sql("{0} IN (SELECT source_id FROM reference WHERE notebook_id IN ('src1', 'src2'))", 10, "n.notebook_id IN ('src1', 'src2')"))
def _(spark, d):
    edges, scope = logical(spark, d, "reference"), ["src1", "src2"]
    chunks, insights, notes = vector_rows(spark, d)
    mine = logical(spark, d, "note").where(F.col("notebook_id").isin(scope)).select(F.col("id").alias("hit"))
    return found_vectors(spark, d, [S.in_scope(chunks, edges, scope, "source_id"), S.in_scope(insights, edges, scope, "source_id"), notes.join(mine, "hit", "left_semi")])


@query("e8_equipment_vector", vector_sql("upper(s.equipment_code) = 'EQ3'", 10, "false"))
def _(spark, d):
    return found_vectors(spark, d, [x.where("upper(equipment_code) = 'EQ3'") for x in vector_rows(spark, d)[:2]])


TERMS_SQL = r"regexp_extract_all(lower(regexp_replace({c}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(table: str, column: str, words: list[str], key: str = "id") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * l / avg_l))" for i in range(len(words)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"(SELECT {key}, {score} AS relevance FROM (SELECT {key}, len(t) AS l, {tf} FROM (SELECT {key}, {TERMS_SQL.format(c=column)} AS t FROM {table} WHERE {column} IS NOT NULL)) s, (SELECT count(*) AS n, avg(l) AS avg_l, {df} FROM (SELECT len(t) AS l, {tf} FROM (SELECT {TERMS_SQL.format(c=column)} AS t FROM {table} WHERE {column} IS NOT NULL))) g WHERE {every})"


_indexes: dict[tuple[str, str], S.TextIndex] = {}


def text_index(spark, d) -> S.TextIndex:
    """One index of all searched columns, written once in a session for each data folder."""
    where = (spark.sparkContext.applicationId, d)
    if where not in _indexes:
        src = logical(spark, d, "source").select(F.col("id").alias("doc"), "id", F.col("id").alias("parent_id"), "title", F.col("id").alias("scope"), "full_text")
        titles = src.select(F.col("doc").alias("sid"), F.col("title").alias("source_title"))
        c = logical(spark, d, "chunk_text").join(titles, F.col("source_id") == F.col("sid"))
        chunks = c.select(F.col("id").alias("doc"), F.col("source_id").alias("id"), F.col("source_id").alias("parent_id"), F.col("source_title").alias("title"), F.col("source_id").alias("scope"), "content")
        i = logical(spark, d, "insight").join(titles, F.col("source_id") == F.col("sid"))
        ins = i.select(F.col("id").alias("doc"), "id", F.col("source_id").alias("parent_id"), F.concat("insight_type", F.lit(" - "), F.coalesce("source_title", F.lit(""))).alias("title"), F.col("source_id").alias("scope"), "content")
        own = -F.col("id") - 1
        notes = logical(spark, d, "note").select(F.col("id").alias("doc"), own.alias("id"), own.alias("parent_id"), "title", F.lit(None).cast("bigint").alias("scope"), "content")
        kinds = {"title": (src, "title"), "chunk": (chunks, "content"), "full_text": (src, "full_text"), "insight": (ins, "content"), "note_title": (notes, "title"), "note": (notes, "content")}
        _indexes[where] = S.write_index(kinds, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return _indexes[where]


@query("e5_bm25", with_tables(f"SELECT id, round(relevance, 9) AS relevance FROM {bm25_sql('source', 'full_text', ['the', 'and'])}"))
def _(spark, d):
    return S.index_bm25(text_index(spark, d), ["the", "and"], ["full_text"]).select("id", F.round("relevance", 9).alias("relevance"))


@query("e5_bm25_scan", with_tables(f"SELECT id, round(relevance, 9) AS relevance FROM {bm25_sql('source', 'full_text', ['the', 'and'])}"))
def _(spark, d):
    """Without an index: one pass counts the query's terms."""
    return S.bm25(logical(spark, d, "source"), ["the", "and"], "full_text", ["id"]).select("id", F.round("relevance", 9).alias("relevance"))


INDEXED = {"title": ("source", "id", "title"), "chunk": ("chunk_text", "id", "content"), "full_text": ("source", "id", "full_text"), "insight": ("insight", "id", "content"), "note_title": ("note", "id", "title"), "note": ("note", "id", "content")}


@query("e4_bm25_index", with_tables("SELECT kind, term, count(*) AS df, sum(tf) AS total, sum(tf * l) AS weighted FROM (SELECT kind, doc, term, l, count(*) AS tf FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {key} AS doc, len(t) AS l, unnest(t) AS term FROM (SELECT {key}, {TERMS_SQL.format(c=c)} AS t FROM {t} WHERE {c} IS NOT NULL)" for k, (t, key, c) in INDEXED.items()) + ") GROUP BY ALL) GROUP BY kind, term"))
def _(spark, d):
    return text_index(spark, d).postings.groupBy("kind", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.sum(F.col("tf") * F.col("len")).alias("weighted"))


HITS = "u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {key} AS doc, relevance FROM {bm25_sql(t, c, ['the'])}" for k, (t, key, c) in INDEXED.items()) + "), hits AS (SELECT CASE u.kind WHEN 'chunk' THEN ct.source_id WHEN 'note' THEN -u.doc - 1 WHEN 'note_title' THEN -u.doc - 1 ELSE u.doc END AS id, CASE u.kind WHEN 'chunk' THEN ct.source_id WHEN 'insight' THEN i.source_id WHEN 'note' THEN -u.doc - 1 WHEN 'note_title' THEN -u.doc - 1 ELSE u.doc END AS parent_id, CASE u.kind WHEN 'insight' THEN i.insight_type || ' - ' || coalesce(s.title, '') WHEN 'note' THEN n.title WHEN 'note_title' THEN n.title ELSE s.title END AS title, u.kind, s.equipment_code, relevance FROM u LEFT JOIN chunk_text ct ON u.kind = 'chunk' AND ct.id = u.doc LEFT JOIN insight i ON u.kind = 'insight' AND i.id = u.doc LEFT JOIN note n ON u.kind IN ('note', 'note_title') AND n.id = u.doc LEFT JOIN source s ON s.id = CASE u.kind WHEN 'chunk' THEN ct.source_id WHEN 'insight' THEN i.source_id WHEN 'note' THEN NULL WHEN 'note_title' THEN NULL ELSE u.doc END)"
E6_SQL = with_tables(f"@{HITS} SELECT id, parent_id, title, round(max(relevance), 9) AS relevance FROM hits GROUP BY id, parent_id, title ORDER BY max(relevance) DESC, id LIMIT 15")


@query("e6_text_search", E6_SQL)
def _(spark, d):
    return S.text_search(text_index(spark, d), ["the"], 15).select("id", "parent_id", "title", F.round("relevance", 9).alias("relevance"))


# the frequencies behind a score are those of all documents; an insight is its own parent here
@query("e9_equipment_text", with_tables(f"@{HITS} SELECT id, id AS parent_id, title, round(max(relevance), 9) AS relevance FROM hits WHERE kind NOT IN ('note', 'note_title') AND upper(equipment_code) = 'EQ3' GROUP BY id, title ORDER BY max(relevance) DESC, id LIMIT 15"))
def _(spark, d):
    mine = logical(spark, d, "source").where("upper(equipment_code) = 'EQ3'").select(F.col("id").alias("scope"))
    return S.text_search(text_index(spark, d), ["the"], 15, ["title", "chunk", "full_text", "insight"], mine, F.col("id")).select("id", "parent_id", "title", F.round("relevance", 9).alias("relevance"))


@query("e10_merge_hits", f"WITH v AS ({E3_SQL}), t AS ({E6_SQL}) SELECT id, parent_id, 'vector' AS found_by FROM v UNION ALL SELECT id, parent_id, 'text' FROM t WHERE id NOT IN (SELECT id FROM v) AND parent_id NOT IN (SELECT parent_id FROM v)")
def _(spark, d):
    v = S.vector_search(vector_rows(spark, d), query_vector(spark, d), 10, 0.0)
    return S.merge_hits(v, S.text_search(text_index(spark, d), ["the"], 15))


@query("e11_multi_query", f"SELECT query_id, rank, id FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.replace('q.v', 'CAST(q.embedding AS DOUBLE[])')} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 5) q) WHERE rank <= 10")
def _(spark, d):
    e = logical(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return S.multi_query(e, e.where("id < 5").select(F.col("id").alias("query_id"), "embedding")).select("query_id", F.col("rank").cast("bigint").alias("rank"), "id")


@query("e12_result_order", f"SELECT e.vec_id, row_number() OVER (ORDER BY round({COS}, 3) DESC, e.vec_id) AS place FROM embeddings e, {QV}")
def _(spark, d):
    s = logical(spark, d, "embeddings").select("vec_id", F.round(S.cosine(F.col("embedding"), query_vector(spark, d)), 3).alias("s"))
    return numbered(s, [F.desc("s"), F.asc("vec_id")], "place").select("vec_id", "place")
