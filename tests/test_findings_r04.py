"""One small case for each finding of round 4."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kbspark.llm import bm25
from kbspark.llm.common import materialize
from kbspark.operators import mining as M
from kbspark.plans import registry

TREES = "code long, t1 string, t2 string, t3 string, t4 string, t5 string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_trees(spark, n=60, seed=1):
    rnd = random.Random(seed)
    pick = lambda x, k: rnd.choice([None, *[f"{x}{i}" for i in range(k)]])
    rows = [(i, pick("a", 2), pick("b", 2), pick("c", 4), pick("d", 2), pick("e", 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, TREES)


def test_equipment_pairs_are_not_shuffled(spark):
    """a pair is made on its finest level alone, so that no pair is dealt out and folded; nulls agree with nothing."""
    rows, trees = some_trees(spark)
    got = M.equipment_pairs(trees, "same_class")

    def rank(x, y):
        same = lambda *at: all(x[i] is not None and x[i] == y[i] for i in at)
        return next((r for r, at in enumerate([(0,), (5,), (4, 3), (3,), (2,), (1,)]) if same(*at)), None)

    want = sorted((x[0], y[0], rank(x, y)) for x in rows for y in rows if rank(x, y) is not None)
    assert sorted((r["a"], r["b"], r["rank"]) for r in got.collect()) == want
    assert "Aggregate" not in plan(got)


def some_records(spark, n=400, seed=2):
    rnd = random.Random(seed)
    texts = [None, " ", "Seal", "seal ", "SEAL", "bolt", "Wear"]
    rows = [(i, rnd.randrange(70), rnd.choice([None, "m0", "m1", "m2"]), rnd.choice(texts), rnd.choice(texts), f"s{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, equipment long, mode string, cause string, mechanism string, symptom string")


def test_causes_without_lists_of_evidence(spark, monkeypatch):
    """Causes counted by spelling, tree by tree, are those of the evidence; with nulls on each level, codes without a tree, and texts said twice."""
    records, trees = some_records(spark), some_trees(spark)[1]
    columns = sorted(M.causes(M.evidence(records, trees)).columns)
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    want, got = M.causes(M.evidence(records, trees)), M.scope_causes(records, trees)
    assert rows(got) == rows(want) and got.count() > 300
    assert [got.schema[c].dataType for c in columns] == [want.schema[c].dataType for c in columns]
    # what meets a scope's tree is counted and ranked there: no exchange stands above that join
    assert "Exchange" not in plan(M.rank_causes(got)).split("SortMergeJoin")[0]
    among = spark.createDataFrame([(i, f"m{i % 4}") for i in range(30)], "scope_equipment long, mode string")
    assert rows(M.scope_causes(records, trees, among)) == rows(M.causes(M.evidence(records, trees, among)))
    totals = M.evidence(records, trees).groupBy("scope_equipment", "mode").agg(F.sum("n").alias("records"), F.sum(F.col("weight") * F.col("n")).alias("weight"))
    assert sorted(map(str, M.scope_totals(records, trees).collect())) == sorted(map(str, totals.collect()))
    monkeypatch.setattr(M, "MOST_TREES", 3)  # a model of too many trees goes by level keys
    assert M._scope_counts(records, trees, M._said()) is None and rows(M.scope_causes(records, trees)) == rows(want)


def test_actions_of_lone_records_stay_in_their_rows(spark):
    """Scopes of one record and of several have the actions, numbers and links of all sentences side by side; a lone record's sentences are not shuffled."""
    texts = spark.createDataFrame([(0, "Replaced seal. tested pump\nreplaced  seal. pump. tested pump"), (1, None), (2, "pump. cleaned filter. tested pump"), (3, "تست شد. checked the valve")], "text_id long, text string")
    r = [(i, i % 9 if i < 30 else i, "m" if i % 5 else None, "c", ["w", " ", None][i % 3], i % 4, ["\nreplaced seal. cleaned. pump", "\n", None, "\nتست شد. تست شد. tested pump"][i // 2 % 4]) for i in range(60)]
    r = spark.createDataFrame(r, "record_id long, equipment long, mode string, cause string, mechanism string, text_id long, repair_text string")
    trees = spark.createDataFrame([(i, "pump", "s", "t", f"m{i % 2}", None) for i in range(50)], TREES)
    whole = r.join(texts, "text_id").withColumn("repair_text", F.concat("text", "repair_text"))
    rows = lambda df: sorted(map(str, df.withColumn("said", F.sort_array("said")).select(sorted(df.columns)).collect()))
    want = M.actions(M.admitted(M.sentence_rows(whole), trees))
    for a in (M.Actions(M.Sentences(r, texts), trees), M.Actions(M.Sentences(whole), trees)):
        assert a.lone.count() > 5 and a.many.count() > 5
        assert rows(a.rows()) == rows(want) and rows(a.rows(False)) == rows(want.drop("n", "action_id"))
        assert sorted(map(str, a.links(2).collect())) == sorted(map(str, M.cause_actions(want, 2).collect()))
        assert sorted(map(str, a.counts().collect())) == sorted(map(str, want.groupBy("equipment", "mode").agg(F.count("*").alias("actions")).collect()))
        # between the join of a text with its record and the rows of its actions stands no exchange
        assert "Exchange" not in plan(a.lone.select(F.explode("acts"))).split("SortMergeJoin")[0]


def test_acceptance_of_odd_documents(spark, tmp_path):
    """blank texts, texts that begin with an error, vertical tabs, blanks beyond ASCII, missing languages and ids: the rows of the SQL."""
    texts = ["", " \n ", None, "Error: in the text", "\x0ba\x0bb c", " 　a  b\t\tc ", "x" * 60, "\u0085y", "a  b"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, x) for t in texts for x in ("en", "-", None, " ", "unknown"))] + [(4 * i + 80, t, "en") for i, t in enumerate(texts)] + [(None, "text", "en")]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}), f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = c.execute(registry.SQL["a20_acceptance"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["a20_acceptance"](spark, str(tmp_path)).select("doc_id", "title").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_blocks_of_alignment_lie_apart(spark, monkeypatch):
    """a reader and an Arrow batch hold all rows of a file or task at once, so a file has one block and blocks have a task each, whatever the size of a partition."""
    import public_tokenizers as P

    from kbspark.llm import align

    kept = {}
    monkeypatch.setattr(align, "materialize", lambda df, name, **more: kept.setdefault(name, materialize(df, name, **more)))
    docs = spark.createDataFrame([(i, f"some words {i} and more of them, time and again") for i in range(40)], "doc_id long, text string").coalesce(1)
    args = (P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))
    want = sorted(map(tuple, align.align_documents(docs, *args).collect()))
    kept.clear()
    out = align.align_documents(docs, *args, block_length=500)
    assert sorted(map(tuple, out.collect())) == want
    files = kept["aligned"].groupBy(F.input_file_name()).count()
    assert files.count() > 5 and files.agg(F.max("count")).first()[0] == 1
    assert "REPARTITION_BY_NUM" in plan(out)


def test_queries_that_travel_together_share_terms():
    """what goes to every shard holds a term once for all queries of a row; each query comes back with its terms in order, also from more terms than 16 bits tell."""
    rnd = np.random.default_rng(1)
    for pool, queries in ((400, 300), (90_000, 40), (5, 3)):
        every = rnd.integers(-(2**63), 2**63 - 1, pool)
        df = dict(zip(every.tolist(), rnd.integers(1, 10**6, pool).tolist()))
        terms = [rnd.choice(every, int(rnd.integers(0, min(pool, 4000))), replace=False) for _ in range(queries)]
        raw = bm25.Bundle.pack(np.arange(queries) * 7, np.array([len(t) for t in terms]), np.concatenate(terms), np.array([df[t] for t in np.concatenate(terms).tolist()], np.int64))
        got = list(bm25.Bundle(raw))
        assert [q for q, _, _ in got] == [7 * i for i in range(queries)]
        for t, (_, back, f) in zip(terms, got):
            assert np.array_equal(back, np.sort(t.view(np.uint64))) and f.tolist() == [df[x] for x in back.view(np.int64).tolist()]
        if pool == 400:
            assert len(raw) < 3 * sum(map(len, terms))


def test_queries_travel_to_groups_of_shards(spark, monkeypatch):
    """how often queries are shuffled does not grow with the number of shards, and the hits are those of one shard; also where a group has many shards, or none of its own queries' documents."""
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices([f"w{j}" for j in range(60)], k=12))) for i in range(400)] + [(None, "w1 w2"), (400, ""), (401, None)], "doc_id long, text string")
    asked = docs.where("doc_id % 9 = 0")
    rows = lambda: sorted(map(tuple, bm25.search(docs, asked, 5).collect()))
    want = rows()
    monkeypatch.setattr(bm25, "SHARD", 6)
    monkeypatch.setattr(bm25, "GROUPS", 1)
    monkeypatch.setattr(bm25, "TOGETHER", 7)
    assert rows() == want and len(want) == 225
    groups = spark.sparkContext.defaultParallelism
    assert "hashpartitioning(group" in plan(bm25.search(docs, asked, 5)) and 403 // 6 > groups
