"""The knowledge base on disk, enrichment, the technical term of clustering, and the posting index, on small tables with known results."""

import itertools
import threading

import pytest
from pyspark.sql import functions as F

from kbspark.operators import knowledge as K
from kbspark.operators import mining as M
from kbspark.operators import search as S
from kbspark.sources import records as R


def test_two_writers_from_one_version(spark, tmp_path):
    kb = R.KnowledgeBase(spark, f"file://{tmp_path}")
    assert kb.number() == 0
    with pytest.raises(LookupError):
        kb.current()
    first = kb.write({"a": spark.range(3)})
    second = kb.write({"a": spark.range(4)}, base=1)
    with pytest.raises(R.Conflict):
        kb.write({"a": spark.range(5)}, base=1)
    assert kb.number() == 2 and kb.current() == second != first and kb.table("a").count() == 4


def test_writers_at_once(spark, tmp_path):
    kb, done, lost = R.KnowledgeBase(spark, f"file://{tmp_path}"), [], []

    def write(n):
        try:
            done.append(kb.write({"a": spark.range(n)}, base=0))
        except R.Conflict:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and len(lost) == 3 and kb.current() == done[0] and kb.number() == 1


def test_failed_check_leaves_the_old_version(spark, tmp_path):
    kb = R.KnowledgeBase(spark, f"file://{tmp_path}")
    parent, child = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, 9)], "id int, up int")
    old = kb.write({"p": parent, "c": child.where("id > 1")}, [("c", "up", "p", "id")])
    with pytest.raises(ValueError):
        kb.write({"p": parent, "c": child}, [("c", "up", "p", "id")])
    assert kb.current() == old and kb.table("c").count() == 0


def test_tree_keys_equal_the_shares_of_all_pairs(spark):
    levels = [None, "", "a", "b"]
    trees = [(i, *t) for i, t in enumerate(itertools.product(levels, levels, levels))]
    df = spark.createDataFrame(trees, "id int, t1 string, t2 string, t3 string")
    a, b = M.tree_keys(df, "a").withColumnRenamed("id", "a"), M.tree_keys(df, "b").withColumnRenamed("id", "b").drop("tech")
    got = {(r.a, r.b): r.tech for r in a.join(b, "key").groupBy("a", "b").agg(F.max("tech").alias("tech")).collect()}
    want = {}
    for (i, *x), (j, *y) in itertools.product(trees, trees):
        both = [p == q for p, q in zip(x, y) if p and q]
        if any(both):
            want[i, j] = sum(both) / len(both)
    assert got == pytest.approx(want)


def test_technical_term_decides(spark):
    records = spark.createDataFrame([(1, 10, "pump seal leaking"), (2, 20, "pump seal worn"), (3, 30, "pump seal broken"), (4, 10, "PUMP  seal leaking"), (5, 10, "motor"), (6, 10, None)], "record_id int, equipment int, mode string")
    trees = spark.createDataFrame([(10, "A", "B", "C", "m", "x"), (20, "A", "B", None, "m", "x"), (30, "Z", "Y", "X", "m", "x")], "code int, t1 string, t2 string, t3 string, t4 string, t5 string")
    got = {r.record_id: r.root for r in M.mode_clusters(records, trees).collect()}
    # the wordings of 1 and 2 need their trees to agree, those of 1 and 3 do not get there
    assert got[1] == got[2] == 1 and got[3] == 3 and got[5] == 5 and 6 not in got


def enriched(spark):
    result = "struct<label: string, causes: array<struct<label: string, kind: string, basis_ids: array<bigint>>>, actions: array<struct<text: string, basis_ids: array<bigint>>>>"
    rows = [
        (1, "leak", {"label": " Seal ", "causes": [{"label": "wear", "kind": "provider_suggested", "basis_ids": [1, 2]}, {"label": "odd", "kind": "x", "basis_ids": [1, 99]}, {"label": " ", "kind": "", "basis_ids": [1]}, {"label": "air", "kind": "", "basis_ids": []}], "actions": [{"text": "", "basis_ids": [1]}, {"text": "renew", "basis_ids": [2]}]}),
        (2, "leak", {"label": " ", "causes": [], "actions": None}),
        (3, "leak", None),
    ]
    return spark.createDataFrame(rows, f"equipment int, mode string, result {result}"), spark.createDataFrame([(1, "leak", [1, 2]), (2, "leak", [3])], "equipment int, mode string, record_ids array<bigint>")


def test_suggestions(spark):
    causes, acts, labels, warnings = M.accept_suggestions(*enriched(spark))
    assert [(r.label, r.kind, r.basis_ids) for r in causes.collect()] == [("wear", "provider_suggested", [1, 2])]
    assert [(r.text, r.basis_ids) for r in acts.collect()] == [("renew", [2])]
    assert [(r.equipment, r.label) for r in labels.collect()] == [(1, "Seal")]
    assert sorted(r.warning for r in warnings.collect()) == ["dropped suggested action with blank text", "dropped suggested cause 'odd': unknown record ids 99", "dropped suggested cause with blank label", "dropped suggestion 'air' (no scope evidence)"]


def test_suggestions_join_the_ranking(spark):
    ranked = spark.createDataFrame([(1, "leak", "Rust", 3.0, 75.0), (1, "leak", "Age", 1.0, 25.0)], "scope_equipment int, mode string, label string, weight double, support_percent double")
    new = spark.createDataFrame([(1, "leak", "Wear", "k", 1.0)], "equipment int, mode string, label string, kind string, weight double")
    assert [(r.cause, r.support_percent, r.rank) for r in M.rerank(ranked, new).orderBy("rank").collect()] == [("Rust", 75.0, 1), ("Age", 25.0, 2), ("Wear", 20.0, 3)]


def test_index_equals_the_scan(spark, tmp_path):
    texts = ["the cat and the dog", "The end", "andThe rest", None, "", "cat " * 50 + "the", "no such"]
    rows = spark.createDataFrame([(i, i, i, f"t{i}", i % 2, t) for i, t in enumerate(texts)], "doc bigint, id bigint, parent_id bigint, title string, scope bigint, text string")
    index = S.write_index({"a": (rows, "text"), "b": (rows.where("id < 3"), "text")}, f"{tmp_path}/index", buckets=3)
    for words in (["the"], ["the", "and"], ["cat", "the"], ["absent"], ["the", "the"]):
        want = {r.id: round(r.relevance, 9) for r in S.bm25(rows, list(dict.fromkeys(words)), "text", ["id"]).collect()}
        assert {r.id: round(r.relevance, 9) for r in S.index_bm25(index, words, ["a"]).collect()} == want
    hits = S.text_search(index, ["the"], 10, within=spark.createDataFrame([(0,)], "scope bigint")).collect()
    assert {r.id for r in hits} == {0, 2} and len(hits) == 2
    stem = S.write_index({"a": (rows, "text")}, f"{tmp_path}/stem", normal=lambda t: F.regexp_replace(t, "s$", ""))
    assert {r.id for r in S.index_bm25(stem, ["cats"]).collect()} == {0, 5}


def test_guides_survive_json(spark, tmp_path):
    g = spark.createDataFrame([(1, "m", [{"rank": 1, "label": "تعویض", "percent": 66.66666666666667}], [3, 1], None), (2, "n", [], None, "x")], "equipment int, mode string, causes array<struct<rank: int, label: string, percent: double>>, ids array<bigint>, note string")
    K.export_guides(g, f"{tmp_path}/g")
    assert sorted(K.load_guides(spark, f"{tmp_path}/g", g.schema).collect()) == sorted(g.collect())
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"equipment": "not a number"}\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        K.load_guides(spark, f"{tmp_path}/bad", g.schema).collect()
