"""Small hand-written rows with known results."""

import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import batches as L
from kbspark.operators import chunking as D
from kbspark.operators import corpus as C
from kbspark.operators import mining as M
from kbspark.sources import records as R


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, ""), ("  a \n b ", "a b"), ("ي ك ة ۱۲٣", "ی ک ه 123"), ("كِتَاب", "کتاب"), ("مـــد", "مد")],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, T.normalize) == want


def test_tokens_and_tags(spark):
    assert one(spark, "ISO-VG68 X-AXIS, Ω a_b", T.tokens) == ["iso-vg68", "x-axis", "Ω", "a_b"]
    assert one(spark, "pump (Hot) (A) (hot)", T.parenthetical_tags) == ["a", "hot"]
    assert one(spark, "ab", T.char_ngrams) == ["ab"] and one(spark, " ", T.char_ngrams) == [] and one(spark, "a bcd", T.char_ngrams) == ["abc", "bcd"]
    assert one(spark, "① ﬁ", T.nfkc) == "1 fi"


@pytest.mark.parametrize(
    ("raw", "thinking", "rest"),
    [("<think>a</think>b", "a", "b"), ("a</think> b", "a", "b"), ("b <think>a", "a", "b"), ("b", "", "b"), ("<think>a</think>x<think>c</think>y", "a\n\nc", "xy")],
)
def test_thinking(spark, raw, thinking, rest):
    assert one(spark, raw, lambda c: T.thinking_split(c)[0]) == thinking and one(spark, raw, lambda c: T.thinking_split(c)[1]) == rest


def test_content_type(spark):
    page = "<!DOCTYPE html><html><head></head><body><div><p>x</p></div></body></html>"
    assert one(spark, page, T.content_type) == "html" and one(spark, "short", T.content_type) == "plain"
    assert one(spark, page, lambda c: T.content_type(c, F.lit("a.txt"))) == "html"
    assert one(spark, "# a\n\n# b\n\n# c\n\n- x\n- y\n- z", T.content_type) == "markdown"
    assert float(one(spark, page, T.html_score)) == pytest.approx(1.0)


def test_chunker(spark):
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(60)) + "." for i in range(40))
    parts = D.split_plain(text, 100)
    assert all(D.estimate(p) <= 100 for p in parts) and set(text.split()) == {w for p in parts for w in p.split()}
    assert all(len(p) <= 4000 for p in D.split_plain("x" * 50_000, 100))
    rows = [(1, text), (2, "  "), (3, None), (4, "tiny"), (5, "# A\nx\n## B\n" + text)]
    got = D.chunk(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    n = {r.id: r["count"] for r in got.groupBy("id").count().collect()}
    assert set(n) == {1, 4, 5} and n[4] == 1 and n[1] > 1
    assert {r.id: r.m for r in got.groupBy("id").agg(F.max("ord").alias("m")).collect()} == {k: v - 1 for k, v in n.items()}


def test_embedding(spark):
    calls = []

    def flaky(texts):
        calls.append(1)
        return [[0.0]] * (len(texts) - 1)

    rows = spark.createDataFrame([(1, "a"), (1, "b")], "id int, t string")
    with pytest.raises(Exception, match="vectors for"):
        D.embed(rows, "t", flaky).collect()
    v = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0]), (2, [0.0, 0.0])], "id int, embedding array<double>")
    assert D.mean_pool(v, "id").collect()[0].embedding == pytest.approx([0.70710678, 0.70710678])


def test_batches(spark):
    def sizes(n, words=3):
        r = [(1, "m", i, " ".join(["w"] * words)) for i in range(n)]
        p = L.plan_batches(spark.createDataFrame(r, "equipment int, failure_mode string, source_record_id int, source_text string"))
        return [x["count"] for x in p.groupBy("batch_id").count().orderBy("batch_id").collect()]

    assert sizes(12) == [12] and sizes(24) == [12, 12] and sizes(25) == [12, 12, 1] and sizes(2, 5000) == [1, 1]


def test_categories(spark):
    got = one(spark, "Repaired connector and checked it", M.match_categories)
    assert got[0] == "repair" and "check" in got
    assert one(spark, "nothing here", M.match_categories) == []


def test_fuzzy_blocks_tags(spark):
    w = spark.createDataFrame([(1, "pump seal leaking", ["a"]), (2, "pump seal leakin", []), (3, "pump seal leaking!", ["b"]), (4, "motor noise", [])], "id int, text string, tags array<string>")
    assert {(r.a, r.b) for r in M.fuzzy_pairs(w).collect()} == {(1, 2), (2, 3)}
    assert {r.id: r.root for r in M.cluster(w, M.fuzzy_pairs(w)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_ordering():
    with pytest.raises(ValueError):
        C.ordering("id; drop", ["id"])
    with pytest.raises(ValueError):
        C.ordering("secret", ["id"])


def test_mapping(spark):
    assert R.resolve(["Code", " equipment  name "], {"code": ["code"], "name": ["equipment name", "code"]}) == {"code": "Code", "name": " equipment  name "}
    df = spark.createDataFrame([("a", "n", "z")], "`Code` string, `Name` string, `Odd` string")
    m = R.map_columns(df, {"code": ["code"], "name": ["name"], "maker": ["maker"]}).first()
    assert (m.code, m.name, m.maker, m.extra) == ("a", "n", None, {"Odd": "z"})


def test_knowledge_base(spark, tmp_path):
    kb = R.KnowledgeBase(spark, str(tmp_path))
    a, b = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, 1), (2, 9)], "id int, a int")
    first = kb.write({"a": a, "b": b.where("id = 1")}, [("b", "a", "a", "id")])
    with pytest.raises(ValueError):
        kb.write({"a": a, "b": b}, [("b", "a", "a", "id")])
    assert kb.current() == first and kb.table("b").count() == 1


def test_evidence_skips_unrelated(spark):
    trees = spark.createDataFrame([(1, "c", "s", "t", "m", "x"), (2, "c", "s", "t", "m", "x"), (3, "c", "s", "t", "m", "y"), (4, "q", "r", "u", "v", "w")], "code int, t1 string, t2 string, t3 string, t4 string, t5 string")
    records = spark.createDataFrame([(i, e, "leak", "wear", None) for i, e in enumerate([1, 2, 3, 4])], "record_id int, equipment int, mode string, cause string, mechanism string")
    c = M.rank_causes(M.causes(M.evidence(records, trees)))
    got = {r.scope_equipment: (r.records, r.share, float(r.similarity)) for r in c.collect()}
    assert got == {1: (3, 1.0, 1.0), 2: (3, 1.0, 1.0), 3: (3, 1.0, 1.0), 4: (1, 1.0, 1.0)}


def test_signed_counts_equal_pairs(spark):
    """Trees whose levels do not nest, with missing keys: counts by category equal those of listed pairs."""
    rows = [(i, [None, "a", "b"][i % 3], ["s", "t"][i % 2], [None, "x", "y", "z"][i % 4], ["m", None, "n"][i // 5 % 3], [None, "p", "q"][i // 3 % 3]) for i in range(40)]
    trees = spark.createDataFrame(rows, "code int, t1 string, t2 string, t3 string, t4 string, t5 string")
    listed = M.equipment_pairs(trees).groupBy("a", "category").count().collect()
    assert {(r.code, r.category, r.codes) for r in M.partner_counts(trees).collect()} == {(r.a, r.category, r["count"]) for r in listed}
    near = {r.a: (r.nearest, r.rank) for r in M.nearest_equipment(trees).collect()}
    want: dict = {}
    for r in M.equipment_pairs(trees).where("a <> b").collect():
        want[r.a] = min(want.get(r.a, (9, 0)), (r.rank, r.b))
    assert near == {a: (b, rank) for a, (rank, b) in want.items()}


def test_words_of_categories(spark):
    said = {"وتعویض قطعه": "replace", "قطعه": "", "rechecked": "", "Checked and fixes": "repair,check", "سیم کشی": "connect", "parameter change": "parameter_change", "change parameter": "", "وصل": "connect", "و": "", "تعویض و تمیز شد": "replace,clean", "سنسور تنظیم و تست شد": "adjust,test", "تغییر پارامتر و تست": "parameter_change,test", "پارامتر عوض شد": "parameter_change", "وپارامتر عوض": "", "بای پس": "bypass", "هم محور": "align", "نرم افزار": "configure", "calibrating meters": "calibrate,measure"}
    df = spark.createDataFrame([(k,) for k in said], "s string").select("s", F.array_join(M.match_categories(F.col("s")), ",").alias("c"))
    assert {r.s: r.c for r in df.collect()} == said
    undone = "تعویض بلبرینگ انجام نشد سنسور تنظیم و تست و تحویل شد"
    rows = spark.createDataFrame([(undone,), (undone.replace("نشد", "شد"),), (undone.replace("سنسور ", ""),)], "s string").select(M.guide_instruction(F.col("s")).alias("i")).collect()
    assert rows[0].i == "در صورت عدم تعویض بلبرینگ، سنسور بررسی و در صورت لزوم تنظیم گردد." and rows[1].i is None and rows[2].i is None
