"""One small case for each finding of round 3."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import batches as B
from kbspark.operators import chunking as D
from kbspark.operators import knowledge as K
from kbspark.operators import mining as M
from kbspark.operators import search as S
from kbspark.plans import registry

TREES = "code long, t1 string, t2 string, t3 string, t4 string, t5 string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_records(spark):
    r = [(i, i % 4, f"m{i % 2}", "seal" if i % 3 else "bolt", "wear", "gloves", "drip", f"replaced seal {i}. tested") for i in range(40)]
    records = spark.createDataFrame(r, "record_id long, equipment long, mode string, cause string, mechanism string, safety string, symptom string, repair_text string")
    trees = spark.createDataFrame([(i, "c", "s", f"t{i % 2}", "m", f"m-{i}") for i in range(4)], TREES)
    return records, trees


def test_evidence_is_not_broadcast(spark):
    """Only the table of signs, of a fixed size, goes to all executors."""
    records, trees = some_records(spark)
    p = plan(M.evidence(records, trees))
    assert "SortMergeJoin" in p and p.count("BroadcastHashJoin") == 1
    assert "BroadcastHashJoin" not in plan(M.scope_records(records, trees))


def test_highlight_ascii_boundaries(spark):
    """a letter outside ASCII ends a word, as in the SQL."""
    df = spark.createDataFrame([("éla the_ Deŕ voilà la",)], "t string")
    assert df.select(T.highlight(F.col("t"), ["the", "la", "der"]).alias("x")).first()[0] == "é`la` the_ `Der`́ voilà `la`"


def test_embed_long_keeps_zero_vectors(spark):
    """a text whose vector is zero has a row, a text of line ends has none; a long document keeps its one vector."""
    flat = lambda texts: [[0.0, 0.0] if "zero" in t else [3.0, 4.0] for t in texts]
    docs = spark.createDataFrame([(1, "zero"), (2, "\n\r\t "), (3, "word " * 500), (4, None), (5, " ")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in D.embed_long(docs, "id", "text", flat).collect()}
    assert set(got) == {1, 3, 5} and got[1] == [0.0, 0.0] and abs(got[3][0] - 0.6) < 1e-9


def conversations(folder, rows):
    pq.write_table(pa.table({"conv_id": [r[0] for r in rows], "turn": [r[1] for r in rows], "role": ["user"] * len(rows), "text": ["hello there"] * len(rows)}), f"{folder}/conversations.parquet")


def test_embed_long_of_long_conversations(spark, tmp_path):
    """turn 1000 of a conversation has the id of the next one's first turn, and both have a row."""
    conversations(tmp_path, [(1, 1000), (2, 0), (2, 1)])
    got = registry.QUERIES["d9_embed_long"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["width"]) for r in got) == [(2000, 64), (2000, 64), (2001, 64)]


def test_long_document_of_one_chunk(spark, tmp_path):
    """a document over the size whose other pieces are too small has one short chunk, and is still a long one."""
    long = "".join(f"# {x}\nhi\n\n" for x in "abcd") + "# z\n" + "word " * 300
    pq.write_table(pa.table({"doc_id": [2, 3], "text": [long, "short one"]}), f"{tmp_path}/documents.parquet")
    got = {r["source_id"]: r["chars"] for r in registry.QUERIES["m1_incremental_chunks"](spark, str(tmp_path)).collect()}
    assert got == {2: None, 3: 9.0}


def test_pieces_come_in_small_batches(spark):
    """What is made of a batch is passed on text by text, not as a whole."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(["a b"] * 1000)], names=["key", "text"])
    out = list(D._pieces(iter([batch]), lambda row: row["text"].split(), "ord", ["key"]))
    assert max(x.num_rows for x in out) <= 2 * D.TEXTS and sum(x.num_rows for x in out) == 2000


def test_texts_meet_lists_once(spark):
    """scopes that show the same records share one list, and the texts are joined to the list."""
    records, trees = some_records(spark)
    shown = M.scope_records(records, trees, 3)
    assert {tuple(r["record_ids"]) for r in shown.collect()} == {(0, 2, 4), (1, 3, 5)}
    got = M.enrichment_input(shown, records)
    assert all(len(r["refs"]) == 3 and r["refs"][0]["record_id"] < 2 for r in got.collect()) and got.count() == 4
    assert "record_ids" in plan(got).split("Join", 1)[1].split("\n", 1)[0]


def test_shared_texts_are_taken_apart_once(spark):
    """Records that share a text give the rows of whole repair texts, and the text is taken apart once."""
    texts = spark.createDataFrame([(0, "Replaced seal. tested pump\nreplaced  seal"), (1, None), (2, "")], "text_id long, text string")
    r = [(i, i % 2, "m" if i % 5 else None, "c", "w", i % 3, ["\nreplaced seal. cleaned.", "\n", None, "\nتست شد. تست شد."][i % 4]) for i in range(24)]
    r = spark.createDataFrame(r, "record_id long, equipment long, mode string, cause string, mechanism string, text_id long, repair_text string")
    whole = r.join(texts, "text_id").withColumn("repair_text", F.concat("text", "repair_text"))
    apart = M.Sentences(r, texts)
    rows = lambda df: sorted(map(str, df.select("record_id", "pos", "original", "text", "again", "kinds", "category", "said").collect()))
    assert rows(apart.where()) == rows(M.sentence_rows(whole)) and apart.where().count() > 20
    assert apart.shared.count() == 2 and apart.own.count() < r.count()
    assert rows(apart.where(M.marked)) == rows(M.sentence_rows(whole).where(M.marked({c: F.col(c) for c in ("text", "category")})))


def test_postings_are_shuffled_once(spark):
    """words are counted in their text's own row, so that postings alone meet a shuffle, and equal a count of all words."""
    texts = ["b a b", "", "  ", "the The the2 theThe", "ä a ä", "x " * 3000, None]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "kind string, doc long, text string").withColumn("terms", S.terms(F.col("text")))
    got = S.postings(df, 16)
    assert plan(got).count("Exchange hash") == 1 and "HashAggregate" not in plan(got)
    words = [r["terms"] or [] for r in df.orderBy("doc").collect()]
    want = {(i, w): (n, len(ws)) for i, ws in enumerate(words) for w, n in Counter(ws).items()}
    assert {(r["doc"], r["term"]): (r["tf"], r["len"]) for r in got.collect()} == want and got.count() == len(want)


def shared_texts(spark):
    texts = spark.createDataFrame([(0, "Replaced seal. tested pump\nreplaced  seal. pump"), (1, None), (2, "fixed.")], "text_id long, text string")
    r = [(i, i % 2, "m" if i % 5 else None, "c", "w", " gloves", "drip", i % 3, ["\nreplaced seal. cleaned. tested pump", "\n", None, "\nتست شد. fixed"][i % 4]) for i in range(24)]
    r = spark.createDataFrame(r, "record_id long, equipment long, mode string, cause string, mechanism string, safety string, symptom string, text_id long, repair_text string")
    trees = spark.createDataFrame([(i, "pump", "s", f"t{i}", "m", f"m-{i}") for i in range(2)], TREES)
    return r, texts, trees, r.join(texts, "text_id").withColumn("repair_text", F.concat("text", "repair_text"))


def test_knowledge_tables_of_shared_texts(spark):
    """the knowledge base takes a shared text apart once, has the tables of whole repair texts, and joins no large table by broadcast."""
    r, texts, trees, whole = shared_texts(spark)
    got, want = K.knowledge_tables(whole, trees, (r, texts)), K.knowledge_tables(whole, trees)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for t in want:
        assert t == "analysis_runs" or rows(got[t]) == rows(want[t]), t
    assert rows(got["repair_actions"]) and rows(got["guide_verifications"])
    for t in ("equipment", "cause_repair_actions", "cause_evidence", "guide_sections", "guide_verifications"):
        assert "BroadcastHashJoin" not in plan(got[t]), t


def test_sentences_without_again(spark):
    """Rows that need not know whether a sentence was said before carry no text to the records, and are the same rows; h3's leave out sentences without a category."""
    r, texts, trees, whole = shared_texts(spark)
    apart = M.Sentences(r, texts)
    rows = lambda df: sorted(map(str, df.select(sorted(set(df.columns) - {"again"})).collect()))
    for keep in (None, M.marked, M.instructive, lambda x: x["category"].isNotNull()):
        got = apart.where(keep, False)
        assert "again" not in got.columns and rows(got) == rows(apart.where(keep))
        assert "array_contains(texts" not in plan(got)
    roles = lambda a: rows(M.with_roles(a).where("role = 'verification'").select("record_id", "pos", "role"))
    known = M.admitted(apart, trees, keep=lambda x: x["category"].isNotNull(), again=False)
    assert roles(known) == roles(M.admitted(M.sentence_rows(whole), trees)) != []
    short = lambda a: rows(a.where(F.char_length("text") < M.SHORT).select("record_id", "pos", "text"))
    assert short(M.admitted(apart, trees, keep=lambda x: F.char_length(x["text"]) < M.SHORT, again=False)) == short(M.admitted(M.sentence_rows(whole), trees)) != []


def test_repair_texts_are_taken_apart_behind_the_shuffle(spark):
    """No condition takes a text apart a second time, which it did before the rows of a table were spread."""
    p = plan(M.own_sentences(shared_texts(spark)[0].repartition(4, "record_id"), True))
    assert "transform(" in p and not any("transform(" in x for x in p.splitlines() if "Filter" in x)
    before = p.split("Exchange", 1)[1]
    assert "transform(" not in before


def test_batches_take_known_numbers_of_words(spark):
    """The planner's query counts words in documents, so that no record carries its text."""
    rows = spark.createDataFrame([("e", "m", i, " ".join(["w"] * (100 * i % 4700))) for i in range(200)] + [("e", None, 1, None)], "equipment string, failure_mode string, source_record_id bigint, source_text string")
    counted = B.plan_batches(rows).drop("tokens")
    given = B.plan_batches(rows.withColumn("n", F.regexp_count("source_text", F.lit(r"\S+"))).withColumn("source_text", F.lit("")), words=F.col("n")).drop("tokens")
    assert sorted(map(str, counted.collect())) == sorted(map(str, given.collect()))


def test_evidence_of_asked_scopes_alone(spark):
    records, trees = some_records(spark)
    asked = spark.createDataFrame([(0, "m0"), (3, "m1"), (9, "m0"), (0, None)], "scope_equipment long, mode string")
    every = M.evidence(records, trees).join(asked, ["scope_equipment", "mode"], "left_semi")
    assert sorted(map(str, M.evidence(records, trees, asked).select(every.columns).collect())) == sorted(map(str, every.collect()))
    assert every.count()
