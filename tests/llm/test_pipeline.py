"""The pipeline on a small table, and the registered queries on the smallest driver tables."""

import collections
import hashlib
import os
import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kbspark.llm import bpe, simhash, toxicity

tiktoken = pytest.importorskip("tiktoken")
SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert 0 < len(rows) <= 3 * docs.count()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def left_by_brute_force(texts):
    """Each text without the strings of 51 words that occur twice."""
    words = [[(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    seen = collections.Counter(tuple(w[2] for w in x[i : i + 51]) for x in words for i in range(len(x) - 50))
    out = []
    for t, x in zip(texts, words):
        hit = set()
        for i in range(len(x) - 50):
            if seen[tuple(w[2] for w in x[i : i + 51])] > 1:
                hit.update(range(i, i + 51))
        kept, at = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                kept += (t or "")[at : x[i][0]]
            at = x[i][1]
        out.append(kept + (t or "")[at:])
    return out


def stage_against_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    got = {r.doc_id: (r.text, r.n_chars, r.kept) for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    want = {}
    for i, (t, left) in enumerate(zip(texts, left_by_brute_force(texts))):
        if left == (t or "") or left.strip():
            want[i] = (t if left == (t or "") else left, len(left), "own")
    assert got == want
    return got


def test_dedup_stage_by_brute_force(spark):
    random.seed(21)
    words = lambda n: " ".join("".join(random.choice("abcdefghij") for _ in range(random.randrange(3, 8))) for _ in range(n))
    passages = [words(n) for n in (52, 60, 45, 80, 12)]
    texts = [words(random.randrange(5, 60)) + f" {random.choice(passages)} " + words(random.randrange(5, 60)) for _ in range(30)] + [passages[3]] * 2 + [None, "", "short", words(300)]
    got = stage_against_brute_force(spark, texts)
    assert not any(p in (v[0] or "") for v in got.values() for p in (passages[0], passages[1], passages[3]))
    assert any(passages[2] in (v[0] or "") for v in got.values())
    docs = spark.createDataFrame([(1, "x", 1)], "doc_id bigint, text string, n_chars bigint")
    assert corpus_pipeline.drop_repeats(spark, docs.limit(0), "").count() == 0


def test_dedup_stage_counts_words(spark):
    """Passages of very short words, of 50 and 51 words, in other white space, in parts of words, of characters of many bytes, twice in one text, and of one word."""
    random.seed(22)
    word = lambda letters, n: " ".join(random.choice(letters) for _ in range(n))
    tiny, fifty, wide = word("abcdefghijkl", 51), word("mnopqrstuv", 50), word(["é", "漢", "字x", "ß"], 70)
    texts = [f"one {tiny} two", f"three\n{tiny} four", f"five {fifty} six", f"seven {fifty} eight", tiny.replace(" ", "\t\n"), f"pre{tiny}post", f"{wide} alpha {wide}", f"\x0b{wide}\r\n", "same " * 60, "same " * 51, "same " * 50, "x" * 900, "x" * 900, " \n ", f"{fifty} end", f"{fifty} end"]
    got = stage_against_brute_force(spark, texts)
    assert got[0][0] == "one  two" and got[1][0] == "three\n four" and 4 not in got and got[5][0] == texts[5]
    assert got[2][0] == texts[2] and got[6][0] == " alpha " and 7 not in got and 8 not in got and 9 not in got and 10 in got and 11 in got and 14 not in got


CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score double, predicted int, _simhash string, _row int, row string, size int, taken int, copies int, n_tokens string"


def clashing(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "own", 0.5, 7, "sim", -i, "row", -1, -2, -3, "own") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, *rows[1][1:])], CLASHING)


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def odd_texts():
    random.seed(31)
    words = [" ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(random.randrange(50)) for _ in range(n)) for n in (3, 40, 40, 90, 200)]
    return [None, "", " \n ", "one", words[1], words[1], words[1] + " ", words[3], words[3].upper(), words[4], words[2], "word " * 30_000, words[0], words[0]]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")
def test_toxicity_stage(spark, odd_texts):
    """What the classifier rejects goes, and all else stays as it was, columns named like the classifier's too."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    toxic = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").join(labels.where("toxic = 1"), "doc_id").select("text").limit(20).collect()]
    docs = clashing(spark, odd_texts + toxic)
    model = toxicity.fit_on(docs, labels)
    got = rows_of(corpus_pipeline.drop_toxic(spark, docs, SMALL))
    want = collections.Counter(tuple(r) for r in docs.collect() if next(iter(model.score_all([r.text]))) < toxicity.THRESHOLD)
    assert got == want and corpus_pipeline.drop_toxic(spark, docs.limit(0), SMALL).count() == 0


def test_near_copies_stage(spark, odd_texts):
    docs = clashing(spark, odd_texts)
    rows = [tuple(r) for r in docs.collect()]
    prints = [simhash.fingerprint(r[1]) & (1 << 64) - 1 for r in rows]
    low = list(range(len(rows)))
    for _ in rows:
        low = [min(low[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(rows))]
    want = collections.Counter(min((r for r, k in zip(rows, low) if k == c), key=lambda r: (r[0] is None, r[0])) for c in set(low))
    assert rows_of(corpus_pipeline.drop_near_copies(spark, docs, "")) == want and len(want) < len(rows)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_mix_stage(spark, odd_texts):
    docs = clashing(spark, odd_texts)
    own = rows_of(docs)
    got = rows_of(corpus_pipeline.mix_sources(spark, docs, ""))
    assert got and all(n <= 3 * own[r] for r, n in got.items()) and not any((r[1] or "").split() == [] for r in got)
    assert got == rows_of(corpus_pipeline.mix_sources(spark, docs, "")) and corpus_pipeline.mix_sources(spark, docs.limit(0), "").count() == 0


def test_encode_stage(spark, odd_texts):
    """Ids as tiktoken gives them for each piece; the last stage's own columns take the place of others of these names."""
    P = pytest.importorskip("public_tokenizers")
    docs = clashing(spark, odd_texts)
    out = corpus_pipeline.encode(spark, docs, "")
    assert sorted(out.columns) == sorted({*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"})
    coder = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in out.collect():
        ids = coder.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r.score == 0.5
    assert out.count() == docs.count() and corpus_pipeline.encode(spark, docs.limit(0), "").count() == 0
