"""Each operator against a plain version on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import gzip
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kbspark.llm import bm25, bpe, common, html, mixing, ngrams, pivots, repeats, simhash, toxicity, warc

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

TEXTS = [None, "", "  \n\t ", "one", "one two", "One TWO three four", "One two three four", "x" * 5000, "a b c " * 400, "naïve ΑΒΓ 日本語 🙂", "one two three four five six seven eight nine ten"] + ["one two three four five six seven eight nine ten"] * 3
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score double"


def table(spark, texts=TEXTS):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "own", 0.0) for i, t in enumerate(texts)]
    rows += rows[-1:]  # a repeated row
    rows.append((None, "one two", None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def classes(ids, edges):
    low = {i: i for i in ids}
    while True:
        moved = False
        for a, b in edges:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
        if not moved:
            return low


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 400 + i) for i in range(40)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges + edges[:3], "a bigint, b bigint")).collect()}
    want = classes({x for e in edges for x in e}, edges)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k not in loops}
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1


def toxic_table(spark, n=400):
    random.seed(1)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = random.choices(words, k=40) + (random.sample(["awful", "vilea", "vileb", "vilec", "nasty", "horrid"], 4) if bad else [])
        random.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(n, None), (n + 1, ""), (None, "awful nasty horrid vilea")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels + [(5, None), (7, 0)], "doc_id bigint, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.with_score(docs, toxicity.fit_on(docs, labels)).collect()
    pred = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id < 400}
    assert sum(pred[i] == (i % 5 == 0) for i in pred) >= 392
    assert all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).predicted == 1 and next(r for r in got if r.doc_id == 401).predicted == 0
    flat = toxicity.with_score(table(spark), toxicity.fit_on(docs, labels.limit(0)))
    assert flat.select("score").distinct().count() == 1 and flat.columns[-2:] == ["score", "predicted"]
    assert toxicity.with_score(empty(spark), toxicity.fit_on(docs, labels)).count() == 0


def test_toxicity_counts_every_row(spark):
    docs, labels = toxic_table(spark)
    copies = docs.where("doc_id = 5").crossJoin(spark.range(1000, 1040)).selectExpr("id as doc_id", "text")
    known = docs.unionByName(copies).join(labels.where("toxic is not null").unionByName(copies.selectExpr("doc_id", "1 as toxic")), "doc_id").where("doc_id is not null")
    rows = [(frozenset(f for w in toxicity.words_of(r.text) for f in toxicity.features_of_word(w)), r.toxic) for r in known.collect()]
    seen = known.selectExpr("text", "toxic", "0.0D as draw").mapInArrow(toxicity._extract, "features array<int>, sketch bigint, toxic int, loud boolean, capitals boolean, draw double")
    got = toxicity._counted(toxicity._weighed(seen).selectExpr("features", "if(toxic = 1, weight, 0D) as up", "if(toxic = 0, weight, 0D) as down")).collect()
    alike = collections.Counter((tuple(sorted(f)[: toxicity.SKETCH]), t) for f, t in rows)
    up, down = collections.Counter(), collections.Counter()
    for f, t in rows:
        for x in f:
            (up if t else down)[x] += 1 / alike[tuple(sorted(f)[: toxicity.SKETCH]), t]
    want = {x: (up[x], down[x]) for x in {*up, *down} if up[x] + down[x] > 2.999}
    assert {r.feature & 0xFFFFFFFF for r in got} == set(want)
    assert all(abs(r.up - want[r.feature & 0xFFFFFFFF][0]) < 1e-9 and abs(r.down - want[r.feature & 0xFFFFFFFF][1]) < 1e-9 for r in got)


def test_toxicity_votes(spark):
    texts = ["awful day", "nasty!! AWFUL", "A LONG TEXT IN CAPITAL LETTERS", "", None, "plain"]
    entry = {w: toxicity.features_of_word(w)[0] for w in ("awful", "nasty")}
    signed = {int(np.uint32(f).view(np.int32)): v for v, f in enumerate(entry.values())}
    got = toxicity.votes_of(spark.createDataFrame([(t,) for t in texts], "text string"), signed).collect()
    assert [r.pattern for r in got] == [1, 3 | 1 << toxicity.VOTERS - 2, 1 << toxicity.VOTERS - 1, 0, 0, 0]
    assert got[3].same == got[4].same != got[5].same


def test_label_model_counts_patterns():
    v = np.array([[1, 1, 0], [0, 0, 0], [1, 0, 0], [0, 1, 1]], float)
    times = np.array([30, 900, 9, 12])
    a, b = toxicity.LabelModel().fit(v, times), toxicity.LabelModel().fit(np.repeat(v, times, axis=0))
    assert np.allclose(a.posterior(v), b.posterior(v)) and np.allclose(a.weight, b.weight)


def test_label_model_weighs_copies_down():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    v = np.where(y[:, None], rng.random((4000, 5)) < 0.7, rng.random((4000, 5)) < 0.03).astype(float)
    v = np.concatenate([v, v[:, :1], v[:, :1]], axis=1)
    m = toxicity.LabelModel().fit(v)
    assert m.weight[0] < 0.6 < m.weight[1] and abs(m.fires_toxic[1] - 0.7) < 0.1
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.97


# --- 2


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark):
    random.seed(2)
    base = [random.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(random.randrange(50)) for _ in range(300)]
    near = []
    for _ in range(25):
        w = list(base)
        for _ in range(random.randrange(4)):
            w[random.randrange(len(w))] = "zz"
        near.append(" ".join(w))
    docs = table(spark, TEXTS + near)
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    fp = [slow_fingerprint(r.text) for r in rows]
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((r.doc_id, f"{f:016x}") for r, f in zip(rows, fp))
    low = classes(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[low[i]].append(r.doc_id)
    want = {(r.doc_id, min(x for x in ids[low[i]] if x is not None)) for i, r in enumerate(rows)}
    assert {(r.doc_id, r.component_id) for r in got} == want
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(ids)
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one_of_each(empty(spark)).count() == 0


# --- 3


def test_bm25(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD", 7)
    monkeypatch.setattr(bm25, "BLOCK", 2)
    random.seed(3)
    texts = TEXTS + [" ".join(random.choices("red blue green old new bolt gear rod plate ring".split(), k=random.randrange(1, 30))) for _ in range(40)]
    docs = table(spark, texts)
    got = collections.defaultdict(list)
    for r in bm25.search(docs, docs.where("doc_id % 5 = 0"), k=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.score)
    rows = docs.collect()
    terms = [collections.Counter(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in rows]
    n, df = len(rows), collections.Counter(w for t in terms for w in t)
    mean = sum(sum(t.values()) for t in terms) / n
    for i, r in enumerate(rows):
        if r.doc_id is None or r.doc_id % 5:
            continue
        s = [sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * sum(t.values()) / mean)) for w in terms[i] if w in t) for t in terms]
        assert got[r.doc_id] == pytest.approx(sorted((x for x in s if x > 0), reverse=True)[:4])
    assert bm25.search(empty(spark), empty(spark)).count() == 0


def test_bm25_ties_go_by_doc_id(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD", 12)
    monkeypatch.setattr(bm25, "BLOCK", 2)
    random.seed(13)
    kinds = [" ".join(random.choices("red blue green old new bolt gear rod plate ring nut pin cap".split(), k=random.randrange(3, 25))) for _ in range(12)]
    texts = [random.choice(kinds) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = collections.defaultdict(list)
    for r in bm25.search(docs, docs.where("doc_id % 5 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.doc_id))
    terms = [collections.Counter(t.split()) for t in texts]
    df, mean = collections.Counter(w for t in terms for w in t), sum(sum(t.values()) for t in terms) / len(terms)
    for i in range(0, 120, 5):
        s = [round(sum(math.log(1 + (120 - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * sum(t.values()) / mean)) for w in terms[i] if w in t), 9) for t in terms]
        want = sorted((j for j in range(120) if s[j] > 0), key=lambda j: (-s[j], j))[:10]
        assert got[i] == list(enumerate(want, 1))


def test_block_max_skips():
    rng = np.random.default_rng(1)
    terms = [np.unique(rng.integers(0, 50, 5)).astype(np.uint64) for _ in range(640)] + [np.array([60, 61, 62], np.uint64)] * 3
    index = bm25.ShardIndex(terms, [np.ones(len(t), np.int64) for t in terms], 5.0)
    best, _, opened = index.search(np.array([60, 61, 62, 1], np.uint64), np.array([9.0, 9, 9, 0.1]), 3)
    assert set(best) == {640, 641, 642} and opened < 50


# --- 4


def test_bpe(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    docs = table(spark, TEXTS + ["é" * 3000, " " * 200, "<|endoftext|> it's 12345"])
    got = bpe.encode_documents(docs, path, P.PATTERN, keep_ids=True)
    for r in got.collect():
        want = public.encode_ordinary(r.text or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_documents(empty(spark), path, P.PATTERN).count() == 0
    random.seed(4)
    e = bpe.encoder_of(path)
    for _ in range(100):
        d = "".join(random.choice("theingonat é日") for _ in range(40)).encode()
        x = bpe.EditableEncoding(e, d[:15])
        x.append(d[15:25])
        x.replace(4, 9, d[25:])
        new = d[:4] + d[25:] + d[9:25]
        assert x.tokens() == bpe.EditableEncoding(e, new).tokens() and e.decode(x.tokens()) == new


# --- 5


def test_ngrams(spark):
    random.seed(6)
    texts = TEXTS + [" ".join(random.choices("Red blue green old new bolt gear".split(), k=30)) for _ in range(60)]
    docs = table(spark, texts)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    got = ngrams.score(docs, held).collect()
    out = {r.doc_id: (r.held_out, r) for r in got}
    tokens = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) + [None]) for r in docs.collect()]
    c = collections.Counter(w for i, t in tokens if not out[i][0] for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(tokens)
    for i, t in tokens:
        r = out[i][1]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0
    assert ngrams.score(empty(spark), held).count() == 0
    assert ngrams.score(docs, F.lit(True)).where("train_tokens = 0 and score <= 0").count() == len(tokens)


def brute_weights(batches, n_words, v):
    """Weights from each batch under the counts of all others, without rounding. batches: lists of token lists of training texts."""
    pairs = [collections.Counter((a, b) for t in x for a, b in zip([0, *t], t)) for x in batches]
    words = [collections.Counter(w for t in x for w in t) + collections.Counter({0: len(x)}) for x in batches]
    all2, all1 = sum(pairs, collections.Counter()), sum(words, collections.Counter())
    rows = collections.defaultdict(list)
    for c2, c1 in zip(pairs, words):
        for (a, b), times in c2.items():
            seen, rest = all1[a] - c1[a], n_words - (sum(c1.values()) - c1[0])
            rows[math.floor(math.log2(seen)) + 1 if seen else 0].append(((all2[a, b] - c2[a, b]) / max(seen, 1), (all1[b] - c1[b]) / max(rest, 1), times))
    return {k: ngrams.bucket_weights(k, *(np.array(c, float) for c in list(zip(*r))[:2]), 1 / (v + 1), np.array([x[2] for x in r], float)) for k, r in rows.items()}


def test_ngram_scores_by_brute_force(spark, monkeypatch, tmp_path):
    random.seed(16)
    docs = table(spark, TEXTS + [" ".join(random.choices("Red blue green old new bolt gear".split(), k=random.randrange(40))) for _ in range(150)])
    docs.repartitionByRange(5, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    learned, plain = {}, ngrams.all_buckets
    monkeypatch.setattr(ngrams, "all_buckets", lambda known: learned.update(known) or plain(known))
    got = ngrams.score(docs, held).collect()
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    rows = docs.withColumn("held", held).collect()
    packed = docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(ngrams.pack(20_000), "batch bigint, docs binary").collect()
    batches = {r.batch: [split(t) for t, h in zip(*(pa.ipc.open_stream(r.docs).read_all().column(c).to_pylist() for c in ("text", "held_out"))) if not h] for r in packed}
    assert len(batches) > 2
    train = [t for x in batches.values() for t in x]
    c1, c2 = collections.Counter(w for t in train for w in t), collections.Counter((a, b) for t in train for a, b in zip([0, *t], t))
    n, v = sum(c1.values()), len(c1)
    want = brute_weights(list(batches.values()), n, v)
    assert set(want) == set(learned) and all(learned[k] == pytest.approx(want[k], abs=0.03) for k in want)
    weights = plain(learned)
    c1[0] = len(train)
    expected = []
    for r in rows:
        t, total = split(r.text), 0.0
        for a, b in zip([0, *t], t):
            w = weights[math.floor(math.log2(c1[a])) + 1 if c1[a] else 0]
            total += math.log10(w[0] * c2[a, b] / max(c1[a], 1) + w[1] * (c1[b] if b != 0 else 0) / n + w[2] / (v + 1))
        expected.append((r.doc_id is None, r.doc_id, total))
    assert [x[2] for x in sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in got)] == pytest.approx([x[2] for x in sorted((a, b or 0, c) for a, b, c in expected)])


def test_weights_are_learned():
    b, p2, p1 = np.array([0, 3, 3, 5]), np.array([0.0, 0.5, 0.0, 0.9]), np.array([0.01, 0.01, 0.02, 0.001])
    w = ngrams.learn_weights(b, p2, p1, 1e-4, np.array([100.0, 80, 20, 50]))
    assert w.sum(1) == pytest.approx(np.ones(ngrams.BUCKETS), abs=0.05) and w[0, 0] < 0.01 and w[5, 0] > w[3, 0] > 0.5


# --- 6


def brute_repeats(texts, length):
    c = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append((len(t), int(hit.sum()), len(list(repeats._runs(hit))), hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("many", [2000, 1])
def test_repeats(spark, many):
    random.seed(7)
    parts = ["".join(random.choice("abcde ") for _ in range(n)) for n in (500, 450, 399, 120, 60)] + ["é" * 300, "q" * 900]
    texts = TEXTS + ["".join(random.choice(parts) for _ in range(random.randrange(6))) for _ in range(40)]
    docs = table(spark, texts)
    got = repeats.remove_repeats(docs.withColumn("cells", F.lit(1)), many=many, keep_bytes=False).collect()
    want = brute_repeats([(r.text or "").encode() for r in docs.collect()], 400)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == collections.Counter((r.doc_id, *w) for r, w in zip(docs.collect(), want))
    assert sum(w[1] for w in want) > 0 and repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_of_words(spark):
    """Window by window as by the index, and long hot passages with different surroundings."""
    random.seed(17)
    parts = [" ".join(random.choice(["ab", "c", "é", "def"]) for _ in range(n)) for n in (55, 30, 51, 90)]
    texts = TEXTS + ["\n".join(random.choice(parts) for _ in range(random.randrange(5))) for _ in range(40)] + [f"{i} {parts[3]} {-i}" for i in range(40)]
    docs = table(spark, texts)
    args = {"length": repeats.WORDS, "gram": repeats.WORD_GRAM, "cell": repeats.WORD_CELL, "words": True}
    one, other = ([sorted(map(str, repeats.remove_repeats(docs, many=many, **args).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect()))] for many in (2000, 1))
    assert one == other
    words = [(r.text or "").encode().split() for r in docs.collect()]
    c = collections.Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    touched = {i for i, w in enumerate(words) if any(c[tuple(w[j : j + 51])] > 1 for j in range(len(w) - 50))}
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(b" ".join(w).decode() for w in words)), "n int, text string"), **args)
    assert {r.n for r in got.where("n_removed > 0").collect()} == touched and touched


def test_repeats_of_cells_index_little(monkeypatch):
    """pipeline: cores of much text have no index (one of all their bytes before), and the hits are those of the index and of a plain count."""
    random.seed(3)
    cells = [" ".join(["", *(random.choice(["ab", "c", "longer"]) for _ in range(8)), ""]).encode() for _ in range(200)]
    by_index = repeats._hits(cells, 5, True)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    monkeypatch.setattr(repeats, "RunLengthIndex", None)
    one_by_one = repeats._hits(cells, 5, True)
    every = [x.split() for x in cells]
    count = collections.Counter(tuple(x[i : i + 5]) for x in every for i in range(len(x) - 4))
    want = [[count[tuple(x[i : i + 5])] > 1 for i in range(len(x) - 4)] for x in every]
    assert [x.tolist() for x in by_index] == [x.tolist() for x in one_by_one] == want


@pytest.mark.parametrize("group", [1, 3000])
def test_repeats_in_small_groups(spark, monkeypatch, group):
    """pipeline: however many cores share an index, the rows are the same."""
    monkeypatch.setattr(repeats, "GROUP", group)
    test_repeats(spark, 2000)


def test_run_length_index():
    random.seed(8)
    for _ in range(20):
        base = "".join(random.choice("ab") for _ in range(60))
        texts = [base[random.randrange(10) : random.randrange(30, 60)].encode() + random.choice([b"", b"c", b"\xff\xfe"]) for _ in range(random.randrange(1, 6))]
        index = repeats.RunLengthIndex(texts)
        assert index.lengths.sum() == sum(map(len, texts)) + len(texts)
        got = index.matching_statistics()
        for a, (t, at) in enumerate(zip(texts, index.begins)):
            for i in range(len(t)):
                best = 0
                for b, u in enumerate(texts):
                    for j in range(len(u)):
                        if (a, i) != (b, j):
                            k = 0
                            while i + k < len(t) and j + k < len(u) and t[i + k] == u[j + k]:
                                k += 1
                            best = max(best, k)
                assert got[at + i] == best


# --- 7


def test_pivots(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres, centres[:10] + rng.normal(size=(10, 16)) * 0.15, np.repeat(centres[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.1])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0, None] + [0.0] * 14), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, rows[3][1]), (n + 8, [float("inf")] * 16)]
    got = {r.vec_id: r for r in pivots.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    def cos(a, b):
        return None if len(a) != len(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    ok = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    edges = [(i, j) for i in ok for j in ok if i < j and len(ok[i]) == len(ok[j]) and cos(ok[i], ok[j]) >= 0.9 - 1e-12]
    links = collections.Counter(k for e in edges for k in e)
    low = classes([i for i, _ in rows], edges)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], low[i], low[i] == i) for i, _ in rows}
    assert pivots.link(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# --- 8


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    monkeypatch.setattr(warc, "SIZES", (10, 150, 190))
    big = "<p>WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n</p>" * 5
    rows = [(3, "http://a/\r\nx", big), (1, "http://b", big), (7, None, big), (2, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""), (8, "u", "é" * 100), (8, "u", "é" * 100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archive = warc.write(warc.classify(pages), f"{tmp_path}/w")
    headers, payloads = warc.store(spark, archive, f"{tmp_path}/s")
    got = {int(r.page_id): r for r in warc.reconstruct(headers, payloads).collect()}
    for i, _, h in rows:
        data = (h or "").encode()
        assert bytes(got[i].payload) == data and got[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", "1"), 7: ("revisit", "1"), **{i: ("response", None) for i in (2, 4, 5, 6, 8)}}
    files = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz"))
    records = [h + b for h, _, b in warc.parse(files)]
    assert sorted(records) == sorted(bytes(r.record) for r in warc.reconstruct(headers, payloads).collect()) and len(list((tmp_path / "w").glob("*.gz"))) > 1
    heads = [h for h, _, _ in warc.parse(files)]
    assert sorted(heads) == sorted(bytes(r.headers) for r in headers.collect()) and len(heads) == len(rows)
    digests = [r.payload_digest for r in payloads.collect()]
    assert len(digests) == len(set(digests)) == len({h or "" for _, _, h in rows})
    none = warc.store(spark, warc.write(warc.classify(pages.limit(0)), f"{tmp_path}/e"), f"{tmp_path}/es")
    assert warc.reconstruct(*none).count() == 0


def test_warc_of_null_ids_clashing_columns_and_a_long_page(spark, tmp_path):
    long = "<p>" + "long page " * 1_200_000 + "</p>"
    rows = [(None, "u", long, "own", 1), (4, "u", long, "own", 1), (9, None, long, None, None), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string, first bigint")
    got = warc.reconstruct(*warc.store(spark, warc.write(warc.classify(pages), f"{tmp_path}/w"), f"{tmp_path}/s")).select("page_id", "record_type", "refers_to", F.octet_length("payload").alias("n"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, "revisit", "4", len(long)), ("4", "response", None, len(long)), ("9", "revisit", "4", len(long)), (None, "response", None, 0)], key=repr)


def test_warc_that_is_damaged_is_an_error():
    good = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, _, b in warc.parse(good + good)] == [b"abcd", b"abcd"]
    for bad in (good[:-6], good[:20], b"x" + good):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


# --- 9


def test_html(spark):
    page = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav><!-- <p>no</p> --><div class="ad">Buy</div><article><h1>Head</h1><p>One &amp; <b>tw</b>o<br>three<p>Four&nbsp;five</p><div class="comments">said</div><form>x</form></article><footer>&copy; x</footer></body></html>'
    plain = "<div>Shared words that stand on every page of this host here</div><p>{}</p>"
    rows = [(1, "http://h.example/1", page), (2, "http://h.example/2", None), (3, None, ""), (4, "http://p.example/a", plain.format("alpha beta one two three four five six")), (5, "http://p.example/b", plain.format("gamma delta uno due tre quattro cinque sei")), (6, "x", "<p>a<b" + " " * 10), (6, "x", "<p>a<b" + " " * 10)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == "Head\nOne & two three\nFour five" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert "Shared" not in got[4].text and got[4].text.startswith("alpha beta") and got[5].text.startswith("gamma delta")
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def html_by_hand(rows):
    """The rule in plain loops: windows on over half of a host's distinct pages go word by word; within articles short whole blocks of hosts of LARGE pages."""
    hosts = {}
    for _, url, page in rows:
        hosts.setdefault((url or "").split("/")[2] if "://" in (url or "") else "", set()).add(page)
    read = {page: html.blocks_of(page or "") for _, _, page in rows}

    def words(page):
        blocks, marks = read[page]
        found = [[m.group().lower() for m in re.finditer(r"\w+", line)] for _, line in blocks]
        for piece in html.pieces_of(blocks, [len(w) for w in found]):
            if not (marks and blocks[piece[0]][0] and any(len(found[no]) > html.SHORT for no in piece)):
                yield [(no, k, w) for no in piece for k, w in enumerate(found[no])]

    out = []
    for page_id, url, page in rows:
        peers = hosts[(url or "").split("/")[2] if "://" in (url or "") else ""]
        held = collections.Counter(w for p in peers for w in {tuple(x[2] for x in s[a : a + 6]) for s in words(p) for a in range(len(s) - 5)})
        common = {w for w, n in held.items() if n > 1 and n * 2 > len(peers)}
        blocks, marks = read[page]
        gone = {x[:2] for s in words(page) for a in range(len(s) - 5) if tuple(x[2] for x in s[a : a + 6]) in common for x in s[a : a + 6]}
        lines = []
        for no, (within, line) in enumerate(blocks):
            at = list(re.finditer(r"\w+", line))
            if marks:
                if within and not (at and len(peers) >= html.LARGE and all((no, k) in gone for k in range(len(at)))):
                    lines.append(line)
                continue
            runs, open_ = [], None
            for k, m in enumerate(at):
                if (no, k) in gone:
                    if open_ is not None:
                        runs.append(line[open_ : m.start()].strip())
                    open_ = None
                elif open_ is None:
                    open_ = m.start()
            if open_ is not None:
                runs.append(line[open_:].strip())
            left = " ".join(r for r in runs if r) if any((no, k) in gone for k in range(len(at))) else line
            if left:
                lines.append(left)
        out.append((page_id, "\n".join(lines)))
    return sorted(out)


def test_html_by_brute_force(spark):
    random.seed(9)
    menu = "<ul><li>Home page</li><li>About us</li><li>All news</li><li>Contact</li></ul>"
    rows = []
    for host, n, marked in (("a", 8, False), ("b", 25, True), ("c", 25, False), ("d", 2, False)):
        shared = [" ".join(random.choice("red blue green stone river cloud".split()) for _ in range(12)) for _ in range(3)]
        for i in range(n):
            own = " ".join(f"w{random.randrange(5000)}" for _ in range(40))
            body = f"<p>{shared[0]} unique{i} ending{i}</p><p>{own}</p>" + (f"<p>{shared[1]}</p>" if i % 3 else "") + (f"<div>{shared[2]}</div>" if i % 5 == 0 else "") + "<p>tail</p>"
            rows.append((len(rows), f"http://{host}.example/{i}", menu + (f"<article>{body}</article>" if marked else body)))
    rows += [(len(rows), rows[0][1], rows[0][2]), (len(rows) + 1, None, None)]
    table = spark.createDataFrame([(*r, "own", 1, True) for r in rows], "page_id bigint, url string, html string, host string, page bigint, marked boolean")
    got = sorted((r.page_id, r.text) for r in html.extract(table).collect())
    assert got == html_by_hand(rows)
    first = dict(got)[0]
    assert "unique0 ending0" in first and "Home page" not in first and "About us" not in first and "Contact" not in first and first.endswith("tail")


def test_html_repeats_across_blocks(spark):
    """words that repeat across the border of two blocks of six words or more go (they stayed before); once on half of the pages they stay."""
    page = "<p>own{0} a{0} b{0} c{0} please read more</p><p>about our firm d{0} e{0} f{0} g{0}</p>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(5)] + [(9, "http://k.example/1", page.format(9)), (10, "http://k.example/2", "<p>nothing of this kind stands here at all</p>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"own{i} a{i} b{i} c{i}\nd{i} e{i} f{i} g{i}" for i in range(5)) and "please read more\nabout our firm" in got[9]
    parts = html.parts_of([np.arange(n) for n in (7, 2, 3, 8)])
    whole = np.concatenate([np.arange(n) for n in (7, 2, 3, 8)])
    assert {a + i for a, x in parts for i in range(len(x) - 5)} == set(range(len(whole) - 5)) and all((whole[a : a + len(x)] == x).all() for a, x in parts)


def test_html_of_a_very_long_page(spark):
    text = " ".join(f"word{i}" for i in range(300_000))
    got = html.extract(spark.createDataFrame([(1, "http://h.example/1", f"<article><p>{text}</p></article>"), (2, "http://h.example/2", f"<p>{text}</p>")], "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in got}[1] == text


def test_suffix_array():
    t = np.array([3, 1, 2, 3, 1, 2, 9])
    order, kind = html.suffix_array(t, 3)
    assert [tuple(t[i : i + 3]) for i in order] == sorted(tuple(t[i : i + 3]) for i in range(len(t)))
    assert kind[list(order).index(0)] == kind[list(order).index(3)]


# --- 10


def sainte_lague(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@pytest.mark.parametrize("seats", [1, 7, 100, 999])
def test_apportionment(spark, seats):
    random.seed(seats)
    votes = [random.choice([0, 1, 5, 1000, 33333]) * random.random() for _ in range(30)]
    t = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i int, v double, s bigint")
    got = {r.i: r.won for r in mixing.apportion(t, "v", "s", "won", [], [F.col("i")]).collect()}
    assert [got[i] for i in range(30)] == sainte_lague(votes, seats)


def test_mixing(spark):
    random.seed(10)
    rows = [(i, " ".join("w" for _ in range(random.randrange(60))), random.choice(["a", "b", "b", "b", "B", None])) for i in range(500)] + [(1000, None, "c"), (1001, "", "c"), (None, "x y z", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit(5))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight, target, free = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= share
    source, taken = {i: s for i, _, s in rows}, collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in names)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_pages_without_article_keep_copies_and_phrases(spark):
    shared = "This notice stands on every single page of the host"
    phrase = "on the other side of the street"
    own = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(30)]
    # three pages hold one phrase, one of them in twenty different blocks
    bodies = [f"<p>{x}</p>" + (f"<p>{phrase} a{i}</p>" if i < 3 else "") + ("".join(f"<p>{phrase} b{k}</p>" for k in range(20)) if i == 0 else "") for i, x in enumerate(own)]
    rows = [(i, f"http://large.example/{i}", f"<div>{shared}</div>{b}") for i, b in enumerate(bodies)]
    rows += [(100 + i, f"http://copies.example/{i}", f"<div>{shared}</div><p>{own[i // 2]}</p>") for i in range(6)]
    rows += [(200 + i, f"http://twins.example/{i}", f"<p>{own[0]}</p>") for i in range(2)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = {i: b.replace("</p><p>", "\n")[3:-4] for i, b in enumerate(bodies)} | {100 + i: own[i // 2] for i in range(6)} | {200: own[0], 201: own[0]}
    assert got == want


def test_mixing_deals_empty_texts_over_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 50)
    rows = [(i, None if i % 2 else "", "hollow") for i in range(300)] + [(1000 + i, "a b c", "full") for i in range(100)] + [(5000, "word " * 100_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(got) == len(rows) and all(got[i].size == got[i].taken == 0 for i in range(300)) and got[5000].size == 100_000
    assert all(r.taken <= 3 * r.size for r in got.values())
    d = spark.createDataFrame([("hollow", 0, 300), ("full", 300, 100)], "source string, source_size bigint, rows bigint")
    assert {r.source: r.rows for r in mixing.targets(d).collect()} == {"hollow": 300, "full": 100}


def test_toxicity_shuffles_texts_that_may_be_labelled_alone(spark):
    docs = spark.range(20_000).select((F.col("id") * 7 - 3000).alias("doc_id"), F.lit("t").alias("text")).union(spark.createDataFrame([(None, "t")], "doc_id long, text string"))
    marks = spark.range(5000).select((F.col("id") * 21 - 3000).alias("doc_id"), F.lit(1).alias("toxic"))
    got = toxicity._perhaps_labelled(docs, marks)
    assert got.join(marks, "doc_id").count() == docs.join(marks, "doc_id").count() == 5000
    assert got.count() < 5100


def test_html_token_lists_are_views():
    column = pa.array([[1, 2], [], [3], [4, 5, -6]], pa.list_(pa.int32()))
    assert [x.tolist() for x in html._lists(column)] == column.to_pylist()
    assert [x.tolist() for x in html._lists(column.slice(1, 3))] == column.to_pylist()[1:]
    assert html._lists(column.slice(0, 0)) == []
