"""Alignment, exact deduplication against snapshots and the Merkle manifest against plain versions: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import align, exact, merkle

P = pytest.importorskip("public_tokenizers")
PATHS = ("byte_bpe_50k.json", "piece_bpe_32k.model")

TEXTS = [
    None, "", " ", "one", "One two  three", "tab\tand\nline\r\nend \n", "naïve ΑΒΓ 日本語 🙂", "a<|endoftext|>b <s> </s> <0x41>", "x" * 30_000, " " * 9_000 + "x", "word " * 4_000,
    "blank▁sign", "▁", "trailing blanks   ", "\n\n\n", "it's 12345 things, isn't it?", ");\r\n", "　wide space\x85next\x1cfile", "é ﬁ",
] + ["the same text again"] * 4
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, place int, block string, pair int, digest string"


def table(spark, texts=TEXTS):
    rows = [(i, t, [None, "en", "", "fr"][i % 4], f"s{i % 3}" if i % 5 else None, len(t or "") if i % 6 else None, True, 1, "own", 2, "x") for i, t in enumerate(texts)]
    rows += rows[-1:]  # a repeated row
    rows.append((None, "One two  three", None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


# --- 11


@pytest.fixture(scope="module")
def both():
    return align.aligner_of(P.path(PATHS[0]), P.PATTERN, P.path(PATHS[1]))


def plain_groups(both, text):
    """Tokens of both libraries on the whole text, cut where both end; and the overlapping pairs, found by comparing all ranges."""
    if not text:
        return [], [], []
    a, b = both.a.slow.encode(" " + text, add_special_tokens=False).ids, both.b.model.encode(text)
    raw_a, raw_b = [both.a.bytes_of[i] for i in a], [both.b.bytes_of[i] for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], []
    ends = [np.cumsum(list(map(len, x))).tolist() for x in (raw_a, raw_b)]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(e) + 1, ends[1].index(e) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    starts = [[0, *x[:-1]] for x in ends]
    links, low = [], 0
    for k, (s, e) in enumerate(zip(starts[0], ends[0])):
        while ends[1][low] <= s:
            low += 1
        m = low
        while m < len(b) and starts[1][m] < e:
            links.append((a[k], b[m]))
            m += 1
    return a, groups, links


def test_gallop():
    random.seed(1)
    for _ in range(300):
        long = sorted(random.sample(range(200), random.randrange(1, 60)))
        short = sorted(random.sample(range(long[-1] + 1), random.randrange(0, min(long[-1] + 1, 20))))
        assert align.gallop(short, long) == np.searchsorted(long, short).tolist()


def test_alignment_equals_all_ranges(spark, both):
    want = {}
    parts = [(t, *plain_groups(both, t)) for t in [r.text for r in table(spark).select("text").collect()]]
    counts = collections.Counter(x for *_, links in parts for x in links)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for text, a, groups, links in parts:
        n_b = len({(g, i) for g, x in enumerate(groups) for i in range(x.split("|")[1].count(",") + 1)})
        want[text] = (len(a), n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
    docs = table(spark)
    got = align.align_documents(docs, P.path(PATHS[0]), P.PATTERN, P.path(PATHS[1])).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[texts[r.doc_id]], repr(texts[r.doc_id])[:60]
    assert want["blank▁sign"][0] == 0 and want["one"][0] > 0


def test_blocks_do_not_change_the_result(spark):
    docs = table(spark).coalesce(1)
    run = lambda n: sorted(map(str, align.align_documents(docs, P.path(PATHS[0]), P.PATTERN, P.path(PATHS[1]), block_length=n).collect()))
    assert run(200) == run(1 << 30)


def test_alignment_of_odd_texts(both):
    random.seed(7)
    parts = [" ", "  ", "a", "b", "\n", "\t", "\r", ");", "́", "日", "<|endoftext|>", "<s>", "<0x41>", "🙂", "　", "\0", ".", "'s", "1", "\xa0", "\x1c", "\x85", "word", "▁"]
    texts = ["".join(random.choices(parts, k=random.randrange(12))) for _ in range(3000)]
    block = align.Block()
    for i, t in enumerate(texts):
        block.add(i, t)
    words, place, size = block.aligned(both)
    at = 0
    for t, n in zip(texts, size.tolist()):
        assert ";".join(words.groups[p] for p in place[at : at + n]) == ";".join(plain_groups(both, t)[1]), repr(t)
        at += n


def test_groups_as_lists(spark, both):
    docs = table(spark)
    got = {r.doc_id: list(r.groups) for r in align.token_groups(docs, P.path(PATHS[0]), P.PATTERN, P.path(PATHS[1])).collect()}
    assert all(got[r.doc_id] == plain_groups(both, r.text)[1] for r in docs.collect())


def test_alignment_of_an_empty_table(spark):
    assert align.align_documents(spark.createDataFrame([], SCHEMA), P.path(PATHS[0]), P.PATTERN, P.path(PATHS[1])).count() == 0


# --- 12


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30_000])
def test_binary_fuse(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64)).view(np.uint64)
    f = exact.BinaryFuse.build(keys)
    assert f.may_hold(keys).all()
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64)
    assert f.may_hold(other).mean() < 0.01
    assert n < 30_000 or len(f.marks) < 1.3 * n


def classes(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_groups(spark, batches):
    docs = table(spark, [*TEXTS, "a  b", "a b", "a\tb ", "a b "] + ["hot"] * 300)
    got = sorted((tuple(r) for r in exact.dedup(docs, batches=batches).collect()), key=repr)
    assert got == classes([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_of_one_digest_stay_apart(spark):
    """A digest of one character, which many different texts share: the texts decide."""
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(120)], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.dedup(docs, batches=3, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)).collect()}
    assert got == {i: (i % 40, 3, i < 40) for i in range(120)}


def test_snapshots_stay_and_screen(spark):
    store = exact.Store(spark)
    batch = lambda a, b: spark.createDataFrame([(i, f"t{i}") for i in range(a, b)] * 2, "id bigint, text string")
    exact.ingest(store, batch(0, 500))
    first = store.snapshots[0].texts.collect()
    _, found = exact.ingest(store, batch(400, 900))
    assert [s.texts.count() for s in store.snapshots] == [500, 400] and store.snapshots[0].texts.collect() == first
    assert {(r.entry.split("-")[0], r["count"]) for r in found.groupBy("entry").count().groupBy("entry").count().collect()} >= {("0", 1), ("1", 1)}
    asked = spark.createDataFrame([(f"t{i}",) for i in range(2000)], "text string").select(F.sha2("text", 256).alias("digest"))
    passed = {r.digest for r in exact.screen(asked, store.snapshots[0]).collect()}
    assert {hashlib.sha256(f"t{i}".encode()).hexdigest() for i in range(500)} <= passed and len(passed) < 540
    _, again = exact.ingest(store, batch(0, 900))
    assert len(store.snapshots) == 2 and again.count() == 900


def test_exact_of_an_empty_table(spark):
    assert exact.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


# --- 13


def levels_of(leaves):
    """All levels of a tree from the leaves up, by the rule alone."""
    out = [leaves]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([merkle.digest_of(*x[i : i + 2]) for i in range(0, len(x), 2)])
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 31, 32, 33, 100])
def test_log_places(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    levels = levels_of(leaves)
    top = merkle.height(n)
    assert top == len(levels) - 1
    log = merkle.append_log(leaves, top)
    assert len(log) == 32 * sum(map(len, levels))
    for level, nodes in enumerate(levels):
        for i, node in enumerate(nodes):
            p = merkle.log_place(level, i, n) * 32
            assert log[p : p + 32] == node, (n, level, i)
    for i, leaf in enumerate(leaves):
        path = merkle.siblings(log, i, n, top)
        assert merkle.fold(leaf, path) == levels[-1][0] and merkle.unpack(merkle.pack(path)) == path


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    leaf = lambda r, more=0: hashlib.sha256("".join(map(part, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text))).encode()).digest()
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r.lang].append((-1 if r.doc_id is None else r.doc_id, leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels_of([h for _, h, _ in sorted(trees[x], key=lambda y: y[:2])]) for x in langs}
    top = levels_of([built[x][-1][0] for x in langs])

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            j = i ^ 1
            out.append((j & 1, nodes[j]) if j < len(nodes) else (2, b""))
            i //= 2
        return out

    out = []
    for at, x in enumerate(langs):
        for i, (_, h, r) in enumerate(sorted(trees[x], key=lambda y: y[:2])):
            way = path(built[x], i) + path(top, at)
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            folded = merkle.fold(leaf(r, 1) if bad else h, way)
            out.append((r.doc_id, h.hex(), built[x][-1][0].hex(), top[-1][0].hex(), hashlib.sha256("".join(s.hex() for _, s in way).encode()).hexdigest(), folded.hex(), folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1, 2, 3, 12])
def test_manifest(spark, bits):
    docs = table(spark, TEXTS * 4)
    got = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, bits).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(docs.collect())
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_manifest_of_few_rows(spark):
    for rows in ([(1, "t", "en", "s", 1)], [(1, None, None, None, None)], [(2, "t", None, "s", 1), (1, "u", "", "s", 1), (3, "v", "en", "s", 1)]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        got = merkle.manifest(docs, F.lit(False)).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == [x[:5] for x in plain_manifest(docs.collect())] and all(r.verified for r in got)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_bm25_index_keeps_little():
    """op3: what an index is made of goes while it is built, which takes at most 65 bytes for a posting (87 before), and the impacts are those of the formula."""
    import tracemalloc

    import numpy as np

    from kbspark.llm import bm25

    rng = np.random.default_rng(0)
    terms = [np.unique(rng.integers(0, 20_000, 300).astype(np.uint64)) for _ in range(2000)]
    counts = [rng.integers(1, 9, len(t)).astype("<i4") for t in terms]
    kept_terms, kept_counts = list(terms), list(counts)
    tracemalloc.start()
    index = bm25.ShardIndex(terms, counts, 1500.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = len(index.own_term)
    assert not terms and not counts and most < 65 * n
    for d in (0, 7, 1999):
        own = slice(index.own_start[d], index.own_start[d] + index.own_size[d])
        tf = kept_counts[d].astype(float)
        assert (index.terms[index.own_term[own]] == kept_terms[d]).all()
        assert (index.own_impact[own] == tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * tf.sum() / 1500.0))).all()
    for t in (0, 5, 19_000):
        at = slice(index.start[t], index.start[t + 1])
        assert index.doc[at].tolist() == [d for d, x in enumerate(kept_terms) if index.terms[t] in x]


def test_bm25_adds_postings_in_steps(monkeypatch):
    """op3: scores come from few postings at once, and the hits are those of a plain sum."""
    import numpy as np

    from kbspark.llm import bm25

    rng = np.random.default_rng(1)
    terms = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(300)]
    counts = [rng.integers(1, 9, len(t)).astype("<i4") for t in terms]
    own = list(terms)
    monkeypatch.setattr(bm25, "STEP", 50)
    index = bm25.ShardIndex(terms, counts, 90.0)
    most, ranges = [], bm25.ShardIndex._ranges
    asked, idf = np.arange(0, 60, 2).astype(np.uint64), np.linspace(0.1, 3, 30)
    score = np.array([sum(idf[int(t) // 2] * index.own_impact[index.own_start[d] + i] for i, t in enumerate(own[d]) if t % 2 == 0) for d in range(300)])
    monkeypatch.setattr(bm25.ShardIndex, "_ranges", staticmethod(lambda start, size: most.append(size.sum()) or ranges(start, size)))
    part = index._partial(np.searchsorted(index.terms, asked), idf)
    assert np.allclose(part, score) and max(most) <= 50 + 300
    hits, scores, _ = index.search(asked, idf, 5)
    assert set(np.argsort(-score, kind="stable")[:5]) <= set(hits.tolist()) and np.allclose(scores, score[hits])


def test_bm25_entries_are_small():
    """op3: block entries take few bytes, so an index is built with at most 45 bytes for a posting (52 before); rounded maxima stay bounds."""
    import tracemalloc

    import numpy as np

    from kbspark.llm import bm25

    rng = np.random.default_rng(0)
    terms = [np.unique((rng.zipf(1.3, 500) % 300_000).astype(np.uint64)) for _ in range(3000)]
    tracemalloc.start()
    index = bm25.ShardIndex(list(terms), [rng.integers(1, 9, len(t)).astype("<i4") for t in terms], 1500.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45 * len(index.own_term)
    for t in range(0, len(index.terms), 997):
        entries = range(index.block_start[t], index.block_start[t + 1])
        lists = [slice(int(index.first[e]), int(index.first[e]) + int(index.size[e])) for e in entries]
        assert [d for x in lists for d in index.doc[x]] == list(index.doc[index.start[t] : index.start[t + 1]])
        assert all((index.doc[x] // bm25.BLOCK == index.block[e]).all() and index.impact[x].max() <= index.block_most[e] for e, x in zip(entries, lists))
