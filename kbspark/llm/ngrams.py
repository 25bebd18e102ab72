"""Bigram scores by deleted interpolation.

The probability of a word after another mixes three estimates: the bigram's
relative frequency, the word's, and one over the vocabulary. The weights depend
on how often the context was seen (by powers of two) and are learned by
expectation maximisation on held-out counts: each batch of documents is judged
by the counts of all others.

Documents are packed into batches. A batch sends its distinct words and bigrams
as digests with their training counts, packed by the partition they belong to;
there the corpus counts are summed and sent back in the same order. So what is
shuffled is a few bytes for each distinct bigram of a batch, whatever the words,
and no table of words or bigrams is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import materialize

#: Bytes of text in a batch at most (a longer document is a batch of its own); batches at least, so that a batch's own counts are a small part.
BATCH = 6_000_000
BATCHES = 16

#: Bytes of text for each partition of the counts.
PART = 32_000_000

#: Context-frequency buckets: unseen, then by powers of two. Rounds of expectation maximisation. Steps of an octave to which held-out estimates are rounded.
BUCKETS = 40
ROUNDS = 80
STEPS = 8

_START, _END = b" ", b""  # neither can be a word
_ZERO = -(1 << 20)
_FIELD = (1 << 21) - 1


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _counts_blob(c: np.ndarray) -> bytes:
    """Length, width and counts, in one byte each where they fit."""
    wide = len(c) > 0 and int(c.max()) > 255
    return len(c).to_bytes(8, "little") + bytes([wide]) + _packed(c.astype("<u8" if wide else "u1"))


def _counts(data: bytes) -> np.ndarray:
    return _unpacked(data[9:], int.from_bytes(data[:8], "little"), "<u8" if data[8] else "u1").astype(np.int64)


def pack(size: int):
    """Documents into batches of about `size` bytes, each an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        weight = 0

        def done() -> pa.RecordBatch:
            nonlocal n
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "docs"])

        for batch in batches:
            lengths = [len(x) for x in (v.as_buffer() or b"" for v in batch.column("text").cast(pa.large_binary()))]
            start = 0
            for i, k in enumerate(lengths):
                weight += k
                if weight >= size:
                    held.append(batch.slice(start, i + 1 - start))
                    yield done()
                    held, weight, start = [], 0, i + 1
            if start < len(lengths):
                held.append(batch.slice(start))
        if held:
            yield done()

    return run


def numbered(texts: pa.Array, held: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts one after another, each text closed by the number 1; words per text with that end; the words, the first two of which stand for start and end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, text = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(words, "")  # a leading or trailing blank makes an empty word
    words, text = words.filter(real), text[real.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    sizes = np.bincount(text, minlength=held).astype(np.int64) + 1
    token = np.ones(len(text) + held, np.int64)
    token[np.arange(len(text)) + text] = coded.indices.to_numpy().astype(np.int64) + 2
    return token, sizes, [_START, _END, *coded.dictionary.cast(pa.binary()).to_pylist()]


class Batch:
    """Words and bigrams of a packed batch, in an order that only depends on the batch: by digest, which is by partition too."""

    def __init__(self, docs: bytes, parts: int):
        table = pa.ipc.open_stream(docs).read_all().combine_chunks()
        self.doc_id, held_out = table.column("doc_id"), table.column("held_out").to_numpy().astype(bool)
        self.held_out = held_out
        token, self.sizes, words = numbered(table.column("text").combine_chunks(), len(held_out))
        before = np.roll(token, 1)
        before[np.cumsum(self.sizes) - self.sizes] = 0
        self.doc = np.repeat(np.arange(len(held_out), dtype=np.int32), self.sizes)
        train = ~held_out[self.doc]
        n = len(words)
        which, pair = pd.factorize(before * n + token)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        left, right = pair // n, pair % n
        both = h[left] * np.uint64(0x9E3779B97F4A7C15) + (h[right] ^ (h[right] >> np.uint64(32)))
        both = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        both ^= both >> np.uint64(32)
        own = np.bincount(which[train], minlength=len(pair))
        counts = np.bincount(token[train], minlength=n)
        counts[0] = int((~held_out).sum())  # a text's start is the context of its first word
        po, wo = np.argsort(both), np.argsort(h)
        back = np.empty(len(po), np.int32)
        back[po] = np.arange(len(po))
        self.which = back[which]
        self.pair_hash, self.pair_own = both[po], own[po]
        place = np.empty(n, np.int32)
        place[wo] = np.arange(n)
        self.left, self.right = place[left[po]], place[right[po]]
        self.word_hash, self.word_own = h[wo], counts[wo]
        # the first bits deal by partition; the last 48 tell bigrams of one partition apart
        self.pair_part, self.word_part = (((x >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64) for x in (self.pair_hash, self.word_hash))
        self.start = int(place[0])

    def sent(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """part, kind (0 bigrams, 1 words), digests, training counts."""
        for kind, part, digest, own in ((0, self.pair_part, self.pair_hash, self.pair_own), (1, self.word_part, self.word_hash, self.word_own)):
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for a, b in zip(edge[:-1], edge[1:]):
                raw = digest[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)
                yield int(part[a]), kind, (raw[:, :6] if kind == 0 else raw).tobytes(), _counts_blob(own[a:b])

    def counts(self, got: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of the bigrams and the words."""
        out = []
        for kind, n in ((0, len(self.pair_own)), (1, len(self.word_own))):
            rows = sorted((g["part"], g["counts"]) for g in got if g["kind"] == kind)
            out.append(np.concatenate([_counts(c) for _, c in rows]) if rows else np.zeros(n, np.int64))
            assert len(out[-1]) == n
        return out[0], out[1]


def _bucket(seen: np.ndarray) -> np.ndarray:
    return np.where(seen > 0, np.minimum(1 + np.floor(np.log2(np.maximum(seen, 1))).astype(np.int64), BUCKETS - 1), 0)


def bucket_weights(k: int, p2: np.ndarray, p1: np.ndarray, p0: float, times: np.ndarray) -> np.ndarray:
    """Mixture weights (bigram, word, uniform) of one bucket by expectation maximisation; an unseen context (bucket 0) has no bigram estimate."""
    least = np.array([0.0 if k == 0 else 0.01, 0.01, 0.01])
    est = np.stack([p2, p1, np.full(len(p1), p0)], 1)
    w = np.array([0.0, 0.5, 0.5]) if k == 0 else np.full(3, 1 / 3)
    for _ in range(ROUNDS):
        share = est * w
        share *= (times / np.maximum(share.sum(1), 1e-300))[:, None]
        w = (share.sum(0) + least) / (share.sum() + least.sum())
    return w


def all_buckets(known: dict[int, np.ndarray]) -> np.ndarray:
    """Weights of every bucket; one without held-out counts takes those of the nearest one below."""
    weights, last = np.zeros((BUCKETS, 3)), np.array([0.0, 0.9, 0.1])
    for k in range(BUCKETS):
        weights[k] = last = known.get(k, last)
    return weights


def learn_weights(b: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, times: np.ndarray) -> np.ndarray:
    """Weights per bucket from held-out estimates that occurred so many times."""
    return all_buckets({int(k): bucket_weights(int(k), p2[b == k], p1[b == k], p0, times[b == k]) for k in np.unique(b)})


def score(docs: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    held_out: a boolean column; counts come from the other rows. Null texts
    are empty: their one token is the end. Without any training row the counts
    are zero and the mixture is its uniform part.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    total = d.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = max(20_000, min(BATCH, (total[0] or 0) // BATCHES))
    packed = materialize(d.mapInArrow(pack(size), "batch bigint, docs binary"), "lm-batches")
    parts = min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total[0] or 0) // PART), 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column("batch").to_pylist(), batch.column("docs")):
                rows = [(p, key, k, h, c) for p, k, h, c in Batch(data.as_py(), parts).sent()]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "batch", "kind", "digests", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        start = np.uint64(xxhash.xxh3_64_intdigest(_START))

        def done() -> pa.RecordBatch:
            width = 6 if key[1] == 0 else 8
            lists = []
            for r in held:
                raw = np.zeros((len(r[1]) // width, 8), np.uint8)
                raw[:, :width] = np.frombuffer(r[1], np.uint8).reshape(-1, width)
                lists.append(raw.view("<u8").ravel())
            digest, at = np.unique(np.concatenate(lists), return_inverse=True)
            sums = np.bincount(at, np.concatenate([_counts(r[2]) for r in held])).astype(np.int64)
            edge = np.cumsum([0] + [len(x) for x in lists])
            known = (sums > 0) & (digest != start)
            n, v = (int(sums[known].sum()), int(known.sum())) if key[1] == 1 else (0, 0)
            k = len(held)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * k, pa.int32()), pa.array([r[0] for r in held], pa.int64()), pa.array([key[1]] * k, pa.int32()), pa.array([_counts_blob(sums[at[a:b]]) for a, b in zip(edge, edge[1:])], pa.binary()), pa.array([n] + [0] * (k - 1), pa.int64()), pa.array([v] + [0] * (k - 1), pa.int64())], names=["part", "batch", "kind", "counts", "n", "v"])

        for batch in batches:
            for p, b, k, h, c in zip(*(batch.column(x).to_pylist() for x in ("part", "batch", "kind", "digests", "counts"))):
                if (p, k) != key:
                    if held:
                        yield done()
                    held, key = [], (p, k)
                held.append((b, h, c))
        if held:
            yield done()

    sent = packed.mapInArrow(send, "part int, batch bigint, kind int, digests binary, counts binary")
    summed = materialize(sent.repartition(parts, "part").sortWithinPartitions("part", "kind", "batch").mapInArrow(add_up, "part int, batch bigint, kind int, counts binary, n bigint, v bigint"), "lm-counts")
    n, v = (int(x or 0) for x in summed.agg(F.sum("n"), F.sum("v")).first())
    answers = summed.groupBy("batch").agg(F.collect_list(F.struct("part", "kind", "counts")).alias("got"))
    met = packed.join(answers, "batch")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Held-out bigrams of each batch under the counts of all others, rounded to steps of an octave."""
        for batch in batches:
            for data, got in zip(batch.column("docs"), batch.column("got")):
                x = Batch(data.as_py(), parts)
                c2, c1 = x.counts(got.as_py())
                own_n = int(x.word_own.sum() - x.word_own[x.start])
                use = np.flatnonzero(x.pair_own > 0)
                d2 = c2[use] - x.pair_own[use]
                dv, dw = (c1 - x.word_own)[x.left[use]], (c1 - x.word_own)[x.right[use]]
                step = lambda p: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * STEPS), _ZERO).astype(np.int64)
                q2, q1, b = step(d2 / np.maximum(dv, 1)), step(dw / max(n - own_n, 1)), _bucket(dv)
                at, key = pd.factorize((b << 42) + (-q2 << 21) - q1)  # steps are at most zero
                times = np.bincount(at, x.pair_own[use], len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 42), pa.array(-(key >> 21 & _FIELD)), pa.array(-(key & _FIELD)), pa.array(times)], names=["b", "q2", "q1", "times"])

    p0 = 1 / (v + 1)

    def maximise(pdf: pd.DataFrame) -> pd.DataFrame:
        value = lambda q: np.where(q > _ZERO, np.exp2(np.maximum(q, -8000) / STEPS), 0.0)
        k = int(pdf["b"].iloc[0])
        w = bucket_weights(k, value(pdf["q2"].to_numpy()), value(pdf["q1"].to_numpy()), p0, pdf["times"].to_numpy(np.float64))
        return pd.DataFrame([[k, *w]], columns=["b", "w2", "w1", "w0"])

    # buckets and rounded estimates: the rows of a bucket are bounded by the estimates' range, not by the corpus, and a bucket's weights are one row
    cells = met.mapInArrow(judge, "b bigint, q2 bigint, q1 bigint, times bigint").groupBy("b", "q2", "q1").agg(F.sum("times").alias("times"))
    learned = cells.groupBy("b").applyInPandas(maximise, "b bigint, w2 double, w1 double, w0 double").collect()
    weights = all_buckets({r.b: np.array([r.w2, r.w1, r.w0]) for r in learned})

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, got in zip(batch.column("docs"), batch.column("got")):
                x = Batch(data.as_py(), parts)
                c2, c1 = x.counts(got.as_py())
                cv, cw = c1[x.left], c1[x.right]
                w = weights[_bucket(cv)]
                prob = w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * cw / max(n, 1) + w[:, 2] * p0
                k = len(x.sizes)
                total = np.bincount(x.doc, np.log10(prob)[x.which], k)
                base = np.bincount(x.doc, np.log10((cw + 1) / (n + v + 1))[x.which], k)
                known = np.bincount(x.doc, (cw > 0)[x.which], k).astype(np.int64)
                yield pa.RecordBatch.from_arrays([x.doc_id.combine_chunks(), pa.array(x.held_out), pa.array(x.sizes), pa.array(known), pa.array(np.full(k, n, np.int64)), pa.array(base), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.mapInArrow(rate, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op5_ngrams(spark, sf_dir: str) -> DataFrame:
    """Add-one and interpolated bigram scores of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True)))


QUERIES = {"op5_ngrams": op5_ngrams}
SQL: dict[str, str] = {}
