"""Exact repeats of long byte strings, by a run-compressed Burrows-Wheeler index.

A byte goes if it is covered by a string of LENGTH bytes that also starts
somewhere else. Spark brings together what can be equal; an index per group
finds what is:

1. Each window of LENGTH bytes has an anchor: the GRAM-byte string in it of
   least hash. Equal windows have equal anchors at equal places, so a window
   whose anchor occurs once in the corpus is done with.
2. Windows of one anchor are cut by their distance to it into cells of up to
   CELL starts. All windows of a cell hold its core, the bytes common to them,
   so equal windows lie in cells of equal cores. Cells with the same bytes are
   one entry, which repeats as a whole if it occurs twice.
3. The different cells of one core go into a run-length index: suffixes sorted
   by doubling, the transform kept as runs, with the text positions at the runs'
   ends and their common prefixes with the neighbours. Streaming the cells past
   those samples gives each position's longest match elsewhere (its matching
   statistic); matches of LENGTH bytes or more are marked.
4. A core with more than MANY different cells is not indexed in one task: its
   windows are compared one by one, dealt by their digests. So are, in their
   task, those of fewer cells that hold more than CHUNK bytes, as words can.

The same works on words: a text is then its words with one space before,
between and behind them, windows begin and end at those spaces, and lengths,
starts and distances count words. So a window is equal to another if its words
are, whatever white space stands between them, and never begins within a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import materialize

LENGTH = 400
GRAM = 128
CELL = 64
MANY = 2000

#: The same where units are words: strings of over 50 words.
WORDS = 51
WORD_GRAM = 16
WORD_CELL = 16

#: Bytes of cells of several cores that share an index, and of one core's that are indexed at all.
GROUP = 250_000
CHUNK = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * self.up[-1] * _BASE])
            self.down = np.concatenate([self.down, self.down * self.down[-1] * _INVERSE])
            assert len(self.up) == 2 * k
        return self.up, self.down


class Hashes:
    """Hashes of all substrings of one text by running sums."""

    def __init__(self, data: bytes, powers: _Powers):
        a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        up, self.down = powers.upto(len(a) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(a * up[: len(a)], dtype=np.uint64)])

    def of(self, start, stop):
        """Hashes of the substrings from start to stop (arrays)."""
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        return _mixed((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def bounds(data: bytes, words: bool) -> tuple[bytes, np.ndarray, np.ndarray]:
    """What is compared of a text and where its units stand: units i to j - 1 are the bytes from begin[i] to end[j]."""
    if not words:
        every = np.arange(len(data) + 1)
        return data, every, every
    spaced = b" ".join([b"", *data.split(), b""])
    begin = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)
    return spaced, begin, begin + 1


def _word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text as it stands begins and ends."""
    a = np.frombuffer(data, np.uint8)
    word = (a != 32) & ((a < 9) | (a > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


class Units:
    """A text as bytes or as words, with the hashes of all strings of them."""

    def __init__(self, data: bytes, words: bool, powers: _Powers):
        self.data, self.begin, self.end = bounds(data, words)
        self.hashes, self.words = Hashes(self.data, powers), words

    def __len__(self) -> int:
        return len(self.begin) - 1

    def of(self, start, stop):
        return self.hashes.of(self.begin[start], self.end[stop])

    def grams(self, n: int) -> np.ndarray:
        return self.hashes.of(self.begin[:-n], self.end[n:]) if self.words else self.hashes.grams(n)


def anchors(units: Units, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position of each run of window starts that share one, and the run's first start and length. The least hash wins (by its upper half), of equal ones the leftmost."""
    g = units.grams(gram)
    at = np.arange(len(g), dtype=np.uint64)
    m = (g & np.uint64(0xFFFFFFFF00000000)) | at
    width, k = length - gram + 1, 1
    n = len(g) - width + 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    m = np.minimum(m[:n], m[width - k : width - k + n])
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return (m[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), first, np.diff(np.append(first, n))


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some texts, with samples at the ends of its runs.

    heads: transform's run starts; symbols and lengths of the runs. For the
    first and the last suffix of each run it holds the text position and the
    common prefix with the suffix before or behind it. Between samples both
    follow: one byte further, the same neighbour, one less in common.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\0".join(texts) + b"\0"
        n = len(joined)
        code = np.frombuffer(joined, np.uint8).astype(np.int64) + 1
        self.begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        ends = self.begins + np.array([len(t) for t in texts], np.int64)
        code[ends] = 0  # no byte, and different from each other
        self.left = np.repeat(ends, np.diff(np.append(self.begins, n))) - np.arange(n)  # bytes up to the text's end
        key = self._first_bytes(code)
        order = self._suffixes(key, n)
        before = code[order - 1]
        new_run = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads = np.flatnonzero(np.concatenate([[True], new_run]))
        tails = np.append(heads[1:] - 1, n - 1)
        self.symbols, self.lengths = before[heads], tails - heads + 1
        self.head_samples, self.head_common = self._samples(order, heads, -1, key)
        self.tail_samples, self.tail_common = self._samples(order, tails, 1, key)

    def _first_bytes(self, code: np.ndarray) -> np.ndarray:
        """The first seven bytes of each suffix in one integer, zero from the end of its text on."""
        n = len(code)
        wide = np.concatenate([code, np.zeros(7, np.int64)])
        key, more = np.zeros(n, np.int64), np.ones(n, bool)
        for t in range(7):
            more &= wide[t : t + n] != 0
            key = (key << 9) | np.where(more, wide[t : t + n], 0)
        return key

    def _suffixes(self, key: np.ndarray, n: int) -> np.ndarray:
        """Suffix order by doubling; suffixes that reach their text's end within the compared bytes are set apart by position."""
        order = np.argsort(key, kind="stable")
        k, ended = key[order], self.left[order] < 7
        new = np.concatenate([[True], (k[1:] != k[:-1]) | ended[1:] | ended[:-1]])
        rank, width = np.empty(n, np.int64), 7
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = start
        while True:
            alone = new & np.append(new[1:], True)
            todo = np.flatnonzero(~alone)
            if not len(todo):
                return order
            pos = order[todo]
            both = rank[pos] * n + rank[pos + width]
            by = np.argsort(both, kind="stable")
            pos, both = pos[by], both[by]
            ended = self.left[pos] < 2 * width
            fresh = np.concatenate([[True], (both[1:] != both[:-1]) | ended[1:] | ended[:-1]])
            order[todo], new[todo] = pos, fresh
            rank[pos] = np.maximum.accumulate(np.where(fresh, todo, 0))
            width *= 2

    def _samples(self, order: np.ndarray, rows: np.ndarray, step: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions in these rows, in text order, and bytes in common with the suffix in the next row (step 1) or the one before (-1)."""
        pos, other = order[rows], rows + step
        real = (other >= 0) & (other < len(order))
        mate = order[np.where(real, other, rows)]
        most = np.where(real, np.minimum(self.left[pos], self.left[mate]), 0)
        common = np.zeros(len(rows), np.int64)
        on = np.flatnonzero(most > 0)
        while len(on):
            differ = key[pos[on] + common[on]] ^ key[mate[on] + common[on]]
            same = differ == 0
            # of seven nine-bit fields, those above the highest differing bit agree
            agree = same.astype(np.int64)
            for field in range(1, 7):
                agree += differ < 1 << 9 * field
            common[on] += agree
            on = on[same & (common[on] < most[on])]
        common = np.minimum(common, most)
        by = np.argsort(pos)
        return pos[by], common[by]

    def matching_statistics(self) -> np.ndarray:
        """Per position of the joined texts, the longest match that starts anywhere else."""
        n, out = len(self.left), None
        for at, common in ((self.head_samples, self.head_common), (self.tail_samples, self.tail_common)):
            mark = np.zeros(n, np.int64)
            mark[at] = np.arange(len(at))
            sample = np.maximum.accumulate(mark)
            got = common[sample] - (np.arange(n) - at[sample])
            out = got if out is None else np.maximum(out, got)
        return np.minimum(out, self.left)


def _runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and length of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())


def _hits(cells: list[bytes], length: int, words: bool) -> list[np.ndarray]:
    """Whether each window of `length` units of some cells starts anywhere else among them: by the index, beyond CHUNK bytes window by window."""
    if sum(map(len, cells)) <= CHUNK:
        index, out = RunLengthIndex(cells), []
        longest = index.matching_statistics()
        for data, at in zip(cells, index.begins.tolist()):
            _, begin, end = bounds(data, words)
            out.append(longest[at + begin[:-length]] >= end[length:] - begin[:-length])
        return out
    seen, sizes = [], []
    for data in cells:
        _, begin, end = bounds(data, words)
        digests = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begin[:-length].tolist(), end[length:].tolist())]
        seen.append(np.frombuffer(b"".join(digests), np.dtype((np.void, 16))))
        sizes.append(len(digests))
    _, kind, times = np.unique(np.concatenate(seen), return_inverse=True, return_counts=True)
    return np.split(times[kind] > 1, np.cumsum(sizes)[:-1])


def _find_anchors(length: int, gram: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for k1, k2, uid, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "uid")), batch.column("text")):
                units = Units((text.as_py() or "").encode("utf-8", "replace"), words, powers)
                if len(units) < length:
                    continue
                at, _, _ = anchors(units, length, gram)
                at = np.unique(at)
                cols[0].append(units.of(at, at + gram).view(np.int64))
                cols[1].append(np.full(len(at), k1, np.int64))
                cols[2].append(np.full(len(at), k2, np.int64))
                cols[3].append(at.astype(np.int32))
                cols[4].append(_mixed(at.astype(np.uint64) + np.uint64(uid * int(_BASE) % (1 << 64))).view(np.int64))
                if len(cols[0]) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "k1", "k2", "at", "place"])
                    cols = [[], [], [], [], []]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "k1", "k2", "at", "place"])

    return run


def _cells_of(units: Units, wanted: np.ndarray, length: int, gram: int, cell: int) -> list[dict]:
    """Cells of the windows whose anchors stand at the wanted positions."""
    at, first, n = anchors(units, length, gram)
    keep = np.isin(at, wanted)
    at, first, n = at[keep], first[keep], n[keep]
    # distance to the anchor falls from at - first to at - first - n + 1; cut where it passes a multiple of cell
    far, near = (at - first) // cell, (at - first - n + 1) // cell
    pieces = far - near + 1
    run = np.repeat(np.arange(len(at)), pieces)
    part = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    block = far[run] - part
    a = np.maximum(first[run], at[run] - (block * cell + cell - 1))
    b = np.minimum(first[run] + n[run] - 1, at[run] - block * cell)
    core_start, core_stop = at[run] - block * cell, at[run] - (block * cell + cell - 1) + length
    core = (units.of(core_start, core_stop) + block.astype(np.uint64) * _BASE).view(np.int64)
    out = []
    for c, x, y in zip(core.tolist(), a.tolist(), b.tolist()):
        whole = xxhash.xxh3_64_intdigest(units.data[units.begin[x] : units.end[y + length]])
        out.append({"core": c, "whole": whole - (1 << 64) if whole >> 63 else whole, "start": x, "n": y - x + 1})
    return out


_CELL = pa.list_(pa.struct([("core", pa.int64()), ("whole", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))


def _removed(data: bytes, spans: list[dict] | None, words: bool = False) -> tuple[int, int, bytes]:
    """Bytes removed, their maximal runs, and what is left. A run of words goes with the white space between them."""
    merged: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    if words and merged:
        begin, end = _word_places(data)
        merged = [[int(begin[a]), int(end[b - 1])] for a, b in merged]
    kept, at = [], 0
    for a, b in merged:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return sum(b - a for a, b in merged), len(merged), b"".join(kept)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, cell: int = CELL, many: int = MANY, words: bool = False, keep_bytes: bool = False) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_sha256, and with keep_bytes kept (binary), to all columns of docs.

    Texts are UTF-8 bytes, null counts as empty; matches never cross texts and
    are judged on the input. A text that occurs twice goes as a whole if it
    has `length` bytes. Columns of the added names are replaced. Texts under 4 GB.

    With words, length, gram and cell count words (WORDS, WORD_GRAM and
    WORD_CELL suit each other): a string of `length` words that occurs twice
    goes, with any white space between them; that before and behind it stays.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
    names = [c for c in docs.columns if c not in added]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row") if len(names) > 1 else F.struct(F.lit(None).cast("int").alias("none")).alias("row"), F.col(f"`{text}`").alias("text"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))

    # 1. anchors that occur at two places or more
    found = keyed.select("k1", "k2", "text", F.monotonically_increasing_id().alias("uid")).where(F.octet_length("text") >= length).mapInArrow(_find_anchors(length, gram, words), "anchor bigint, k1 bigint, k2 bigint, at int, place bigint")
    found = materialize(found, "repeats-anchors")
    # a written table, so that both sides of the join are plain shuffles: Spark can then split the rows of a hot anchor
    twice = materialize(found.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("anchor"), "repeats-twice")
    wanted = found.select("anchor", "k1", "k2", "at").join(twice, "anchor").groupBy("k1", "k2").agg(F.collect_set("at").alias("wanted"))

    # 2. cells of their windows; a text without any is done
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            made, shas, kept = [], [], []
            for x, want in zip(batch.column("text"), batch.column("wanted")):
                data = (x.as_py() or "").encode("utf-8", "replace")
                made.append(_cells_of(Units(data, words, powers), np.array(want.as_py()), length, gram, cell) if want.is_valid else None)
                shas.append(None if want.is_valid else hashlib.sha256(data).hexdigest())
                kept.append(len(data))
            i = {c: batch.schema.get_field_index(c) for c in ("row", "text", "k1", "k2")}
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in i.values()), pa.array(made, _CELL), pa.array(shas, pa.string()), pa.array(kept, pa.int64())], names=[*i, "cells", "sha", "n_bytes"])

    row_type = keyed.schema["row"].dataType.simpleString()
    whole = materialize(keyed.join(wanted, ["k1", "k2"], "left").mapInArrow(cells, f"row {row_type}, text string, k1 bigint, k2 bigint, cells array<struct<core: bigint, whole: bigint, start: int, n: int>>, sha string, n_bytes bigint").withColumn("uid", F.monotonically_increasing_id()), "repeats-texts")

    # 3. cells with the same bytes are one entry
    single_cells = whole.where("cells is not null").select("k1", "k2", "uid", F.explode("cells").alias("c")).select("k1", "k2", "c.*", F.xxhash64("uid", "c.start").alias("place"))
    entries = single_cells.groupBy("core", "whole").agg(F.min("place").alias("p"), F.max("place").alias("q"), F.min(F.struct("k1", "k2", "start", "n")).alias("e")).select("core", "whole", (F.col("p") != F.col("q")).alias("again"), "e.*")
    entries = materialize(entries, "repeats-entries")
    cores = entries.groupBy("core").agg(F.count("*").alias("entries"), F.max("again").alias("any")).where("entries > 1 or any")
    entries = materialize(entries.join(cores, "core"), "repeats-open")
    repeated = single_cells.select("core", "whole", "k1", "k2", "start", "n").join(entries.where("again").select("core", "whole"), ["core", "whole"]).select("k1", "k2", "start", (F.col("start") + F.col("n") + F.lit(length - 1)).alias("stop"))

    # 4. the bytes of different cells with one core, and their matches
    texts = whole.where("cells is not null").groupBy("k1", "k2").agg(F.min("uid").alias("uid"))
    one = whole.where("cells is not null").select("uid", "text").join(texts, "uid").select("k1", "k2", "text")
    open_cells = entries.where(f"entries > 1 and entries <= {many}").groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "again", "start", "n")).alias("cells"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("core", "again", "start", "k1", "k2", "bytes")}
            for k1, k2, x, cs in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), batch.column("cells")):
                data, begin, end = bounds(x.as_py().encode("utf-8", "replace"), words)
                for c in cs.as_py():
                    for k, v in (("core", c["core"]), ("again", c["again"]), ("start", c["start"]), ("k1", k1), ("k2", k2), ("bytes", data[begin[c["start"]] : end[c["start"] + c["n"] + length - 1]])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["core"], pa.int64()), pa.array(out["again"], pa.bool_()), pa.array(out["start"], pa.int32()), pa.array(out["k1"], pa.int64()), pa.array(out["k2"], pa.int64()), pa.array(out["bytes"], pa.binary())], names=list(out))

    group = GROUP  # travels with the function

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            spans: list[tuple] = []
            for (_, again, start, k1, k2, data), hit in zip(rows, _hits([r[5] for r in rows], length, words)):
                if not again:  # those that occur twice are marked as a whole already
                    spans += [(k1, k2, start + a, start + a + n + length - 1) for a, n in _runs(hit)]
            cols = list(zip(*spans)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k1", "k2", "start", "stop"])

        rows: list[tuple] = []  # whole cores, and the core that is being read
        core: list[tuple] = []
        size = own = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("core", "again", "start", "k1", "k2", "bytes"))):
                if core and r[0] != core[-1][0]:
                    if rows and size + own > group:
                        yield done(rows)
                        rows, size = [], 0
                    rows += core
                    size, core, own = size + own, [], 0
                core.append(r)
                own += len(r[5])
        if rows and size + own > group:
            yield done(rows)
            rows = []
        if rows or core:
            yield done(rows + core)

    bytes_of = one.join(open_cells, ["k1", "k2"]).mapInArrow(cut, "core bigint, again boolean, start int, k1 bigint, k2 bigint, bytes binary")
    matched = bytes_of.repartition("core").sortWithinPartitions("core").mapInArrow(match, "k1 bigint, k2 bigint, start int, stop int")

    # 5. cores with very many different cells: their windows one by one
    crowded = entries.where(f"entries > {many}").groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "again", "start", "n")).alias("cells"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "digest", "again", "k1", "k2", "start"]
        kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for k1, k2, x, cs in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), batch.column("cells")):
                data, begin, end = bounds(x.as_py().encode("utf-8", "replace"), words)
                for c in cs.as_py():
                    for s in range(c["start"], c["start"] + c["n"]):
                        for k, v in (("core", c["core"]), ("digest", xxhash.xxh3_128_digest(data[begin[s] : end[s + length]])), ("again", c["again"]), ("k1", k1), ("k2", k2), ("start", s)):
                            out[k].append(v)
                if len(out["core"]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in zip(names, kinds)], names=names)
                    out = {k: [] for k in names}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in zip(names, kinds)], names=names)

    single = one.join(crowded, ["k1", "k2"]).mapInArrow(windows, "core bigint, digest binary, again boolean, k1 bigint, k2 bigint, start int")
    often = single.groupBy("digest").agg(F.count("*").alias("times"), F.max("again").alias("again")).where("times > 1").select("digest")
    singled = single.where("not again").join(often, "digest").select("k1", "k2", "start", (F.col("start") + F.lit(length)).alias("stop"))

    spans = repeated.unionByName(matched).unionByName(singled).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    # 6. what is left of each text
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, shas, kept = [], [], [], []
            for x, sha, spans in zip(batch.column("text"), batch.column("sha").to_pylist(), batch.column("spans")):
                data = (x.as_py() or "").encode("utf-8", "replace")
                n, k, rest = _removed(data, spans.as_py(), words)
                removed.append(n)
                runs.append(k)
                shas.append(sha or hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            i = {c: batch.schema.get_field_index(c) for c in ("row", "text", "n_bytes")}
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in i.values()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string())] + [pa.array(kept, pa.binary())] * keep_bytes, names=[*i, *added[1:]])

    out_type = f"row {row_type}, text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    clear = whole.where("cells is null").select("row", "text", "sha", "n_bytes", F.lit(None).cast("array<struct<start: int, stop: int>>").alias("spans"))
    marked = whole.where("cells is not null").join(spans, ["k1", "k2"], "left").select("row", "text", "sha", "n_bytes", "spans")
    if keep_bytes:
        done = marked.unionByName(clear).mapInArrow(finish, out_type)
    else:  # the digest of an untouched text is known
        done = marked.mapInArrow(finish, out_type).unionByName(clear.select("row", "text", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256")))
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in names], *added)


def op6_suffix_array(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that occur twice."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op6_suffix_array": op6_suffix_array}
SQL: dict[str, str] = {}
