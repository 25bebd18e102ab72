"""Aligning the tokens of two tokenizers over the same bytes.

Both encodings of a text are lists of rising byte offsets at which tokens end.
The shorter list drives a galloping search (steps that double, then bisection)
into the longer one, from the place found before. Offsets in both lists cut the
tokens into groups; the ranks found, and whether an offset is common, give each
token of the shorter list the range of the longer list's tokens that overlap it.

Documents are gathered into blocks of bounded size. Both tokenizers end a token
where a word ends before a blank, so a block is aligned over its different
words, written one behind the other, and documents add up their words. How often
two ids are linked in the corpus is counted without carrying links through a
shuffle: a block asks once for each of its different pairs, and gets back its
answers by place.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from kbspark.llm.common import materialize, parts

#: Characters of the texts of one block; the document that passes it ends the block.
BLOCK_LENGTH = 8_000_000

#: Characters that are encoded and aligned in one go.
RUN_LENGTH = 20_000

#: Words with so long a run of white space go to the slower library, as the faster one's pattern matcher has a bounded stack.
LONG_RUN = re.compile(r"\s{2000}")

#: White space and what follows, up to a blank, tab or line feed behind something visible; white space that ends a text begins a word if it begins with one of these.
WORDS = re.compile(r"\s*\S+(?:[^\S \t\n]\s*(?:\S+|\Z))*|\s+")

MASK = (1 << 32) - 1


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: its own code point, or one from 256 on for bytes that have no visible one."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """The first tokenizer: byte-level BPE from a JSON file; strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters, special = byte_letters(), {x["id"] for x in model["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, k)): i for k, i in model["model"]["vocab"].items() if i not in special}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        made = [model["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        # ids in order of merging are ranks, which the faster library takes
        self.fast = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None

    def encode(self, text: str) -> list[int]:
        if self.fast is None or LONG_RUN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokenizer:
    """The second tokenizer: a piece model with byte fallback that puts a blank before each text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(r"[^▁\s][▁\t\n]", p) for p in names):
            raise ValueError("the piece model joins words")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lead = len(self.model.encode("."))

    def encode(self, words: str) -> list[int]:
        """Ids of a text that has its blank in front already: a full stop takes the model's own blank and goes again."""
        return self.model.encode("." + words)[self.lead :]


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each of the rising numbers in short the place of the first in long that is not smaller; the last of long is not smaller than any."""
    at, last, out = 0, len(long) - 1, []
    for x in short:
        if long[at] < x:
            at += 1
            if long[at] < x:
                step = 1
                while at + step < last and long[at + step] < x:
                    at, step = at + step, step * 2
                at = bisect_left(long, x, at + 1, min(at + step, last) + 1)
        out.append(at)
    return out


class Alignment:
    """Of two lists of ends the group cuts (places behind each group's last token) and all overlapping pairs of token places, in order."""

    def __init__(self, ends_a: list[int], ends_b: list[int]):
        swap = len(ends_a) > len(ends_b)
        short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
        rank, s = np.array(gallop(short, long), np.int64), np.array(short, np.int64)
        common = np.array(long, np.int64)[rank] == s
        own, other = np.flatnonzero(common) + 1, rank[common] + 1
        self.cuts_a, self.cuts_b = (other, own) if swap else (own, other)
        # a token's first partner is the one its forerunner ended in, or the next if they ended together
        first = np.zeros(len(s), np.int64)
        first[1:] = rank[:-1] + common[:-1]
        size = rank - first + 1
        begin = np.cumsum(size) - size
        mine = np.repeat(np.arange(len(s)), size)
        theirs = np.arange(int(size.sum())) - np.repeat(begin - first, size)
        self.link_a, self.link_b = (theirs, mine) if swap else (mine, theirs)


class Words:
    """What is known of a block's different words: numbers of tokens, groups and links, the groups as text, and the linked pairs of ids (first in the upper half) one word behind the other. A word that a tokenizer does not give back byte by byte has no groups."""

    def __init__(self):
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.n_groups: list[int] = []
        self.n_links: list[int] = []
        self.groups: list[str | None] = []
        self.pairs: list[np.ndarray] = []


class Aligner:
    """Both tokenizers, and the alignment of words."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.a, self.b = ByteTokenizer(path_a, pattern), PieceTokenizer(path_b)
        self.written = list(map(str, range(max(len(self.a.bytes_of), len(self.b.bytes_of)))))

    def align(self, words: list[str]) -> Words:
        """Words that end visibly go in runs, the ends of which both tokenizers share; what ends in white space ended a text and goes alone."""
        out, run, size = Words(), [], 0
        for w in words:
            if w[-1].isspace() or LONG_RUN.search(w):
                self._run(run, out)
                self._run([w], out)
                run, size = [], 0
                continue
            run.append(w)
            size += len(w)
            if size >= RUN_LENGTH:
                self._run(run, out)
                run, size = [], 0
        self._run(run, out)
        return out

    def group_texts(self, ids_a: list[int], ids_b: list[int], found: Alignment) -> list[str]:
        """Each group as text, a1,a2|b1."""
        a, b = list(map(self.written.__getitem__, ids_a)), list(map(self.written.__getitem__, ids_b))
        out, i, j = [], 0, 0
        for x, y in zip(found.cuts_a.tolist(), found.cuts_b.tolist()):
            if x - i == 1:
                out.append(f"{a[i]}|{b[j]}" if y - j == 1 else f"{a[i]}|{','.join(b[j:y])}")
            else:
                out.append(f"{','.join(a[i:x])}|{','.join(b[j:y])}")
            i, j = x, y
        return out

    def _run(self, run: list[str], out: Words) -> None:
        if not run:
            return
        text = "".join(run)
        raw, ids_a, ids_b = text.encode(), self.a.encode(text), self.b.encode(text)
        bytes_a, bytes_b = list(map(self.a.bytes_of.__getitem__, ids_a)), list(map(self.b.bytes_of.__getitem__, ids_b))
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            if len(run) > 1:
                for w in run:
                    self._run([w], out)
            else:
                out.groups.append(None)
                for x in (out.n_a, out.n_b, out.n_groups, out.n_links):
                    x.append(0)
            return
        ends_a, ends_b = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
        found = Alignment(ends_a, ends_b)
        # places behind each word's last token, group and link
        stops = np.cumsum([len(w.encode()) for w in run])
        past_a, past_b = np.searchsorted(ends_a, stops) + 1, np.searchsorted(ends_b, stops) + 1
        past_group = np.searchsorted(found.cuts_a, past_a) + 1
        if not np.array_equal(found.cuts_a[past_group - 1], past_a) or not np.array_equal(found.cuts_b[past_group - 1], past_b):
            raise ValueError("a tokenizer joins words")
        past_link = np.searchsorted(found.link_a, past_a)
        for to, past in ((out.n_a, past_a), (out.n_b, past_b), (out.n_groups, past_group), (out.n_links, past_link)):
            to += np.diff(past, prepend=0).tolist()
        groups = self.group_texts(ids_a, ids_b, found)
        at = 0
        for past in past_group.tolist():
            out.groups.append(groups[at] if past - at == 1 else ";".join(groups[at:past]))
            at = past
        out.pairs.append(np.array(ids_a, np.int64)[found.link_a] << 32 | np.array(ids_b, np.int64)[found.link_b])


@lru_cache(maxsize=1)
def aligner_of(path_a: str, pattern: str, path_b: str) -> Aligner:
    """One per worker."""
    return Aligner(path_a, pattern, path_b)


class Block:
    """Texts of bounded length, one as long as it is. place: the number of each of their words among the block's different words, text by text; texts that have no tokens have no words."""

    def __init__(self):
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.keys: list = []
        self.place: list[int] = []
        self.size: list[int] = []
        self.length = 0

    def add(self, key, text: str | None) -> None:
        # a text with this sign cannot come back: the second tokenizer writes blanks so
        words = WORDS.findall(" " + text) if text and "▁" not in text else []
        self.place.extend(map(self.numbers.__getitem__, words))
        self.keys.append(key)
        self.size.append(len(words))
        self.length += len(text or "") + 64  # rows without text count too

    def aligned(self, aligner: Aligner) -> tuple[Words, np.ndarray, np.ndarray]:
        """The block's words, and place and size without texts of which a word does not come back."""
        words = aligner.align(list(self.numbers))
        place, size = np.array(self.place, np.int32), np.array(self.size, np.int64)
        if None in words.groups:
            lost = np.array([g is None for g in words.groups])
            bad = np.repeat(_sums(lost[place], size) > 0, size)
            size[np.unique(np.repeat(np.arange(len(size)), size)[bad])] = 0
            place = place[~bad]
        return words, place, size


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these sizes."""
    running, stops = np.concatenate([[0], np.cumsum(values, dtype=np.int64)]), np.cumsum(size)
    return running[stops] - running[stops - size]


def _blocks(batches: Iterator[pa.RecordBatch], length: int = BLOCK_LENGTH) -> Iterator[Block]:
    block = Block()
    for batch in batches:
        for key, text in zip(batch.column("_key"), batch.column("_text")):
            block.add(key.as_py(), text.as_py())
            if block.length >= length:
                yield block
                block = Block()
    if block.keys:
        yield block


def _lists(sizes: list[int] | np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def token_groups(docs: DataFrame, path_a: str, pattern: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, groups (array of text, a1,a2|b1 with the ids of both) of every row, in order; none for a row without tokens."""
    kind = docs.schema[key].dataType
    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, pattern, path_b)
        for block in _blocks(batches):
            words, place, size = block.aligned(aligner)
            split, at = [(g or "").split(";") for g in words.groups], 0
            for k, n in zip(block.keys, size.tolist()):
                groups = list(chain.from_iterable(split[p] for p in place[at : at + n]))
                yield pa.RecordBatch.from_arrays([pa.array([k], key_type), _lists([len(groups)], pa.array(groups, pa.string()))], names=["_key", "groups"])
                at += n

    lean = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return lean.mapInArrow(run, f"_key {kind.simpleString()}, groups array<string>").withColumnRenamed("_key", key)


_OWN = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string"}


def align_documents(docs: DataFrame, path_a: str, pattern: str, path_b: str, key: str = "doc_id", text: str = "text", block_length: int = BLOCK_LENGTH) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row.

    A null or empty text, or one that a tokenizer does not give back byte by
    byte, has no tokens: zeros and an empty digest. Keys may be null or repeat,
    each row stands for itself; other columns are left out. n_best: links whose
    pair of ids is as frequent in the corpus as the most frequent pair of the
    second id; count_sum: the frequencies of all links added up.
    """
    kind = docs.schema[key].dataType
    key_type, own = to_arrow_type(kind), ", ".join(f"{k} {v}" for k, v in _OWN.items())
    rows = ", ".join(f"{k}: {v}" for k, v in {"_key": kind.simpleString(), **_OWN, "n_words": "bigint"}.items())
    lean = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, pattern, path_b)
        for block in _blocks(batches, block_length):
            words, place, size = block.aligned(aligner)
            counts = [_sums(np.array(x, np.int64)[place], size) for x in (words.n_a, words.n_b, words.n_groups, words.n_links)]
            digests, at = [], 0
            for n in size.tolist():
                digests.append(hashlib.sha256(";".join(map(words.groups.__getitem__, place[at : at + n].tolist())).encode()).hexdigest() if n else "")
                at += n
            said = np.repeat(np.bincount(place, minlength=len(words.n_links)), words.n_links)
            pairs, links = np.unique(np.concatenate(words.pairs or [np.zeros(0, np.int64)]), return_inverse=True)
            n = np.bincount(links, said, minlength=len(pairs)).astype(np.int64)
            docs = pa.StructArray.from_arrays([pa.array(block.keys, key_type), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(size)], names=["_key", *_OWN, "n_words"])
            arrays = [_lists([len(docs)], docs), _lists([len(pairs)], pa.array(pairs)), _lists([len(n)], pa.array(n))]
            packed = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (place, links, np.array(words.n_links))]
            yield pa.RecordBatch.from_arrays([*arrays, *packed], names=["docs", "pairs", "n", "place", "links", "n_links"])

    made = lean.mapInArrow(gather, f"docs array<struct<{rows}>>, pairs array<bigint>, n array<bigint>, place binary, links binary, n_links binary")
    # a block is a row of many MB, and readers and batches take rows by the thousand: a file holds one, and blocks are dealt to as many tasks as there are
    blocks = materialize(made.withColumn("block", F.monotonically_increasing_id()), "aligned", rows=1)
    spread_over = parts(docs.sparkSession, blocks.count(), 1)
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("pos", "x")).select("block", "pos", "x.*").withColumnRenamed("pairs", "pair")
    totals = materialize(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    second = F.col("pair").bitwiseAND(MASK)
    best = totals.groupBy(second.alias("b")).agg(F.max("count").alias("top"))  # a row per id of the second vocabulary at most
    known = totals.withColumn("b", second).join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    answers = asked.select("block", "pos", "pair").join(known, "pair").repartition(spread_over, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "count", "best"))).alias("told"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs, told = batch.column("docs")[row].values, batch.column("told")[row].values
                place, links, n_links = (np.frombuffer(batch.column(c)[row].as_py(), "<i4") for c in ("place", "links", "n_links"))
                *own, size = docs.flatten()
                sums = []
                for name in ("best", "count"):
                    value = told.field(name).to_numpy(zero_copy_only=False).astype(np.int64) if told is not None else np.zeros(0, np.int64)
                    sums.append(pa.array(_sums(_sums(value[links], n_links.astype(np.int64))[place], size.to_numpy())))
                yield pa.RecordBatch.from_arrays([*own, *sums], names=["_key", *_OWN, "n_best", "count_sum"])

    out = blocks.select("block", "docs", "place", "links", "n_links").repartition(spread_over, "block").join(answers.hint("merge"), "block", "left")
    return out.mapInArrow(spread, f"_key {kind.simpleString()}, {own}, n_best bigint, count_sum bigint").withColumnRenamed("_key", key)


def op11_align(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens by two vocabularies, aligned by the bytes they cover."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = align_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op11_align": op11_align}
SQL: dict[str, str] = {}
