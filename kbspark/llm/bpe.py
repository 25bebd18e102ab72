"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every byte prefix of a piece the table holds the one token that ends the
prefix's encoding. A token may follow another if merging the two tokens' bytes
by rank gives just that pair; the last token of a prefix is then the only
vocabulary entry that ends there and may follow the last token of the prefix
before it. So bytes can be appended without redoing what stands before, and an
edit only redoes the prefixes behind it.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections import ChainMap
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Encoded pieces that a worker keeps; a second table of this size holds the ones before.
CACHED_PIECES = 200_000

#: Characters of text whose new pieces are encoded together.
GROUP_LENGTH = 2_000_000

#: Answers that a worker keeps on whether one token may follow another.
KEPT_BORDERS = 300_000

#: Pieces longer than this are encoded each time, as they hardly recur.
CACHED_LENGTH = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class PrefixEncoder:
    """Encodes pieces by the ranks of one vocabulary.

    An automaton finds all tokens that end at a byte, longest first. Whether a
    token may stand after another is found by undoing merges on both sides of
    the border, the latest first: the pair is out if the tokens that then touch
    would have merged before the merge just undone.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.joined: dict[int, int] = {}
        self.ends = ahocorasick.Automaton()
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if (two := self._last_merge(b)) is None:
                continue  # merging its bytes never makes it: it only stands for a piece that is the token as a whole
            self.left[i], self.right[i] = two
            if len(b) > 1:
                self.joined[two[0] << 32 | two[1]] = i
            self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()
        self._fits: dict[int, bool] = {}

    def _last_merge(self, b: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes b, itself twice for one byte, None if the merge loop on b ends elsewhere."""
        if len(b) == 1:
            return self.ranks[b], self.ranks[b]
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _border_holds(self, a: int, b: int) -> bool:
        """Whether the bytes of both tokens are encoded as just these two."""
        bound = 1 << 60  # merges at the border of this rank or later come too late to matter
        while True:
            if self.joined.get(a << 32 | b, 1 << 60) < bound:
                return False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or (not whole_a and a > b):
                # of equal ranks the left merge comes first, so at this rank the border loses
                bound, a = a, self.right[a]
            else:
                bound, b = b + 1, self.left[b]

    def extend(self, data: bytes, last: list[int], start: int) -> list[int]:
        """last[i] is the last token of the encoding of data[: i + 1], known for i < start; fills in the rest."""
        del last[start:]
        text, known, holds, at = data.decode("latin-1"), self._fits, self._border_holds, start
        if len(known) >= KEPT_BORDERS:
            known.clear()
        for end, (n, token) in self.ends.iter(text, max(0, start + 1 - self.longest)):
            if end == at:
                if n <= at:
                    key = last[at - n] << 32 | token
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = holds(last[at - n], token)
                    if not fits:
                        continue
                last.append(token)
                at += 1
        if at < len(data):
            raise ValueError("the vocabulary has no valid token here")
        return last

    def tokens_of(self, data: bytes, last: list[int]) -> list[int]:
        """Walk back from the end: each prefix names its last token."""
        out, at = [], len(data)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """A whole piece that is a token is that token, as the public libraries have it; else by the table of prefixes."""
        token = self.ranks.get(piece)
        return [token] if token is not None else self.tokens_of(piece, self.extend(piece, [], 0))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableEncoding:
    """The encoding of one piece under appends and edits: only prefixes behind the first changed byte are redone."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = encoder.extend(data, [], 0)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self.encoder.extend(self.data, self.last, start)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        self.data = self.data[:start] + new + self.data[stop:]
        self.encoder.extend(self.data, self.last, start)

    def tokens(self) -> list[int]:
        return self.encoder.tokens_of(self.data, self.last)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> PrefixEncoder:
    """One encoder per worker and file."""
    return PrefixEncoder(load_ranks(path))


class TextEncoder:
    """Splits texts by a pattern and keeps the encodings of recent pieces as bytes of little-endian ids."""

    def __init__(self, path: str, pattern: str):
        self.encoder, self.split = encoder_of(path), regex.compile(pattern)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.vocabulary = [self.encoder.bytes_of.get(i, b"") for i in range(max(self.encoder.bytes_of) + 1)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Encode new pieces in byte order, so that each only appends to the table of the prefix it shares with the one before."""
        encoder, ranks, made = self.encoder, self.encoder.ranks, {}
        before, last = b"", []
        for raw, piece in sorted((p.encode("utf-8", "replace"), p) for p in pieces):
            if (token := ranks.get(raw)) is not None:
                made[piece] = token.to_bytes(4, "little")
                continue
            same = min(len(before), len(raw))
            while before[:same] != raw[:same]:
                same -= 1
            ids = encoder.tokens_of(raw, encoder.extend(raw, last, same))
            made[piece] = array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)
            before = raw
        return made

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers. Texts are taken in groups of bounded size."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_LENGTH:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[str]) -> list[bytes]:
        split = [self.split.findall(text) for text in group]
        if len(self.kept) >= CACHED_PIECES:  # the pieces of the last round stay within reach, older ones go
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        new = set().union(*split).difference(kept)
        kept.update((p, older[p]) for p in new.intersection(older))
        made = self._learn(new.difference(older))
        if any(len(p) > CACHED_LENGTH for p in made):
            kept.update((p, x) for p, x in made.items() if len(p) <= CACHED_LENGTH)
            kept = ChainMap(kept, made)
        else:
            kept.update(made)
        return [b"".join(map(kept.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str) -> bytes:
        return self._encode([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I")))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every text and decode it again.

    Adds n_tokens (long), ids_sha256 and decoded_sha256 (lower-case hex) to
    all columns of docs, and with keep_ids the ids (array of int). It replaces
    columns of these names. A null text counts as empty: no tokens, the
    digests of the empty string. The work is one pass without a shuffle; a
    text is held whole, and nothing beside it but one Arrow batch and a
    bounded table of pieces.
    """
    own = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    df = docs.drop(*own)
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema] + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextEncoder(path, pattern)
        for batch in batches:
            n, ids_sha, back_sha, ids = [], [], [], []
            for code in coder.encode_all(x.as_py() or "" for x in batch.column(text)):
                n.append(len(code) // 4)
                ids_sha.append(hashlib.sha256(code).hexdigest())
                back_sha.append(hashlib.sha256(coder.decode(code)).hexdigest())
                if keep_ids:
                    ids.append(list(memoryview(code).cast("I")))
            new = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())] + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *own])

    return df.mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's token count and digests of its ids and of the bytes they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op4_bpe": op4_bpe}
SQL: dict[str, str] = {}
