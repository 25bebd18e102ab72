"""Exact deduplication against immutable snapshots.

A snapshot is a table of different texts with their digests, and a binary-fuse
filter for each of its shards, which says of a digest that it is new or may be
known. Of an incoming batch the duplicates are grouped first, so each different
text is asked about once; what the filters of all snapshots call new is new, and
the rest joins the snapshots' exact buckets, where texts are compared. What was
not found becomes a snapshot of its own, and no snapshot is ever changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.common import materialize

#: Keys of one shard's filter, about.
SHARD_KEYS = 250_000

#: Parts into which the query deals a table that comes all at once: each is a batch against those before it.
BATCHES = 2

#: A class this share of all rows is broadcast instead of shuffled to; there are at most as many of them as the share's inverse.
HOT = 1000

_M1, _M2, _GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed) * _GOLD
        h = (h ^ (h >> np.uint64(33))) * _M1
        h = (h ^ (h >> np.uint64(33))) * _M2
        return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """A static filter with 8-bit marks: three places in three neighbouring segments whose marks give a key's own mark by exclusive or."""

    def __init__(self, seed: int, segment: int, segments: int, marks: np.ndarray):
        self.seed, self.segment, self.segments, self.marks = seed, segment, segments, marks

    @staticmethod
    def _shape(n: int) -> tuple[int, int]:
        """Length of a segment (a power of two) and number of segments for n different keys."""
        segment = 1 << int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        space = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        return segment, max(3, -(-int(n * space) // segment) + 2)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three places of each key, and its mark."""
        h = _mix(keys, self.seed)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments - 2)) >> np.uint64(32)
        mask, size = np.uint64(self.segment - 1), np.uint64(self.segment)
        inner = _mix(h, 1)
        at = [(first + np.uint64(i)) * size + ((inner >> np.uint64(20 * i)) & mask) for i in range(3)]
        return np.stack(at).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Of different unsigned 64-bit keys. Places that one key alone has are taken off in rounds until no key is left, and marks are set in the reverse order; another seed is tried if some keys remain."""
        segment, segments = cls._shape(len(keys))
        for seed in range(1, 101):
            new = cls(seed, segment, segments, np.zeros(segment * segments, np.uint8))
            if new._fill(keys):
                return new
        raise RuntimeError("no seed separates the keys; are they different?")

    def _fill(self, keys: np.ndarray) -> bool:
        at, mark = self._places(keys)
        count = np.bincount(at.ravel(), minlength=len(self.marks))
        who = np.zeros(len(self.marks), np.int64)
        for row in at:
            np.bitwise_xor.at(who, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, first = np.unique(who[alone], return_index=True)  # a key alone in two places goes by one
            rounds.append((key, alone[first]))
            left -= len(key)
            places = at[:, key].ravel()
            np.subtract.at(count, places, 1)
            np.bitwise_xor.at(who, places, np.tile(key, 3))
            alone = np.unique(places[count[places] == 1])
        if left:
            return False
        for key, place in reversed(rounds):
            others = self.marks[at[0, key]] ^ self.marks[at[1, key]] ^ self.marks[at[2, key]]  # its own place is still empty
            self.marks[place] = mark[key] ^ others
        return True

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at, mark = self._places(keys)
        return self.marks[at[0]] ^ self.marks[at[1]] ^ self.marks[at[2]] == mark


def normal_text(text: Column) -> Column:
    """Every run of ASCII white space as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass
class Snapshot:
    """One immutable part of the store: texts (entry, digest, text) and filters (shard, seed, segment, segments, marks), and into how many shards its digests fall."""

    texts: DataFrame
    filters: DataFrame
    shards: int


@dataclass
class Store:
    """Snapshots in the order in which they were made."""

    spark: SparkSession
    snapshots: list[Snapshot] = field(default_factory=list)


def _key(digest: Column) -> Column:
    """Sixty-four bits of a digest; any text will do as one."""
    return F.xxhash64(digest)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 32), F.lit(shards)).cast("int")


def group_batch(rows: DataFrame) -> DataFrame:
    """digest, text, first_id, size of the different texts of rows (id, digest, text): copies are added up before the shuffle, so any number of them is one row per task."""
    return rows.groupBy("digest", "text").agg(F.min("id").alias("first_id"), F.count("*").alias("size"))


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """One filter per shard of a column digest, which may repeat. The keys of a partition come sorted by shard, so a task holds those of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            f = BinaryFuse.build(np.unique(np.concatenate(parts)).view(np.uint64))
            one = [(shard, pa.int32()), (f.seed, pa.int64()), (f.segment, pa.int64()), (f.segments, pa.int64()), (f.marks.tobytes(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in one], names=["shard", "seed", "segment", "segments", "marks"])

        now, parts = None, []
        for batch in batches:
            shard, key = batch.column("shard").to_numpy(), batch.column("key").to_numpy()
            for s in np.unique(shard):  # sorted
                if s != now and parts:
                    yield row(int(now), parts)
                    parts = []
                now = s
                parts.append(key[shard == s])
        if parts:
            yield row(int(now), parts)

    key = _key(F.col("digest"))
    keyed = digests.select(_shard(key, shards).alias("shard"), key.alias("key"))
    return keyed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, seed long, segment long, segments long, marks binary")


def screen(rows: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests of rows (distinct ones) that a snapshot may hold: no known one is left out. Each filter goes in front of its shard's digests in the order of a partition, and the digests pass it in a stream."""
    key = _key(F.col("digest"))
    no = {"seed": "long", "segment": "long", "segments": "long", "marks": "binary"}
    asked = rows.select(_shard(key, snapshot.shards).alias("shard"), F.lit(1).alias("turn"), key.alias("key"), "digest", *[F.lit(None).cast(t).alias(c) for c, t in no.items()])
    told = snapshot.filters.select("shard", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("digest"), *no)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            shard, turn = batch.column("shard").to_numpy(), batch.column("turn").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard) | (turn[1:] == 0) | (turn[:-1] == 0)) + 1).tolist(), len(shard)] if len(shard) else []
            for i, j in zip(cuts, cuts[1:]):
                if turn[i] == 0:
                    seed, segment, segments, marks = (batch.column(c)[i].as_py() for c in no)
                    now, held = shard[i], BinaryFuse(seed, segment, segments, np.frombuffer(marks, np.uint8))
                elif shard[i] == now:  # else no key of the snapshot is in this shard
                    some = batch.slice(i, j - i)
                    yes = held.may_hold(some.column("key").to_numpy().view(np.uint64))
                    yield pa.RecordBatch.from_arrays([some.column("digest").filter(pa.array(yes))], names=["digest"])

    both = asked.unionByName(told).repartition("shard").sortWithinPartitions("shard", "turn")
    return both.mapInArrow(run, "digest string")


def ingest(store: Store, batch: DataFrame, digest=lambda text: F.sha2(text, 256)) -> tuple[DataFrame, DataFrame]:
    """Take in a batch (id, text; texts as they are to be compared, not null).

    Returns the batch's digests (id, digest, one row per row) and its different
    texts (entry, digest, first_id, size): entry names the text in the store,
    where it is new from now on if it was not before. digest may be any
    function of the text; texts that only share it are kept apart.
    """
    rows = batch.withColumn("digest", digest(F.col("text")))
    ids = materialize(rows.select("id", "digest"), "digests")
    grouped = materialize(group_batch(rows).withColumn("own", F.concat(F.lit(f"{len(store.snapshots)}-"), F.monotonically_increasing_id().cast("string"))), "batch")
    known = None
    for s in store.snapshots:
        maybe = screen(grouped.select("digest").distinct(), s)
        positive = grouped.join(maybe, "digest", "left_semi").select("digest", "text", "own")
        hit = positive.join(s.texts, ["digest", "text"]).select("own", "entry")
        known = hit if known is None else known.unionByName(hit)
    if known is None:
        resolved = grouped.withColumn("entry", F.lit(None).cast("string"))
    else:
        resolved = materialize(grouped.join(materialize(known, "known"), "own", "left"), "resolved")
    new = resolved.where("entry is null").select(F.col("own").alias("entry"), "digest", "text")
    n = new.count()
    if n:
        texts = materialize(new, "snapshot")
        shards = max(1, -(-n // SHARD_KEYS))
        store.snapshots.append(Snapshot(texts, materialize(build_filters(texts.select("digest"), shards), "filters"), shards))
    return ids, resolved.select(F.coalesce("entry", "own").alias("entry"), "digest", "first_id", "size")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """key, keep_id, group_size, kept, digest of every row, kept or not.

    The rows are dealt into batches by a hash of the key, and each batch meets
    the snapshots of those before it. Of equal texts the row of the smallest
    key stays; null counts as the empty text. A null key is above all others
    (where a group has no other, keep_id is null and its rows stay), and rows
    that repeat the smallest key stay together. Other columns are left out; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), normal_text(F.col(text)).alias("text"))
    store, ids, texts = Store(docs.sparkSession), None, None
    for i in range(batches):
        own, found = ingest(store, rows.where(F.pmod(F.xxhash64("id", F.lit("batch")), F.lit(batches)) == i), digest)
        ids = own if ids is None else ids.unionByName(own)
        texts = found if texts is None else texts.unionByName(found)
    classes = texts.groupBy("digest", "entry").agg(F.min("first_id").alias("keep_id"), F.sum("size").alias("group_size"))
    classes = materialize(classes, "classes")
    shared = classes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    clash = not shared.isEmpty()
    clear = classes.join(shared, "digest", "left_anti").drop("entry") if clash else classes.drop("entry")
    total = classes.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    hot = clear.where(F.col("group_size") * HOT >= max(total, HOT))  # at most HOT classes, as their rows are disjoint
    met = ids.join(F.broadcast(hot.select("digest", F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))), "digest", "left")
    few = met.where("_size is null").drop("_keep", "_size").join(clear, "digest")
    out = met.where("_size is not null").withColumnsRenamed({"_keep": "keep_id", "_size": "group_size"}).unionByName(few)
    if clash:  # texts that share a digest are told apart by the texts themselves
        entries = None
        for s in store.snapshots:
            one = s.texts.join(shared, "digest", "left_semi")
            entries = one if entries is None else entries.unionByName(one)
        mixed = rows.withColumn("digest", digest(F.col("text"))).join(entries, ["digest", "text"]).select("id", "digest", "entry").join(classes, ["digest", "entry"])
        out = out.unionByName(mixed.select(*out.columns))
    return out.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op12_exact(spark, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, and whether it is the one that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).withColumnRenamed("digest", "text_sha256")


SQL_OP12 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""

QUERIES = {"op12_exact": op12_exact}
SQL = {"op12_exact": SQL_OP12}
