"""A Merkle manifest of a dataset, kept as a postorder append log.

Leaves of a group stand in order of their ids. A node is written as soon as all
below it are, so a log of n leaves is the tree in postorder, and the place of
each node follows from the sizes of the subtrees before it, without a search.
The log is built in segments: an aligned builder takes 2^BITS neighbouring
leaves and writes their whole subtree; the roots of the segments are the leaves
of the next round, until one node is left. Proofs read their siblings from the
segments by place, a round from each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kbspark.llm.common import materialize

#: A segment has two to this power leaves at most.
BITS = 12

#: Bytes of a digest.
WIDTH = 32


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves: pairs are joined, and a last one alone too, until one node is left."""
    return (n - 1).bit_length() if n else 0


def nodes_before(leaves: int) -> int:
    """Nodes that are complete when so many leaves are: a leaf and all aligned subtrees that end with one."""
    return 2 * leaves - leaves.bit_count()


def log_place(level: int, index: int, n: int, levels: int | None = None) -> int:
    """Place of a node in the postorder log of n leaves, closed at `levels` levels (the tree's height where none is given).

    A node over 2^level whole leaves follows the nodes complete before its last
    leaf, that leaf, and its own lower levels; a node that lacks leaves is
    written when the log is closed, after all whole ones and the lower ones
    like it.
    """
    end = (index + 1) << level
    if end <= n:
        return nodes_before(end - 1) + level
    top = height(n) if levels is None else levels
    whole = sum(n >> j for j in range(min(top, n.bit_length()) + 1))
    return whole + sum(1 for j in range(level) if n & ((1 << j) - 1))


def append_log(leaves: list[bytes], levels: int) -> bytes:
    """The log of the leaves' tree: digests of all nodes in the order in which they are complete, closed at `levels` levels. A node is the digest of its children's hexadecimal digests."""
    out: list[bytes] = []
    open_nodes: list[tuple[int, bytes]] = []  # the whole subtrees that wait for a partner, the highest first
    for leaf in leaves:
        level, node = 0, leaf
        out.append(node)
        while open_nodes and open_nodes[-1][0] == level and level < levels:
            node = digest_of(open_nodes.pop()[1], node)
            level += 1
            out.append(node)
        open_nodes.append((level, node))
    level, rest = 0, None  # what lacks leaves, from the lowest level up
    while level < levels:
        left = open_nodes.pop()[1] if open_nodes and open_nodes[-1][0] == level else None
        if left is not None or rest is not None:
            rest = digest_of(*[x for x in (left, rest) if x is not None])
            out.append(rest)
        level += 1
    return b"".join(out)


def digest_of(*children: bytes) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in children).encode()).digest()


def siblings(log: bytes, at: int, n: int, levels: int) -> list[tuple[int, bytes]]:
    """From a leaf's level up, the other node of its run with its side (0 left, 1 right), or side 2 and nothing where it is alone."""
    out = []
    for level in range(levels):
        i = (at >> level) ^ 1
        if i << level >= n:
            out.append((2, b""))
        else:
            p = log_place(level, i, n, levels) * WIDTH
            out.append((i & 1, log[p : p + WIDTH]))
    return out


def fold(leaf: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for side, other in path:
        leaf = digest_of(leaf) if side == 2 else digest_of(leaf, other) if side == 1 else digest_of(other, leaf)
    return leaf


def pack(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + other for side, other in path)


def unpack(data: bytes) -> list[tuple[int, bytes]]:
    out, i = [], 0
    while i < len(data):
        step = 1 if data[i] == 2 else 1 + WIDTH
        out.append((data[i], data[i + 1 : i + step]))
        i += step
    return out


def segments(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """tree, block, n (leaves of the tree), at (places of the block's leaves in the block), items, log: one row per aligned block.

    leaves: tree (never null), place (from 0 within the tree), n, digest
    (binary) and item, anything that comes along. A block's group is bounded
    by its 2^bits places, however large a tree is.
    """
    block = F.shiftright("place", bits)
    g = leaves.groupBy("tree", block.alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "item"))).alias("x"))
    lean = g.select("tree", "block", "n", F.col("x.item").alias("items"), F.col("x.digest").alias("digests"))
    fields = {f.name: f.dataType for f in lean.schema if f.name != "digests"}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, roots = [], []
            for n, digests in zip(batch.column("n").to_pylist(), batch.column("digests")):
                logs.append(append_log(digests.as_py(), bits if n > 1 << bits else height(n)))
                roots.append(logs[-1][-WIDTH:])
            kept = [batch.column(c) for c in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(logs, pa.binary()), pa.array(roots, pa.binary())], names=[*fields, "log", "root"])

    return lean.mapInArrow(build, ", ".join(f"{c} {t.simpleString()}" for c, t in fields.items()) + ", log binary, root binary")


def rounds(leaves: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """Segments of all rounds, written: those over the leaves, then over their roots, and so on until each tree has one."""
    out = []
    while True:
        done = materialize(segments(leaves, bits), "segments")
        out.append(done)
        most = done.agg(F.max("n")).first()[0] or 0
        if most <= 1 << bits:
            return out
        whole = F.lit(1 << bits)
        up = done.where(F.col("n") > whole)
        leaves = up.select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / whole).cast("long").alias("n"), F.col("root").alias("digest"), F.lit(0).alias("item"))


def roots(built: list[DataFrame], bits: int = BITS) -> DataFrame:
    """tree, root: each tree's last node, from the round in which it has one segment."""
    out = None
    for r in built:
        one = r.where(F.col("n") <= 1 << bits).select("tree", "root")
        out = one if out is None else out.unionByName(one)
    return out


def _paths(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Of each segment the paths of its leaves up to the top: its own siblings and, behind them, those of the rounds above."""
    for batch in batches:
        rows: list[tuple] = []
        for tree, block, n, log, above, size in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "log", "above", "size"))):
            levels = bits if n > 1 << bits else height(n)
            rows += [(tree, (block << bits) + i, pack(siblings(log, i, size, levels)) + (above or b"")) for i in range(size)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["tree", "place", "path"])


def segment_paths(built: list[DataFrame], top: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """The lowest round's segments with above, the packed path from their roots on: rounds are joined from the top, one row per segment. top: tree, path from a tree's root on, if that is a leaf of another tree."""
    above = None
    for r in reversed(built):
        x = r.withColumn("size", F.size("items").cast("long"))
        single = F.col("n") <= 1 << bits
        if above is not None:
            x = x.join(above.select("tree", F.col("place").alias("block"), F.col("path").alias("above")), ["tree", "block"], "left")
        else:
            x = x.withColumn("above", F.lit(None).cast("binary"))
        if top is not None:
            x = x.join(top.select("tree", F.col("path").alias("_top")), "tree", "left")
            x = x.withColumn("above", F.when(single, F.col("_top")).otherwise(F.col("above"))).drop("_top")
        if r is built[0]:
            return x
        above = x.mapInArrow(lambda b: _paths(b, bits), "tree string, place long, path binary")
    raise ValueError("no rounds")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add place (from 0) and n within a tree: rows are dealt by ranges of tree and order, so a tree of any size is spread, and only counts by tree and partition are added up."""
    ranged = materialize(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    parts = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row per tree and partition
    w = Window.partitionBy("tree")
    parts = parts.withColumn("_before", F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).withColumn("n", F.sum("_n").over(w)).drop("_n")
    return ranged.join(parts, ["tree", "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def part(value: Column) -> Column:
    """A field of a leaf: a dash for null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(docs: DataFrame, tampered: bool = False) -> Column:
    """Digest of a document's fields, or of those with one added to n_chars."""
    value = {c: F.col(c) for c in FIELDS}
    if tampered:
        value["n_chars"] = value["n_chars"] + 1
    return F.unhex(F.sha2(F.concat(*[part(value[c]) for c in FIELDS]), 256))


def manifest(docs: DataFrame, tamper: Column, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Each language is a tree over its documents in order of doc_id (null first,
    repeated ids by their leaf), and the languages' roots, null first, are the
    leaves of one more. Documents for which tamper holds are checked with a
    changed n_chars (a null one stays as it is), all others as they are.
    Columns other than the five fields are left out; an empty table has no
    rows. A tree is cut into segments wherever its rows lie, so a language of
    any share is spread; the rounds above hold one row per segment.
    """
    kind = docs.schema["doc_id"].dataType
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, and apart from the empty name
    lean = materialize(docs.select(tree.alias("tree"), "doc_id", leaf_of(docs).alias("digest"), F.when(F.coalesce(tamper, F.lit(False)), leaf_of(docs, True)).alias("changed")), "leaves")
    leaves = placed(lean, ["doc_id", "digest"]).withColumn("item", F.struct("doc_id", "changed"))
    built = rounds(leaves.select("tree", "place", "n", "digest", "item"), bits)
    subroots = materialize(roots(built, bits), "subroots")
    tops = rounds(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("item"), F.col("root").alias("digest")), ["item"]), bits)
    root = roots(tops, bits).select(F.col("root").alias("whole"))  # one row
    pairs = segment_paths(tops, None, bits)
    up = pairs.mapInArrow(lambda b: _item_paths(b, bits), "tree string, path binary")
    x = segment_paths(built, up, bits).join(subroots.select("tree", F.col("root").alias("subroot")), "tree").crossJoin(F.broadcast(root))
    id_type = to_arrow_type(kind)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        types = [id_type, *[pa.string()] * 5, pa.bool_()]
        for batch in batches:
            for row in batch.to_pylist():
                n, size, log = row["n"], row["size"], row["log"]
                levels, above, rows = bits if n > 1 << bits else height(n), unpack(row["above"] or b""), []
                for i, item in enumerate(row["items"]):
                    path = siblings(log, i, size, levels) + above
                    p = log_place(0, i, size, levels) * WIDTH
                    leaf = log[p : p + WIDTH]
                    folded = fold(item["changed"] or leaf, path)
                    proof = hashlib.sha256("".join(other.hex() for _, other in path).encode()).hexdigest()
                    rows.append((item["doc_id"], leaf.hex(), row["subroot"].hex(), row["whole"].hex(), proof, folded.hex(), folded == row["whole"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return x.mapInArrow(prove, f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _item_paths(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The paths of the trees whose roots are a segment's items."""
    for batch in batches:
        for row in batch.to_pylist():
            n, size = row["n"], row["size"]
            levels = bits if n > 1 << bits else height(n)
            paths = [pack(siblings(row["log"], i, size, levels)) + (row["above"] or b"") for i in range(size)]
            yield pa.RecordBatch.from_arrays([pa.array(row["items"], pa.string()), pa.array(paths, pa.binary())], names=["tree", "path"])


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether it still folds to the root; a document whose number's checksum seven divides is changed before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"
_PART = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_PART.format({"n_chars": n}.get(c, c)) for c in FIELDS) + ")"

#: Levels of both kinds of tree in turn, then each document's way up, a step a row.
SQL_OP13 = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, {_LEAF('n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF('n_chars + 1')} END AS changed FROM documents
), low AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaf
), sub AS (
  SELECT lang, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM low
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM sub WHERE n > 1 GROUP BY lang, level, place // 2, n
), subroot AS (
  SELECT lang, level AS height, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM sub WHERE n = 1
), top AS (
  SELECT 0 AS level, place, h, n FROM subroot
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, place // 2, n
), node AS (
  SELECT coalesce('=' || s.lang, '') AS tree, s.level, s.place, s.h FROM sub s UNION ALL SELECT 'top', level, place, h FROM top
), way AS (
  SELECT low.doc_id, low.leaf, low.place AS id, low.lang, 0 AS level, low.place, coalesce('=' || low.lang, '') AS tree, r.height, r.place AS next, r.h AS subroot,
         coalesce(low.changed, low.leaf) AS folded, '' AS proof
  FROM low JOIN subroot r ON r.lang IS NOT DISTINCT FROM low.lang
  UNION ALL
  SELECT w.doc_id, w.leaf, w.id, w.lang, CASE WHEN w.level = w.height THEN 0 ELSE w.level + 1 END, CASE WHEN w.level = w.height THEN w.next ELSE w.place // 2 END,
         CASE WHEN w.level = w.height THEN 'top' ELSE w.tree END, CASE WHEN w.level = w.height THEN (SELECT max(level) FROM top) ELSE w.height END, w.next, w.subroot,
         CASE WHEN w.level = w.height THEN w.folded WHEN o.h IS NULL THEN sha256(w.folded) WHEN w.place % 2 = 0 THEN sha256(w.folded || o.h) ELSE sha256(o.h || w.folded) END,
         CASE WHEN w.level = w.height THEN w.proof ELSE w.proof || coalesce(o.h, '') END
  FROM way w LEFT JOIN node o ON o.tree = w.tree AND o.level = w.level AND o.place = xor(w.place, 1)
  WHERE NOT (w.tree = 'top' AND w.level = w.height)
)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM top WHERE n = 1) AS verified
FROM way WHERE tree = 'top' AND level = height
"""

QUERIES = {"op13_merkle": op13_merkle}
SQL = {"op13_merkle": SQL_OP13}
