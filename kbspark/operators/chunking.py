"""Chunking, embedding and pooling. Splitters and models run over Arrow batches; everything countable stays in Spark."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import content_type, word_estimate

SIZE, OVERLAP, LEAST = 400, 0.15, 5
SEPARATORS = ["\n\n", "\n", ". ", ", ", " "]


def estimate(text: str) -> int:
    """As word_estimate."""
    return len(text.split()) * 13 // 10


def split_plain(text: str, size: int = SIZE, overlap: int | None = None) -> list[str]:
    """Pieces of at most `size` estimated tokens, cut at the coarsest separator that does, with a tail of the piece before in front."""
    overlap = int(size * OVERLAP) if overlap is None else overlap

    def atoms(t: str, level: int) -> Iterator[str]:
        if estimate(t) <= size and len(t) <= size * 40:
            yield t
        elif level == len(SEPARATORS):
            for i in range(0, len(t), size * 4):
                yield t[i : i + size * 4]
        else:
            sep = SEPARATORS[level]
            parts = t.split(sep)
            for i, p in enumerate(parts):
                yield from atoms(p + sep if i < len(parts) - 1 else p, level + 1)

    out: list[str] = []
    held: list[str] = []
    words = 0  # estimates of parts do not add up, words do
    for a in atoms(text, 0):
        n = len(a.split())
        if held and ((words + n) * 13 // 10 > size or sum(map(len, held)) + len(a) > size * 40):
            out.append("".join(held))
            while held and (words * 13 // 10 > overlap or (words + n) * 13 // 10 > size or sum(map(len, held)) > overlap * 40):
                words -= len(held.pop(0).split())
        held.append(a)
        words += n
    if held:
        out.append("".join(held))
    return out


def split_markdown(text: str) -> list[str]:
    """Sections under a path of headers of level one to three, headers kept.

    Lines are stripped of their margins. A header ends what is above it, unless
    that is a header alone, which stays with the deeper one that follows.
    Paragraphs of one path are one section, and so are neighbouring sections
    that name the same path. Inside a code fence nothing is a header.
    """
    out: list[tuple[dict[int, str], str]] = []
    path: dict[int, str] = {}
    held: list[str] = []
    fence = ""

    def end() -> None:
        if not held:
            return
        block = "\n".join(held)
        held.clear()
        if out and (out[-1][0] == path or (len(out[-1][0]) < len(path) and out[-1][1].rsplit("\n", 1)[-1].startswith("#"))):
            out[-1] = (dict(path), f"{out[-1][1]}  \n{block}")
        else:
            out.append((dict(path), block))

    for line in text.split("\n"):
        line = "".join(c for c in line.strip() if c.isprintable())
        if fence:
            held.append(line)
            if line.startswith(fence):
                fence = ""
            continue
        if (line.startswith("```") and line.count("```") == 1) or line.startswith("~~~"):
            fence = line[:3]
            held.append(line)
        elif header := re.match(r"(#{1,3})(?: (.*))?$", line):
            end()
            level = len(header[1])
            path = {k: v for k, v in path.items() if k < level} | {level: (header[2] or "").strip()}
            held.append(line)
        elif line:
            held.append(line)
        else:
            end()
    end()
    return [block for _, block in out]


HEADERS, VOID, SILENT = {"h1", "h2", "h3"}, set("area base br col embed hr img input link meta source track wbr".split()), {"script", "style", "head", "title"}


class _Elements(HTMLParser):
    """The elements of a page in the order in which they begin, each with the texts that stand in it directly."""

    def __init__(self):
        super().__init__()
        self.nodes: list[tuple[str, list[str]]] = [("", [])]
        self.open = [0]

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, []))
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[i]][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if data.strip() and not any(self.nodes[i][0] in SILENT for i in self.open):
            self.nodes[self.open[-1]][1].append(data.strip())


def split_html(text: str) -> list[str]:
    """Sections between headers h1 to h3, each header a section of its own. The texts of one element are set apart by a blank, those of different elements by a line."""
    p = _Elements()
    p.feed(text)
    p.close()
    out: list[list[str]] = [[]]
    for tag, texts in p.nodes:
        if not texts:
            continue
        if tag in HEADERS:
            out += [[" ".join(texts)], []]
        else:
            out[-1].append(" ".join(texts))
    return ["  \n".join(x) for x in out if x]


#: Texts that a worker takes apart before it passes on what it made.
TEXTS = 64


def _pieces(it: Iterator[pa.RecordBatch], split: Callable[[dict], list[str]], number: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept columns, the number and the content of each piece of every row's text: a few texts at a time, so that an Arrow batch never stands beside all of its pieces."""
    for batch in it:
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            rows = [(i, n, c) for i, row in enumerate(some.to_pylist()) for n, c in enumerate(split(row))]
            place, numbers, contents = zip(*rows) if rows else ((), (), ())
            kept = [some.column(k).take(pa.array(place, pa.int64())) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), pa.array(contents, pa.string())], names=[*keep, number, "content"])


def sections(docs: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """key, section, content: the sections of every document's whole text, of kind markdown or html."""
    split = {"markdown": split_markdown, "html": split_html}[kind]
    key_type = docs.schema[key].dataType.simpleString()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(it, lambda row: split(row["text"]), "section", ["key"])

    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    return d.mapInArrow(cut, f"key {key_type}, section int, content string").withColumnRenamed("key", key)


def secondary(found: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """key, section, part, content: sections over the size cut again as plain text, the others as they are. Only the large ones go through Python."""
    key_type = found.schema[key].dataType.simpleString()
    large = word_estimate(F.col("content")) > size
    x = found.select(F.col(key).alias("key"), "section", "content")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(it, lambda row: split_plain(row["content"], size), "part", ["key", "section"])

    again = x.where(large).mapInArrow(cut, f"key {key_type}, section int, part int, content string")
    return x.where(~large).select("key", "section", F.lit(0).alias("part"), "content").unionByName(again).withColumnRenamed("key", key)


def chunk(docs: DataFrame, key: str, text: str, size: int = SIZE, path: str | None = None) -> DataFrame:
    """key, ord, content of every document.

    Blank texts have no chunks, short ones are one chunk. Others are cut by
    content type, sections over the size again as plain text. Pieces under
    LEAST tokens go if another one stays.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), content_type(F.col(text), F.col(path) if path else None).alias("kind")).where(F.col("text").rlike(r"[^\t\n\f\r ]"))
    small = d.where(word_estimate(F.col("text")) <= size).select("key", F.lit(0).alias("ord"), F.trim("text").alias("content"))
    kind = d.schema["key"].dataType.simpleString()

    def pieces(row: dict) -> list[str]:
        t, how = row["text"], row["kind"]
        parts = split_markdown(t) if how == "markdown" else split_html(t) if how == "html" else [t]
        found = [c.strip() for p in parts for c in (split_plain(p, size) if estimate(p) > size else [p])]
        found = [c for c in found if c]
        return [c for c in found if estimate(c) >= LEAST] or found

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(it, pieces, "ord", ["key"])

    large = d.where(word_estimate(F.col("text")) > size).mapInArrow(cut, f"key {kind}, ord int, content string")
    return small.unionByName(large).withColumnRenamed("key", key)


def hashing_embedder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A model for tests: signed counts of words by hash, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % width] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 50, attempts: int = 3) -> DataFrame:
    """Add embedding (array of double) by calling the model with up to `batch` texts, trying again on failure; a wrong number of vectors is a failure."""
    schema = rows.withColumn("embedding", F.array(F.lit(0.0))).schema

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts, vectors = pdf[text].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                for left in range(attempts - 1, -1, -1):
                    try:
                        got = model(some)
                        if len(got) != len(some):
                            raise ValueError(f"{len(got)} vectors for {len(some)} texts")
                        break
                    except Exception:
                        if not left:
                            raise
                vectors += got
            yield pdf.assign(embedding=vectors)

    return rows.mapInPandas(run, schema)


def mean_pool(rows: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """key, embedding: unit vectors averaged by position and scaled to unit length; a key whose vectors are all zero keeps a zero vector. Vectors of a key have one length."""
    e = F.transform(embedding, lambda x: x.cast("double"))
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.where(F.col(embedding).isNotNull()).select(key, e.alias("e")).withColumn("n", norm("e")).where("n >= 0").select(key, F.posexplode(F.transform("e", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(x))))
    mean = unit.groupBy(key, "pos").agg(F.avg("col").alias("v")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p"))
    vec = mean.select(key, F.transform("p", lambda s: s["v"]).alias("e")).withColumn("n", norm("e"))
    return vec.select(key, F.when(F.col("n") > 0, F.transform("e", lambda x: x / F.col("n"))).otherwise(F.col("e")).alias("embedding"))


def embed_long(docs: DataFrame, key: str, text: str, model) -> DataFrame:
    """One vector per document: of the text if it is short, else the pooled vectors of its chunks."""
    return mean_pool(embed(chunk(docs, key, text), "content", model), key)


def chunk_statistics(chunks: DataFrame, key: str) -> DataFrame:
    n = F.char_length("content")
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.avg(n).alias("avg_chars"))


def rebuild_selection(entities: DataFrame, vectors: DataFrame, key: str, text: str, mode: str) -> DataFrame:
    """Entities to embed again: those that have vectors (existing) or all with text (all)."""
    if mode == "existing":
        return entities.join(vectors.select(F.col("source_id").alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")
    if mode != "all":
        raise ValueError("mode is existing or all")
    return entities.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")


def ordered(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("ord")))
