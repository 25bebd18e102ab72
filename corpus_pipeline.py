"""The training-data pipeline: five operators one after another, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import bpe, mixing, repeats, simhash, toxicity
from kbspark.llm.common import materialize

#: Fitted scores, XXH64, byte-wise repeats and BPE are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under column names that no operator adds, and the new name of each column."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def back(left: DataFrame, own: dict[str, str]) -> DataFrame:
    """The columns that apart() renamed, under their first names."""
    return left.select(*[F.col(x).alias(c) for c, x in own.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier takes for toxic go; it is fitted on these documents' labels outside the held-out fold. Null and empty texts get the score of no words; columns named like the classifier's stay the documents' own."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    renamed, own = apart(docs)
    return back(toxicity.with_score(renamed, model, text=own["text"]).where("predicted = 0"), own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one of smallest doc_id (nulls last), of repeated rows the first; texts without words are copies of each other."""
    renamed, own = apart(docs)
    return back(simhash.keep_one_of_each(renamed, text=own["text"], doc_id=own["doc_id"]), own)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of over 50 words that occur twice, whatever white space stands between the words, go from the texts, every copy of them, and n_chars follows. A text of which nothing but white space is left goes as a whole; untouched texts, null and blank ones among them, stay as they are."""
    renamed, own = apart(docs)
    text, old = F.col(own["text"]), F.col(own["n_chars"])
    left = repeats.remove_repeats(renamed, text=own["text"], length=repeats.WORDS, gram=repeats.WORD_GRAM, cell=repeats.WORD_CELL, words=True, keep_bytes=True)
    cut = F.col("n_removed") > 0
    left = left.withColumn("kept_text", F.when(cut, F.col("kept").cast("string")).otherwise(text)).where(~cut | (F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " ")) != ""))
    n_chars = F.when(cut, F.char_length("kept_text")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("kept_text"), "n_chars": n_chars}
    return left.select(*[new.get(c, F.col(x)).alias(c) for c, x in own.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it, from not at all to three times; a text without words never."""
    return mixing.mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the byte-level BPE of every text that is left, each decoded again."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
