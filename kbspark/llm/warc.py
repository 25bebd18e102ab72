"""A content-addressed WARC archive.

Pages are written as WARC records by Spark's text writer: a record ends with
two line breaks, which is the writer's line separator. Of equal payloads of
LEAST bytes or more the one of the smallest id is a response record and the
others are revisits that refer to it. Read back, the archive is two tables: the
exact record headers, and each payload once under its verified SHA-256.
Records are put together again by a join of the two. Files are bounded in bytes,
as long records have files of their own, and are read record by record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.common import materialize, shared_folder

#: Payload bytes from which equal payloads are revisits.
LEAST = 100

#: Bytes of one file before compression, at most (a longer record has a file of its own); a file is read by one task.
FILE_BYTES = 256 << 20

#: Payload bytes up to which records share files; longer ones are written with longer ones.
SIZES = (64 << 10, 4 << 20, 256 << 20)

#: Bytes of record that a reading task holds before it hands them on.
HELD = 8 << 20

DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + "Content-Length: "


@dataclass
class Archive:
    """Where an archive's WARC files lie."""

    path: str


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(END))


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to: null refers_to marks a response. Rows that repeat both id and payload are responses alike; a null id is above all others and, as it names no record, is never referred to."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    first = p.where(F.octet_length("payload") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    joined = p.join(first, "payload_digest", "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(classified: DataFrame, path: str) -> Archive:
    """One WARC record per row, in gzip files of at most FILE_BYTES: records of one range of SIZES are written together, as many to a file as would fit if all were the longest. No row is shuffled for it."""
    length = F.octet_length("payload")
    longest = classified.agg(F.max(length)).first()[0] or 0
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    response = F.col("refers_to").isNull()
    block = F.concat(F.lit(HTTP), F.octet_length("payload").cast("string"), F.lit(END + END), F.when(response, F.col("payload")).otherwise(F.lit("")))
    record = F.concat(
        F.lit("WARC/1.1" + END),
        _line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(response, F.lit("")).otherwise(F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", name(F.col("refers_to"))))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(F.col("block")).cast("string")),
        F.lit(END),
        F.col("block"),
    )
    whole = classified.withColumn("block", block)
    for over, upto in zip((-1, *SIZES), (*SIZES, None)):
        if over < longest:
            some = whole.where((length > over) if upto is None else (length > over) & (length <= upto))
            each = 1 if upto is None else max(1, FILE_BYTES // upto)
            some.select(record.alias("value")).write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)
    return Archive(path)


def parse(data: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Exact header bytes, header fields (names in lower case) and block of each record of a WARC file, gzip or plain, one record in memory at a time. Blocks are cut by Content-Length alone, whatever bytes they hold."""
    source = io.BytesIO(data)
    stream = gzip.GzipFile(fileobj=source) if data[:2] == b"\x1f\x8b" else source
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record before byte {stream.tell()}")
        lines, fields = [line], {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("the file ends within a header")
            lines.append(line)
            key, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                fields[key.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the file ends within a block")
        yield b"".join(lines) + b"\r\n", fields, block


def _digest(fields: dict[str, str]) -> str:
    return fields["warc-payload-digest"].removeprefix("sha256:")


def _rows_out(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of about HELD bytes; the last value of a row is its longest."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 512
        if size > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for at, (head, fields, block) in enumerate(parse(content.as_py())):
                    own = [fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") or None for k in ("warc-record-id", "warc-refers-to")]
                    yield own[0], fields["warc-type"], own[1], _digest(fields), path.as_py(), at, block[: block.index(b"\r\n\r\n") + 4], head

    yield from _rows_out(pa.schema([(c, pa.string()) for c in ("page_id", "record_type", "refers_to", "payload_digest", "file")] + [("at", pa.int64()), ("http", pa.binary()), ("headers", pa.binary())]), rows())


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for at, (_, fields, block) in enumerate(parse(content.as_py())):
                    if fields["warc-type"] != "response":
                        continue
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if hashlib.sha256(payload).hexdigest() != _digest(fields):
                        raise ValueError(f"payload of record {at} does not match its digest {_digest(fields)}")
                    yield path.as_py(), at, _digest(fields), payload

    yield from _rows_out(pa.schema([("file", pa.string()), ("at", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]), rows())


def store(spark: SparkSession, archive: Archive, path: str) -> tuple[DataFrame, DataFrame]:
    """Read an archive's files into two tables under path: headers (one row per record) and payloads (payload_digest, payload: each digest once; every response's bytes are checked against its digest)."""
    files = spark.read.format("binaryFile").load(archive.path).select("path", "content")
    files.mapInArrow(_headers, "page_id string, record_type string, refers_to string, payload_digest string, file string, at bigint, http binary, headers binary").write.option("compression", "zstd").parquet(f"{path}/headers")
    headers = spark.read.parquet(f"{path}/headers")
    # responses that repeat a digest (short payloads mostly) are told by place alone, so that no payload is shuffled
    place = F.struct("file", "at")
    responses = headers.where("record_type = 'response'").select("payload_digest", "file", "at")
    first = responses.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialize(responses.join(first, "payload_digest").where(place != F.col("first")).select("file", "at"), "warc-again")  # its size is known before the join is planned
    payloads = files.mapInArrow(_payloads, "file string, at bigint, payload_digest string, payload binary")
    payloads.join(again, ["file", "at"], "left_anti").select("payload_digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    return headers.drop("file", "at"), spark.read.parquet(f"{path}/payloads")


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record with its whole payload, a revisit's too, and `record`, its exact bytes as they stand in the archive: headers joined to the payload of their digest."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return headers.join(payloads, "payload_digest", "left").withColumn("record", F.concat("headers", "http", block))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Write the pages as WARC, read the archive back, and describe each page's record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    headers, payloads = store(spark, write(classify(pages), f"{folder}/warc"), f"{folder}/store")
    whole = reconstruct(headers, payloads).withColumn("payload_digest", F.sha2("payload", 256))
    kind = pages.schema["page_id"].dataType
    return whole.select(F.col("page_id").cast(kind), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast(kind))


SQL_OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

QUERIES = {"op8_warc": op8_warc}
SQL = {"op8_warc": SQL_OP8}
