"""A content-addressed WARC archive.

Payload bytes are stored once for each strong digest (SHA-256, verified: equal digests must have equal
bytes), the exact header of every record is stored apart, and a join of the two gives the original
records back, byte for byte.

Layout: ``payloads(payload_digest, payload)`` and ``records(record_no, header, payload_digest,
has_block)``, both Parquet. A header ends with its blank line. The block of a response is its payload;
a revisit has none, but its payload is still found by the digest.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the smallest id is the
response; smaller payloads are responses all.

Defined cases: a null payload is empty, as are null urls; rows with a null id are left out of the order
by coming last; repeated rows each get a record; an empty table gives empty archives.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import spread_join, table
from driftline.plans.storage import materialize, new_path

MIN_REVISIT = 100
_EOL = "\r\n"


def classify(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, refers_to`` of every page.

    The smallest id of a digest is found by an aggregate that combines before the shuffle, and is joined
    back; a digest of very many pages is dealt to many tasks.
    """
    base = pages.select(
        F.col("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")
    ).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    first = materialize(
        base.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "digests"
    )
    joined = spread_join(base, first.select("payload_digest", "first_id"), "payload_digest", "page_id", "left", counts=first)
    return joined.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"),
    )


def _record_id(page_id: Column) -> Column:
    h = F.md5(page_id.cast("string").cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def header(date: str) -> Column:
    """The exact header bytes of a record, from the columns of :func:`classify`."""
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace("url", "[\\r\\n]", "")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: text/html; charset=UTF-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return F.encode(F.concat(F.concat_ws(_EOL, *lines), F.lit(_EOL * 2)), "UTF-8")


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive of ``pages(page_id, url, html)`` below ``path``."""
    classified = classify(pages, min_revisit)
    records = classified.select(
        F.col("page_id").alias("record_no"), header(date).alias("header"), "payload_digest", F.col("refers_to").isNull().alias("has_block")
    )
    records.write.parquet(f"{path}/records")
    # min and max over a digest's payloads agree only if all its bytes do
    stored = (
        pages.select(F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
        .groupBy(F.sha2("payload", 256).alias("payload_digest"))
        .agg(F.min("payload").alias("payload"), F.max("payload").alias("other"))
        .select("payload_digest", F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads with one digest"))).alias("payload"))
    )
    stored.write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``record_no, record, payload``: every original record (header, block and the two line ends) and
    its full payload, by a join over the digest. A payload whose digest isn't the stored one fails."""
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "payload_digest",
        F.when(F.sha2("payload", 256) == F.col("payload_digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload is damaged"))).alias("payload"),
    )
    joined = spread_join(records, payloads, "payload_digest", "record_no", "left")
    block = F.when(F.col("has_block"), F.col("payload")).otherwise(F.lit(b""))
    return joined.select("record_no", F.concat("header", block, F.lit((_EOL * 2).encode())).alias("record"), "payload")


def export_files(spark: SparkSession, archive: str, path: str) -> None:
    """Write ordinary ``.warc`` byte streams, one value for each partition, as a table of binaries
    ``part, warc`` below ``path``; rows are in the order of their ids within a part."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        for n, batch in enumerate(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() * 1_000_000 + n], pa.int64()), pa.array([b"".join(batch.column(0).to_pylist())], pa.binary())], names=["part", "warc"]
            )

    read_archive(spark, archive).select("record").mapInArrow(run, "part long, warc binary").write.parquet(path)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header with its blank line, block) of each record of a byte stream."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        length = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if data[end + length : end + length + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, data[end : end + length]
        at = end + length + 4


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: archive all pages in the shared folder, read the records back, and report them."""
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_archive(spark, path)
    back = back.withColumn("_head", F.substring_index(F.decode("record", "ISO-8859-1"), _EOL * 2, 1))
    get = lambda name: F.regexp_extract("_head", f"(?m)^{name}: (.*?)\\r?$", 1)
    refers = get("X-Refers-To-Page-ID")
    return back.select(
        F.col("record_no").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        get("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r
"""
