"""WARC archives with revisit records in place of repeated payloads.

Headers are shuffled by payload digest; of the records that share a payload of enough bytes
one stays a response and the others become revisits that refer to it. Archives are written
with fresh headers by Spark's text writer (a record ends in two CRLF, which is the writer's
line separator), so any file system and task retries are covered. Reading parses whole
archives, whose size is bounded, hashes the payloads again and joins each revisit to its
response.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Least payload bytes of a record that others may revisit; payload bytes aimed at in an archive.
LEAST_BYTES, ARCHIVE_BYTES = 1000, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"
_RECORD = "record long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def plan_revisits(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """`page_id, url, payload` with digest, payload_bytes, record_type and refers_to, a partition for each archive.

    Of records with equal payloads of `least` bytes or more, that with the largest page_id is
    the response. Rows that repeat this id too are all responses. A null payload is empty; a
    record without an id is a response and never referred to.

    Only headers are shuffled by digest; payloads move once, to archives of about
    `archive_bytes`, where the headers' decisions join them. A payload that very many records
    share is decided without gathering their headers. A payload of any length is one record,
    in an archive of its own if it is long; it is held whole. Other columns are not read and may
    have any names; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    scratch = C.Scratch(spark, "revisits")
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    x = x.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})
    heads = scratch.store(x.select("page_id", "digest", "payload_bytes"), "heads")
    total = heads.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*")).first()
    heads = heads.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    original = heads.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    original = scratch.store(original, "originals", narrow=True)
    revisits = C.join_hot(heads, original, "digest", total[1]).where("page_id <> refers_to").distinct()
    files = max(1, -(-(total[0] + 500 * total[1]) // archive_bytes))
    # records without an id are never revisits; their addresses spread them
    spread = F.when(F.col("page_id").isNull(), F.xxhash64("url", "digest")).otherwise(0)
    x = x.withColumn("spread", spread).repartition(files, "page_id", "digest", "spread")
    x = x.join(revisits.withColumn("spread", F.lit(0).cast("long")), ["page_id", "digest", "spread"], "left").drop("spread")
    return x.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))


def write_archives(planned: DataFrame, path: str, compress: bool = True) -> None:
    """Write records as WARC/1.0 files below `path`, one for each partition."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    unnamed = F.concat(F.lit("none-"), F.monotonically_increasing_id().cast("string"))
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), unnamed), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("payload"))
    head = [
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", uri("page_id")),
        line("WARC-Date", F.lit(WARC_DATE)),
        # an address may hold anything; line ends would end the header
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.translate("url", "\r\n", "  "))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uri("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    ]
    planned.select(F.concat(*head, body).alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip" if compress else "none").text(path)


def _number(uri: bytes | None) -> int | None:
    text = (uri or b"").strip(b"<>").rpartition(b":")[2]
    return None if not text or text.startswith(b"none-") else int(text)


def parse_archive(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, payload) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for b in batches:
        for i in range(b.num_rows):
            data = b.column(0)[i].as_py()
            if data[:2] == b"\x1f\x8b":
                data = zlib.decompress(data, wbits=31)
            rows = []
            for k, (f, payload) in enumerate(parse_archive(data)):
                kind = f[b"WARC-Type"].decode()
                digest = hashlib.sha1(payload).hexdigest() if kind == "response" else f[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                url = f.get(b"WARC-Target-URI")
                rows.append((k, _number(f[b"WARC-Record-ID"]), url and url.decode(), kind, len(payload), digest, _number(f.get(b"WARC-Refers-To"))))
            names = ["record", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below `path`, each revisit with the figures of its response's payload.

    Columns: page_id, url, record_type, payload_bytes, payload_digest (hashed again from the
    payload; bare hex) and refers_to. A revisit whose response is missing has null figures.
    """
    C.tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    # archives are read once: what is joined are their records' headers
    heads = C.Scratch(spark, "records").store(files.mapInArrow(_read, _RECORD).drop("record"), "heads")
    revisits = heads.where("record_type = 'revisit'")
    responses = heads.where("record_type = 'response' and page_id is not null").groupBy("page_id")
    # repeated ids: the record that a revisit means is the larger
    originals = responses.agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("of")).select(F.col("page_id").alias("refers_to"), "of.*")
    counts = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    known = originals.join(counts, "refers_to")
    joined = C.join_hot(revisits.drop("payload_bytes", "payload_digest"), known, "refers_to", heads.count()).select(heads.columns)
    missing = revisits.join(originals.select("refers_to"), "refers_to", "left_anti").select(heads.columns)
    missing = missing.withColumns({"payload_bytes": F.lit(None).cast("long"), "payload_digest": F.lit(None).cast("string")})
    return heads.where("record_type = 'response'").unionByName(joined).unionByName(missing)
