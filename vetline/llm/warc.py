"""Content-addressed web archive: each payload is stored once under its SHA-256,
record headers are stored apart, byte for byte, and records are put together
again by a join.  Payloads are stored and shuffled as Zstandard frames; digests
are of the bytes themselves.

Plan.  Digests are computed where the pages lie; only digests and ids are
grouped.  The newest copy of a payload (largest id) is its response record and
the one whose bytes are stored; the others revisit it.  A payload with many
copies is read back through several salts (one for each ``SALT_COPIES``
records), so a hot payload is spread over tasks.  Reading verifies every
payload against its digest and fails on a difference.

Defined results: a null payload is empty; payloads shorter than
``min_revisit_bytes`` are always responses; a null url is an empty one; of
repeated rows with one id and payload one is the response and the others
revisit it; ids that are null count as smallest; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetline.llm import common as C

SALT_COPIES = 5_000


def base32(hexadecimal: str) -> Column:
    """Upper-case base32 of 20 bytes given as hexadecimal digits: 5 bits a letter."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(0, 40, 10):  # 40 bits at a time
        part = F.conv(F.substring(hexadecimal, k + 1, 10), 16, 10).cast("long")
        out += [letters.substr(F.shiftright(part, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*out)


def _record_id(page_id):
    h = F.md5(F.concat(F.lit("page/"), page_id.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> None:
    """Write ``path``/payloads (digest, copies, payload) and ``path``/headers
    (page_id, digest, salt, record_type, refers_to, header)."""
    def digest(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            raw = [(x.as_py() or "").encode() for x in b["payload"]]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
                 pa.array([hashlib.sha1(x).hexdigest() for x in raw]), pa.array([len(x) for x in raw], pa.int64()),
                 pa.array([squeeze(x) for x in raw], pa.binary())], ["page_id", "url", "digest", "sha1", "n", "payload"])

    C.small_batches(pages.sparkSession, 500)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = (pages.select(F.col(id_col).alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.col(payload_col).alias("payload"))
            .mapInArrow(digest, f"page_id {kind}, url string, digest binary, sha1 string, n long, payload binary")
            .withColumn("key", F.when(F.col("n") < min_revisit_bytes,
                                      F.concat_ws("/", F.lit("own"), "page_id", F.hex("digest"))).otherwise(F.hex("digest"))))
    light = rows.drop("payload")
    newest = light.groupBy("key").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("copies"))
    nth = F.row_number().over(Window.partitionBy("key", "page_id").orderBy("url"))
    light = (light.join(newest, "key").withColumn("own", F.col("page_id").eqNullSafe(F.col("newest")))
             .withColumn("response", F.col("own") & (nth == 1)))
    crlf = "\r\n"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(crlf))
    header = F.concat(
        F.lit("WARC/1.1" + crlf), line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32("sha1"))),
        F.when(F.col("response"), "").otherwise(F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(F.col("newest"))))),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(F.col("response"), F.col("n")).otherwise(0).cast("string")), F.lit(crlf))
    salts = F.ceil(F.col("copies") / SALT_COPIES)
    (light.select("page_id", "digest", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int").alias("salt"),
                  F.when(F.col("response"), "response").otherwise("revisit").alias("record_type"),
                  F.when(~F.col("response"), F.col("newest")).alias("refers_to"), F.encode(F.coalesce(header, F.lit("")), "UTF-8").alias("header"))
     .write.parquet(f"{path}/headers"))
    pid = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("pid")
    # dropDuplicates finds the rows dealt and sorted by the join: repeated rows are stored once
    (rows.select("key", pid("page_id"), "digest", "payload").join(newest.select("key", pid("newest"), "copies"), ["key", "pid"])
     .dropDuplicates(["key", "pid"]).select("digest", "copies", "payload").write.parquet(f"{path}/payloads"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: page_id, record_type, refers_to, header and its full payload."""
    headers = spark.read.parquet(f"{path}/headers")
    # spread over salts first: grouping and join then share one shuffle of the payloads
    payloads = (spark.read.parquet(f"{path}/payloads")
                .withColumn("salt", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("copies") / SALT_COPIES) - 1).cast("int"))))
                .groupBy("digest", "salt").agg(F.first("payload").alias("payload")))
    joined = headers.join(payloads, ["digest", "salt"]).select("page_id", "record_type", "refers_to", "header", "digest", "payload")

    def verify(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            raw = [expand(x.as_py()) for x in b["payload"]]
            for x, digest in zip(raw, b["digest"]):
                if hashlib.sha256(x).digest() != digest.as_py():
                    raise ValueError(f"a payload differs from its digest {digest.as_py().hex()}")
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(raw, pa.binary())], b.schema.names)

    C.small_batches(spark, 500)
    return joined.mapInArrow(verify, joined.schema)
