"""File sources and sinks.

Folders of small files become DataFrames through Spark's own readers
(``binaryFile``, ``text`` with ``wholetext``), so listing and reading are
distributed and a folder of millions of files is split across tasks.
"""

from __future__ import annotations

import email
import email.policy

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vetline.functions import text as tx
from vetline.session import path_exists

MESSAGE_SCHEMA = "path string, html string"


def read_messages(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """``*.eml`` files as ``path, modificationTime, length, content``.
    In streaming form, add ``cleanSource`` to delete/archive processed files."""
    r = spark.readStream if stream else spark.read
    r = r.format("binaryFile").option("pathGlobFilter", "*.eml")
    if stream:
        from pyspark.sql.types import (BinaryType, LongType, StringType, StructField, StructType,
                                       TimestampType)
        r = r.schema(StructType([StructField("path", StringType()),
                                 StructField("modificationTime", TimestampType()),
                                 StructField("length", LongType()),
                                 StructField("content", BinaryType())]))
    return r.load(folder)


def drain_messages(spark: SparkSession, folder: str, archive: str, out: str, checkpoint: str):
    """Take in all mail that is there and stop (S1): each file becomes one row
    (``path, received, raw``) of the file sink ``out``, exactly once however often the
    job dies and is started again with the same checkpoint; files of finished
    batches are moved to ``archive``.  Bytes stay in the JVM."""
    rows = (spark.readStream.schema(spark.read.format("binaryFile").load(folder).schema).format("binaryFile")
            .option("pathGlobFilter", "*.eml").option("cleanSource", "archive").option("sourceArchiveDir", archive).load(folder)
            .select("path", F.col("modificationTime").alias("received"), F.col("content").alias("raw")))
    return (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _html_body(raw: bytes) -> str:
    """First text/html part in walk order, declared charset or utf-8, bad
    bytes replaced; no HTML part -> '' (S2, C24)."""
    msg = email.message_from_bytes(raw or b"")
    parts = msg.walk() if msg.is_multipart() else [msg]
    for part in parts:
        if part.get_content_type() == "text/html":
            payload = part.get_payload(decode=True) or b""
            charset = part.get_content_charset() or "utf-8"
            try:
                return payload.decode(charset, errors="replace")
            except LookupError:
                return payload.decode("utf-8", errors="replace")
    return ""


def message_html(messages: DataFrame) -> DataFrame:
    """MIME decode per message in Arrow batches (S2); the batch size bounds
    memory, the message count bounds nothing."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"],
                                "html": [_html_body(b) for b in pdf["content"]]})
    return messages.select("path", "content").mapInPandas(run, MESSAGE_SCHEMA)


def read_lines(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """Trimmed non-blank lines, ``#`` comments dropped, with their position
    (S3 links, S7 keywords).  A missing file gives an empty frame (pass all)."""
    if not path_exists(spark, path):  # only a missing file passes all; other errors are raised
        return spark.createDataFrame([], "pos long, kw string")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"),
                                        tx.trim_ws("value").alias("v"))
    rows = rows.where((F.col("v") != "") & ~F.col("v").startswith("#"))
    v = F.lower("v") if lower else F.col("v")
    return rows.select("pos", v.alias("kw"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Exclusion keywords ``(pos, kw)``, lower-cased, in file order."""
    return read_lines(spark, path, lower=True)


def read_shortcuts(spark: SparkSession, folder: str, loose: bool = False) -> DataFrame:
    """``*.url`` internet shortcuts -> ``name, url`` (S4 strict / S5 loose)."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", "*.url").text(folder)
    name = F.regexp_replace(_file_name(), r"\.url$", "")
    return df.select(name.alias("name"), tx.shortcut_url("value", loose=loose).alias("url"))


def _file_name():
    """File name of the row's source file (hidden metadata column), decoded."""
    n = F.col("_metadata.file_name")
    return F.url_decode(F.replace(n, F.lit("+"), F.lit("%2B")))


def read_documents(spark: SparkSession, folder: str, exclude_sidecars: bool = False) -> DataFrame:
    """``*.md`` listing documents as ``stem, body_md`` (S9); stage 06 leaves
    out ``_REPORT`` / ``_SCORING`` sidecars."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder)
    stem = F.regexp_replace(_file_name(), r"\.md$", "")
    out = df.select(stem.alias("stem"), F.col("value").alias("body_md"))
    if exclude_sidecars:
        out = out.where(~F.col("stem").rlike(r"_(REPORT|SCORING)$"))
    return out


def read_seen(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Seen list (S6): a Parquet table of ``url``, or a text file of trimmed,
    non-empty lines; distinct either way."""
    if fmt == "text":
        df = spark.read.text(path).select(tx.trim_ws("value").alias("url"))
        return df.where(F.col("url") != "").distinct()
    return spark.read.parquet(path).select("url").distinct()


def read_listing_db(spark: SparkSession, path: str) -> DataFrame:
    """Listing table snapshot (S11), upgraded to the full column set (K9)."""
    from vetline.operators.listing_db import upgrade_schema
    return upgrade_schema(spark.read.parquet(path))


def pair_documents(docs: DataFrame, shortcuts: DataFrame, stage: str = "extract") -> DataFrame:
    """Listing document + shortcut sharing a stem (J4, F17): the extraction
    stage needs the partner (inner join), the scoring stage tolerates its
    absence (left join, url null)."""
    how = "inner" if stage == "extract" else "left"
    return docs.join(shortcuts.withColumnRenamed("name", "stem"), "stem", how)


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """Criteria text as one value (S10); a missing file is an error."""
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("criteria"))


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """New snapshot directory per write (K1-K3, K5-K9); never overwrite a path
    that is being read."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_routed(df: DataFrame, path: str, outcome_col: str = "outcome", outcomes: tuple[str, ...] = ()) -> dict[str, int]:
    """Route rows to outcome folders in one write (K10): one directory per
    outcome value, so a reader of one outcome prunes the others.

    Gives the rows of each of ``outcomes`` and of all (key ``""``), counted by the
    write itself (A1): no second pass."""
    seen = Observation()
    counts = [F.count_if(F.col(outcome_col) == o).alias(f"n{i}") for i, o in enumerate(outcomes)]
    (df.observe(seen, F.count(F.lit(1)).alias("n"), *counts)
     .write.mode("errorifexists").partitionBy(outcome_col).parquet(path))
    got = seen.get
    return {"": got["n"], **{o: got[f"n{i}"] for i, o in enumerate(outcomes)}}


def append_rows(df: DataFrame, path: str) -> None:
    """Append a batch (seen list K2, listing rows K5/K6)."""
    df.write.mode("append").parquet(path)


def write_shortcut_text(url) -> "F.Column":
    """Internet-shortcut body for a URL (K1)."""
    return F.concat(F.lit("[InternetShortcut]\nURL="), url, F.lit("\n"))
