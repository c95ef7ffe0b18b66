"""The listing table in ref buckets, updated without rewriting it.

A row lives in bucket ``ref_nr mod buckets``.  Each change writes new versions of
the buckets it touches (``v=N/bucket=B``) and then one small pointer file that
names the version of every bucket; a reader takes the newest pointer, so it
sees a change whole or not at all, and a change that dies leaves no trace but
unread files.  Two writers can't both commit one version: the pointer is
created, never replaced.

Rows whose ref can't be read as a number live in bucket 0.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.operators import listing_db as ldb
from vetline.session import list_names

#: A bucket is rewritten as a whole: with 10 billion rows it has 150,000.
BUCKETS = 65_536


def _bucket(df: DataFrame, buckets: int):
    return F.coalesce(F.pmod(ldb.ref_key(df, "ref_nr"), F.lit(buckets)), F.lit(0)).cast("int")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, root: str) -> int:
    """The newest committed version."""
    found = (re.fullmatch(r"(\d+)\.json", n) for n in list_names(spark, os.path.join(root, "_pointer")))
    return max((int(m.group(1)) for m in found if m), default=-1)


def pointer(spark: SparkSession, root: str, n: int | None = None) -> dict:
    """``buckets``, ``schema`` and ``versions`` (of the buckets that hold rows)."""
    n = version(spark, root) if n is None else n
    if n < 0:
        raise FileNotFoundError(f"no listing table in {root}")
    p, fs = _path(spark, os.path.join(root, "_pointer", f"{n}.json"))
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, n: int, content: dict) -> None:
    p, fs = _path(spark, os.path.join(root, "_pointer", f"{n}.json"))
    out = fs.create(p, False)  # fails if another writer was first
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()


def _write(df: DataFrame, root: str, n: int, buckets: int) -> list[int]:
    """Write the rows of a version and give the buckets that hold any."""
    spark, folder = df.sparkSession, os.path.join(root, f"v={n}")
    (df.withColumn("bucket", _bucket(df, buckets)).repartition("bucket").write.mode("overwrite")
     .partitionBy("bucket").parquet(folder))
    return [int(m.group(1)) for m in (re.fullmatch(r"bucket=(\d+)", x) for x in list_names(spark, folder)) if m]


def create(db: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Store a table as version 0."""
    held = _write(db, root, 0, buckets)
    _commit(db.sparkSession, root, 0, {"buckets": buckets, "schema": db.schema.json(), "versions": {str(b): 0 for b in held}})


def read(spark: SparkSession, root: str, n: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The table (as of version ``n``), or the rows of some of its buckets."""
    from pyspark.sql.types import StructType

    at = pointer(spark, root, n)
    schema = StructType.fromJson(json.loads(at["schema"]))
    wanted = at["versions"] if only is None else {str(b): at["versions"][str(b)] for b in only if str(b) in at["versions"]}
    paths = [os.path.join(root, f"v={v}", f"bucket={b}") for b, v in wanted.items()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def update(spark: SparkSession, root: str, updates: DataFrame, columns: list[str], **how) -> list[int]:
    """Apply ``listing_db.update_by_ref`` and commit; only buckets that hold an
    updated ref are read and written.  Gives those buckets (at most ``buckets``
    numbers reach the driver)."""
    n = version(spark, root)
    at = pointer(spark, root, n)
    touched = sorted(r[0] for r in updates.select(_bucket(updates, at["buckets"]).alias("b")).distinct().collect())
    touched = [b for b in touched if str(b) in at["versions"]]
    if touched:
        rows = read(spark, root, n, touched)
        held = _write(ldb.update_by_ref(rows, updates, columns, **how).drop("updated"), root, n + 1, at["buckets"])
        _commit(spark, root, n + 1, {**at, "versions": {**at["versions"], **{str(b): n + 1 for b in held}}})
    return touched


def append(spark: SparkSession, root: str, rows: DataFrame) -> list[int]:
    """Add rows; buckets that get none are not touched."""
    n = version(spark, root)
    at = pointer(spark, root, n)
    rows = rows.select(*[f.name for f in read(spark, root, n, []).schema.fields])
    touched = sorted(r[0] for r in rows.select(_bucket(rows, at["buckets"]).alias("b")).distinct().collect())
    if touched:
        held = _write(read(spark, root, n, touched).unionByName(rows), root, n + 1, at["buckets"])
        _commit(spark, root, n + 1, {**at, "versions": {**at["versions"], **{str(b): n + 1 for b in held}}})
    return touched
