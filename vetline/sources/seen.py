"""The seen list as a bucketed table.

The list only grows, so it must not be shuffled for every batch that is
compared with it.  It is stored hash-bucketed on its key: a join with a batch
moves the batch's keys to the buckets, and the list is read where it lies.
Additions go to a folder of their own (``batch_id=N``) in the same buckets;
a batch written again replaces its own folder only, so a replay changes
nothing.  ``compact`` writes one sorted file a bucket into a new folder.

The number of buckets is fixed when the list is created and kept beside it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.session import path_exists

#: One bucket is read by one task; at 10 billion keys of 100 bytes a bucket has 250 MB.
BUCKETS = 4096
#: The list given at the start, before any batch.
INITIAL = -1


def _table(spark: SparkSession, path: str, key: str, buckets: int) -> str:
    """Name of the session's table over ``path``."""
    name = f"vetline_seen_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (`{key}` STRING, batch_id BIGINT) USING parquet "
              f"PARTITIONED BY (batch_id) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS "
              f"LOCATION '{path}/keys'")
    return name


def _layout(spark: SparkSession, path: str) -> tuple[str, int]:
    row = spark.read.schema("key string, buckets int").json(f"{path}/_layout").first()
    return row["key"], row["buckets"]


def exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_layout/_SUCCESS")


def create(spark: SparkSession, path: str, key: str = "url", buckets: int = BUCKETS, keys: DataFrame | None = None) -> None:
    """A new list, with the distinct non-null ``keys`` as its initial content."""
    spark.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.json(f"{path}/_layout")
    if keys is not None:
        add(spark, path, keys, INITIAL)


def add(spark: SparkSession, path: str, keys: DataFrame, batch_id: int) -> None:
    """Store the distinct non-null keys of one batch; a replay replaces them."""
    key, buckets = _layout(spark, path)
    rows = (keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
            .repartition(buckets, key)  # the buckets' own hash: one file a bucket
            .select(key))
    name = _table(spark, path, key, buckets)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch_id = {int(batch_id)}) SELECT * FROM {{rows}}", rows=rows)


def read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The keys stored by batches before ``before`` (all, if not given), in their buckets."""
    key, buckets = _layout(spark, path)
    name = _table(spark, path, key, buckets)
    spark.catalog.refreshTable(name)
    rows = spark.table(name)
    return (rows if before is None else rows.where(F.col("batch_id") < before)).select(key)


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """The same keys, distinct and in one file a bucket, as the initial list of a new folder."""
    key, buckets = _layout(spark, path)
    create(spark, new_path, key, buckets, read(spark, path))


class SeenList:
    """A stored list to compare batches with; ``before`` leaves out that batch and later ones."""

    def __init__(self, spark: SparkSession, path: str, before: int | None = None):
        self.spark, self.path, self.before = spark, path, before
        self.key, self.buckets = _layout(spark, path)

    def keys(self) -> DataFrame:
        return read(self.spark, self.path, self.before)

    def known(self, batch_keys: DataFrame, key: str) -> DataFrame:
        """The ``batch_keys`` that are in the list, once each.  The batch is dealt
        to the list's buckets; the list itself is neither moved nor widened."""
        mine = batch_keys.select(F.col(key).cast("string").alias(self.key)).repartition(self.buckets, self.key)
        return self.keys().join(mine, self.key).select(F.col(self.key).alias(key)).distinct()
