"""Streaming intake de-duplication, in two forms.

The seen list never expires, so no watermark can bound it.

``start_intake_stream`` keeps the list as a bucketed table (``sources.seen``)
and routes each micro-batch with the batch operators (J1/W1): the list is read
in its buckets, never shuffled, and nothing stays in executor memory.

``start_stateful_intake`` keeps each key in the query's own state, that of
Spark's ``dropDuplicates``, held by RocksDB on the executors' disks and
checkpointed with the query.  A micro-batch then touches its own keys only, so
its time doesn't grow with the list.  Both write each micro-batch to a folder of its own: one that is run
again after a failure replaces its folder and gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.operators import intake
from vetline.sources import seen as seen_list

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_batch_writer(seen_path: str, out_path: str, key: str = "url",
                       order_col: str = "name", force: bool = False, buckets: int = seen_list.BUCKETS):
    """``foreachBatch`` function.  Each batch compares with the keys of earlier
    batches only and overwrites its own ``batch_id=N`` folders, so a batch
    replayed after a failure produces the same rows (idempotent)."""
    def run(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        if not seen_list.exists(spark, seen_path):
            seen_list.create(spark, seen_path, key, buckets)
        known = seen_list.SeenList(spark, seen_path, before=batch_id)
        routed = intake.dedup_against_seen(batch, known, force=force, key=key, order_col=order_col)
        routed.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        added = spark.read.parquet(f"{out_path}/batch_id={batch_id}")
        seen_list.add(spark, seen_path, intake.seen_additions(added, key), batch_id)
    return run


def init_seen(seen: DataFrame, seen_path: str, key: str = "url", buckets: int = seen_list.BUCKETS) -> None:
    """Store an initial seen list."""
    seen_list.create(seen.sparkSession, seen_path, key, buckets, seen)


def start_intake_stream(links: DataFrame, seen_path: str, out_path: str, checkpoint: str,
                        key: str = "url", order_col: str = "name", trigger_once: bool = True,
                        buckets: int = seen_list.BUCKETS):
    """``buckets`` counts for a list that this stream creates."""
    q = (links.writeStream.foreachBatch(dedup_batch_writer(seen_path, out_path, key, order_col, buckets=buckets))
              .option("checkpointLocation", checkpoint))
    if trigger_once:
        q = q.trigger(availableNow=True)
    return q.start()


def with_fresh_keys(links: DataFrame, key: str = "url", order_col: str = "name", seen_col: str = "is_seen") -> DataFrame:
    """``k, o, seen, fresh``: the rows of streamed links and, for each key that no
    earlier micro-batch had, one more row that is ``fresh``.  The keys so far are
    the state.

    Rows whose ``seen_col`` is true are the list's own.  A null ``order_col``
    (numeric or text) counts, and is given back, as 0 or ''."""
    kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    zero = F.lit("" if kinds[order_col] == "string" else 0).cast(kinds[order_col])
    rows = links.select(F.col(key).alias("k"), F.coalesce(F.col(order_col), zero).alias("o"),
                        F.coalesce(F.col(seen_col), F.lit(False)).alias("seen"), F.lit(False).alias("fresh"))
    fresh = rows.where(F.col("k").isNotNull()).select("k").dropDuplicates(["k"])
    return rows.unionByName(fresh.select("k", F.lit(None).cast(kinds[order_col]).alias("o"), F.lit(False).alias("seen"), F.lit(True).alias("fresh")))


def route_arrived(arrived: DataFrame) -> DataFrame:
    """``k, o, outcome, is_new`` of one micro-batch of ``with_fresh_keys``.

    The smallest ``o`` of a fresh key that the list doesn't hold is ``moved``; all
    else is ``deleted``, null keys are ``skipped``; the list's rows give none.
    Equal rows meet in a partial aggregate, and the rows of a key in a join that
    AQE splits, so no group has to pass through one task."""
    link = ~F.col("seen") & ~F.col("fresh")
    once = arrived.where(link).groupBy("k", "o").agg(F.count(F.lit(1)).alias("_n"))
    per_key = (arrived.where(F.col("k").isNotNull()).groupBy("k")
               .agg(F.min(F.when(link, F.col("o"))).alias("_first"), F.max(F.col("seen").cast("int")).alias("_seen"),
                    F.max(F.col("fresh").cast("int")).alias("_fresh"))
               .where((F.col("_fresh") == 1) & (F.col("_seen") == 0)).select("k", "_first"))
    out = intake.every_copy(once.join(per_key, "k", "left"))
    is_new = F.coalesce(F.col("o") == F.col("_first"), F.lit(False)) & (F.col("_copy") == 0)
    outcome = F.when(F.col("k").isNull(), "skipped").when(is_new, "moved").otherwise("deleted")
    return out.select("k", "o", outcome.alias("outcome"), is_new.alias("is_new"))


def start_stateful_intake(links: DataFrame, out_path: str, checkpoint: str, key: str = "url", order_col: str = "name"):
    """Route all that is there by the state of ``with_fresh_keys`` and stop;
    started again with the same checkpoint it goes on from its state.  What
    arrived is written before it is routed, so the state is met once."""
    spark = links.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{out_path}/_arrived/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        routed = route_arrived(batch.sparkSession.read.schema(batch.schema).parquet(path))
        (routed.select(F.col("k").alias(key), F.col("o").alias(order_col), "outcome", "is_new")
         .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}"))

    return (with_fresh_keys(links, key, order_col).writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_routed(spark: SparkSession, out_path: str) -> DataFrame:
    """All rows that micro-batches wrote."""
    return spark.read.parquet(out_path).drop("batch_id")
