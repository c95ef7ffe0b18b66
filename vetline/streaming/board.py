"""Board state folded continuously from the move-event stream.

The same fold as the batch ``operators.board.fold_events`` run as a streaming
aggregation in update mode.  Each micro-batch writes the refs it changed to a
folder of its own (``change/batch=N``), so nothing passes through the driver
and a replayed batch overwrites its own folder only.

Every so many batches the changes are merged into a new base (``base-N``: the
state after batch N), so a reader meets one base and a bounded number of
change folders however long the stream runs.  A base counts once its write is
committed; a compaction that dies leaves the former one in place.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.operators.board import fold_events
from vetline.session import list_names, path_exists

#: Batches between two compactions.
COMPACT_EVERY = 20


def board_state_stream(events: DataFrame, order_cols=("ts", "event_id")) -> DataFrame:
    return fold_events(events, list(order_cols))


def _numbers(spark: SparkSession, folder: str, pattern: str) -> list[int]:
    found = (re.fullmatch(pattern, name) for name in list_names(spark, folder))
    return sorted(int(m.group(1)) for m in found if m)


def bases(spark: SparkSession, state_dir: str) -> list[int]:
    """Batches whose state is stored as a whole, ascending; committed bases only."""
    return [n for n in _numbers(spark, state_dir, r"base-(\d+)") if path_exists(spark, os.path.join(state_dir, f"base-{n}", "_SUCCESS"))]


def changes(spark: SparkSession, state_dir: str, after: int, upto: int | None = None) -> list[int]:
    """Batches after ``after`` (to ``upto``) whose changes are stored apart."""
    return [n for n in _numbers(spark, os.path.join(state_dir, "change"), r"batch=(\d+)") if n > after and (upto is None or n <= upto)]


def read_board_state(spark: SparkSession, state_dir: str, upto: int | None = None) -> DataFrame:
    """State of each ref: that of the last batch that changed it, from the newest
    base and the change folders after it (to batch ``upto``, if given)."""
    base = max((n for n in bases(spark, state_dir) if upto is None or n <= upto), default=-1)
    parts = [spark.read.parquet(os.path.join(state_dir, "change", f"batch={n}")).withColumn("_batch", F.lit(n))
             for n in changes(spark, state_dir, base, upto)]
    if base >= 0:
        parts.append(spark.read.parquet(os.path.join(state_dir, f"base-{base}")).withColumn("_batch", F.lit(base)))
    if not parts:
        raise FileNotFoundError(f"no board state in {state_dir}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    state = F.struct(*[F.col(c) for c in rows.columns if c not in ("ref_nr", "_batch")])
    return rows.groupBy("ref_nr").agg(F.max_by(state, F.col("_batch")).alias("_s")).select("ref_nr", "_s.*")


def compact(spark: SparkSession, state_dir: str, upto: int) -> None:
    """Merge all changes to batch ``upto`` into a base of their own.  Older bases
    and changes stay for readers that hold them; ``drop_superseded`` removes them."""
    if upto in bases(spark, state_dir):
        return
    read_board_state(spark, state_dir, upto).write.mode("overwrite").parquet(os.path.join(state_dir, f"base-{upto}"))


def drop_superseded(spark: SparkSession, state_dir: str) -> None:
    """Remove what the last but one base replaced: readers of the newest two are unharmed."""
    done = bases(spark, state_dir)
    if len(done) < 2:
        return
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    old = [os.path.join(state_dir, f"base-{n}") for n in done[:-2]]
    old += [os.path.join(state_dir, "change", f"batch={n}") for n in changes(spark, state_dir, -1, done[-2])]
    for path in map(fs_path, old):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def start_board_stream(events: DataFrame, checkpoint: str, state_dir: str, compact_every: int = COMPACT_EVERY,
                       available_now: bool = False):
    """Write the changed refs of each batch to ``state_dir/change/batch=<n>`` and
    a base after every ``compact_every`` batches."""
    def write(changed: DataFrame, n: int) -> None:
        changed.write.mode("overwrite").parquet(os.path.join(state_dir, "change", f"batch={n}"))
        if (n + 1) % compact_every == 0:
            compact(changed.sparkSession, state_dir, n)
            drop_superseded(changed.sparkSession, state_dir)

    q = (board_state_stream(events).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    return (q.trigger(availableNow=True) if available_now else q).start()
