"""Row numbering that scales: no single-partition window, no hot-key task.

``global_sequence`` numbers rows 1..n in a total order:

1. range-partition on the order columns (a hot value of a leading column is
   spread over many partitions because the trailing columns keep splitting it),
2. sort inside each partition and tag rows with ``monotonically_increasing_id``
   (partition id in the high bits, position in the low 33 bits),
3. cut lineage with a reliable ``checkpoint()`` so ids stay fixed if an
   executor is lost and a stage is recomputed,
4. count rows per partition (one row per partition: a bounded table) and
   turn the counts into running offsets, a literal of the plan.

``sequence_within`` numbers rows inside groups: the global sequence over (group,
order) minus the group start, so no task sorts a whole hot group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.session import checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def _num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_sequence(df: DataFrame, order_cols: list, col: str = "seq",
                    start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Add ``col`` = 1-based (or ``start``-based) position in ``order_cols`` order.
    ``order_cols`` must be a total order (end with a unique key)."""
    checkpoint_dir(df.sparkSession)
    n = num_partitions or _num_partitions(df)
    tagged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", 33))
                    .withColumn("_local", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    # one row per partition reaches the driver: bounded by the partition count; the offsets are a literal of the plan
    counts = {r["_pid"]: r["n"] for r in tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for pid in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(pid, 0)
    offset = F.get(F.split(F.lit(",".join(map(str, offsets)) or "0"), ",").cast("array<bigint>"), F.col("_pid").cast("int"))
    return tagged.withColumn(col, (offset + F.col("_local") + F.lit(start)).cast("long")).drop("_mid", "_pid", "_local")


def sequence_within(df: DataFrame, group_cols: list, order_cols: list, col: str = "rn") -> DataFrame:
    """Add ``col`` = 1-based position inside each group (``row_number`` semantics)
    without putting a whole large group into one task.

    Rows are numbered by the global sequence over (group, order), and the
    smallest number of a group, a partial aggregate, is subtracted.  The same
    way holds for groups of any size: a group holding a third of the rows is
    spread over range partitions by its order columns, and its start reaches
    its rows through a join that AQE splits where it is skewed.  Null group
    values form a group, as in a window."""
    g = global_sequence(df, list(group_cols) + list(order_cols), col="_gseq")
    starts = g.groupBy(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate(group_cols)]) \
              .agg(F.min("_gseq").alias("_gstart"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{i}")) for i, c in enumerate(group_cols)])
    return (g.join(starts, same)
             .withColumn(col, (F.col("_gseq") - F.col("_gstart") + 1).cast("long"))
             .drop("_gseq", "_gstart", *[f"_g_{i}" for i in range(len(group_cols))]))


def spread(df: DataFrame) -> DataFrame:
    """Deal narrow rows, or rows that cost milliseconds each (HTML and JSON
    parsing), evenly over ``spark.sql.shuffle.partitions`` tasks.  Not for cheap
    work on whole texts, where reading by ``spark.sql.files.maxPartitionBytes``
    needs no shuffle."""
    return df if df.isStreaming else df.repartition(_num_partitions(df))  # a trigger sizes its batches by itself
