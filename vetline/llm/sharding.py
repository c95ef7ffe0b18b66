"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of a ring of 2**64 positions.  A row's key
is hashed to a position; the first point clockwise is its home, and the rows
between two points form an arc.  A shard takes no more than its capacity: the
rows of the table divided evenly, so that counts are at most one apart (law
``rows``).  Rows whose home is full go on clockwise, past points of full
shards, until one has room.

Homes come first: in round 0 all rows ask their home, in round r those without
a place ask the r-th point after it; a shard with too little room for all that
ask in a round takes them in ring order.  So a full shard sends away only its
surplus, and a changed number of rows or shards moves little.

Plan.  Only the key, the order columns and what the caller selected are
shuffled, once, by ranges of (position, key, order): ranges split a key that
holds a third of the rows.  One count for each arc (shards x virtual numbers,
whatever the table's size) reaches the driver, which plays the rounds on counts
and gives back intervals of the global order with their shard and first slot.
Each task looks its rows up in those intervals; slots need no second shuffle.

Defined results: null keys share one position; rows with one key are told apart
by ``order_cols`` and otherwise interchangeable; an empty table gives no row;
the columns of the input stay, whatever their names, and ``shard``, ``slot``,
``law`` replace columns of those names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm import common as C
from vetline.operators.sequence import global_sequence

VIRTUAL = 128


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all virtual nodes, ascending, and the shard of each.

    A node's position depends on its shard and number alone, so a further shard
    adds points and moves none."""
    node = np.arange(shards * virtual, dtype=np.uint64)
    shard, number = node // np.uint64(virtual), node % np.uint64(virtual)
    with np.errstate(over="ignore"):
        at = C.mix(C.mix(shard + np.uint64(C.BASES[0])) + (number + np.uint64(1)) * np.uint64(C.BASES[1]))
    at = (at ^ np.uint64(1 << 63)).view(np.int64)  # positions are signed, like Spark's hashes
    at[0] = np.iinfo(np.int64).max  # shard 0's first node closes the ring: no arc runs over its end
    order = np.lexsort((shard, at))
    return at[order], shard[order].astype(np.int64)


def capacities(rows: int, shards: int) -> np.ndarray:
    """Even shares; what is left goes to the first shards."""
    return rows // shards + (np.arange(shards) < rows % shards)


def intervals(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first place in ring order, rows, shard, first slot) of every run of rows
    that go to one shard, from the rows of each arc and the shard of its home."""
    nodes = len(owner)
    left, room = counts.astype(np.int64).copy(), capacity.astype(np.int64).copy()
    done = np.zeros(nodes, dtype=np.int64)        # rows of an arc that have a place
    start = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out = []
    for r in range(nodes):
        asking = np.flatnonzero(left)
        if not len(asking):
            break
        shard = owner[(asking + r) % nodes]
        open_ = room[shard] > 0
        asking, shard = asking[open_], shard[open_]
        order = np.argsort(shard, kind="stable")  # ring order within a shard
        asking, shard = asking[order], shard[order]
        want = left[asking]
        first = np.searchsorted(shard, shard)
        before = np.cumsum(want) - want
        take = np.clip(room[shard] - (before - before[first]), 0, want)
        for arc, s, n in zip(asking[take > 0].tolist(), shard[take > 0].tolist(), take[take > 0].tolist()):
            out.append((int(start[arc] + done[arc]), n, s))
            done[arc] += n
            left[arc] -= n
            room[s] -= n
    out.sort()
    filled = np.zeros(len(capacity), dtype=np.int64)
    runs = []
    for first_row, n, s in out:
        runs.append((first_row, n, s, int(filled[s])))
        filled[s] += n
    return runs


def shard(df: DataFrame, shards: int, key_col: str = "doc_id", order_cols: tuple[str, ...] = (),
          virtual: int = VIRTUAL) -> DataFrame:
    """``df`` with ``law``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard)."""
    spark = df.sparkSession
    positions, owner = ring(shards, virtual)
    keep = [c for c in df.columns if c.lower() not in ("law", "shard", "slot")]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    order = ["pos", "key", *[f"o{i}" for i in range(len(order_cols))]]
    placed = df.select(F.struct(*[quoted(c) for c in keep]).alias("row"), quoted(key_col).alias("key"),
                       *[quoted(c).alias(f"o{i}") for i, c in enumerate(order_cols)],
                       F.xxhash64(quoted(key_col).cast("string")).alias("pos"))
    numbered = global_sequence(placed, order, col="seq", start=0)

    def arcs(batches):
        seen = np.zeros(len(positions), dtype=np.int64)
        for b in batches:
            at = b["pos"].to_numpy(zero_copy_only=False)
            seen += np.bincount(np.searchsorted(positions, at), minlength=len(positions))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["arc", "n"])

    # one row an arc, bounded by shards x virtual
    found = numbered.select("pos").mapInArrow(arcs, "arc long, n long").groupBy("arc").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(positions), dtype=np.int64)
    for r in found:
        counts[r["arc"]] = r["n"]
    runs = intervals(counts, owner, capacities(int(counts.sum()), shards))
    table = spark.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 4))

    def place(batches):
        first, _, to, slot = table.value.T
        for b in batches:
            n = b["seq"].to_numpy(zero_copy_only=False)
            k = np.searchsorted(first, n, side="right") - 1
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(to[k].astype(np.int32)), pa.array(slot[k] + n - first[k])],
                                             ["row", "shard", "slot"])

    schema = numbered.select("row", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema
    return (numbered.select("row", "seq").mapInArrow(place, schema)
            .select("row.*", F.lit("rows").alias("law"), "shard", "slot"))
