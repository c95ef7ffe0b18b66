"""Best-fit packing into bins of several permitted lengths.

Pieces are taken longest first.  A piece goes to the open bin with the least
room that still holds it; where none does, a new bin is opened at the size that
costs least a token.  At the end every bin shrinks to the cheapest size that
holds its contents.  Which lengths may be opened is chosen jointly: from all of
them, the one whose absence lowers the total cost most is left out, as long as
there is one.

Plan.  Best fit looks at lengths only, and there are at most as many different
lengths as the largest permitted one.  Spark counts the pieces of each length;
the driver runs best fit over these counts, bins with like contents as one
range, which takes the same decisions as piece by piece and is bounded by the
permitted lengths whatever the corpus.  Pieces of a length are numbered by their
place in a task and the counts of the tasks before it, and a number is looked up
in the plan.  So bins, fill and cost do not depend on how the input is split,
and no key holds more rows than a task has.

Defined results: texts longer than the largest size are cut into pieces of that
size and a rest; a text without tokens gives one row without a bin; null
lengths count as 0; each input row is packed, repeated rows too; which of the
pieces of one length goes where follows the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetline.llm import common as C

LENGTHS = (512, 1024, 2048, 4096)
#: Bits of a piece's number among those of its length.
_NUMBER_BITS = 44


def attention_cost(length: int) -> float:
    """Work for one sequence: linear layers and, beside them, attention."""
    return length + length * length / 8192


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens, one token a word."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(np.diff(C.split_words(b["text"]).off))], ["id", "n_tokens"])
    C.small_batches(docs.sparkSession)
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long")
            .withColumnRenamed("id", id_col))


@dataclass
class Plan:
    """Best fit over counts.  ``places``: piece length, first number, first bin,
    pieces a bin, offset of the first; ``bins``: first bin of a range, its length."""

    places: np.ndarray
    bins: np.ndarray
    cost: float


def best_fit(counts: dict[int, int], lengths: Sequence[int], costs: dict[int, float], opened: Sequence[int]) -> Plan:
    """Pack ``counts[n]`` pieces of each length n.  Of bins with the same room
    those opened smallest are taken first."""
    rooms: dict[int, dict[int, list]] = {}  # room left -> opened size -> ranges (first bin, bins)
    free = 0                                # bit r: some bin has r left
    places, made = [], 0

    def put(room, cap, first, n):
        nonlocal free
        if n:
            rooms.setdefault(room, {}).setdefault(cap, []).append((first, n))
            free |= 1 << room

    for n in sorted(counts, reverse=True):
        at, total = 0, counts[n]
        while at < total:
            fits = free >> n
            if not fits:
                cap = min((c for c in opened if c >= n), key=lambda c: (costs[c] / c, c))
                new = -(-(total - at) // (cap // n))
                put(cap, cap, made, new)
                made += new
                continue
            room = n + (fits & -fits).bit_length() - 1
            cap = min(rooms[room])
            first, m = rooms[room][cap].pop()
            if not rooms[room][cap]:
                del rooms[room][cap]
                if not rooms[room]:
                    del rooms[room]
                    free &= ~(1 << room)
            each = room // n  # a bin is filled before the next one, as it then has the least room
            whole = min(m, (total - at) // each)
            if whole:
                places.append((n, at, first, each, cap - room))
                put(room - each * n, cap, first, whole)
                at += whole * each
            if whole < m and at < total:
                rest = total - at
                places.append((n, at, first + whole, rest, cap - room))
                put(room - rest * n, cap, first + whole, 1)
                at, whole = total, whole + 1
            put(room, cap, first + whole, m - whole)
    bins, cost = [], 0.0
    for room, by_cap in rooms.items():
        for cap, ranges in by_cap.items():
            length = min((c for c in lengths if c >= cap - room), key=lambda c: (costs[c], c))
            bins += [(first, length) for first, _ in ranges]
            cost += costs[length] * sum(m for _, m in ranges)
    table = lambda rows, k: np.array(sorted(rows), dtype=np.int64).reshape(-1, k)
    return Plan(table(places, 5), table(bins, 2), cost)


def joint_plan(counts: dict[int, int], lengths: Sequence[int], costs: dict[int, float]) -> Plan:
    """The plan of least cost met while lengths that may be opened are left out, one a turn."""
    opened = list(lengths)
    best = best_fit(counts, lengths, costs, opened)
    while len(opened) > 1:  # the largest one stays: it alone holds every piece
        tried = [(best_fit(counts, lengths, costs, [c for c in opened if c != out]), out) for out in opened[:-1]]
        plan, out = min(tried, key=lambda x: x[0].cost)
        if plan.cost >= best.cost:
            break
        best = plan
        opened.remove(out)
    return best


def pieces(items: DataFrame, id_col: str, size_col: str, top: int) -> DataFrame:
    """Written once: id, piece, start, n_tokens, the task that cut it and the
    piece's number among those of its length there, from 0."""
    names = ["id", "piece", "start", "n_tokens", "task", "number"]

    def run(batches):
        task, had = TaskContext.get().partitionId(), np.zeros(top + 1, dtype=np.int64)
        for b in batches:
            size = b["n"].fill_null(0).to_numpy(zero_copy_only=False)
            n_pieces = np.maximum(1, -(-size // top))
            owner = np.repeat(np.arange(len(size)), n_pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            n = np.minimum(top, size[owner] - piece * top)
            order = np.argsort(n, kind="stable")
            fresh = np.r_[True, n[order][1:] != n[order][:-1]] if len(n) else np.zeros(0, bool)
            heads = np.flatnonzero(fresh)
            number = np.empty(len(n), dtype=np.int64)
            number[order] = np.arange(len(n)) - heads[np.cumsum(fresh) - 1] + had[n[order]]
            had += np.bincount(n, minlength=top + 1)
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(pa.array(owner)), pa.array(piece), pa.array(piece * top), pa.array(n),
                 pa.array(np.full(len(n), task, dtype=np.int64)), pa.array(number)], names)

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("id"), F.greatest(F.lit(0), F.col(size_col)).cast("long").alias("n"))
    return C.materialise(rows.mapInArrow(run, f"id {kind}, piece long, start long, n_tokens long, task long, number long"), "pieces")


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", lengths: Sequence[int] = LENGTHS,
         cost: Callable[[int], float] = attention_cost) -> DataFrame:
    """One row a piece: id, piece, start, n_tokens, bin_id, bin_length, bin_offset."""
    lengths = sorted(set(lengths))
    cut = pieces(items, id_col, size_col, lengths[-1])
    per_task = cut.where("n_tokens > 0").groupBy("n_tokens", "task").agg(F.count(F.lit(1)).alias("n"))
    # a row a task and length, in order of tasks
    before = Window.partitionBy("n_tokens").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("n_tokens", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["n_tokens"]: r["n"] for r in per_task.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    plan = joint_plan(counts, lengths, {c: cost(c) for c in lengths})
    length_of, number_of, first_bin, each, offset = plan.places.T
    keys, starts, bin_lengths = (length_of << _NUMBER_BITS) + number_of, plan.bins[:, 0], plan.bins[:, 1]
    names = ["id", "piece", "start", "n_tokens", "bin_id", "bin_length", "bin_offset"]

    def place(batches):
        for b in batches:
            n = b["n_tokens"].to_numpy()
            none = n == 0
            out = [np.zeros(len(n), dtype=np.int64) for _ in range(3)]
            if not none.all():
                number = (b["number"].to_numpy() + b["before"].fill_null(0).to_numpy(zero_copy_only=False))[~none]
                at = np.searchsorted(keys, (n[~none] << _NUMBER_BITS) + number, side="right") - 1
                within = number - number_of[at]
                bin_id = first_bin[at] + within // each[at]
                for column, values in zip(out, (bin_id, bin_lengths[np.searchsorted(starts, bin_id, side="right") - 1],
                                                offset[at] + within % each[at] * n[~none])):
                    column[~none] = values
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *[pa.array(x, mask=none) for x in out]], names)

    kind = items.schema[id_col].dataType.simpleString()
    return (cut.join(offsets, ["n_tokens", "task"], "left").select("id", "piece", "start", "n_tokens", "number", "before")
            .mapInArrow(place, f"id {kind}, piece long, start long, n_tokens long, bin_id long, bin_length long, bin_offset long")
            .withColumnRenamed("id", id_col))
