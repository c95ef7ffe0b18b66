"""Product codes of vectors: k-means of equal consecutive parts in integers,
with norm-of-sum bounds.

Components become integers, floor(scale * x); every part position has its own
codebook of ``entries`` integer vectors.  A round assigns each part to the
nearest entry (squared Euclidean distance, ties to the lower index) and moves
each entry to the componentwise floor of its parts' mean.

Bounds.  A part keeps, for each group of entries, a lower bound of its distance
to the group's entries other than its own, and the stamp of the round in which
that bound was measured.  All codebooks so far are kept, so in a later round
the bound shrinks by the largest *net* displacement of a group's entry between
the stamped round and now, the norm of the summed moves; that is never more
than the moves' norms added up, as running drifts would have it.  Where
the distance to the own entry, always measured exactly, stays below the bound,
no entry of the group can be as near, and the group is left out; all others are
measured again, exactly, and stamped anew.

Plan.  No row is shuffled: a round is one map over the vectors that writes
codes, bounds and stamps (a table in the shared folder, so a lost executor
repeats its own tasks only) and one partial aggregation to parts x entries
sums, whatever the number of vectors.  Only those sums and the first
``entries`` vectors reach the driver.

Defined results: vectors that are null or hold a null or non-finite component
take no part; vectors of another length have codebooks of their own, of parts
as equal as can be where the length cannot be divided; with fewer
vectors than entries each is an entry; rows of one id are ordered by their
components, null ids come last; other columns are ignored.  Scaled components
beyond +-2**26 are taken at that bound, so that all sums fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that share a bound.
GROUP = 16
LIMIT = 1 << 26
FAR = 1 << 62


def whole(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def edges(length: int, parts: int) -> list[int]:
    """Where each part starts, and the last ends."""
    return [length * i // parts for i in range(parts + 1)]


def _integers(column: pa.Array, length: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype(np.int64).reshape(len(column), length)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x entries."""
    out = np.zeros((len(x), len(book)), dtype=np.int64)
    for d in range(x.shape[1]):
        gap = x[:, d, None] - book[None, :, d]
        out += gap * gap
    return out


def net_moves(history: list[np.ndarray], group: int) -> np.ndarray:
    """[round, group]: largest distance of a group's entries between that round
    and the last one."""
    now = history[-1].astype(np.float64)
    moved = [np.sqrt(((now - h) ** 2).sum(axis=1)) for h in history]
    return np.array([[m[a:a + group].max() for a in range(0, len(now), group)] for m in moved]) * (1 + 1e-9)


def assign(x: np.ndarray, history: list[np.ndarray], state=None, group: int = GROUP):
    """Nearest entry of the newest codebook for every row of one part.

    ``state`` is (entry, bounds, stamps) of an earlier round or None.  Gives
    entry, squared distance, bounds, stamps and how many distances were measured."""
    book, now = history[-1], len(history) - 1
    n, k = len(x), len(book)
    n_groups = -(-k // group)
    if state is None:
        own, low, stamp = np.zeros(n, np.int64), np.full((n, n_groups), -1.0), np.full((n, n_groups), now, np.uint8)
    else:
        own, low, stamp = state[0].astype(np.int64), state[1].astype(np.float64), state[2]
    own_near = ((x - book[own]) ** 2).sum(axis=1)
    held = low - net_moves(history, group)[stamp, np.arange(n_groups)]  # the bounds as they hold now
    ask = ~(np.sqrt(own_near)[:, None] * (1 + 1e-6) < held)             # groups to measure
    best, near, measured = own.copy(), own_near.copy(), n
    one, two, at = (np.full((n, n_groups), fill, np.int64) for fill in (0, FAR, -1))
    for g in range(n_groups):
        some = np.flatnonzero(ask[:, g])
        if not len(some):
            continue
        d = _distances(x[some], book[g * group:(g + 1) * group])
        measured += d.size
        row, j = np.arange(len(some)), d.argmin(axis=1)                 # the lowest index of the nearest
        dj = d[row, j]
        j_all = j + g * group
        better = (dj < near[some]) | ((dj == near[some]) & (j_all < best[some]))
        best[some[better]], near[some[better]] = j_all[better], dj[better]
        d[row, j] = FAR
        one[some, g], two[some, g], at[some, g] = dj, d.min(axis=1), j_all
    # a bound leaves out the own entry; the entry that was left counts in its group's bound again
    left = np.flatnonzero(best != own)
    g_old = own[left] // group
    calm = ~ask[left, g_old]
    held[left[calm], g_old[calm]] = np.minimum(held[left[calm], g_old[calm]], np.sqrt(own_near[left[calm]]))
    low[left[calm], g_old[calm]] = held[left[calm], g_old[calm]]
    fresh = ask.copy()
    fresh[left, g_old] = True
    low = np.where(ask, np.sqrt(np.where(at == best[:, None], two, one)), low)
    return best, near, np.nextafter(low.astype(np.float32), np.float32(-np.inf)), np.where(fresh, np.uint8(now), stamp), measured


def _block(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    """A column of equally long binaries as one array, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.dtype(kind).itemsize * int(np.prod(shape))
    return np.frombuffer(column.buffers()[2], dtype=kind, count=len(column) * int(np.prod(shape)),
                         offset=int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])).reshape(len(column), *shape) \
        if size and len(column) else np.zeros((len(column), *shape), kind)


def _binaries(block: np.ndarray) -> pa.Array:
    """The rows of an array as a column of binaries."""
    block = np.ascontiguousarray(block)
    size = block.itemsize * int(np.prod(block.shape[1:]))
    ends = (np.arange(len(block) + 1) * size).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(ends), pa.py_buffer(block)])


def _round(rows: DataFrame, length: int, cut: list[int], books: list, group: int, scale: int) -> DataFrame:
    """One assignment of all rows; ``books`` holds each part's codebooks, oldest first."""
    shared, parts = rows.sparkSession.sparkContext.broadcast(books), len(cut) - 1
    again = "code" in rows.columns
    groups = -(-len(books[0][0]) // group)

    def run(batches):
        for b in (b for b in batches if len(b)):
            n = len(b)
            x = (_block(b["ints"], "<i4", length) if again else _integers(b["v"], length, scale)).astype(np.int64)
            if again:
                before = (_block(b["code"], "<u2", parts), _block(b["bounds"], "<f4", parts, groups), _block(b["stamps"], "u1", parts, groups))
            code, error, measured = np.zeros((n, parts), "<u2"), np.zeros(n, np.int64), np.zeros(n, np.int64)
            low, stamp = np.zeros((n, parts, groups), "<f4"), np.zeros((n, parts, groups), np.uint8)
            for p in range(parts):
                state = tuple(s[:, p] for s in before) if again else None
                code[:, p], near, low[:, p], stamp[:, p], m = assign(x[:, cut[p]:cut[p + 1]], shared.value[p], state, group)
                error += near
                measured[0] += m  # the batch's, on its first row
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["label"], _binaries(x.astype("<i4")), _binaries(code), pa.array(error), pa.array(measured), _binaries(low), _binaries(stamp)],
                ["id", "label", "ints", "code", "error", "measured", "bounds", "stamps"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label")]
    used = ["ints", "code", "bounds", "stamps"] if again else ["v"]
    return rows.select("id", "label", *used).mapInArrow(
        run, f"{', '.join(kinds)}, ints binary, code binary, error long, measured long, bounds binary, stamps binary")


def _moved(state: DataFrame, cut: list[int], books: list) -> list[np.ndarray]:
    """Every part's next codebook: the floor of each entry's mean."""
    parts, k, length = len(cut) - 1, len(books[0][-1]), cut[-1]

    def run(batches):
        total, count = np.zeros((k, length), np.int64), np.zeros((parts, k), np.int64)
        for b in (b for b in batches if len(b)):
            x, code = _block(b["ints"], "<i4", length), _block(b["code"], "<u2", parts)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=k)
                for d in range(cut[p], cut[p + 1]):  # a batch's sums are exact in doubles
                    total[:, d] += np.bincount(code[:, p], weights=x[:, d], minlength=k).astype(np.int64)
        part = np.repeat(np.arange(parts), np.diff(cut))
        used = np.concatenate([count[p] > 0 for p in part] or [np.zeros(0, bool)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(length), k)[used]), pa.array(np.tile(np.arange(k), length)[used]),
             pa.array(total.T.ravel()[used]), pa.array(count[part].ravel()[used])], ["d", "entry", "s", "n"])

    sums = (state.select("ints", "code").mapInArrow(run, "d long, entry long, s long, n long")
            .groupBy("d", "entry").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())  # components x entries rows
    books = [h[-1].copy() for h in books]
    part = np.repeat(np.arange(parts), np.diff(cut))
    for r in sums:
        p = part[r["d"]]
        books[p][r["entry"], r["d"] - cut[p]] = r["s"] // r["n"]
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, group: int = GROUP):
    """Codes of all vectors, and the codebooks: (rows id, label, code (binary,
    16 bits a part), error, length; {length: [part's entries]}; {length:
    distances measured in each assignment})."""
    base = whole(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    lengths = sorted(r[0] for r in base.select(F.size("v")).distinct().collect())  # as many as kinds of vectors
    done, books_of, measured = [], {}, {}
    for length in lengths:
        rows, cut = base.where(F.size("v") == length), edges(length, parts)
        first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
        first = _integers(first, length, scale)
        books = [[first[:, cut[p]:cut[p + 1]]] for p in range(parts)]
        state, measured[length] = rows, []
        for r in range(rounds + 1):
            state = C.materialise(_round(state, length, cut, books, group, scale), "codes")
            measured[length].append(int(state.agg(F.sum("measured")).first()[0]))
            if r < rounds:
                books = [h + [new] for h, new in zip(books, _moved(state, cut, books))]
        books_of[length] = [h[-1] for h in books]
        done.append(state.select("id", "label", "code", "error", F.lit(length).alias("length")))
    if not done:
        return base.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).alias("length")), {}, {}
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, books_of, measured


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over rows of one label."""
    sums = C.materialise(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "_l")  # its size is known now, so a small one is broadcast by the planner
    return codes.join(sums, codes["label"].eqNullSafe(sums["_l"]), "left").drop("_l")


def code_text(code) -> "F.Column":
    """Two hex digits a part (indexes below 256), in part order."""
    # 16 bits a part, little-endian: the low byte comes first
    return F.lower(F.regexp_replace(F.hex(code), "(..)..", "$1"))
