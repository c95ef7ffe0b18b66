"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform)
turns a unit vector; its code is the nearest signed axis among the first ``m``.
Several tables use other rotations, two codes are joined where one is too
coarse, and a query also probes its next nearest signed axes.  Candidates are
ranked by exact Euclidean distance in double precision on the original vectors.
A fixed number of probes finds ever fewer of the nearest as points grow, so the
true neighbours of a hashed sample of the queries are found by comparing it with
all points, and probes are doubled until that share of them (``target``) lies in
a probed bucket.  Where probing would read as much as the whole table, the
queries are compared with all points.

Plan.  Exact copies become one point with its few smallest ids (enough for any
answer, as ties go to smaller ids), so a hot vector costs one row; equal
queries ask once and share the answer, less each one's own row.  All joins are
sort-merge joins: a query becomes a row a table and probe, which the planner does
not foresee, so it would send them all to the driver to broadcast.  The number
of buckets grows with the points, so a bucket keeps about ``bucket_points``;
larger ones are split by salts that every query of the bucket visits.  Queries
and points meet in a co-grouped task that returns ``k`` rows a query: no pairs
are shuffled.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part; vectors of different lengths are never compared; rows
with the query's own id are not its candidates; repeated rows of one id and
vector count once; fewer rows where fewer candidates exist.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetline.llm import common as C

TABLES, PROBES, BUCKET_POINTS, SALT_POINTS = 10, 8, 256, 4_000
#: Recall that probes are doubled for, and the queries of a vector length it is measured on.
TARGET, SAMPLE_QUERIES = 0.97, 128


def rotations(dim: int, table: int, seed: int) -> np.ndarray:
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng([seed, dim, table]).choice([-1.0, 1.0], size=(2, 3, size))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and Hadamard transform over zero-padded rows."""
    n, size = len(x), signs.shape[-1]
    y = np.zeros((n, size))
    y[:, :x.shape[1]] = x
    for s in signs:
        y = y * s
        h = 1
        while h < size:
            y = y.reshape(n, -1, 2, h)
            y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, size)
            h *= 2
        y /= math.sqrt(size)
    return y


def shape(points: int, dim: int, bucket_points: int) -> tuple[int, int]:
    """Axes used by the first and second code for about points / bucket_points
    buckets; 0 where a code is not needed."""
    want, size = points / bucket_points, 1 << max(1, (dim - 1).bit_length())
    if want <= 1:
        return 0, 0
    first = min(size, math.ceil(want / 2))
    return first, min(size, math.ceil(want / (2 * first) / 2)) if want > 2 * size else 0


def _ranked(y: np.ndarray, axes: int, probes: int):
    """The codes of the nearest signed axes and what each falls short of the nearest."""
    signed = np.stack((y[:, :axes], -y[:, :axes]), axis=2).reshape(len(y), -1)
    top = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
    value = np.take_along_axis(signed, top, axis=1)
    return top, value[:, :1] - value


def codes(unit: np.ndarray, table: int, axes: tuple[int, int], probes: int, seed: int) -> np.ndarray:
    """(rows, up to probes) bucket codes, nearest first."""
    if not axes[0]:
        return np.zeros((len(unit), 1), dtype=np.int64)
    signs = rotations(unit.shape[1], table, seed)
    first, lost = _ranked(rotate(unit, signs[0]), axes[0], probes)
    if not axes[1]:
        return first
    second, lost2 = _ranked(rotate(unit, signs[1]), axes[1], probes)
    # a pair comes after all that are nearer on both axes, so only these can be among the first
    i, j = np.nonzero(np.outer(np.arange(first.shape[1]) + 1, np.arange(second.shape[1]) + 1) <= probes)
    best = np.argsort(lost[:, i] ** 2 + lost2[:, j] ** 2, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(first, i[best], axis=1) * (2 * axes[1]) + np.take_along_axis(second, j[best], axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def usable(column):
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return column.isNotNull() & finite & F.exists(column, lambda x: x != 0)


def neighbours(points: DataFrame, sample: dict[int, np.ndarray], k: int) -> pa.Table:
    """dim, q (a row of the sample), vec: the true k nearest points of each
    sampled vector, without those equal to it (they share its buckets)."""
    def run(batches):
        best = {dim: [(np.zeros(0), np.zeros((0, dim)))] * len(q) for dim, q in sample.items()}
        for b in batches:
            dims = np.array(pc.list_value_length(b["vec"]))
            for dim in np.unique(dims):
                q = sample.get(int(dim))
                if q is None:
                    continue
                x = _matrix(b["vec"].take(pa.array(np.flatnonzero(dims == dim))), dim)
                own = (q * q).sum(axis=1)
                for i, d in enumerate(own[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)):
                    d = np.where(d <= 1e-12 * own[i], np.inf, d)
                    near = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                    d, v = np.append(best[dim][i][0], d[near]), np.concatenate((best[dim][i][1], x[near]))
                    near = np.argsort(d, kind="stable")[:k]
                    near = near[np.isfinite(d[near])]
                    best[dim][i] = (d[near], v[near])
        for dim, rows in best.items():
            for i, (d, v) in enumerate(rows):
                if len(d):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(d), dim, np.int32)), pa.array(np.full(len(d), i, np.int32)), pa.array(d),
                         pa.array(list(v), pa.list_(pa.float64()))], ["dim", "q", "d", "vec"])

    place = F.row_number().over(Window.partitionBy("dim", "q").orderBy("d", "vec"))
    return (points.select("vec").mapInArrow(run, "dim int, q int, d double, vec array<double>")
            .withColumn("place", place).where(F.col("place") <= k).select("dim", "q", "vec").toArrow())


def probes_for(asked: np.ndarray, near: np.ndarray, of: np.ndarray, points: int, axes: tuple[int, int], tables: int,
               probes: int, bucket_points: int, target: float, seed: int) -> tuple[tuple[int, int], int]:
    """Axes and probes at which ``target`` of the true neighbours (``near``, of
    row ``of`` in ``asked``) lie in probed buckets: no axes, so one bucket, where
    that many probes would read the whole table."""
    home = [codes(near, t, axes, 1, seed) for t in range(tables)]
    while True:
        hit = np.zeros(len(near), dtype=bool)
        for t in range(tables):
            for q, visited in enumerate(codes(asked, t, axes, probes, seed)):
                mine = np.flatnonzero(of == q)
                hit[mine] |= np.isin(home[t][mine, 0], visited)
        if hit.mean() >= target:
            return axes, probes
        if tables * probes * bucket_points >= points:
            return (0, 0), 1
        probes *= 2


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int = TABLES, probes: int = PROBES, bucket_points: int = BUCKET_POINTS, seed: int = 3,
            target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query row;
    ``probes`` is the least number, doubled where ``target`` needs more."""
    spark = vectors.sparkSession
    C.small_batches(spark, 4000)
    kind = vectors.schema[id_col].dataType.simpleString()
    element = vectors.schema[vector_col].dataType.elementType.simpleString()

    def tidy(df):
        return (df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
                .where(F.col("id").isNotNull() & usable(F.col("vec"))))

    def fewest(batches):  # of the copies in a batch only the k + 1 smallest ids
        for b in batches:
            seen: dict[bytes, int] = {}
            ids = b["id"].to_pylist()
            order = sorted(range(len(ids)), key=ids.__getitem__)
            keep, last = [], {}
            for i, key in ((i, b["vec"][i].values.to_numpy(zero_copy_only=False).tobytes()) for i in order):
                if seen.get(key, 0) <= k and last.get(key) != ids[i]:
                    seen[key] = seen.get(key, 0) + 1
                    last[key] = ids[i]
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    points = (tidy(vectors).mapInArrow(fewest, f"id {kind}, vec array<{element}>")
              .groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(16)).alias("salt")).agg(least(F.collect_list("id")).alias("ids"))
              .groupBy("vec").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
              .withColumn("dim", F.size("vec")))
    points = C.materialise(points, "points")
    count = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a vector length
    axes = {dim: shape(n, dim, bucket_points) for dim, n in count.items()}
    wide = dict.fromkeys(axes, probes)
    asking = tidy(queries).select("vec", F.size("vec").alias("dim")).distinct()
    share = {r["dim"]: SAMPLE_QUERIES / r["n"] for r in asking.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()
             if axes.get(r["dim"], (0, 0))[0]}
    if share:
        limit = F.element_at(F.create_map(*[F.lit(x) for dim, s in share.items() for x in (dim, int(min(1.0, s) * (1 << 30)))]), F.col("dim"))
        chosen = asking.where(F.pmod(F.xxhash64("vec", F.lit(9)), F.lit(1 << 30)) < limit).toArrow()
        dims = chosen["dim"].to_numpy()
        sample = {int(dim): _matrix(chosen["vec"].take(pa.array(np.flatnonzero(dims == dim))), dim) for dim in np.unique(dims)}
        true = neighbours(points, sample, k)
        dims = true["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            some = pa.array(np.flatnonzero(dims == dim))
            axes[dim], wide[dim] = probes_for(
                _unit(sample[dim]), _unit(_matrix(true["vec"].take(some), dim)), true["q"].take(some).to_numpy(),
                count[dim], axes[dim], tables, probes, bucket_points, target, seed)

    def deal(n_probes):
        def run(batches):
            for b in batches:
                dims = np.array(pc.list_value_length(b["vec"]))
                for dim in np.unique(dims):
                    part = b.take(pa.array(np.flatnonzero(dims == dim)))
                    unit = _unit(_matrix(part["vec"], dim))
                    for t in range(tables if axes.get(int(dim), (0, 0))[0] else 1):
                        code = codes(unit, t, axes.get(int(dim), (0, 0)), n_probes.get(int(dim), 1), seed)
                        for p in range(code.shape[1]):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(part), dim, np.int32)), pa.array(np.full(len(part), t, np.int32)),
                                 pa.array(code[:, p]), part[0], part["vec"]], ["dim", "tab", "code", part.schema.names[0], "vec"])
        return run

    head = f"dim int, tab int, code long, {{}}, vec array<{element}>"
    dealt = C.materialise(points.select("ids", "vec").mapInArrow(deal({}), head.format(f"ids array<{kind}>")), "dealt")
    key = ["dim", "tab", "code"]
    sizes = (dealt.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SALT_POINTS).cast("int").alias("salts"))
             .hint("merge"))  # as all joins here: the planner takes what deal() makes of a row for one row and would broadcast it
    stored = (dealt.join(sizes, key).withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), "salts").cast("int")).drop("salts"))
    # equal queries ask once, as the smallest of their ids; the others get its answer below
    members = tidy(queries).distinct()
    first = members.groupBy("vec").agg(F.min("id").alias("id"))
    asked = (first.select("id", "vec").mapInArrow(deal(wide), head.format(f"id {kind}")).join(sizes, key)
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))

    def rank(q: pa.Table, v: pa.Table) -> pa.Table:
        rows = ([], [], [])
        if len(q) and len(v):
            dim = q["dim"][0].as_py()
            x, ids = _matrix(v["vec"], dim), v["ids"].to_pylist()
            lead = np.array([i[0] for i in ids])
            for own, y in zip(q["id"].to_pylist(), _matrix(q["vec"], dim)):
                score = np.sqrt(((x - y) ** 2).sum(axis=1))
                near = np.flatnonzero(score <= np.partition(score, k)[k]) if len(score) > k + 1 else np.arange(len(score))
                near = near[np.lexsort((lead[near], score[near]))][:k + 1]
                found = sorted((score[i], j) for i in near for j in ids[i])[:k + 1]
                for s, j in found:
                    for out, value in zip(rows, (own, j, s)):
                        out.append(value)
        return pa.table({"query_id": pa.array(rows[0], q["id"].type), "id": pa.array(rows[1], q["id"].type),
                         "score": pa.array(rows[2], pa.float64())})

    key.append("salt")
    found = (asked.groupBy(*key).cogroup(stored.groupBy(*key))
             .applyInArrow(rank, f"query_id {kind}, id {kind}, score double")
             .groupBy("query_id", "id").agg(F.min("score").alias("score")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    lists = (found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("query_id")
             .agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near")))  # k + 1 at most
    # each member's own row is left out of the answer that it shares
    rep = first.select(F.col("vec").alias("_vec"), F.col("id").alias("rep")).hint("merge")
    answers = (members.join(rep, members["vec"] == rep["_vec"]).select(F.col("id").alias("own"), "rep")
               .join(lists.hint("merge"), F.col("rep") == lists["query_id"])
               .select("own", F.explode(F.slice(F.filter("near", lambda x: x["id"] != F.col("own")), 1, k)).alias("x"))
               .groupBy("own", F.col("x.id").alias("id")).agg(F.min("x.score").alias("score")))  # an id may ask with several vectors
    rank_of = F.row_number().over(Window.partitionBy("own").orderBy("score", "id"))
    return (answers.withColumn("rank", rank_of).where(F.col("rank") <= k)
            .select(F.col("own").alias("query_id"), "rank", F.col("id").alias(id_col), "score"))
