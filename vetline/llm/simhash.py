"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a few
differing bits through vantage-point trees.

Plan.  Python batches compute fingerprints; Spark keeps each distinct
fingerprint once, so a group of exact copies is one point however large.  A
vantage-point tree over a bounded sample (``sample_points``) deals points to
shards by Hamming distance.  A point lives in one leaf and also visits each
later leaf that the triangle bound cannot rule out, so every pair within the
radius meets in exactly one leaf.  The points that ask in a leaf are dealt over
salts, each with all points that live there, so neither a small table's only
leaf nor a full one's visitors fall to one task.  A shard goes on splitting by vantage points
down to small blocks, compares blocks exactly, and returns only a spanning
forest of its links: never more rows than points.  Forests are joined by
alternating star contraction in Spark.

The sample only places the vantage points; any tree gives the same links.
For fingerprints that look random, distances lie close together and the bounds
prune slowly: the work of the comparison grows with a power of the number of
distinct fingerprints between 1.6 and 1.8, not linearly.

Defined results: a null or empty text has fingerprint zero, linked like any
other; each input row gives one row, repeated ids too; a null id is never the
smallest of its component unless all are null; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm import common as C

SAMPLE_POINTS = 20_000
LEAF_POINTS = 100_000
#: Asking points of a salt: at most about the first, at least about the second.
ASK_POINTS, LEAST_ASK_POINTS = 25_000, 1_000
BLOCK = 384


def _fingerprints(texts: pa.Array, shingle: int, seed: int) -> np.ndarray:
    words = C.split_words(texts, lower=True)
    out = np.zeros(len(words.off) - 1, dtype=np.uint64)
    array, digest = words.array(), xxhash.xxh64_intdigest
    length = np.diff(words.ends)
    at = 0
    while at < len(out):  # a few megabytes of words at a time
        to = max(at + 1, int(np.searchsorted(words.off, words.off[at] + 200_000, side="right")) - 1)
        lo, hi = int(words.off[at]), int(words.off[to])
        off = words.off[at:to + 1] - lo
        joined = " ".join(array.slice(lo, hi - lo).to_pylist()).encode()
        ends = np.cumsum(length[lo:hi] + 1) - 1
        begins = ends - length[lo:hi]
        n_words = np.diff(off)
        n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
        first = np.concatenate(([0], np.cumsum(n)))
        pos = np.arange(first[-1]) - np.repeat(first[:-1] - off[:-1], n)
        take = np.repeat(np.minimum(n_words, shingle), n)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins[pos].tolist(), ends[pos + take - 1].tolist())),
                        dtype=np.uint64, count=len(pos))
        if len(h):
            some = np.flatnonzero(n)
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
            packed = np.packbits(ones * 2 > n[some, None], axis=1)
            out[at + some] = packed.view(">u8").ravel().astype(np.uint64)
        at = to
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 seed: int = 42) -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a long)."""
    def run(batches):
        for b in batches:
            fp = _fingerprints(b["text"], shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fp)], ["id", "fp"])
    C.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, fp long"))


def _far(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(points: np.ndarray, rng) -> tuple | None:
    """A vantage point and radius that divide the points, if any does."""
    for _ in range(4):
        vantage = points[rng.integers(len(points))]
        d = _far(points, vantage)
        for radius in (int(np.median(d)), int(np.median(d)) - 1):
            inner = d <= radius
            if 0 < inner.sum() < len(points):
                return vantage, radius, inner
    return None


def build_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> list:
    """Nodes (vantage, radius, inner, outer); a negative child -k-1 is leaf k."""
    rng, nodes, count = np.random.default_rng(seed), [], [0]

    def grow(points, depth):
        cut = _split(points, rng) if depth and len(points) >= 8 else None
        if cut is None:
            count[0] += 1
            return -count[0]
        nodes.append(None)
        me = len(nodes) - 1
        vantage, radius, inner = cut
        nodes[me] = (vantage, radius, grow(points[inner], depth - 1), grow(points[~inner], depth - 1))
        return me

    root = grow(sample, max(0, math.ceil(math.log2(max(1, leaves)))))
    return nodes if root >= 0 else []


def visits(points: np.ndarray, nodes: list, radius: int):
    """(point index, leaf, home): the leaf a point lives in and the later ones
    within reach of it."""
    if not nodes:
        yield np.arange(len(points)), 0, np.ones(len(points), bool)
        return
    leaf_home = np.full(len(points), -1)
    found = []
    stack = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, idx, home = stack.pop()
        if not len(idx):
            continue
        if node < 0:
            leaf_home[idx[home]] = -node - 1
            found.append((-node - 1, idx, home))
            continue
        vantage, mu, inner, outer = nodes[node]
        d = _far(points[idx], vantage)
        go = d <= mu + radius
        stack.append((inner, idx[go], home[go] & (d[go] <= mu)))
        go = d > mu - radius
        stack.append((outer, idx[go], home[go] & (d[go] > mu)))
    for leaf, idx, home in found:
        keep = home | (leaf_home[idx] < leaf)
        yield idx[keep], leaf, home[keep]


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def salts_of(points: int, leaves: int, parallelism: int) -> int:
    """Over how many salts the asking points of each leaf are dealt."""
    each = points / max(1, leaves)
    want = max(each / ASK_POINTS, min(parallelism / max(1, leaves), each / LEAST_ASK_POINTS))
    return max(1, math.ceil(want))


def salted(fp: np.ndarray, home: np.ndarray, salts: int):
    """(point index, salt, asks): where each point asks, and every salt for one that lives in the leaf."""
    own = (C.mix(fp) % np.uint64(salts)).astype(np.int32)
    for salt in range(salts):
        idx = np.flatnonzero(home | (own == salt))
        yield idx, salt, own[idx] == salt


def link_forest(points: np.ndarray, home: np.ndarray, radius: int, block: int = BLOCK, seed: int = 11,
                asks: np.ndarray | None = None) -> np.ndarray:
    """Component label (an index) of each point, over links from any asking point to a home point."""
    rng, label = np.random.default_rng(seed), np.arange(len(points))
    stack = [(np.flatnonzero(home), np.arange(len(points)) if asks is None else np.flatnonzero(asks))]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        cut = _split(points[own], rng) if len(own) > block else None
        if cut is not None:
            vantage, mu, inner = cut
            d = _far(points[ask], vantage)
            stack.append((own[inner], ask[d <= mu + radius]))
            stack.append((own[~inner], ask[d > mu - radius]))
            continue
        step = max(1, 1_000_000 // len(own))
        for k in range(0, len(ask), step):
            q = ask[k:k + step]
            near = np.bitwise_count(points[q][:, None] ^ points[own][None, :]) <= radius
            i, j = np.nonzero(near)
            a, b = q[i], own[j]
            other = label[a] != label[b]
            if other.any():
                _union(label, a[other], b[other])
    return label


def _stars(pairs: DataFrame) -> bool:
    """Whether each node hangs on one root that hangs on none."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(pairs.select("v", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("low")).where("n > 1 or (n = 1 and low = 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of (a, b) by alternating large and small stars: node
    and root (its component's smallest node), for nodes with an edge."""
    pairs = C.materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                          .where("u != v").distinct(), "edges")
    while not _stars(pairs):
        # large star: neighbours above u move to the least node around u
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = C.materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")
        # small star: everything below u, and u itself, moves to the least node below u
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = C.materialise(large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    return (pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4, seed: int = 42, sample_points: int = SAMPLE_POINTS,
                    leaf_points: int = LEAF_POINTS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hexadecimal digits) and
    component_id (the smallest id that can be reached through links)."""
    spark = docs.sparkSession
    prints = C.materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("id").alias("least_id"))
    n = points.count()
    share = min(1.0, sample_points / max(1, n))
    if share < 1:  # the points whose hash is smallest: the same sample on every run
        taken = points.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp")
    else:
        taken = points.select("fp")
    sample = np.sort(np.array([r[0] for r in taken.collect()], dtype=np.int64)).view(np.uint64)
    leaves = math.ceil(n / leaf_points)
    nodes = build_tree(sample, leaves)
    salts = salts_of(n, leaves, spark.sparkContext.defaultParallelism)

    def deal(batches):
        for x in batches:
            fp = x["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for idx, leaf, home in visits(fp, nodes, max_bits):
                for some, salt, asks in salted(fp[idx], home, salts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), leaf, np.int32)), pa.array(np.full(len(some), salt, np.int32)),
                         pa.array(fp[idx[some]].view(np.int64)), pa.array(home[some]), pa.array(asks)],
                        ["leaf", "salt", "fp", "home", "asks"])

    def link(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        label = link_forest(fp, table["home"].to_numpy(), max_bits, asks=table["asks"].to_numpy())
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(fp[far].view(np.int64)), "b": pa.array(fp[label[far]].view(np.int64))})

    edges = (points.select("fp").mapInArrow(deal, "leaf int, salt int, fp long, home boolean, asks boolean")
             .groupBy("leaf", "salt").applyInArrow(link, "a long, b long"))
    roots = components(edges)
    placed = points.join(roots, points.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = placed.join(names, "root").select("fp", "component_id")
    return (prints.join(by_fp, "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
