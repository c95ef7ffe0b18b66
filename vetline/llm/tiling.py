"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased (ASCII punctuation only
separates).  Documents and benchmark items share seeds: equal Karp-Rabin hashes
of ``min_match`` words.  For each document and item with a shared seed, the
longest match of unmarked words is marked again and again, until none of
``min_match`` words is left; marked words of the item over its length is its
coverage, so passages whose parts are moved about still count.

Plan.  The benchmark's seeds go to every task in blocks of at most
``block_bytes`` of text (the sum is taken first), one pass over the documents
for each block; documents are never shuffled and a hot passage is matched where
its document lies.  Memory: one block, one batch of texts, and the seed matches
of so many documents as have ``seed_pairs`` of them together, or of one.

Defined results: a null text or item has no words; items of fewer than
``min_match`` words cannot be told from chance and never match; each input row
is judged for itself, so repeated rows give repeated results; of equally long
matches the one first in the document, then first in the item, is marked.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vetline.llm import common as C

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_BYTES = 32 << 20
SEED_PAIRS = 2_000_000


def _seeds(items: list[str], width: int):
    words = C.split_words(pa.array(items, pa.string()), lower=True, ends_word=C.NOT_ALNUM)
    at = C.window_starts(words.off, width)
    h = C.rolling(C.word_hashes(words), width)[at]
    order = np.argsort(h, kind="stable")
    item = np.searchsorted(words.off, at, side="right") - 1
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(h >> np.uint64(44)).astype(np.int64)] = True
    return h[order], item[order], (at - words.off[item])[order], np.diff(words.off), bits


def tile(p: np.ndarray, q: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles (document word, item word, length) from seed matches p ~ q."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    fresh = np.ones(len(p), dtype=bool)
    fresh[1:] = (np.diff(p) != 1) | (np.diff(p - q) != 0)
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, len(p))) + width - 1
    heap = [(-int(n), int(p[i]), int(q[i])) for i, n in zip(heads, sizes)]
    heapq.heapify(heap)
    marked_p, marked_q, tiles = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [a + k not in marked_p and b + k not in marked_q for k in range(n)]
        if all(free):
            marked_p.update(range(a, a + n))
            marked_q.update(range(b, b + n))
            tiles.append((a, b, n))
            continue
        k = 0
        while k < n:  # what is left unmarked may still be long enough
            z = k
            while z < n and free[z]:
                z += 1
            if z - k >= width:
                heapq.heappush(heap, (k - z, a + k, b + k))
            k = z + 1
    return tiles


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH,
                 coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, seed_pairs: int = SEED_PAIRS) -> DataFrame:
    """(id, item, coverage, tiles) of each document and item covered to ``coverage`` or more."""
    spark = docs.sparkSession
    C.small_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(item_text_col, F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = (f"id {id_type}, item {item_type}, coverage double, "
              "tiles array<struct<doc_word:long,item_word:long,words:long>>")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tile_type = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(([r["item"] for r in block], _seeds([r["text"] for r in block], min_match)))

        def run(batches, shared=shared):
            names, (seeds, item_of, place, n_words, bits) = shared.value
            names = pa.array(names, item_arrow)
            for b in batches:
                words = C.split_words(b["text"], lower=True, ends_word=C.NOT_ALNUM)
                windows = C.window_starts(words.off, min_match)
                h = C.rolling(C.word_hashes(words), min_match)[windows]
                maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
                windows, h = windows[maybe], h[maybe]
                owner = np.searchsorted(words.off, windows, side="right") - 1
                low = np.searchsorted(seeds, h, side="left")
                many = np.searchsorted(seeds, h, side="right") - low
                # whole documents, of seed_pairs matches together
                heads = np.flatnonzero(np.r_[True, np.diff(owner) != 0]) if len(owner) else np.zeros(0, np.int64)
                before = (np.cumsum(many) - many)[heads] // seed_pairs
                edges = [*heads[np.r_[True, np.diff(before) != 0]].tolist(), len(owner)] if len(heads) else [0]
                rows = []
                for x, y in zip(edges[:-1], edges[1:]):
                    hits = many[x:y]
                    at, doc = np.repeat(windows[x:y], hits), np.repeat(owner[x:y], hits)
                    seed = np.arange(len(at)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low[x:y], hits)
                    p, q, item = at - words.off[doc], place[seed], item_of[seed]
                    order = np.lexsort((item, doc))
                    doc, item, p, q = doc[order], item[order], p[order], q[order]
                    cut = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0), True]) if len(doc) else [0]
                    for i, j in zip(cut[:-1], cut[1:]):
                        need = coverage * n_words[item[i]]
                        if (np.unique(q[i:j]).size + min_match - 1) * min_match < need:
                            continue  # even apart from each other these seeds would not cover enough
                        tiles = tile(p[i:j], q[i:j], min_match)
                        if (covered := sum(t[2] for t in tiles)) >= need:
                            rows.append((doc[i], item[i], covered / n_words[item[i]], tiles))
                yield pa.RecordBatch.from_arrays(
                    [b["id"].take(pa.array([r[0] for r in rows], pa.int64())), names.take(pa.array([r[1] for r in rows], pa.int64())),
                     pa.array([r[2] for r in rows], pa.float64()),
                     pa.array([[dict(zip(("doc_word", "item_word", "words"), t)) for t in r[3]] for r in rows], tile_type)],
                    ["id", "item", "coverage", "tiles"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)
