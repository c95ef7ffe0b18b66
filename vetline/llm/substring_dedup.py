"""Substring dedup: Rabin-Karp hashes of every window of words, counted in
Spark; a window seen earlier in the corpus is removed, and windows that touch
merge into maximal removal intervals.

Plan.  Texts are dealt into shards of neighbouring ids (bounds from a quantile
sketch weighted by length, so a shard holds about ``shard_bytes`` of text).  A
shard hashes all its windows and keeps each hash once, so a window that fills a
third of the corpus sends one hash a shard.  Hashes go to buckets, packed
8 bytes each; a bucket finds for each hash the first shard that holds it and
answers every shard with one bit a hash.  The shard then knows its repeats:
those with an earlier place in the shard or in an earlier shard.

The shuffles are the text once, 8 bytes a window and 1 bit a window.  No task
holds more than a shard (at least one text) or a bucket of ``bucket_windows``
hashes.  Equality is by 64 bits of one hash plus the bucket from an independent
one: n windows give about n * bucket_windows / 2**65 expected false repeats.

Defined results: a null text has no words; a null id sorts before all others;
rows of one id are ordered by text, so repeats among them count as later; texts
shorter than the window are kept whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm import common as C

SHARD_BYTES = 8 << 20
BUCKET_WINDOWS = 4_000_000


def shard_bounds(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> tuple[list, int]:
    """Ids at which a new shard starts, and the bytes of all texts."""
    sizes = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    k = math.ceil(total / shard_bytes)
    if k < 2:
        return [], total
    weighted = sizes.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("n div 4096"))).alias("_"))
    marks = [i / k for i in range(1, k)]
    got = weighted.agg(F.percentile_approx("id", marks, max(10_000, 20 * k))).first()[0] or []
    return sorted(set(got)), total


def _sorted(table: pa.Table) -> pa.Table:
    # sort_indices puts nulls last; the key is doubled to put them first
    table = table.append_column("has", pc.is_valid(table["id"]))
    return table.take(pc.sort_indices(table, sort_keys=[("has", "ascending"), ("id", "ascending"), ("text", "ascending")]))


def _windows(table: pa.Table, window: int, n_buckets: int):
    """Words of a shard, its window starts, and its distinct hashes dealt to buckets."""
    words = C.split_words(table["text"])
    hashes = C.word_hashes(words)
    starts = C.window_starts(words.off, window)
    h = C.rolling(hashes, window)[starts]
    bucket = (C.rolling(hashes, window, C.BASES[1])[starts] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(h, kind="stable")
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = h[order][1:] != h[order][:-1]
    holder = order[fresh]  # of each distinct hash, its first window
    by_bucket = np.argsort(bucket[holder], kind="stable")
    counts = np.bincount(bucket[holder], minlength=n_buckets)
    which = np.empty(len(h), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    return words, starts, h[holder][by_bucket], counts, by_bucket, which, holder


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   shard_bytes: int = SHARD_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """One row per input row: id, n_words, n_removed, removed (word intervals,
    end exclusive) and kept (the words that stay, joined by one space)."""
    bounds, total = shard_bounds(docs, id_col, text_col, shard_bytes)
    n_buckets = max(1, math.ceil(total / 6 / bucket_windows))
    id_type = docs.schema[id_col].dataType
    marks = np.array(bounds)

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        if not len(marks):
            return pd.Series(np.zeros(len(ids), dtype=np.int64))
        out = np.zeros(len(ids), dtype=np.int64)
        known = ids.notna().to_numpy()
        out[known] = np.searchsorted(marks, ids[known].to_numpy().astype(marks.dtype), side="right")
        return pd.Series(out)

    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("shard", shard_of("id"))

    def send(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        _, _, h, counts, _, _, _ = _windows(_sorted(table), window, n_buckets)
        cut = np.concatenate(([0], np.cumsum(counts)))
        used = np.flatnonzero(counts)
        return pa.table({"bucket": pa.array(used, pa.int32()), "shard": pa.array([shard] * len(used), pa.int64()),
                         "hashes": pa.array([h[cut[b]:cut[b + 1]].tobytes() for b in used], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["shard"]))
        parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["hashes"]]
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")  # equal hashes stay in the order of their shards
        later = np.zeros(len(h), dtype=bool)
        later[order[1:]] = h[order[1:]] == h[order[:-1]]
        cut = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        bits = [later[a:b] for a, b in zip(cut[:-1], cut[1:])]
        told = [i for i, x in enumerate(bits) if x.any()]
        return pa.table({"shard": table["shard"].take(pa.array(told, pa.int64())), "bucket": table["bucket"].take(pa.array(told, pa.int64())),
                         "later": pa.array([np.packbits(bits[i]).tobytes() for i in told], pa.binary())})

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut_out(table: pa.Table, told: pa.Table) -> pa.Table:
        table = _sorted(table)
        words, starts, h, counts, by_bucket, which, holder = _windows(table, window, n_buckets)
        cut = np.concatenate(([0], np.cumsum(counts)))
        later = np.zeros(len(h), dtype=bool)
        for b, bits in zip(told["bucket"].to_pylist(), told["later"]):
            n = counts[b]
            later[cut[b]:cut[b] + n] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n).astype(bool)
        elsewhere = np.empty(len(h), dtype=bool)
        elsewhere[by_bucket] = later
        repeat = elsewhere[which] if len(which) else np.zeros(0, bool)
        repeat |= holder[which] != np.arange(len(which)) if len(which) else False
        n = len(words)
        edge = np.zeros(n + 1, dtype=np.int64)
        edge[starts[repeat]] += 1
        np.add.at(edge, starts[repeat] + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        run = np.concatenate(([0], np.cumsum(gone)))
        n_removed = run[words.off[1:]] - run[words.off[:-1]]
        # maximal intervals: a run starts at a removed word after a kept one or at a text's start
        opens = np.zeros(n + 1, dtype=bool)
        opens[words.off] = True
        a = gone.copy()
        a[1:] &= ~gone[:-1] | opens[1:-1]
        z = gone.copy()
        z[:-1] &= ~gone[1:] | opens[1:-1]
        first, last = np.flatnonzero(a), np.flatnonzero(z) + 1
        owner = np.searchsorted(words.off, first, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(first - words.off[owner]), pa.array(last - words.off[owner])], ["start", "end"])
        span_off = np.searchsorted(first, words.off)
        stay = words.array().filter(pa.array(~gone))
        stay_off = words.off - run[words.off]
        lists = pa.ListArray.from_arrays(pa.array(stay_off.astype(np.int32)), stay.cast(pa.string()))
        return pa.table({"id": table["id"], "n_words": pa.array(np.diff(words.off)), "n_removed": pa.array(n_removed),
                         "removed": pa.ListArray.from_arrays(pa.array(span_off.astype(np.int32)), spans).cast(span),
                         "kept": pc.binary_join(lists, " ")})

    sent = dealt.groupBy("shard").applyInArrow(send, "bucket int, shard long, hashes binary")
    told = sent.groupBy("bucket").applyInArrow(answer, "shard long, bucket int, later binary")
    id_ddl = id_type.simpleString()
    out = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(
        cut_out, f"id {id_ddl}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
    return out.withColumnRenamed("id", id_col)
