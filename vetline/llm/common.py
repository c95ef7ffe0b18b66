"""Helpers shared by the operators: column-at-a-time word splitting, word and
window hashes over Arrow batches, and written intermediate tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vetline.session import checkpoint_dir

#: Bytes that end a word: 0x09-0x0D and 0x20.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: For matching that ignores punctuation: every ASCII byte but letters and digits.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers of the Rabin-Karp hashes (arithmetic modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F3)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the cluster's shared checkpoint folder and read it
    back: lineage is cut and a lost executor loses nothing.  The folder is the
    cluster's to clean, like its other checkpoints."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has a column of that name."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def small_batches(spark, rows: int = 1000) -> None:
    """Whole texts travel to Python; keep an Arrow batch to a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@dataclass
class Words:
    """Words of a batch of texts; text i has words ``off[i]`` to ``off[i+1]``."""

    data: np.ndarray   # bytes of all words, nothing between them
    ends: np.ndarray   # where each word ends in data, after a leading 0
    off: np.ndarray
    start: np.ndarray  # where each word starts in the batch's bytes
    base: np.ndarray   # where each text starts in the batch's bytes

    def __len__(self):
        return len(self.ends) - 1

    def array(self) -> pa.Array:
        big = self.ends[-1] >= 1 << 31
        kind = pa.LargeStringArray if big else pa.StringArray
        ends = np.ascontiguousarray(self.ends, dtype=np.int64 if big else np.int32)
        return kind.from_buffers(len(self), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.data)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each starts (and the last ends); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def split_words(texts: pa.Array, lower: bool = False, ends_word: np.ndarray = WHITE) -> Words:
    """Maximal runs of bytes that do not end a word, text by text."""
    raw, base = text_bytes(texts)
    if lower:
        raw = LOWER[raw]
    inside = ~ends_word[raw]
    fresh = np.zeros(len(raw) + 1, dtype=bool)  # a text starts here
    fresh[base] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    ends = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=ends[1:])
    return Words(raw[inside], ends, np.searchsorted(start, base), start, base)


def slices(texts: pa.Array, most: int = 4_000_000):
    """The texts in runs of at most ``most`` bytes, or of one longer text, so
    that work arrays of several bytes a byte stay small."""
    sizes = np.diff(text_bytes(texts)[1])
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield texts.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield texts.slice(first)


_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        have = _POW[base] = np.multiply.accumulate(table)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    length = np.diff(words.ends)
    within = np.arange(len(words.data)) - np.repeat(words.ends[:-1], length)
    terms = _BYTE[words.data] * powers(BASES[2], int(length.max()))[within]
    return mix(np.add.reduceat(terms, words.ends[:-1]) + length.astype(np.uint64))


def rolling(values: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` values, by running sums."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return mix((sums[width:] - sums[:n]) * powers(inverse, n))


def window_starts(off: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of ``width`` words lies within one text."""
    n = int(off[-1])
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    return np.flatnonzero(left >= width)
