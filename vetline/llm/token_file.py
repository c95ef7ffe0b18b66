"""Token files in patched frame-of-reference blocks.

Format.  A file is a Parquet table of segments; a segment holds whole
documents: their ids and token counts, and ``data``.  ``data`` is

    u32 tokens | u32 blocks | u32 start of each block in what follows | blocks

A block has 128 tokens (the last is padded): u32 minimum, u8 width, u8 number
of exceptions, 128 offsets from the minimum in ``width`` bits each (high bits
cut off), then the exceptions: u8 position and u32 offset.  The width covers
``percentile`` of the block's offsets; larger ones are the exceptions.  Any
block can be read alone through the index (``read_block``).

Plan.  Texts are dealt by ranges of id and sorted (one shuffle of the text);
tasks tokenize and write segments in order, so a shard's tokens follow each
other and a global start is the shard's start (a running sum over one row a
shard) plus the start in the shard.

A tokenizer that drops white space gives for a text the tokens of its words one
after another, so each word of a task is tokenized once and then found by its
hash; ``Encoder`` checks the tokenizer for that and otherwise encodes whole
texts.

Defined results: a null text has only the end id; a null id comes first; rows
of one id are ordered by text; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetline.llm import common as C

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_TOKENS = 1 << 15
#: Words a Python worker remembers; it then starts afresh.  Results don't depend on it.
CACHE_WORDS = 2_000_000
#: Texts are encoded by so many bytes at a time: their words have fewer different ones than many small lots.
LOT_BYTES = 8 << 20


_RNG = np.random.default_rng(77)
_BYTE2 = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _as_words(names: pa.Array) -> C.Words:
    data, off = C.text_bytes(names)
    return C.Words(data, off, off, off, off)


def _second_hashes(words: C.Words) -> np.ndarray:
    """A hash of each word that is independent of ``common.word_hashes``."""
    length = np.diff(words.ends)
    within = np.arange(len(words.data)) - np.repeat(words.ends[:-1], length)
    return C.mix(np.add.reduceat(_BYTE2[words.data] * C.powers(C.BASES[1], int(length.max()))[within], words.ends[:-1]))


class Encoder:
    """Token ids of many texts at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ab, cd, dotted = self._ids(["ab", "cd", "Ab"])
        # white space parts words and is dropped; a full stop or comma after a letter is a token of its own
        self.by_word = (self._ids(["ab \n\t cd", " ab\x0b"]) == [ab + cd, ab]
                        and all(self._ids([f"Ab{c}", c]) == [dotted + self._ids([c])[0], self._ids([c])[0]] for c in ".,"))
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _clear(self):
        # words by a sorted 64-bit hash, confirmed by a second, independent one
        self.hash, self.check, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.flat, self.used = np.zeros(1, np.int64), np.zeros(1 << 20, np.uint32), 0

    def _find(self, names: pa.Array) -> np.ndarray:
        """Slot of each name; new ones are learnt."""
        words = _as_words(names)
        first, second = C.word_hashes(words), _second_hashes(words)
        if len(self.hash) + len(names) > CACHE_WORDS:
            self._clear()
        at = np.minimum(np.searchsorted(self.hash, first), max(0, len(self.hash) - 1))
        have = (self.hash[at] == first) if len(self.hash) else np.zeros(len(names), bool)
        slot = self.slot[at] if len(self.hash) else np.zeros(len(names), np.int64)
        known = have & (self.check[at] == second) if len(self.hash) else have
        fresh = np.flatnonzero(~known)
        if len(fresh):
            slot[fresh] = len(self.begin) - 1 + self._learn(names.take(pa.array(fresh)).to_pylist())
            keep = fresh[~have[fresh]]  # of two words with one hash the first is remembered
            keep = keep[np.unique(first[keep], return_index=True)[1]]
            place = np.searchsorted(self.hash, first[keep])
            self.hash, self.check, self.slot = (np.insert(a, place, v[keep]) for a, v in
                                                ((self.hash, first), (self.check, second), (self.slot, slot)))
        return slot

    def _learn(self, new: list[str]) -> np.ndarray:
        """Tokenize words; gives the number of each among the added slots.

        Words of letters alone are each one word to the tokenizer too, so many are
        tokenized at once and told apart by its word numbers; where these don't
        fit, and for all other words, each is tokenized by itself."""
        letters = np.fromiter(map(str.isalpha, new), dtype=bool, count=len(new))
        plain, other = np.flatnonzero(letters), np.flatnonzero(~letters)
        parts, counts = [], []
        for k in range(0, len(plain), 200):
            words = [new[i] for i in plain[k:k + 200].tolist()]
            one = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            of = np.array(one.word_ids, dtype=np.int64)
            if len(of) and of[-1] + 1 == len(words) and (np.diff(of, prepend=0) <= 1).all() and (np.diff(of) >= 0).all() and of[0] == 0:
                parts.append(np.array(one.ids, dtype=np.uint32))
                counts.append(np.bincount(of, minlength=len(words)))
            else:
                self._each(words, parts, counts)
        for k in range(0, len(other), 1000):  # few Python lists alive at a time
            self._each([new[i] for i in other[k:k + 1000].tolist()], parts, counts)
        fresh, counts = np.concatenate(parts), np.concatenate(counts)
        while self.used + len(fresh) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used:self.used + len(fresh)] = fresh
        self.begin = np.concatenate((self.begin, self.used + np.cumsum(counts)))
        self.used += len(fresh)
        place = np.empty(len(new), dtype=np.int64)
        place[np.concatenate((plain, other))] = np.arange(len(new))
        return place

    def _each(self, words: list[str], parts: list, counts: list) -> None:
        some = self._ids(words)
        parts.append(np.fromiter(chain.from_iterable(some), dtype=np.uint32))
        counts.append(np.fromiter(map(len, some), np.int64, len(some)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and where each text starts."""
        if not self.by_word:
            ids = [np.array(x, dtype=np.uint32) for x in self._ids(["" if t is None else t for t in texts.to_pylist()])]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        raw, _ = C.text_bytes(texts)
        # lower case first: fewer words.  Not beside combining marks or special tokens, where it matters.
        plain = not ((raw == 0xCC) | (raw == 0xCD)).any() and b"<|" not in raw.tobytes()
        words = C.split_words(texts, lower=plain)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(words.off), np.int64)
        # a full stop or comma after a letter is a token of its own
        last, before = words.data[words.ends[1:] - 1], words.data[np.maximum(words.ends[1:] - 2, 0)]
        letter = ((before | 32) >= 97) & ((before | 32) <= 122) & (np.diff(words.ends) > 1)
        apart = ((last == 46) | (last == 44)) & letter
        off = words.off + np.concatenate(([0], np.cumsum(apart)))[words.off]
        words.ends = np.sort(np.concatenate((words.ends, words.ends[1:][apart] - 1)))
        coded = words.array().dictionary_encode()
        which = self._find(coded.dictionary)[coded.indices.to_numpy()]
        begin, counts = self.begin[which], self.begin[which + 1] - self.begin[which]
        starts = np.concatenate(([0], np.cumsum(counts)))
        place = np.repeat((begin - starts[:-1]).astype(np.int32), counts)  # fewer than 2**31 ids are remembered and in a lot
        place += np.arange(starts[-1], dtype=np.int32)
        ids = self.flat[place]
        return ids, starts[off]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


_LENGTHS = _bit_length(np.arange(1 << 16))


def _lanes(width: int):
    """Eight values of ``width`` bits fill ``width`` bytes, highest bit first: for
    each value and byte that share bits, how far the value moves left."""
    for i in range(8):
        for j in range(i * width // 8, ((i + 1) * width - 1) // 8 + 1):
            yield i, j, (j + 1) * 8 - (i + 1) * width


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes."""
    lanes = np.ascontiguousarray(values.reshape(-1, 8).T)
    out = np.zeros((width, lanes.shape[1]), dtype=np.uint8)
    for i, j, left in _lanes(width):
        out[j] |= (lanes[i] << np.uint32(left) if left >= 0 else lanes[i] >> np.uint32(-left)).astype(np.uint8)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The values of ``_pack``."""
    lanes = np.ascontiguousarray(packed.reshape(-1, width).T).astype(np.uint32)
    out = np.zeros((8, lanes.shape[1]), dtype=np.uint32)
    for i, j, left in _lanes(width):
        out[i] |= lanes[j] >> np.uint32(left) if left >= 0 else lanes[j] << np.uint32(-left)
    out &= np.uint32((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(len(packed), -1)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    nb = -(-n // BLOCK)
    x = np.full(nb * BLOCK, ids[-1] if n else 0, dtype=np.uint32)
    x[:n] = ids
    x = x.reshape(nb, BLOCK)
    low = x.min(axis=1) if nb else np.zeros(0, np.uint32)
    x = x - low[:, None]
    bits = _LENGTHS[x] if not nb or x.max() < 1 << 16 else _bit_length(x)
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.sort(bits, axis=1)[:, rank] if nb else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    n_over = over.sum(axis=1)
    sizes = 6 + 16 * width.astype(np.int64) + 5 * n_over
    start = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(start[-1]), dtype=np.uint8)
    head = np.zeros((nb, 6), dtype=np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(nb, 4)
    head[:, 4], head[:, 5] = width, n_over
    out[start[:-1, None] + np.arange(6)] = head
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        packed = _pack(x[rows] & np.uint32((1 << int(w)) - 1), int(w))
        out[start[rows, None] + 6 + np.arange(16 * int(w))] = packed
    row, pos = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        base = start[row] + 6 + 16 * width[row].astype(np.int64)
        out[base + nth] = pos
        at = base + n_over[row] + 4 * nth
        out[at[:, None] + np.arange(4)] = x[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.array([n, nb], dtype="<u4").tobytes() + start[:-1].astype("<u4").tobytes() + out.tobytes()


def _open(data: bytes):
    n, nb = np.frombuffer(data, dtype="<u4", count=2)
    start = np.frombuffer(data, dtype="<u4", count=int(nb), offset=8).astype(np.int64)
    return int(n), start, np.frombuffer(data, dtype=np.uint8, offset=8 + 4 * int(nb))


def _decode(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    nb = len(start)
    head = raw[start[:, None] + np.arange(6)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, n_over = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    x = np.zeros((nb, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        packed = raw[start[rows, None] + 6 + np.arange(16 * w)]
        x[rows] = _unpack(packed, int(w))
    if n_over.sum():
        row = np.repeat(np.arange(nb), n_over)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        base = start[row] + 6 + 16 * width[row]
        at = base + n_over[row] + 4 * nth
        x[row, raw[base + nth]] = np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4").ravel()
    return x + low[:, None]


def decode_blocks(data: bytes) -> np.ndarray:
    n, start, raw = _open(data)
    return _decode(raw, start).ravel()[:n] if n else np.zeros(0, np.uint32)


def read_block(data: bytes, block: int) -> np.ndarray:
    """The tokens of one block, found through the index."""
    n, start, raw = _open(data)
    return _decode(raw, start[block:block + 1]).ravel()[:n - block * BLOCK]


def _lots(batches):
    """Batches put together to ``LOT_BYTES`` of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= LOT_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text", percentile: float = PERCENTILE, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Tokenize ``docs`` in ascending id order and write a token file."""
    C.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["shard", "segment", "shard_start", "n_tokens", "ids", "counts", "data"]

    def run(batches):
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        done, segment = 0, 0
        ids, counts, tokens, held = [], [], [], 0

        def flush():
            data = np.concatenate(tokens)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([done], pa.int64()),
                 pa.array([held], pa.int64()), pa.ListArray.from_arrays([0, sum(map(len, ids))], pa.concat_arrays(ids)),
                 pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([encode_blocks(data, percentile)], pa.binary())], names)

        for b in _lots(batches):
            got, at = encode(b["text"])
            if end_id is not None:
                got = np.insert(got, at[1:], end_id)
                at = at + np.arange(len(at))
            # cut the batch into segments of whole documents
            i = 0
            while i < len(at) - 1:
                j = int(np.searchsorted(at, at[i] + max(1, segment_tokens - held)))
                j = min(max(j, i + 1), len(at) - 1)
                ids.append(b["id"].slice(i, j - i))
                counts.append(np.diff(at[i:j + 1]))
                tokens.append(got[at[i]:at[j]])
                held += int(at[j] - at[i])
                i = j
                if held >= segment_tokens:
                    yield flush()
                    done, segment = done + held, segment + 1
                    ids, counts, tokens, held = [], [], [], 0
        if ids:
            yield flush()

    (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
     .repartitionByRange(F.col("id"), F.octet_length("text")).sortWithinPartitions("id", F.octet_length("text"), "text")
     .mapInArrow(run, f"shard int, segment int, shard_start long, n_tokens long, ids array<{kind}>, counts array<long>, data binary")
     .write.parquet(path))


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """One row a document: id, start, n_tokens, ids_crc32 and, unless left out,
    ids (little-endian unsigned 32-bit)."""
    file = spark.read.parquet(path)
    shards = file.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a writing task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    kind = file.schema["ids"].dataType.elementType.simpleString()
    more = ", ids binary" if ids else ""

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                tokens = decode_blocks(b["data"][k].as_py()).astype("<u4")
                counts = b["counts"][k].values.to_numpy()
                at = np.concatenate(([0], np.cumsum(counts)))
                parts = [tokens[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                cols = [b["ids"][k].values, pa.array(at[:-1] + b["first"][k].as_py()), pa.array(counts),
                        pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    cols, names = [*cols, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    C.small_batches(spark)
    return (file.join(F.broadcast(shards), "shard")
            .select("ids", "counts", "data", (F.col("before") + F.col("shard_start")).alias("first"))
            .mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long{more}")
            .withColumnRenamed("id", id_col))
