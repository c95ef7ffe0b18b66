"""Source divergence audit by chunk factorization.

Terms are maximal runs of letters (all bytes but ASCII signs, digits and white
space), A-Z lower-cased.  White space never lies within a term, so the terms of
a text are those of its white-space chunks, and a corpus has far fewer
different chunks than chunks.

Plan.
1. Chunks are counted where the texts lie, in blocks of documents: a block's
   different chunks, dealt to buckets by their hash, and for each chunk the
   block's document (16 bits) of every occurrence.  A row is a block's share of
   a bucket, so neither words nor counts travel one by one, and a chunk that is
   in every text takes one entry a block.
2. A bucket brings together all entries of its chunks: each globally distinct
   chunk is tokenized once and its terms are joined back to the entries.  The
   number of buckets grows with the bytes of text.
3. A block's terms meet its occurrences again and are reduced to terms with
   occurrences by source and distinct documents, as a term may reach one
   document through several chunks ("the", "the,").  A group is one block of
   bounded size.  Partial aggregation then gives the documents of each term in
   the corpus, and the occurrences of the terms that are kept.
4. Shares are exact integers.  For a pair of sources, the sum over all kept
   terms is put together from terms that both have, terms of one only and
   terms of neither.  Blocks of terms give, for every two sources that
   share terms, one partial sum; terms of one source enter through the
   histogram of its shares against the other's share of an absent term.  So no
   row is made for a term and a pair.

Defined results: null text, lang and source are ''; each row is a document of
its own, repeated ones too; a lang without kept terms gives pairs of value 0
and no term rows; a source alone in its lang has no pairs; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetline.llm import common as C

MIN_DOCS, TOP_TERMS, ONE = 10, 10, 1_000_000_000
#: A block closes at so many documents or bytes of text; a bucket is for so many bytes.
BLOCK_DOCS, BLOCK_BYTES, BUCKET_BYTES = 1 << 14, 24 << 20, 16 << 20
#: Occurrences worked on at a time within a block.
STEP = 1 << 18
_KEYS = ["lang", "source"]
#: Bytes that are in no term.
NOT_TERM = np.zeros(256, dtype=bool)
NOT_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts in a sorted array."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _slices(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``values`` cut at ``ends`` (which starts with 0) into binaries."""
    values = np.ascontiguousarray(values)
    ends = (ends * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(pa.binary())


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype=kind)


def chunk_blocks(docs: DataFrame, buckets: int, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a block and bucket: chunks, how often each occurs (u32), the document
    of each occurrence (u16); and a row (bucket -1) a block with its groups:
    langs, sources and each one's first document (u32).  A block's documents are
    numbered by group."""
    block_docs = min(block_docs, 1 << 16)
    names = ["block", "bucket", "chunks", "sizes", "docs", "langs", "sources"]
    texts, none = pa.list_(pa.string()), [None]

    def count(b: pa.RecordBatch, block: int) -> list[pa.RecordBatch]:
        groups = pa.table({"lang": b["lang"], "source": b["source"], "row": np.arange(len(b))}).sort_by([("lang", "ascending"), ("source", "ascending"), ("row", "ascending")])
        order, lang, source = groups["row"].to_numpy(), _column(groups, "lang"), _column(groups, "source")
        number = np.empty(len(b), dtype=np.int64)
        number[order] = np.arange(len(b))
        code = np.unique(np.array([lang.dictionary_encode().indices.to_numpy(), source.dictionary_encode().indices.to_numpy()]), axis=1, return_inverse=True)[1].ravel()
        first = _runs(code)
        out = [pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([-1], pa.int32()), pa.array(none, texts), pa.array([first.astype("<u4").tobytes()], pa.binary()),
             pa.array(none, pa.binary()), pa.array([lang.take(pa.array(first)).to_pylist()], texts),
             pa.array([source.take(pa.array(first)).to_pylist()], texts)], names)]
        parts, codes, docs, at, known = [], [], [], 0, 0
        for part in C.slices(b["text"]):  # work arrays for a slice; for the block, six bytes a word
            words = C.split_words(part)
            coded = words.array().cast(pa.string()).dictionary_encode()
            codes.append(coded.indices.to_numpy() + np.int32(known))
            docs.append(np.repeat(number[at:at + len(part)].astype(np.uint16), np.diff(words.off)))
            parts.append(coded.dictionary)
            at, known = at + len(part), known + len(coded.dictionary)
        if not known:
            return out
        coded = pa.concat_arrays(parts).dictionary_encode()
        chunks, code = coded.dictionary, coded.indices.to_numpy()
        bucket = np.concatenate([(C.word_hashes(C.split_words(x)) % np.uint64(buckets)).astype(np.int64) for x in C.slices(chunks)])
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(chunks), dtype=np.int64)
        rank[by_bucket] = np.arange(len(chunks))
        place = rank[code] << 16
        seen = np.empty(sum(map(len, codes)), dtype=np.int64)
        at = 0
        for c, d in zip(codes, docs):
            np.bitwise_or(place[c], d, out=seen[at:at + len(c)])
            at += len(c)
        del codes, docs, c, d
        seen.sort()
        sizes = np.diff(np.searchsorted(seen, np.arange(len(chunks) + 1) << 16))
        first = _runs(bucket[by_bucket])
        ends = np.append(first, len(chunks))
        n = len(first)
        empty = pa.array([None] * n, texts)
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(bucket[by_bucket[first]].astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), chunks.take(pa.array(by_bucket)).cast(pa.string())),
             _slices(sizes.astype("<u4"), ends), _slices(seen.astype("<u2"), np.concatenate(([0], np.cumsum(sizes)))[ends]),
             empty, empty], names))
        return out

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            lengths = np.cumsum(np.diff(C.text_bytes(b["text"])[1]))
            i = 0
            while i < len(b):  # cut where the block is full; a longer document is a block of its own
                past = lengths[i - 1] if i else 0
                j = min(max(i + 1, int(np.searchsorted(lengths, past + block_bytes - size, side="right"))),
                        i + block_docs - sum(map(len, held)), len(b))
                held.append(b.slice(i, j - i))
                size += int(lengths[j - 1] - past)
                i = j
                if size >= block_bytes or sum(map(len, held)) >= block_docs:
                    whole, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
                    yield from count(whole, block)
                    block, size = block + 1, 0
        if sum(map(len, held)):
            yield from count(pa.Table.from_batches(held).combine_chunks().to_batches()[0], block)

    C.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "block long, bucket int, chunks array<string>, sizes binary, docs binary, langs array<string>, sources array<string>")


def _tokenize(table: pa.Table) -> pa.Table:
    """The entries of one bucket with the terms of their chunks: each distinct
    chunk is tokenized once."""
    chunks = _column(table, "chunks")
    coded = chunks.flatten().dictionary_encode()
    terms = C.split_words(coded.dictionary, lower=True, ends_word=NOT_TERM)
    entry = coded.indices.to_numpy()
    n = np.diff(terms.off)[entry]                       # terms of each entry
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(terms.off[:-1][entry], n)
    ends = np.concatenate(([0], np.cumsum([len(c) for c in chunks])))
    return pa.table({"block": table["block"], "bucket": table["bucket"], "n_terms": _slices(n.astype("<u4"), ends),
                     "terms": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n)))[ends].astype(np.int32)),
                                                       terms.array().cast(pa.string()).take(pa.array(place)))})


_COUNTS = "lang string, term string, n_docs long, by_source array<struct<source:string,n:long>>"


def _reduce(blocks: pa.Table, terms: pa.Table) -> pa.Table:
    """One block: documents and occurrences by source of each (lang, term)."""
    blocks, terms = blocks.sort_by("bucket"), terms.sort_by("bucket")
    first = _numbers(_column(blocks.slice(0, 1), "sizes"), "<u4").astype(np.int64)
    langs, sources = (pa.array(_column(blocks.slice(0, 1), c)[0].as_py(), pa.string()) for c in ("langs", "sources"))
    sizes, docs = _numbers(_column(blocks.slice(1), "sizes"), "<u4").astype(np.int64), _numbers(_column(blocks.slice(1), "docs"), "<u2")
    n_terms, coded = _numbers(_column(terms, "n_terms"), "<u4").astype(np.int64), _column(terms, "terms").flatten().dictionary_encode()
    entry = np.repeat(np.arange(len(sizes)), n_terms)   # the chunk of each term
    held, start, term = sizes[entry], (np.cumsum(sizes) - sizes)[entry], coded.indices.to_numpy()
    ends = np.concatenate(([0], np.cumsum(held)))
    key, i = np.empty(int(ends[-1]), dtype=np.int64), 0
    while i < len(held):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + STEP, side="right")) - 1)
        n = held[i:j]
        place = np.arange(int(n.sum())) + np.repeat(start[i:j] - (ends[i:j] - ends[i]), n)
        np.bitwise_or(np.repeat(term[i:j].astype(np.int64) << 16, n), docs[place], out=key[ends[i]:ends[j]])
        i = j
    key.sort()
    once = _runs(key)                                   # a document of a term
    end, key = len(key), key[once]
    group = np.searchsorted(first, key & 0xFFFF, side="right") - 1
    term = key >> 16
    cell = _runs(term * (len(first) + 1) + group)       # a (lang, source) of a term
    n = np.diff(np.append(once[cell], end))
    n_docs = np.diff(np.append(cell, len(once)))
    term, group = term[cell], group[cell]
    code = langs.dictionary_encode()
    lang = code.indices.to_numpy().astype(np.int64)[group]
    row = _runs(term * (len(code.dictionary) + 1) + lang)
    by_source = pa.StructArray.from_arrays([sources.take(pa.array(group)), pa.array(n, pa.int64())], ["source", "n"])
    return pa.table({"lang": code.dictionary.take(pa.array(lang[row])), "term": coded.dictionary.take(pa.array(term[row])),
                     "n_docs": pa.array(np.add.reduceat(n_docs, row) if len(row) else row, pa.int64()),
                     "by_source": pa.ListArray.from_arrays(pa.array(np.append(row, len(cell)).astype(np.int32)), by_source)})


def block_terms(docs: DataFrame, buckets: int | None = None, **limits) -> DataFrame:
    """lang, term, n_docs, by_source: the counts of every block, from rows lang, source, text without nulls."""
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = min(max(8, -(-size // BUCKET_BYTES)), 1 << 30)
    blocks = C.materialise(chunk_blocks(docs, buckets, **limits), "chunks")
    terms = (blocks.where("bucket >= 0").select("block", "bucket", "chunks").groupBy("bucket")
             .applyInArrow(_tokenize, "block long, bucket int, n_terms binary, terms array<string>"))
    return (blocks.drop("chunks").groupBy("block").cogroup(terms.groupBy("block"))
            .applyInArrow(_reduce, _COUNTS))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), exactly."""
    top = F.lit(ONE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shared_sums(kept: DataFrame, blocks: int) -> DataFrame:
    """lang, a, b, s: for two sources of a lang, what the terms that both have add
    beyond each one's share against the other's absent term.

    ``kept`` has lang, s_id, term, p, p0."""
    def run(table: pa.Table) -> pa.Table:
        b = table.combine_chunks().to_batches()[0]
        term = b["term"].dictionary_encode().indices.to_numpy()
        ids = b["s_id"].to_numpy()
        order = np.lexsort((ids, term))
        term, ids = term[order], ids[order]
        p, p0 = b["p"].to_numpy()[order], b["p0"].to_numpy()[order]
        f = lambda x, y: (x - y) ** 2 // (x + y)
        names, local = np.unique(ids, return_inverse=True)
        width = len(names)
        found = {"k": np.zeros(0, np.int64), "s": np.zeros(0, np.int64)}

        def fold(k, s):
            k, s = (np.concatenate((found[c], v)) for c, v in (("k", k), ("s", s)))
            order = np.argsort(k, kind="stable")
            first = _runs(k[order])
            found.update(k=k[order][first], s=np.add.reduceat(s[order], first))

        step = 1
        i = np.arange(len(term) - 1)
        while len(i := i[i + step < len(term)]):
            i = i[term[i] == term[i + step]]      # the step-th further source of the same term
            if not len(i):
                break
            j = i + step
            s = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            fold(local[i] * width + local[j], s)
            step += 1
        return pa.table({"lang": pa.array([b["lang"][0].as_py()] * len(found["k"]), pa.string()),
                         "a": names[found["k"] // max(1, width)], "b": names[found["k"] % max(1, width)], "s": found["s"]})

    dealt = kept.withColumn("_block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    return (dealt.groupBy("lang", "_block").applyInArrow(run, "lang string, a long, b long, s long")
            .groupBy("lang", "a", "b").agg(F.sum("s").alias("s")))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, lang_col: str = "lang",
               source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = C.materialise(block_terms(docs), "terms")
    groups = docs.select(*_KEYS).distinct()
    wanted = C.materialise(counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("d")).where(F.col("d") >= min_docs).drop("d"), "kept")
    kept = C.materialise(counts.select("lang", "term", "by_source").join(wanted, ["lang", "term"])
                         .select("lang", "term", F.explode("by_source").alias("x"))
                         .groupBy("lang", F.col("x.source").alias("source"), "term").agg(F.sum("x.n").alias("n")), "counts")
    per_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = per_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("lang_total"))
    kept = kept.join(per_lang, ["lang", "term"])
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    zero = F.lit(0).cast("long")
    sources = (groups.join(totals, _KEYS, "left").join(langs, "lang", "left")
               .na.fill(0, ["total", "n_terms", "v", "lang_total"]))
    # p0: the share of a term that the source does not have
    sources = C.materialise(sources.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))))
                            .withColumn("s_id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")), "sources")
    n_kept = max(1, wanted.count())
    shares = C.materialise(kept.join(sources, _KEYS).select(
        *_KEYS, "s_id", "term", "p0", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("n_lang"), F.col("lang_total"), F.col("v")).alias("q")), "shares")

    order = [F.desc("value"), F.asc("item")]
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(*_KEYS).orderBy(*order)))
    terms = ranked(shares.where("p > q").select(*_KEYS, F.lit("term").alias("part"), F.col("term").alias("item"),
                                                gap(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top_terms)

    # pairs: terms of neither, of one only, of both
    hist = (shares.groupBy("lang", "s_id", "p").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("lang", "s_id").agg(F.collect_list(F.struct("p", "n")).alias("hist")))
    base = (sources.join(hist, ["lang", "s_id"], "left")
            .select(*_KEYS, "s_id", "p0", "v", "n_terms", F.coalesce("hist", F.array().cast("array<struct<p:long,n:long>>")).alias("hist")))
    other = base.select("lang", *[F.col(c).alias(f"o_{c}") for c in ("source", "s_id", "p0", "n_terms", "hist")])
    both = base.join(other, "lang").where(F.col("s_id") != F.col("o_s_id"))
    against = lambda h, q: F.aggregate(h, zero, lambda s, x: s + x["n"] * gap(x["p"], q))
    absent = gap(F.col("p0"), F.col("o_p0"))
    plain = (against(F.col("hist"), F.col("o_p0")) + against(F.col("o_hist"), F.col("p0"))
             + (F.col("v") - F.col("n_terms") - F.col("o_n_terms")) * absent)
    shared = _shared_sums(shares.select("lang", "s_id", "term", "p", "p0"), max(1, -(-n_kept // 20_000)))
    pairs = (both.withColumn("a", F.least("s_id", "o_s_id")).withColumn("b", F.greatest("s_id", "o_s_id"))
             .join(shared, ["lang", "a", "b"], "left")
             .select(*_KEYS, F.lit("pair").alias("part"), F.col("o_source").alias("item"),
                     F.when(F.col("v") > 0, plain + F.coalesce("s", zero)).otherwise(zero).alias("value")))
    return ranked(pairs).unionByName(terms).select(*_KEYS, "part", "item", "value", "rank")
