"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
its words and their beginnings (so other endings of a word count too); a
document's is their noisy-or, 1 - prod(1 - p).  Only documents
carry labels: gradients of the bag likelihood reach the words of the sentences
that explain it, so the same scores then show which sentences offend.

Plan.  Words are hashed to a fixed number of weights (``BUCKETS``), so the
model is a megabyte at any size of corpus.  Which words are worth a weight is
counted over all labelled rows; the weights are fitted on a bounded sample of
labelled rows (``train_docs``, half of them toxic where there are enough; which
rows is decided by a hash of the id).  Scoring is one pass, without a shuffle.

Defined results: a null or empty text has no sentences and scores 0; rows with
a null id count as held out; of several labels of one id the largest counts;
without both labels to learn from every score is 0; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm import common as C
from vetline.llm.quality import held_out

BUCKETS = 1 << 18
#: In place of a weight that is not learned.
SPARE = 0
TRAIN_DOCS = 16_000
#: Beginnings of words, in bytes, that have weights of their own.
PREFIXES = (4, 5)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".!?\n\r"]] = True


def sentences(texts: pa.Array):
    """Weights that each word uses, the first word of each sentence, the first sentence of each
    text, and words; sentences end at . ! ? or a line's end."""
    words = C.split_words(texts, lower=True, ends_word=C.NOT_ALNUM)
    raw, _ = C.text_bytes(texts)
    breaks = np.cumsum(_BREAK[raw])
    owner = np.repeat(np.arange(len(words.off) - 1), np.diff(words.off))
    mark = breaks[words.start]
    opens = np.ones(len(words), dtype=bool)
    opens[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(opens)
    length = np.diff(words.ends)
    hashes = [C.word_hashes(words)]
    padded = np.concatenate((words.data, np.zeros(max(PREFIXES), np.uint8)))
    for k in PREFIXES:
        h = np.full(len(words), k, dtype=np.uint64)
        for j in range(k):
            h = C.mix(h * np.uint64(257) + np.where(j < length, padded[words.ends[:-1] + j], 0))
        hashes.append(h)
    bucket = np.stack([(h >> np.uint64(64 - 18)).astype(np.int32) for h in hashes], axis=1)
    return bucket, first, np.searchsorted(first, words.off), words


def _softplus(z):
    return np.logaddexp(0, z)


def fit_bags(used: np.ndarray, of: np.ndarray, bag: np.ndarray, n_sentences: int, y: np.ndarray, epochs: int = 60,
             rate: float = 0.25, l2: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and constant by gradient steps on the bag likelihood.  used: the
    weights of each word that has any; of: its sentence; bag: first sentence of
    each document (all have one)."""
    w, b = np.zeros(BUCKETS), -4.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    per_bag = np.diff(np.append(bag, n_sentences))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, epochs + 1):
        z = np.clip(np.bincount(of, weights=w[used].sum(axis=1), minlength=n_sentences) + b, -40, 40)
        total = np.add.reduceat(_softplus(z), bag)
        d_total = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0) * weight
        d_z = np.repeat(d_total, per_bag) / (1 + np.exp(-z))
        grad = np.bincount(used.ravel(), weights=np.repeat(d_z[of], used.shape[1]), minlength=BUCKETS) + l2 * w
        grad_b = d_z.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b ** 2
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        w[SPARE] = 0
        b -= 0.1 * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-6)
    return w, b


def telling(labelled: DataFrame, min_z: float, min_docs: int, min_lift: float) -> np.ndarray:
    """Which weights to learn, counted over all labelled rows (y, text): those of
    words found in toxic documents more often than chance (``min_z`` standard
    errors, ``min_docs`` documents) and ``min_lift`` times as often as in clean
    ones, which no growth of the tables alone brings about.  The others could only be fitted to
    accidents and stay 0."""
    def count(batches):
        held, totals = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for b in batches:
            bucket, _, bag, words = sentences(b["text"])
            y = b["y"].to_numpy()
            owner = np.repeat(np.arange(len(y)), np.diff(words.off))
            used = np.unique(owner[:, None] * BUCKETS + bucket)  # a document counts once for each of its weights
            for label in (0, 1):
                held[label] += np.bincount(used[y[used // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
            totals += np.bincount(y[np.diff(bag) > 0], minlength=2)
        held[:, SPARE] = totals
        some = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[0][some]), pa.array(held[1][some])], ["k", "clean", "toxic"])

    found = (labelled.mapInArrow(count, "k int, clean long, toxic long").groupBy("k")
             .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .where((F.col("toxic") >= min_docs) | (F.col("k") == SPARE)).toArrow())
    k, clean, toxic = found["k"].to_numpy(), found["clean"].to_numpy(), found["toxic"].to_numpy()
    seen = np.zeros(BUCKETS, dtype=bool)
    if not (k == SPARE).any():
        return seen
    n_clean, n_toxic = clean[k == SPARE][0], toxic[k == SPARE][0]
    if not n_clean or not n_toxic:
        return seen
    both = (clean + toxic) / (n_clean + n_toxic)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_clean + 1 / n_toxic))
    bad, good = toxic / n_toxic, clean / n_clean
    seen[k[(bad - good > min_z * error) & (bad >= min_lift * good)]] = True
    seen[SPARE] = False
    return seen


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_docs: int = TRAIN_DOCS, min_z: float = 6, min_docs: int = 5, min_lift: float = 2) -> tuple[np.ndarray, float]:
    """Learn from at most about ``train_docs`` labelled rows that are not held out."""
    C.small_batches(docs.sparkSession)
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(label_col).alias("y")).where(~held_out("id")))
    counts = {r["y"]: r["n"] for r in known.groupBy((F.col("y") == 1).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return np.zeros(BUCKETS), -np.inf
    share = {y: min(1.0, train_docs / 2 / counts[y]) for y in (0, 1)}
    limit = F.when(F.col("y") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20)))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < limit)

    def run(batches):
        for b in batches:
            bucket, first, bag, words = sentences(b["text"])
            ends = np.append(first, len(words))
            rows = [(bucket[ends[i]:ends[j]], (first[i:j] - ends[i]).astype(np.int32)) for i, j in zip(bag[:-1], bag[1:])]
            yield pa.RecordBatch.from_arrays(
                [b["y"], pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())],
                ["y", "words", "first"])

    sample = C.materialise(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
        .select((F.col("y") == 1).cast("int").alias("y"), "text").mapInArrow(run, "y int, words binary, first binary")
        .where(F.length("first") > 0), "toxic_sample")
    if sample.select("y").distinct().count() < 2:
        return np.zeros(BUCKETS), -np.inf
    labelled = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known.hint("merge"), "id")  # labels may be many
                .select((F.col("y") == 1).cast("int").alias("y"), "text"))
    seen = telling(labelled, min_z, min_docs, min_lift)

    def live(batches):  # of each document the words that have a weight, and their sentences
        for b in batches:
            rows = []
            for words, first in zip(b["words"], b["first"]):
                words = np.frombuffer(words.as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES))
                first = np.frombuffer(first.as_buffer(), np.int32)
                keep = np.flatnonzero(seen[words].any(axis=1))
                rows.append((np.where(seen[words[keep]], words[keep], SPARE).astype(np.int32),
                             (np.searchsorted(first, keep, side="right") - 1).astype(np.int32), len(first)))
            yield pa.RecordBatch.from_arrays(
                [b["y"], pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.int64())], ["y", "words", "sentence", "n"])

    got = sample.mapInArrow(live, "y int, words binary, sentence binary, n long").toArrow()
    used = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES)) for x in got["words"]]
    size = got["n"].to_numpy()
    bag = np.cumsum(size) - size
    of = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) + a for x, a in zip(got["sentence"], bag)])
    return fit_bags(np.concatenate(used), of.astype(np.int64), bag, int(size.sum()), got["y"].to_numpy())


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """id, held_out, score, predicted and offending: (start, end, score) of each
    sentence, in code points, whose own score reaches the threshold."""
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        w, b = shared.value
        for x in batches:
            bucket, first, bag, words = sentences(x["text"])
            n = len(x)
            total, offending = np.zeros(n), [[]] * n
            if len(words):
                z = np.add.reduceat(w[bucket].sum(axis=1, dtype=np.float64), first) + b
                run_total = np.concatenate(([0.0], np.cumsum(_softplus(z))))
                total = np.maximum(0, np.diff(run_total[bag]))
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                hot = np.flatnonzero(p >= threshold)
                last = np.append(first[1:], len(words)) - 1
                doc = np.searchsorted(bag, hot, side="right") - 1
                length = np.diff(words.ends)
                for s, i in zip(hot.tolist(), doc.tolist()):
                    raw = x["text"][i].as_py().encode()
                    a, e = words.start[first[s]] - words.base[i], words.start[last[s]] + length[last[s]] - words.base[i]
                    start = len(raw[:a].decode())
                    offending[i] = [*offending[i], {"start": start, "end": start + len(raw[a:e].decode()), "score": float(p[s])}]
            s = -np.expm1(-total)
            yield pa.RecordBatch.from_arrays(
                [x["id"], x["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(offending, span)],
                ["id", "held_out", "score", "predicted", "offending"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")
            .withColumnRenamed("id", id_col))
