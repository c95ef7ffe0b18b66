"""Quality by positive-unlabelled learning.

Trusted positives are rows labelled good; every other text, and the good ones
again, is unlabelled web text: labels other than good are never read.  With an
estimated class prior p the classifier minimises the unbiased risk

    p E_pos[l(g)] + max(0, E_all[l(-g)] - p E_pos[l(-g)]),   l(z) = log(1 + exp(-z))

of a linear function g of text statistics.  While the second part is positive
the risk is convex and Newton steps minimise it.  A step that takes the second
part below zero is corrected: it is followed by steps along that part's own
gradient until the part is zero again, and taken if the risk still falls.

The prior is estimated from positives and unlabelled rows alone: a first linear
function tells positives from all rows, and p is the least ratio of the share
of all rows above a threshold to that of positives above it, the threshold
being the one with the lowest upper confidence bound of that ratio.

Plan.  One pass turns texts into some thirty numbers each; Newton's sums over
all rows are added up in Spark, a gradient and a matrix of thirty by thirty
coming back, and once two histograms of ``BINS`` counts.  Nothing else reaches
the driver and no text is shuffled.  Scores are a column expression.

Defined results: a null or empty text has all statistics zero and gets a score
like any other; rows with a null id count as held out; a row with several
labels is a positive if one of them is good; without positives every score is
the prior, one half unless given.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm import common as C

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "other": range(128, 256),
    "space": (32, 9), "line": (10,), "stop": (46,), "comma": (44,), "bang": (33,), "ask": (63,), "bar": (124,),
    "sign": tuple(b"#$%&*@^~"), "bracket": tuple(b"()[]{}<>"), "quote": (34, 39), "dash": (45, 95), "slash": (47, 92, 58, 61),
}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.uint8)  # each byte is in one class, or in none
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _i
FEATURES = (*_CLASSES, "log_words", "word_length", "word_spread", "distinct", "again", "again2", "caps", "signed", "long_words",
            "line_words", "same_line", "short", "distinct2")


def features(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES) numbers, each a share or a small logarithm."""
    raw, at = C.text_bytes(texts)
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    size = np.maximum(1, np.diff(at))
    cell = np.repeat(np.arange(n, dtype=np.int64) * (len(_CLASSES) + 1), np.diff(at))
    cell += _CLASS_OF[raw]
    hits = np.bincount(cell, minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, :-1]
    out[:, :len(_CLASSES)] = np.sqrt(hits / size[:, None])
    words = C.split_words(texts)
    if not len(words):
        return out
    h, length, off = C.word_hashes(words), np.diff(words.ends), words.off
    count = np.diff(off)
    some = np.maximum(1, count)
    owner = np.repeat(np.arange(n), count)

    def share(flag):
        return np.diff(np.concatenate(([0], np.cumsum(flag, dtype=np.float64)))[off]) / some

    def distinct(keys, of):
        order = np.lexsort((keys, of))
        keys, of = keys[order], of[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        return np.bincount(of[first], minlength=n)

    def back(k):
        same = np.zeros(len(h), dtype=bool)
        same[k:] = (h[k:] == h[:-k]) & (owner[k:] == owner[:-k])
        return share(same)

    mean = share(length)
    last, first = words.data[words.ends[1:] - 1], words.data[words.ends[:-1]]
    second = words.data[np.minimum(words.ends[:-1] + 1, len(words.data) - 1)]
    caps = (first >= 65) & (first <= 90) & (second >= 65) & (second <= 90) & (length > 1)
    signed = C.NOT_ALNUM[last] & ~np.isin(last, list(b".,;:'\")"))
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    line = lines[words.start]
    opens = np.ones(len(h), dtype=bool)
    opens[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(opens)
    line_hash = np.add.reduceat(C.mix(h + (np.arange(len(h)) - heads[np.cumsum(opens) - 1]).astype(np.uint64)), heads)
    n_lines = np.maximum(1, np.bincount(owner[heads], minlength=n))
    pairs = C.rolling(h, 2)
    inside = owner[:-1] == owner[1:] if len(h) > 1 else np.zeros(0, bool)
    more = np.stack([
        np.log1p(count) / 5, mean / 8, np.sqrt(np.maximum(0, share(length.astype(np.float64) ** 2) - mean ** 2)) / 8,
        distinct(h, owner) / some, np.sqrt(back(1)), np.sqrt(back(2)), np.sqrt(share(caps)), np.sqrt(share(signed)),
        share(length > 15), np.log1p(count / n_lines) / 5, np.sqrt(1 - distinct(line_hash, owner[heads]) / n_lines),
        (count < 20).astype(float), distinct(pairs[inside], owner[1:][inside]) / some if len(h) > 1 else np.zeros(n)], axis=1)
    out[:, len(_CLASSES):] = np.where(count[:, None] > 0, more, 0)
    return out


#: Bins of the histograms from which the prior is estimated.
BINS = 2000


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant
    prior: float

    def score(self, x: str = "x"):
        """The score as a column of the array column ``x``."""
        z = F.lit(float(self.weights[-1]))
        for j, (m, s, w) in enumerate(zip(self.mean.tolist(), self.scale.tolist(), self.weights.tolist())):
            unit = (F.col(x)[j].cast("double") - F.lit(m)) / F.lit(s)
            z = z + F.greatest(F.lit(-6.0), F.least(F.lit(6.0), unit)) * F.lit(w)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))


def held_out(id_col):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id, held_out and x, written once; with ``carry`` also all columns of ``docs``, as c0, c1 and so on."""
    names = ["id", "held_out", *[f"c{i}" for i in range(len(docs.columns))]] if carry else ["id", "held_out"]
    place = names.index(f"c{docs.columns.index(text_col)}") if carry else 2

    def run(batches):
        for b in batches:
            x = np.concatenate([np.zeros((0, len(FEATURES))), *map(features, C.slices(b.column(place)))]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], lists], [*names, "x"])

    C.small_batches(docs.sparkSession)
    own = [F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out")]
    rows = docs.select(*own, F.col(text_col).alias("text"))
    if carry:
        plain = docs.toDF(*names[2:])  # names of any kind
        key = names[2 + docs.columns.index(id_col)]
        rows = plain.select(F.col(key).alias("id"), F.coalesce(held_out(key), F.lit(True)).alias("held_out"), *names[2:])
    out = rows.select(*names).withColumn("x", F.lit(None).cast("array<float>")).schema
    return C.materialise(rows.mapInArrow(run, out), "features")


def _sums(rows: DataFrame, add) -> np.ndarray:
    """The sum over all rows of arrays: ``add(x, positive)`` gives one for a batch."""
    def run(batches):
        total = None
        for b in batches:
            if len(b):
                x = b["x"].flatten().to_numpy().reshape(len(b), -1).astype(np.float64)
                part = add(x, b["pos"].to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])
    got = {r["i"]: r["v"] for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return np.array([got[i] for i in range(len(got))])


def _ratio(every: np.ndarray, good: np.ndarray) -> float:
    """The prior from histograms of all rows and of positives over the same bins, worst scores first."""
    n, n_pos = every.sum(), good.sum()
    above_all, above_pos = np.cumsum(every[::-1]) / n, np.cumsum(good[::-1]) / n_pos
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(n_pos))  # of both shares, one in ten
    some = above_pos > 0
    bound = np.where(some, (above_all + slack) / np.where(some, above_pos, 1), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(above_all[best] / above_pos[best], n_pos / n, 1 - 1e-3))


def fit(table: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", prior: float | None = None,
        steps: int = 8, ridge: float = 1e-2) -> Model:
    """Learn from rows of a feature table that are not held out.  ``prior`` is
    estimated, unless given, from the positives and all rows."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct().withColumn("pos", F.lit(True))
    rows = C.materialise(table.where("not held_out").select("id", "x").join(good, "id", "left")
                         .select("x", F.coalesce("pos", F.lit(False)).alias("pos")), "learn")
    n, n_pos = rows.agg(F.count(F.lit(1)), F.sum(F.col("pos").cast("int"))).first()
    d = len(FEATURES)
    k = d + 1
    if not n_pos:
        constant = 0.0 if prior is None else np.log(prior / (1 - prior))
        return Model(np.zeros(d), np.ones(d), np.r_[np.zeros(d), constant], prior or 0.5)
    s = _sums(rows, lambda x, pos: np.r_[x.sum(axis=0), (x ** 2).sum(axis=0)])
    mean = s[:d] / n
    scale = np.sqrt(np.maximum(s[d:] / n - mean ** 2, 1e-6))
    keep = np.r_[np.full(d, ridge), 0]

    def unit(x):
        return np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))]

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def bend(x, p):
        return ((x * (p * (1 - p))[:, None]).T @ x).ravel()

    if prior is None:
        def contrast(w):
            """Loss, gradient and curvature of telling positives from all rows, both of weight one half."""
            def add(x, pos):
                x = unit(x)
                z = x @ w
                p = sigmoid(z)
                return np.r_[x.T @ p / n - x[pos].T @ (1 - p[pos]) / n_pos, bend(x, p) / n + bend(x[pos], p[pos]) / n_pos,
                             np.logaddexp(0, z).sum() / n + np.logaddexp(0, -z[pos]).sum() / n_pos]
            s = _sums(rows, add) / 2
            return s[-1] + (keep * w * w).sum() / 2, s[:k] + keep * w, s[k:-1].reshape(k, k) + np.diag(keep + 1e-9)

        w = np.zeros(k)
        loss, gradient, hess = contrast(w)
        for _ in range(steps):
            step = np.linalg.solve(hess, gradient)
            for size in (1.0, 0.3, 0.1):
                ahead = contrast(w - size * step)
                if ahead[0] <= loss + 1e-9:
                    break
            else:
                break
            before, w = loss, w - size * step
            loss, gradient, hess = ahead
            if before - loss < 1e-4:
                break

        def count(x, pos):
            at = np.minimum((sigmoid(unit(x) @ w) * BINS).astype(np.int64), BINS - 1)
            return np.r_[np.bincount(at, minlength=BINS), np.bincount(at[pos], minlength=BINS)].astype(np.float64)
        s = _sums(rows, count)
        prior = _ratio(s[:BINS], s[BINS:])

    def parts(w):
        """The risk, its second part, the gradients of both and the curvature."""
        def add(x, pos):
            x = unit(x)
            z = x @ w
            p = sigmoid(z)
            soft = np.logaddexp(0, z)  # l(-g)
            return np.r_[x[pos].sum(axis=0), x.T @ p, x[pos].T @ p[pos], bend(x, p), soft.sum(), soft[pos].sum()]
        s = _sums(rows, add)
        pos_x, all_p, pos_p, hess = s[:k] / n_pos, s[k:2 * k] / n, s[2 * k:3 * k] / n_pos, s[3 * k:-2].reshape(k, k) / n
        negative = s[-2] / n - prior * s[-1] / n_pos
        risk = prior * (s[-1] / n_pos - pos_x @ w) + max(0.0, negative) + (keep * w * w).sum() / 2
        return risk, negative, all_p - prior * pos_x + keep * w, hess + np.diag(keep + 1e-9), all_p - prior * pos_p

    w = np.r_[np.zeros(d), np.log(prior / (1 - prior))]
    state = parts(w)
    for _ in range(steps):
        step = np.linalg.solve(state[3], state[2])
        for size in (1.0, 0.3, 0.1, 0.03):
            to = w - size * step
            ahead = parts(to)
            for _ in range(3):
                if ahead[1] >= 0:
                    break
                # the correction: up along the second part's gradient, to where its tangent is zero
                to = to - ahead[4] * (1.01 * ahead[1] / max(ahead[4] @ ahead[4], 1e-12))
                ahead = parts(to)
            if ahead[1] >= 0 and ahead[0] <= state[0] + 1e-9:
                break
        else:
            break
        fell = state[0] - ahead[0]
        w, state = to, ahead
        if fell < 1e-6:
            break
    return Model(mean, scale, w, prior)


def scores(table: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score and predicted for each row of a feature table."""
    return (table.select(F.col("id").alias(id_col), "held_out", model.score().alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(table: DataFrame, columns: list[str], model: Model, threshold: float = 0.3) -> DataFrame:
    """Of a feature table that carries its documents, the rows whose score
    reaches the threshold, with the documents' own ``columns``."""
    return table.where(model.score() >= threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
