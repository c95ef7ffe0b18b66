"""Personal data: exact patterns, and more found by bootstrapped contexts.

Four kinds have exact rules (email, ip, card, phone); their matches are seeds.
Every other token that looks like an identifier is a candidate, and so are
digit groups joined by blanks or signs, of as many digits as a phone or card.
A mention belongs to two lexical patterns: the word before it, or after it, with
the shape of the token (runs of letters, digits, signs).  Cards, phones and runs
of digit groups also belong to the word before or after with only a class of
digit counts, so another way of writing a number is found in the same context.
White space of any length may lie between; of a context word the 60 characters
nearest the mention count.
Spark scores the graph of
patterns and instances in turns: a pattern by the mean score of its instances,
discounted where few seeds support it; an instance by noisy-or of its patterns,
seeds staying at 1.  Candidates in patterns of high confidence are added with
the kind of the pattern's seeds, for example cards whose check digit is wrong.

A word that is frequent everywhere stands beside identifiers too.  So a pattern
takes part only if its word is bound to its shape: with M instances of the shape
on that side (one for each word beside it) and a word that makes up the share f
of all words, chance alone brings E = M f instances; the pattern needs
``MIN_LIFT`` E + ``SIGMAS`` sqrt(E).  Copies of a text add no instances.  Words
are counted over all whole texts, by a 64-bit hash; a context word with signs
inside it is as frequent as its first part.  The edge of a text and
words of signs alone make no pattern.

Plan.  One pass over the texts writes, for each row, its base spans and its
mentions, another counts words with partial aggregation; graphs are grouped by
pattern or instance with partial aggregation; texts are not shuffled.
``audit`` hides a share of the seeds and reports how many are found again.

Defined results: a null text is empty; offsets are code points, ends exclusive;
each input row gives one row, repeated ids too; other columns are ignored;
discovered spans may overlap each other.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm import common as C

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, MIN_SCORE = 3, 3, 0.8, 0.8
#: How far a pattern's instances must be above those that its word's frequency alone brings.
MIN_LIFT, SIGMAS = 2.0, 3.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match always starts at a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_RUN = re.compile(r"[+(]{0,2}[0-9]+(?:[\x20().-]{1,3}[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")
#: Digits of the shortest phone and the longest card, and from which a run may be a card.
LEAST_DIGITS, MOST_DIGITS, CARD_DIGITS = 9, 19, 13
#: Characters of a context word, those nearest the mention.
CONTEXT = 60
_EDGE = ".,;:!?\"'()[]{}<>|"
_ENDS = C.WHITE.copy()
_ENDS[list(_EDGE.encode())] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start."""
    out, past = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > past and _LOCAL.match(text[a - 1]):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
        past = m.end() if m else at + 1
        at = text.find("@", past)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def token_shape(token: str) -> str:
    """Runs of digits, letters and signs: 4.5.6.7 -> 9.9.9.9, with the size of a long run of digits."""
    short = re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", token))
    return re.sub(r"[0-9]+", lambda m: "9" if len(m.group()) < 6 else f"9{len(m.group())}", short)


def digit_runs(text: str, taken: list[tuple[int, int]]) -> dict[tuple[int, int], bool]:
    """(start, end) of digit groups joined by blanks or signs outside the taken
    spans, from any group of a run to any other of 9 to 19 digits, and whether
    the digit count is a context's shape: the most groups from the run's start,
    or to its end (between other groups the neighbours are no words)."""
    out: dict[tuple[int, int], bool] = {}
    at = 0
    for a, z in [*taken, (len(text), len(text))]:
        ends: dict[int, tuple[int, int]] = {}  # of each run, its longest span to the end
        for m in _RUN.finditer(text, at, a) if at < a else ():
            first, last = m.span()
            if last - first < LEAST_DIGITS or (first and (text[first - 1].isalnum() or text[first - 1] in "_@")) or (
                    last < len(text) and (text[last].isalnum() or text[last] in "_@")):
                continue
            groups = [g.span() for g in _DIGITS.finditer(text, first, last)]
            start = first if ")" in m.group() or "(" not in m.group() else groups[0][0]
            for i, (x, _) in enumerate(groups):
                # an opening bracket goes with its group
                x = start if not i else x - (text[x - 1] == "(")
                n, most = 0, None
                for k in range(i, len(groups)):
                    n += groups[k][1] - groups[k][0]
                    if n > MOST_DIGITS:
                        break
                    if n >= LEAST_DIGITS:
                        most = (x, groups[k][1])
                        out.setdefault(most, False)
                        if k == len(groups) - 1 and last not in ends:
                            ends[last] = most
                if most and not i:
                    out[most] = True
        for span in ends.values():
            out[span] = True
        at = max(at, z)
    return out


def mentions(text: str, base: list) -> list[tuple]:
    """(start, end, instance, kind or None, [patterns], [frames], [words]) of seeds
    and candidates; a frame is its pattern with ``_`` for the word."""
    found = [(a, z, kind) for kind, a, z in base]
    taken = sorted((a, z) for _, a, z in base)
    runs = digit_runs(text, taken)
    found += [(a, z, None) for a, z in runs]
    k = 0
    for m in _TOKEN.finditer(text):
        a, z = m.span()
        while a < z and text[a] in _EDGE:
            a += 1
        while z > a and text[z - 1] in _EDGE:
            z -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        clash = k < len(taken) and taken[k][0] < z
        if not clash and z - a >= 7 and (a, z) not in runs and ("@" in text[a:z] or sum(c in "0123456789" for c in text[a:z]) >= 4):
            found.append((a, z, None))
    out = []
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    for a, z, kind in sorted(found, key=lambda x: x[:2]):
        token = text[a:z]
        i, j = bisect.bisect_left(starts, a) - 1, bisect.bisect_right(ends, z)
        before = text[max(starts[i], min(ends[i], a) - CONTEXT):min(ends[i], a)].split() if i >= 0 else []
        after = text[max(starts[j], z):min(ends[j], max(starts[j], z) + CONTEXT)] if j < len(ends) else ""
        left = before[-1].strip(_EDGE).lower() if before else ""
        right = after.strip(_EDGE).lower()
        s = token_shape(token)
        frames = [(w, f) for w, f in ((left, f"_ <{s}>"), (right, f"<{s}> _")) if w]
        if kind in ("card", "phone") or (kind is None and runs.get((a, z))):
            size = "long" if sum(c in "0123456789" for c in token) >= CARD_DIGITS else "short"
            frames += [(left, f"_ #{size}")] if any(map(str.isalpha, left)) else []
            frames += [(right, f"#{size} _")] if any(map(str.isalpha, right)) else []
        patterns = [f"{w}{f[1:]}" if f[0] == "_" else f"{f[:-1]}{w}" for w, f in frames]
        out.append((a, z, token, kind, patterns, [f for _, f in frames], [w for w, _ in frames]))
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_MENTION = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("kind", pa.string()),
                               ("patterns", pa.list_(pa.string())), ("frames", pa.list_(pa.string())),
                               ("words", pa.list_(pa.int64()))]))
_SPAN_DDL = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, base spans and mentions, written once."""
    trigger = np.zeros(256, dtype=bool)
    trigger[[*b"0123456789@"]] = True

    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            raw, at = C.text_bytes(b["text"])
            hits = np.concatenate(([0], np.cumsum(trigger[raw])))[at]
            spans, seen = [[]] * len(b), [[]] * len(b)
            for i in np.flatnonzero(np.diff(hits)).tolist():
                text = b["text"][i].as_py()
                base = base_spans(text)
                spans[i] = [dict(zip(("kind", "start", "end"), s)) for s in base]
                seen[i] = [dict(zip(("start", "end", "instance", "kind", "patterns", "frames", "words"), m)) for m in mentions(text, base)]
            distinct = list({w for ms in seen for m in ms for w in m["words"]})
            hashes = dict(zip(distinct, word_keys(distinct)))
            for m in (m for ms in seen for m in ms):
                m["words"] = [hashes[w] for w in m["words"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(b))), b["id"], pa.array(spans, _SPAN), pa.array(seen, _MENTION)],
                ["row", "id", "base", "mentions"])
            row += len(b)

    C.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return C.materialise(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            run, f"row long, id {kind}, base {_SPAN_DDL}, "
                 "mentions array<struct<start:long,end:long,instance:string,kind:string,patterns:array<string>,frames:array<string>,words:array<long>>>"), "mentions")


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, split at signs too and with A-Z lower-cased, and where each text's begin and end."""
    words = C.split_words(texts, lower=True, ends_word=_ENDS)
    return C.word_hashes(words).view(np.int64), words.off


def word_keys(words: list[str]) -> list[int]:
    """The hash under which ``word_counts`` counts each of the words."""
    h, off = _hashes(pa.array(words, pa.string()))
    return [int(h[a]) if a < z else 0 for a, z in zip(off[:-1].tolist(), off[1:].tolist())]


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): how often each word occurs over all texts, words by their hashes."""
    def run(batches):
        keys, counts, held = [], [], 0

        def merged():
            word, at = np.unique(np.concatenate(keys), return_inverse=True)
            return word, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

        for b in batches:
            for part in C.slices(b["text"]):
                word, n = np.unique(_hashes(part)[0], return_counts=True)
                keys.append(word)
                counts.append(n)
                held += len(word)
                if held > 1_000_000:  # merged within the task; what is still much goes on
                    word, n = merged()
                    keys, counts, held = [word], [n], len(word)
                    if held > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])
                        keys, counts, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["word", "n"])

    C.small_batches(docs.sparkSession)
    each = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long")
    return C.materialise(each.groupBy("word").agg(F.sum("n").alias("n")), "words")


def confident(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) and (instance, score) from edges (pattern,
    instance, kind): patterns and instances score each other in turns."""
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 0.5)).alias("confidence"), F.sum("seed").alias("seeds"),
            *[F.sum((F.col("kind") == k).cast("int")).alias(k) for k in KINDS])
        graph = edges.join(patterns.select("pattern", "confidence"), "pattern")
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        instances = graph.groupBy("instance").agg((1 - F.exp(doubt)).alias("heard"), F.max("seed").alias("is_seed"))
        scored = edges.join(instances, "instance").withColumn(
            "score", F.when(F.col("is_seed") == 1, 1.0).otherwise(F.col("heard"))).drop("heard", "is_seed")
    most = F.greatest(*KINDS)
    kind = F.coalesce(*[F.when(F.col(k) == most, k) for k in KINDS])
    return patterns.select("pattern", "confidence", "seeds", kind.alias("as_kind")), scored.groupBy("instance").agg(F.max("score").alias("score"))


def bound(edges: DataFrame, words: DataFrame) -> DataFrame:
    """Patterns whose word stands beside their shape more often than its
    frequency explains.  A word unknown to ``words`` (one cut at ``CONTEXT``,
    or with capitals beyond A-Z) counts as often as it stands there."""
    total = words.agg(F.sum("n")).first()[0] or 1
    seen = edges.groupBy("pattern", "frame", "word").agg(F.count(F.lit(1)).alias("seen"))
    frames = seen.groupBy("frame").agg(F.sum("seen").alias("framed"))
    chance = F.col("framed") * F.coalesce("n", "seen") / F.lit(total)
    return (seen.join(frames, "frame").join(words, "word", "left")
            .where(F.col("seen") >= MIN_LIFT * chance + SIGMAS * F.sqrt(chance)).select("pattern").distinct())


def mention_links(seen: DataFrame) -> DataFrame:
    """row, start, end, instance, kind, pattern, frame and word: one row a mention and pattern."""
    each = seen.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    return each.select("row", "start", "end", "instance", "kind", F.explode(F.arrays_zip("patterns", "frames", "words")).alias("p")).select(
        "row", "start", "end", "instance", "kind", F.col("p.patterns").alias("pattern"), F.col("p.frames").alias("frame"),
        F.col("p.words").alias("word"))


def discover(links: DataFrame, words: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
             min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """(row, start, end, kind) of candidates, the mentions without a kind, in patterns of high confidence."""
    every = C.materialise(links.groupBy("pattern", "frame", "word", "instance").agg(F.max("kind").alias("kind")), "contexts")
    edges = C.materialise(every.join(bound(every, words), "pattern").select("pattern", "instance", "kind")
                          .withColumn("seed", F.col("kind").isNotNull().cast("int")), "edges")
    patterns, instances = confident(edges, rounds)
    good = patterns.where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence))
    return (links.where("kind is null").join(good, "pattern").join(instances.where(F.col("score") >= min_score), "instance")
            .groupBy("row", "start", "end").agg(F.min("as_kind").alias("kind")))


def audit(docs: DataFrame, hide: float = 0.2, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """What contexts alone find of seeds that are hidden from them, a share
    ``hide`` of the instances, by hash: kind, hidden, found, right (with that kind),
    and in the row of the null kind how many other candidates were found."""
    links = mention_links(scan(docs, id_col, text_col))
    part = F.pmod(F.xxhash64("instance"), F.lit(1_000_000)) < int(hide * 1_000_000)
    known = links.withColumn("truth", F.col("kind")).withColumn("kind", F.when(~part, F.col("kind")))
    found = discover(known.drop("truth"), word_counts(docs, text_col), **how).withColumnRenamed("kind", "said")
    asked = known.where("kind is null").groupBy("row", "start", "end").agg(F.max("truth").alias("kind"))
    return (asked.join(found, ["row", "start", "end"], "left").groupBy("kind").agg(
        F.sum(F.col("kind").isNotNull().cast("long")).alias("hidden"), F.count("said").alias("found"),
        F.sum((F.col("said").eqNullSafe(F.col("kind")) & F.col("kind").isNotNull()).cast("long")).alias("right")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: id, base (spans by kind, then start) and spans
    (base and discovered); ``how`` goes to ``discover``."""
    seen = scan(docs, id_col, text_col)
    new = (discover(mention_links(seen), word_counts(docs, text_col), **how)
           .groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    every = F.concat("base", F.coalesce("more", F.array().cast(_SPAN_DDL)))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(place[s["kind"]].alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return seen.drop("mentions").join(new, "row", "left").select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def spans_text(column):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[dict]) -> str:
    """The text with each span (overlapping ones merged) replaced by its kind in brackets."""
    parts, past = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= past:
            parts += [text[past:s["start"]], f"[{s['kind'].upper()}]"]
        past = max(past, s["end"])
    return "".join([*parts, text[past:]])
