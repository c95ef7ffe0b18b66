"""Each operator against a plain version of itself on small, awkward tables."""
import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vetline.llm import ann, common as C, packing, pii, quality, queries, simhash, substring_dedup, tiling, token_file, toxicity, warc

DOCS = "doc_id long, text string, id string, start long, lang string"  # extra names that operators use inside


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    passage = " ".join(rng.choices(vocab, k=35))
    out = [(None, "null id " + passage), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "x " * 3000)]
    for i in range(6, 60):
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 80)))
        out.append((i, f"{text}\n{passage}  {text}" if i % 3 == 0 else text))
    out += [(60, out[20][1]), (61, out[20][1]), (60, out[20][1]), (62, out[20][1].replace("W1 ", "W2 ", 1))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "en") for i, t in rows], DOCS).repartition(5)


def test_substring_dedup(spark, docs, rows):
    want, seen = [], set()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.remove_repeats(docs, shard_bytes=4000, bucket_windows=300).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        spans = [(s.start, s.end) for s in r.removed]
        assert sum(b - a for a, b in spans) == r.n_removed and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    assert substring_dedup.remove_repeats(docs.where("false")).count() == 0


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def test_simhash(docs, rows):
    prints = [fingerprint(t) for _, t in rows]
    root = linked(prints, 4)
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    got = simhash.near_duplicates(docs, leaf_points=8).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(
        ((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root)), key=key)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_vantage_point_trees_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, size=300, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, size=n, dtype=np.uint64)) for n in rng.integers(1, 6, size=600)]
    points = np.unique(np.concatenate((base, base.repeat(2) ^ np.array(flips, np.uint64))))
    nodes = simhash.build_tree(points, 16)
    met, homes = set(), np.zeros(len(points), int)
    for idx, _, home in simhash.visits(points, nodes, 4):
        homes[idx[home]] += 1
        met.update(tuple(sorted((int(a), int(b)))) for a in idx for b in idx[home] if a != b)
        label = simhash.link_forest(points[idx], home, 4, block=16)
        assert len(label) == len(idx)
    near = {(a, b) for a in range(len(points)) for b in range(a + 1, len(points)) if int(points[a] ^ points[b]).bit_count() <= 4}
    assert (homes == 1).all() and near <= met and near
    whole = simhash.link_forest(points, np.ones(len(points), bool), 4, block=16)
    root = linked([int(p) for p in points], 4)
    assert len({*zip(whole.tolist(), root)}) == len(set(root)) == len(set(whole.tolist()))


def test_salts_spread_one_leaf_and_lose_no_link():
    assert simhash.salts_of(4_000, 1, 6) == 4 and simhash.salts_of(100_000, 1, 6) == 6  # one leaf, several tasks
    assert simhash.salts_of(100, 1, 6) == 1 and simhash.salts_of(10_000_000, 100, 6) == 4
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, size=300, dtype=np.uint64)
    points = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << np.uint64(b)) for b in range(0, 60, 7)]))
    home = rng.random(len(points)) < 0.7
    want, got, asked = simhash.link_forest(points, home, 2, block=32), np.arange(len(points)), []
    for idx, _, asks in simhash.salted(points, home, 4):
        assert asks.sum() < len(points) / 2
        asked += idx[asks].tolist()
        label = simhash.link_forest(points[idx], home[idx], 2, block=32, asks=asks)
        simhash._union(got, idx, idx[label])
    assert sorted(asked) == list(range(len(points))) and np.array_equal(got, want)


def test_components_join_chains(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_tiling(spark, docs):
    item = " ".join(f"b{k}" for k in range(30))
    parts = item.split()
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    cases = spark.createDataFrame([
        (1, f"before {item.upper()}, after"), (2, " ".join(parts[15:] + ["x"] + parts[:15])), (3, " ".join(parts[:12])),
        (4, "b1, b2 b3"), (5, None), (6, " ".join(parts[:10] + ["y"] + parts[11:20] + ["z"] + parts[21:])), (7, "too short")], "doc_id long, text string")
    got = {r.doc_id: r for r in tiling.contaminated(cases, bench).collect()}
    assert set(got) == {1, 2, 6} and got[2].coverage == 1.0 and len(got[2].tiles) == 2
    assert got[6].coverage == pytest.approx(28 / 30)
    assert {r.doc_id for r in tiling.contaminated(cases, bench, block_bytes=20).collect()} == {1, 2, 6}
    # documents apart or together, and other types of item ids
    whole = {r.doc_id: r for r in tiling.contaminated(cases, bench.union(bench), seed_pairs=1).collect()}
    assert {i: (r.coverage, r.tiles) for i, r in whole.items()} == {i: (r.coverage, r.tiles) for i, r in got.items()}
    for kind in ("string", "int"):
        typed = tiling.contaminated(cases, bench.withColumn("item_id", F.col("item_id").cast(kind)))
        assert {(r.doc_id, str(r.item_id)) for r in typed.collect()} == {(1, "1"), (2, "1"), (6, "1")}
    assert tiling.contaminated(cases, bench.where("false")).count() == 0 == tiling.contaminated(docs, bench).count()


def plain_best_fit(sizes, lengths, costs, opened):
    """[room, opened size, held pieces] of each bin, piece by piece."""
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if not fits:
            cap = min((c for c in opened if c >= n), key=lambda c: (costs[c] / c, c))
            bins.append([cap, cap, []])
            fits = bins[-1:]
        best = min(fits, key=lambda b: (b[0], b[1], -len(b[2])))
        best[0] -= n
        best[2].append(n)
    return bins


def test_best_fit_over_counts_is_best_fit_by_piece():
    rng = np.random.default_rng(8)
    for turn in range(40):
        lengths = sorted({int(x) for x in rng.integers(3, 70, 3)} | {70})
        costs = {c: packing.attention_cost(c * 100) if turn % 2 else c + 9.0 for c in lengths}
        sizes = rng.integers(1, 71, int(rng.integers(1, 300))) if turn % 3 else rng.integers(1, 9, 200)
        counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
        for opened in (lengths, lengths[-1:], lengths[1:]):
            plain = plain_best_fit(sizes.tolist(), lengths, costs, opened)
            plan = packing.best_fit(counts, lengths, costs, opened)
            least = sum(min(costs[c] for c in lengths if c >= cap - room) for room, cap, _ in plain)
            assert plan.cost == pytest.approx(least)
        joint = packing.joint_plan(counts, lengths, costs).cost
        assert joint <= packing.best_fit(counts, lengths, costs, lengths).cost
    assert packing.joint_plan({}, [4], {4: 1.0}).cost == 0


def test_best_fit_against_the_optimum():
    rng, lengths = np.random.default_rng(4), (4, 8, 16)
    costs = {c: packing.attention_cost(512 * c // 4) for c in lengths}

    def least(left, bins):
        if not left:
            return sum(min(costs[c] for c in lengths if c >= b) for b in bins)
        n, rest = left[0], left[1:]
        grown = [bins[:k] + (b + n,) + bins[k + 1:] for k, b in enumerate(bins) if b + n <= 16]
        return min(least(rest, x) for x in [*grown, (*bins, n)])

    for _ in range(25):
        sizes = rng.integers(1, 17, 6).tolist()
        counts = {n: sizes.count(n) for n in sizes}
        best, got = least(tuple(sizes), ()), packing.joint_plan(counts, lengths, costs).cost
        assert best - 1e-9 <= got <= 1.25 * best


def packed_bins(got, lengths):
    bins = {}
    for r in got:
        if r.n_tokens:
            bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.n_tokens))
        else:
            assert r.bin_id is None
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), held in bins.items():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= length and not any(c >= end for c in lengths if c < length)
    return sorted(length for _, length in bins)


def test_packing(spark):
    sizes = [(k, n) for k, n in enumerate([0, None, 1, 5, 8, 8, 9, 20, 33, 3, 3, 2])] + [(3, 5), (None, 4)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").repartition(3)
    got = packing.pack(df, lengths=(4, 8, 16)).collect()
    packed_bins(got, (4, 8, 16))
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in sizes)
    assert sorted(r.start for r in got if r.doc_id == 8) == [0, 16, 32]
    assert packing.pack(df.where("false"), lengths=(4, 8, 16)).count() == 0


def test_packing_ignores_layout_and_hot_lengths(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 7, id * id % 40) n_tokens", "id piece_", "'x' bin")
    seen = [packed_bins(packing.pack(rows.repartition(n), lengths=(8, 16, 32)).collect(), (8, 16, 32)) for n in (1, 5, 40)]
    assert seen[0] == seen[1] == seen[2]


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0), [7], np.arange(128), rng.integers(0, 50_000, 1000), np.r_[np.full(300, 5), 2 ** 32 - 1, 0],
                rng.integers(0, 2 ** 32, 257), np.full(129, 2 ** 31)):
        ids = np.asarray(ids, dtype=np.uint32)
        data = token_file.encode_blocks(ids)
        assert (token_file.decode_blocks(data) == ids).all() and len(token_file.decode_blocks(data)) == len(ids)
        for k in range(-(-len(ids) // 128)):
            assert (token_file.read_block(data, k) == ids[128 * k:128 * k + 128]).all()


def test_token_file(spark, docs, rows, tmp_dir):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    odd = [(70, "J̌ Don't İ <|ENDOFTEXT|> <|endoftext|> a\x01b \x01 x. y... 3,4, É …. l'eau."), (71, "KELVIN Kİ ss.,")]
    every = [*rows, *odd]
    df = docs.unionByName(spark.createDataFrame([(i, t, "a", 1, "en") for i, t in odd], DOCS))
    for name, one in (("all", df), ("odd", df.where("doc_id >= 70")), ("none", df.where("false"))):
        token_file.write_tokens(one, f"{tmp_dir}/{name}", queries.tokenizer_path(), end_id=1, segment_tokens=100)
    want, start = [], 0
    for i, t in sorted(every, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_file.read_documents(spark, f"{tmp_dir}/all").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_file.read_documents(spark, f"{tmp_dir}/odd", ids=False).count() == 2
    assert token_file.read_documents(spark, f"{tmp_dir}/none").count() == 0


def test_archive(spark, tmp_dir):
    pages = [(1, "u1", "same"), (5, "u5", "same"), (3, None, "same"), (4, "u", None), (6, "u", ""), (7, "v", "é" * 5000), (7, "v", "é" * 5000), (8, "w", "x")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, key string")
    warc.write_archive(df, f"{tmp_dir}/a")
    got = warc.read_archive(spark, f"{tmp_dir}/a").withColumn("d", warc.base32(F.sha1("payload"))).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == sorted((i, h or "") for i, _, h in pages)
    assert all(r.d == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() for r in got)
    kind = sorted((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kind[:5] == [(1, "revisit", 5), (3, "revisit", 5), (4, "revisit", 6), (5, "response", None), (6, "response", None)]
    assert sorted(k[1:] for k in kind if k[0] == 7) == [("response", None), ("revisit", 7)]
    assert spark.read.parquet(f"{tmp_dir}/a/payloads").count() == 4
    head = next(bytes(r.header).decode() for r in got if r.page_id == 1)
    assert head.startswith("WARC/1.1\r\nWARC-Type: revisit\r\n") and head.endswith("\r\n\r\n") and "WARC-Refers-To: " in head
    warc.write_archive(df, f"{tmp_dir}/b", min_revisit_bytes=2)
    assert {r.page_id for r in warc.read_archive(spark, f"{tmp_dir}/b").where("record_type = 'revisit'").collect()} == {1, 3, 7}


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [1.0, None] + [0.0] * 22, 1), (7, x[7].tolist(), 1), (2100, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, salt int").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), k=10, bucket_points=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    recall = []
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == pytest.approx(d[m[1]], abs=1e-12) for m in mine)
        recall.append(len({m[1] for m in mine} & set(order)) / 10)
    assert np.mean(recall) >= 0.9 and set(m[1] for m in got[200]) == {*range(100, 110)}
    assert set(m[1] for m in got[100]) == {*range(101, 111)}  # equal queries share an answer but for their own row
    assert 2100 not in got and 2000 not in got
    twice = ann.nearest(df, df.where("vec_id = 7").union(df.where("vec_id = 9").withColumn("vec_id", F.lit(7).cast("long"))), k=5).collect()
    assert sorted(r["rank"] for r in twice) == [1, 2, 3, 4, 5] and 7 not in {r.vec_id for r in twice}
    assert ann.nearest(df.where("false"), df).count() == 0
    few = ann.nearest(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert len(few) == 3


def test_nearest_keeps_its_recall_on_larger_tables(spark):
    x = np.random.default_rng(8).normal(size=(8000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), k=10, tables=4, bucket_points=32).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d = ((x[::100, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2)
    d[np.arange(80), np.arange(0, 8000, 100)] = np.inf
    recall = np.mean([len(got[100 * i] & set(row[:10].tolist())) / 10 for i, row in enumerate(np.argsort(d, axis=1))])
    assert recall >= 0.93  # 4 tables x 8 probes x 32 points hold a tenth of the points at most


def test_nearest_sends_no_queries_to_the_driver(spark):
    x = np.random.default_rng(4).normal(size=(600, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    out = ann.nearest(df, df.where("vec_id % 10 = 0"), k=10, bucket_points=32)
    assert len(out.collect()) == 600
    plan = out._jdf.queryExecution().executedPlan()  # small enough that Spark's own threshold would broadcast each side
    assert "SortMergeJoin" in plan.toString() and "Broadcast" not in plan.toString()


def test_nearest_probes_are_the_first_of_all_pairs():
    unit = ann._unit(np.random.default_rng(6).normal(size=(50, 20)))
    unit[:10] = ann._unit(np.sign(unit[:10]))  # many equal distances
    signs = ann.rotations(20, 1, 3)
    (a, lost), (b, lost2) = (ann._ranked(ann.rotate(unit, s), 32, 64) for s in signs)
    loss = (lost[:, :, None] ** 2 + lost2[:, None, :] ** 2).reshape(50, -1)
    every = (a[:, :, None] * 64 + b[:, None, :]).reshape(50, -1)
    order = np.take_along_axis(every, np.argsort(loss, axis=1, kind="stable"), axis=1)
    for probes in (1, 8, 37, 64):
        assert (ann.codes(unit, 1, (32, 32), probes, 3) == order[:, :probes]).all()


def plain_base(text):
    out = []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return out


def test_personal_data(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("a.@1-+ 2%é(", k=60)) for _ in range(400)]
    texts += ["a@b@c.com x@y.z@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1", "4111 1111 1111 1111 and 4111111111111112", "+1 (736) 555-2678.", "1" * 5000, "@" * 3000]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t
    seeds = [(k, f"é pay card {n} now") for k, n in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "4222222222222220", "6011000990139424"] * 2)]
    more = [(20, "we pay card 4111111111111112 now"), (21, None), (22, ""), (23, "version 4.0. of 12345 things"), (24, "card 4111111111111112")]
    df = spark.createDataFrame([(i, t, 1) for i, t in seeds + more], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert len(got) == len(seeds + more)
    assert [(s.kind, s.start, s.end) for s in got[20].spans] == [("card", 12, 28)] and not got[20].base
    assert not got[23].spans and not got[21].spans and not got[22].spans and got[0].base == got[0].spans
    assert pii.masked("a 12 b", [{"kind": "ip", "start": 2, "end": 4}, {"kind": "card", "start": 3, "end": 4}]) == "a [IP] b"
    assert pii.find(df.where("false")).count() == 0


def test_personal_data_in_digit_groups(spark):
    texts = [f"please call +1 (017) 555-77{n} today" for n in range(20, 30)]
    texts += [f"we pay card {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} now" for c in
              ("4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424", "5105105105105100", "5555555555554444")]
    texts += ["please call (017) 555-7713 today", "we pay card 4111 1111 1111 1112 now", "the years 1998 1999 2000 2001 were fine", "call x (017) 555-7713)"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pii.find(df).collect()}
    found = [[(s.kind, texts[i][s.start:s.end]) for s in got[i].spans] for i in range(len(texts))]
    assert all(len(f) == 1 and got[i].base == got[i].spans for i, f in enumerate(found[:16]))
    assert not got[16].base and ("phone", "(017) 555-7713") in found[16]
    assert not got[17].base and ("card", "4111 1111 1111 1112") in found[17]
    assert not found[18]
    table = "card 4111 1111 1111 1112 " + "2020 " * 30 + "(017) 555-7713 today"
    assert {table[a:z] for a, z in pii.digit_runs(table, [])} >= {"4111 1111 1111 1112", "(017) 555-7713"}


def test_words_frequent_everywhere_are_no_context(spark):
    rng = random.Random(8)
    vocab = [a + b for a in ("ba", "du", "ki", "lo", "me") for b in ("n", "ra", "st", "vo", "zer", "t")]

    def card(good):
        digits = "".join(rng.choices("123456789", k=15))
        last = next(d for d in "0123456789" if pii.luhn(digits + d))
        return digits + (last if good else str((int(last) + 1) % 10))
    texts = []
    for i in range(400):
        w = [x for _ in range(30) for x in ("the", rng.choice(vocab))]
        if i % 4 == 0:  # chance neighbours of cards, and the words that introduce them
            at = 2 * rng.randrange(25) + 1
            w[at:at] = [card(i % 40 > 0)] if i % 8 else ["visa", card(i % 40 > 0), "expires"]
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = {r.word: r.n for r in pii.word_counts(df, "text").collect()}
    plain = {}
    for w in re.findall(r"[^\s.]+", " ".join(texts)):
        plain[w] = plain.get(w, 0) + 1
    assert {w: counts[k] for w, k in zip(plain, pii.word_keys(list(plain)))} == plain and len(counts) == len(plain)
    assert plain["the"] == 12000 and plain["visa"] == 50 and pii.word_keys(["", "a-b", "A-B"])[:1] == [0]
    parts = list(C.slices(pa.array(["ab", None, "", "abcdef", "a", "b"]), 3))
    assert [p.to_pylist() for p in parts] == [["ab", None, ""], ["abcdef"], ["a", "b"]]
    got = {r.doc_id: r for r in pii.find(df).collect()}
    added = {i for i, r in got.items() if len(r.spans) > len(r.base)}
    assert added == {i for i in range(0, 400, 40)}  # wrong check digits after "visa"; none after "the"
    kinds = {r["kind"]: r for r in pii.audit(df, hide=0.3).collect()}
    assert kinds["card"].hidden > 10 and kinds["card"].found == kinds["card"].right
    assert 0.3 < kinds["card"].right / kinds["card"].hidden < 0.7  # half of the cards stand after "visa"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    vocab = [a + b for a in ("ba", "du", "ki", "lo", "me") for b in ("n", "ra", "st", "vo", "zer", "t")]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(15, 60))]
        bad, toxic = i % 6 == 0, i % 5 == 1
        if bad:
            w = [x.upper() + "!!" for x in w[:8]] * 4
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["grubble", "grubbling", "snarfed"])
        text = " ".join(w[:10]) + ". " + " ".join(w[10:])
        docs.append((i, text, 1.0))
        if i % 2 or bad:
            labels.append((i, int(not bad), int(toxic), "x"))
    docs += [(None, "ban dura", 1.0), (1000, None, 1.0), (1001, "", 1.0), (5, docs[5][1], 1.0)]
    labels += [labels[3], (None, 1, 1, "x"), (1, None, None, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_quality(spark, labelled):
    docs, labels = labelled
    table = quality.feature_table(docs)
    got = quality.scores(table, quality.fit(table, labels)).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 6 != 0) for r in test]) > 0.97
    assert quality.scores(quality.feature_table(docs.where("false")), quality.fit(table, labels)).count() == 0
    blank = quality.fit(table, labels.where("false"))
    assert all(r.score == pytest.approx(0.5) for r in quality.scores(table, blank).collect())


def test_byte_classes_are_counted_as_one_by_one():
    texts = ["Ab c1\n.. !?|", "", None, "é#() '-/: \t_" * 3, "x" * 5000]
    got = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for j, members in enumerate(quality._CLASSES.values()):
            assert got[i, j] == pytest.approx((sum(b in set(members) for b in raw) / max(1, len(raw))) ** 0.5)


def test_quality_reaches_the_least_corrected_risk(spark, labelled):
    docs, labels = labelled
    table = quality.feature_table(docs)
    rows = [(r.id, np.array(r.x)) for r in table.where("not held_out").collect()]
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {None}
    x = np.array([v for _, v in rows], dtype=float)
    pos = np.array([i in good for i, _ in rows])
    for prior in (None, 0.6, 0.97):  # the last is too high: without correction the second part would fall below zero
        model = quality.fit(table, labels, prior=prior)
        if prior is None:
            assert 0.75 < model.prior < 0.92  # five of six texts are good
        u = np.c_[np.clip((x - model.mean) / model.scale, -6, 6), np.ones(len(x))]

        def risk(w):
            z = u @ w
            second = np.logaddexp(0, z).mean() - model.prior * np.logaddexp(0, z[pos]).mean()
            return model.prior * np.logaddexp(0, -z[pos]).mean() + max(0, second) + 0.01 * (w[:-1] ** 2).sum() / 2, second
        best, second = risk(model.weights)
        assert second >= -1e-9
        start = np.r_[np.zeros(u.shape[1] - 1), np.log(model.prior / (1 - model.prior))]
        assert best < risk(start)[0]
        if prior == 0.6:  # the second part stays above zero, so this is the least risk of all
            rng = np.random.default_rng(1)
            assert second > 0
            assert all(risk(model.weights + rng.normal(size=len(start)) * s)[0] > best - 1e-5 for s in (0.3, 0.1, 0.03, 0.01) for _ in range(20))
        z = u @ model.weights
        got = {i: s for i, s in zip([i for i, _ in rows], 1 / (1 + np.exp(-z)))}
        assert all(r.score == pytest.approx(got[r.doc_id]) for r in quality.scores(table, model).where("not held_out").collect())


def test_prior_from_histograms():
    rng = np.random.default_rng(5)
    good, bad = rng.beta(8, 2, 40_000), rng.beta(2, 8, 60_000)
    every, _ = np.histogram(np.r_[good, bad], 2000, (0, 1))
    known, _ = np.histogram(good[:5000], 2000, (0, 1))
    assert abs(quality._ratio(every.astype(float), known.astype(float)) - 0.4) < 0.03
    assert quality._ratio(known.astype(float), known.astype(float)) == 1 - 1e-3


def test_toxicity(spark, labelled):
    docs, labels = labelled
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 904 and by_id[1000].score == 0 == by_id[1001].score
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900 and r.doc_id % 6]
    assert np.mean([r.predicted == (r.doc_id % 5 == 1) for r in test]) > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    hits = [r for r in test if r.predicted and r.doc_id % 5 == 1]
    assert hits and all(re.search("grubbl|snarfed", texts[r.doc_id][s.start:s.end]) for r in hits for s in r.offending)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}


def test_pipeline_stages(spark, labelled, tmp_dir):
    docs, labels = labelled
    item = " ".join(f"q{k}" for k in range(20))
    texts = {r.doc_id: r.text for r in docs.where("doc_id in (1, 7)").collect()}
    back = " ".join(reversed(texts[7].split()))
    extra = [(2000, f"{texts[1]} {item} {texts[7]}", 1.0), (2001, f"{back} jo.do@example.com {back[:40]}", 1.0)]
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in extra], docs.schema)
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    kept = [spark.read.parquet(f"{tmp_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept[-1], tmp_dir)
        (out if k else out.unionByName(more)).write.parquet(f"{tmp_dir}/{k}")  # planted for the stages after the first
        kept.append(spark.read.parquet(f"{tmp_dir}/{k}"))
        assert kept[-1].columns == docs.columns
    good = {r.doc_id for r in kept[1].collect()}
    assert sum(i % 6 == 0 for i in good if i is not None and i < 900) < 10
    assert sum(i % 6 > 0 for i in good if i is not None and i < 900) > 740
    # one row of each linked group, and exactly the smallest id of each
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    root = linked([fingerprint(t) for _, t in rows], 4)
    assert kept[2].count() == len(set(root))
    third = {r.doc_id for r in kept[3].collect()}
    assert 2000 not in third and third == {r.doc_id for r in kept[2].collect()} - {2000}
    masked = kept[4].where("doc_id = 2001").first()
    assert f"{back} [EMAIL] {back[:40]}" == masked.text and masked.n_chars == len(masked.text)
    assert kept[4].count() == kept[3].count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[4], tmp_dir)
    assert {r.doc_id for r in packed.collect()} == third
    assert {r.doc_id for r in corpus_pipeline.run(spark, tmp_dir).collect()} <= good


def test_stages_keep_columns_of_any_name(spark, tmp_dir):
    item = " ".join(f"q{k}" for k in range(20))
    texts = [f"word{i} other{i} thing{i} mail jo{i}@example.com end{i}" for i in range(6)] + [item, None, "", None]
    names = ["_key", "__key", "_k", "_spans", "_found", "_found_key", "_hit", "_chosen", "id", "fp", "row", "spans", "base", "item",
             "component_id", "n_tokens", "x y", "a.b"]
    rows = [(i if i < 9 else None, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        out = stage(spark, docs, tmp_dir)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_dir}/{name}")
        docs = spark.read.parquet(f"{tmp_dir}/{name}")
    got = docs.collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 5, 7}  # the null and empty texts are one group
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert all("[EMAIL]" in r.text for r in got if r.doc_id < 6)
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, docs, tmp_dir).collect()} == {0, 1, 2, 3, 4, 5, 7}


def test_digit_runs_take_every_stretch_of_groups():
    rng = random.Random(3)
    for _ in range(60):
        groups = ["".join(rng.choices("0123456789", k=rng.randint(1, 6))) for _ in range(rng.randint(2, 14))]
        text, at = "total ", []
        for g in groups:
            at.append((len(text), len(text) + len(g)))
            text += g + rng.choice((" ", "-", ". ", "  "))
        text = text.rstrip(" .-") + " sum"
        want = {(at[i][0], at[k][1]) for i in range(len(at)) for k in range(i, len(at))
                if 9 <= sum(map(len, groups[i:k + 1])) <= 19}
        if at[-1][1] - at[0][0] >= 9:
            assert set(pii.digit_runs(text, [])) == want
    numbers = "row 111111 222222 4111 1111 1111 1112 333333 444444 end"
    assert "4111 1111 1111 1112" in {numbers[a:z] for a, z in pii.digit_runs(numbers, [])}
    far = "card" + " " * 500 + "4111111111111112"
    assert any("card <" in p for m in pii.mentions(far, []) for p in m[4])
    assert pii.mentions("x" * 100_000 + "@", []) != [] == pii.mentions("", [])


def test_toxic_words_are_counted_over_all_labelled_rows(spark):
    rng = random.Random(6)
    rows = [(int(k % 9 == 0), " ".join(rng.choices(["ab", "bc", "cd", "de"], k=6)) + (" vile" if k % 9 == 0 and k % 2 else "") + ". Fin") for k in range(400)]
    rows += [(1, None), (0, ""), (0, "...")]
    df = spark.createDataFrame(rows, "y int, text string").repartition(4)
    seen = toxicity.telling(df, 6, 5, 2)

    def weight(word):
        return toxicity.sentences(pa.array([word]))[0][0, 0]
    docs = {y: [set(re.findall(r"[a-z]+", (t or "").lower())) for label, t in rows if label == y and re.search("[a-zA-Z]", t or "")] for y in (0, 1)}
    for word in ("ab", "bc", "cd", "de", "vile", "fin"):
        clean, toxic = (sum(word in d for d in docs[y]) for y in (0, 1))
        n0, n1 = len(docs[0]), len(docs[1])
        both = (clean + toxic) / (n0 + n1)
        z = (toxic / n1 - clean / n0) / max(both * (1 - both) * (1 / n0 + 1 / n1), 1e-12) ** 0.5
        assert seen[weight(word)] == (z > 6 and toxic >= 5 and toxic / n1 >= 2 * clean / n0), word
    assert seen[weight("vile")] and not toxicity.telling(df.where("y = 0"), 6, 5, 2).any() and not toxicity.telling(df.where("false"), 6, 5, 2).any()


def test_bag_weights_lower_the_plain_risk():
    rng = np.random.default_rng(1)
    used = rng.integers(1, 40, (300, 1))
    of = np.sort(rng.integers(0, 80, 300))
    bag = np.arange(0, 80, 4)
    y = np.array([int((used[(of >= b) & (of < b + 4)] == 7).any()) for b in bag])

    def risk(w, b):  # mean over both labels of the noisy-or's log loss, document by document
        loss = {0: [], 1: []}
        for d, first in enumerate(bag):
            quiet = 1.0
            for s in range(first, first + 4):
                quiet *= 1 - 1 / (1 + np.exp(-(sum(w[used[of == s, 0]]) + b)))
            loss[y[d]].append(-np.log(max(1 - quiet if y[d] else quiet, 1e-12)))
        return np.mean(loss[0]) + np.mean(loss[1])
    w, b = toxicity.fit_bags(used, of, bag, 80, y, epochs=200)
    assert risk(w, b) < 0.3 * risk(np.zeros(toxicity.BUCKETS), -4.0)
    assert np.argmax(w) == 7
