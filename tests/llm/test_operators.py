"""Each operator against a brute-force version, an exact round trip or held-out accuracy; nulls, blanks, ties, repeats, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrublake.llm import common, language_id, media, mixing, near_dedup, pieces, reputation, sharding, substring_dedup, token_files, topk, webp

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("seed", range(6))
def test_webp_round_trips(seed):
    rng = np.random.default_rng(seed)
    w, h = int(rng.integers(1, 30)), int(rng.integers(1, 20))
    px = rng.integers(0, 1 << 32, w * h, dtype=np.uint32) if seed % 2 else rng.integers(0, 4, w * h).astype(np.uint32) * 0x01020304
    k = int(rng.integers(2, 6))
    n = -(-w >> k) * -(-h >> k)
    modes, factors = rng.integers(0, 16, n).astype(np.uint32) << 8, rng.integers(0, 1 << 32, n, dtype=np.uint32)
    table = np.unique(rng.integers(0, 1 << 32, [2, 3, 9, 17, 200, 256][seed], dtype=np.uint32))
    indexed = table[rng.integers(0, len(table), w * h)]
    cases = [(px, {}), (px, {"cache_bits": 5}), (px, {"transforms": [(webp.SUBTRACT_GREEN,)]}), (px, {"transforms": [(webp.PREDICTOR, k, modes)]})]
    cases += [(px, {"transforms": [(webp.CROSS_COLOUR, k, factors)]}), (indexed, {"transforms": [(webp.PALETTE, table)]}), (indexed, {"transforms": [(webp.PALETTE, table)], "cache_bits": 2})]
    cases.append((px, {"transforms": [(webp.PREDICTOR, k, modes), (webp.CROSS_COLOUR, k, factors), (webp.SUBTRACT_GREEN,)], "cache_bits": 4}))
    if w * h > 60:
        px2 = px.copy()
        px2[30:50] = px2[10:30]
        px2[50:60] = np.resize(px2[47:50], 10)
        cases += [(px2, {"copies": [(30, 20, 20), (50, 10, 3)]}), (px2, {"copies": [(30, 20, 20), (50, 10, 3)], "cache_bits": 6})]
    for p, options in cases:
        width, height, out = webp.decode(webp.encode(p, w, **options))
        assert (width, height) == (w, h) and (out == p).all(), options


def test_webp_meta_groups_and_errors():
    """Two groups of codes, written by hand: the left half is red, the right half blue."""
    w = webp.Writer()
    w.put(0x2F | 7 << 8 | 3 << 22 | 1 << 36, 40)
    w.put(0, 1)  # no transform
    w.put(0, 1)  # no colour cache
    w.put(1 | 0 << 1, 4)  # meta codes in blocks of 4
    webp._write_image(w, np.array([0, 1 << 8], np.uint32), 2, False)
    for red, blue in ((255, 0), (0, 255)):
        for value, size in ((0, 280), (red, 256), (blue, 256), (255, 256), (0, 40)):
            webp._write_code(w, {value: 1}, size)
    body = w.data()
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    _, _, px = webp.decode(data)
    assert px.reshape(4, 8).tolist() == [[0xFFFF0000] * 4 + [0xFF0000FF] * 4] * 4
    with pytest.raises(ValueError):
        webp.decode(b"RIFF0000WAVE")


def test_media(docs, empty):
    got = {(r.doc_id, r.payload_sha256): r for r in media.read_texts(media.store_texts(docs)).collect()}
    assert sum(1 for _ in texts(docs)) == media.read_texts(media.store_texts(docs)).count()
    for i, t in texts(docs):
        raw = (t or "").encode()
        p = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = got[i, hashlib.sha256(p).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(p), zlib.crc32(p[-32:]))
    assert media.read_texts(media.store_texts(empty)).count() == 0
    one = media.decode_media(media.store_texts(docs.where("doc_id = 8"))).first()
    assert one.images[0].width == 576 and bytes(x & 255 for x in one.images[0].pixels[:13]) == b"one two three"
    long = media.payload_of(b"ab" * (5 << 20))
    assert b"".join(p.astype(np.uint8).tobytes() for _, _, p in media.images(media.store(long))) == long


# ---------------------------------------------------------------- 2


def test_rules_and_reputation(spark, sf):
    got = {r.page_id: r for r in reputation.op2(spark, sf).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[1].rule, got[1].verdict) == ("example.org/en/1", "block")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("b.example.com", "/de/1", "com/de/", "block")
    assert (got[3].rule, got[4].rule, got[4].path) == ("com/fr/", None, "")
    assert [(got[i].host, got[i].path) for i in (5, 6, 7)] == [("", "")] * 3
    assert (got[8].host, got[10].host) == ("site.net:80", "b.c:")
    assert len(got) == 12 and {r.verdict for r in got.values()} <= {"allow", "block"}
    pages = spark.createDataFrame([(i, "h" if i < 100 else f"x{i}.net") for i in range(200)], "page_id long, host string")
    outcomes = spark.createDataFrame([(i, i < 100 or i % 10 == 0) for i in range(200)], "page_id long, bad boolean")
    hosts = {r.host: r for r in reputation.host_reputation(pages, outcomes).collect()}
    assert hosts["h"].mean > 0.9 and hosts["h"].doubt < 1e-9 and hosts["h"].pages == 100 and 0 < hosts["x150.net"].mean < 1 and hosts["x151.net"].mean < hosts["x150.net"].mean
    assert reputation.filter_urls(pages.select("page_id", F.lit("u").alias("url")).limit(0), outcomes).count() == 0


def test_posterior_bound(spark):
    """Against sums of binomial probabilities: P(Beta(a, b) <= x) is the chance of a successes or more in a + b - 1 trials."""
    cases = [(a, b) for a in (1, 2, 3, 7, 40, 300) for b in (1, 2, 5, 30, 90, 700)] + [(3_100, 6_900), (30_200, 70_000)]

    def expected(a, b, x):
        n = a + b - 1
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log(1 - x) for j in range(a, n + 1)]
        return math.fsum(math.exp(v) for v in logs)

    given = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double")
    for x in (0.3, 0.05, 0.8):
        for r in given.select("a", "b", reputation.beta_cdf(x, "a", "b").alias("p")).collect():
            assert abs(r.p - expected(int(r.a), int(r.b), x)) < 1e-8, (r, x)
    ends = spark.createDataFrame([(0.0, 2.0), (2.0, 0.0), (1e-3, 1e-3), (3e9, 7e9)], "a double, b double")
    none, all_, half, huge = (r.p for r in ends.select(reputation.beta_cdf(0.3, "a", "b").alias("p")).collect())
    assert (none, all_) == (1.0, 0.0) and abs(half - 0.5) < 1e-3 and abs(huge - 0.5) < 1e-3


def test_sites_under_longer_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk:80", "co.uk", "u@x.y.net.:8080", "10.0.0.1:80", "[::1]:443", "", "localhost", "me.github.io", "10.0.0.1.net"]
    name = reputation.name_of(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(reputation.registered_domain(name), reputation.suffix_of(name))
    assert rows(got) == [
        ("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.net", "net"), ("10.0.0.1", "ip"), ("[::1]", "ip"), ("", ""),
        ("localhost", "localhost"), ("me.github.io", "github.io"), ("1.net", "net"),
    ]


def test_reputation_against_sql(spark, sf):
    """The small tables, and pages of clashing names, repeated rows and a very long url, as DuckDB judges them."""
    import duckdb

    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    assert sorted(map(repr, rows(reputation.op2(spark, sf)))) == sorted(map(repr, db.execute(reputation.OP2_SQL).fetchall()))
    urls = ["http://h.co.uk/" + "x" * 200_000, "http://h.co.uk/a", "http://h.co.uk/a"]
    pages = spark.createDataFrame([(i // 2, u, "own", 1, "r") for i, u in enumerate(urls)], "page_id long, url string, host string, pages int, rule string")
    judged = reputation.filter_urls(pages, spark.createDataFrame([(0, True), (1, None)], "page_id long, bad boolean")).collect()
    assert sorted((r.page_id, len(r.path), r.host) for r in judged) == [(0, 2, "h.co.uk"), (0, 200_001, "h.co.uk"), (1, 2, "h.co.uk")]


# ---------------------------------------------------------------- 3


def test_top_k(spark, sf):
    v = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding):
            v[r.vec_id] = [int(np.floor(256 * float(np.float64(x)))) for x in r.embedding]
    expected = []
    for q in v:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q))[:5]
            expected += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert sorted(rows(topk.op3(spark, sf))) == sorted(expected)


def test_top_k_of_repeated_rows(spark, monkeypatch):
    """Equal rows are counted before the blocks are dealt, so that no block outgrows BLOCK, and each is a candidate."""
    built, most = topk._built, topk.BLOCK

    def bounded(leaf, loose):
        make = built(leaf, loose)

        def build(table):
            assert len(table) <= most
            return make(table)

        return build

    few = spark.range(60).select(F.col("id").alias("vec_id"), F.array("id", F.lit(40) - F.col("id")).alias("v"))
    many = few.union(spark.range(3 * most).select(F.lit(7).cast("long"), F.array(F.lit(7).cast("long"), F.lit(33).cast("long"))))
    monkeypatch.setattr(topk, "_built", bounded)
    v = [(i, (i, 40 - i)) for i in range(60)] + [(7, (7, 33))] * 6
    expected = []
    for q in range(0, 60, 7):
        best = sorted((-(x * a + y * b), c) for i, (x, y) in v if i == q for c, (a, b) in v if c != q)[:5]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(rows(topk.top_k(many, many.where("vec_id % 7 = 0"), 5))) == sorted(expected)


@pytest.mark.parametrize("block", [2048, 20])
def test_top_k_equals_sql_on_repeats(spark, monkeypatch, tmp_path, block):
    """Repeated rows, ids with several vectors, repeated queries: as many rows as SQL gives."""
    import duckdb

    for name, value in (("BLOCK", block), ("QUERY_BLOCK", max(2, block // 8)), ("CHUNK", 4), ("GROUP", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    data = [(int(i), rng.normal(size=6).tolist()) for i in rng.integers(0, 130, size=240)]
    data += data[:60] + [data[3]] * 9 + [(50, data[0][1]), (50, data[0][1]), (100, data[5][1]), (None, [1.0] * 6), (7, None)]
    spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = con.execute(f'select query_id, "rank", vec_id, score from ({topk.OP3_SQL})').fetchall()
    assert sorted(rows(topk.op3(spark, str(tmp_path)))) == sorted(expected) and len(expected) == 15


def test_bounds_by_angle_hold(spark):
    """Of long vectors with norms alike, angles rule out more than radii, and no pair is above its bound."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    x = np.repeat(centres, 40, axis=0) + rng.normal(size=(1200, 8)) * 0.05
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 256).astype(np.int64)
    block, queries = topk.Block(np.arange(1200), x), topk.Block(np.arange(0, 1200, 50), x[::50], topk.QUERY_LEAF, 2)
    search = topk.DualSearch(queries, block, 5)
    for a, (c, r, s, _, e, _) in enumerate(queries.nodes):
        for b, (rc, rr, rs, _, re_, _) in enumerate(block.nodes):
            bound = search._bound(queries.vectors[c], r, queries.norms[c], np.array([rc]), rr, queries.caps[a], np.array([block.caps[b]]))[0]
            assert (queries.vectors[s:e] @ block.vectors[rs:re_].T).max() <= bound
    assert search.computed < 1200 * 24 / 4


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 4)) * 500
    x = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(size=(360, 4)) * 5).astype(np.int64)
    x[100:140] = x[100]
    block = topk.Block(np.arange(360), x)
    for c, radius, start, _, end, _ in block.nodes:
        away = np.linalg.norm(block.vectors[start:end] - block.vectors[c], axis=1)
        assert away.max() <= radius + 1e-6
    assert sorted(block.ids.tolist()) == list(range(360)) and len(block.nodes) > 6
    found = topk.DualSearch(topk.Block(np.arange(0, 360, 7), x[::7], topk.QUERY_LEAF, 2), block, 3)
    for q, s, f in zip(found.q.ids, found.scores, found.found, strict=True):
        best = sorted((-int(x[q] @ x[c]), c) for c in range(360) if c != q)[:3]
        assert [(-a, b) for a, b in zip(s.tolist(), f.tolist(), strict=True)] == best
    assert found.computed < 360 * len(found.q.ids) / 2
    assert topk.inner(np.array([[1 << 40]]), np.array([[1 << 20]]))[0, 0] == 1 << 60


def clustered(n, groups, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 300
    return np.floor(centres[rng.integers(groups, size=n)] + rng.normal(size=(n, width)) * 6).astype(np.int64)


def test_few_queries_prune_most_scores():
    """One row in 50 as queries, 40 clusters: under a fifth of the scores are computed, in a first block and less in a second."""
    x = clustered(4000, 40, 16, 3)
    ids = np.arange(4000)
    queries = topk.Block(ids[::50], x[::50], topk.QUERY_LEAF, 2)
    first = topk.DualSearch(queries, topk.Block(ids[:2000], x[:2000]), 5)
    assert first.computed < 80 * 2000 / 5
    second = topk.DualSearch(queries, topk.Block(ids[2000:], x[2000:]), 5, first.scores[:, -1].copy())
    assert second.computed < 80 * 2000 / 5
    both = np.sort(np.concatenate([first.scores, second.scores], axis=1), axis=1)[:, :-6:-1]
    scores = x[queries.ids] @ x.T
    scores[np.arange(80), queries.ids] = topk.NONE
    assert (np.sort(scores, axis=1)[:, :-6:-1] == both).all()


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Many cells, split cells, a common vector; clashing columns and long vectors."""
    for name, value in (("BLOCK", 60), ("QUERY_BLOCK", 5), ("CHUNK", 3), ("GROUP", 2), ("MOST_PIVOTS", 8)):
        monkeypatch.setattr(topk, name, value)
    x = clustered(900, 12, 70, 4)
    x[::7] = x[3]
    data = [(i, v.tolist(), i, "own") for i, v in enumerate(x)] + [(900, [], 1, "own"), (950, None, 1, None), (None, [1], 1, None)]
    d = spark.createDataFrame(data, "vec_id long, v array<long>, block int, rank string")
    got = sorted(rows(topk.top_k(d, d.where("vec_id % 50 = 0"), 5)))
    want = []
    every = [(i, v) for i, v, *_ in data if i is not None and v is not None]
    for q, v in every:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for c, w in every if c != q)[:5]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert got == sorted(want)


# ---------------------------------------------------------------- 4


def test_pieces_equal_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = pieces.decode_pieces(pieces.encode_pieces(docs.select("doc_id", "text", "score"))).collect()
    for r in got:
        assert r.ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.ids)
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert len(got) == docs.count() and pieces.encode_pieces(empty).count() == 0 and pieces.round_trip(empty).count() == 0
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    both = Counter((r.doc_id, r.n_pieces, r.ids_crc32, r.decoded_crc32, r.same) for r in pieces.round_trip(docs).collect())
    assert both == Counter((r.doc_id, len(r.ids), crc(r.ids), zlib.crc32(r.decoded.encode()), r.decoded == (r.text or "")) for r in got)


def test_unigram_is_the_best_sum():
    v = object.__new__(pieces.Vocabulary)
    v.kind, v.bytes, v.unknown, v.unknown_score = pieces.UNIGRAM, {}, 0, -20.0
    v.scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "abc": -6.0, "c": -2.2, "bc": -3.1, "ca": -1.0}
    v.ids, v.longest = {p: i + 1 for i, p in enumerate(v.scores)}, 3
    words = sorted({"abc", "abca", "abcab", "cab", "ab", "a", "zab", "abz", "cccab"})

    def best(w):
        if not w:
            return 0.0, ()
        out = []
        for n in range(1, len(w) + 1):
            s = v.scores.get(w[:n], v.unknown_score if n == 1 else None)
            if s is not None:
                t, ids = best(w[n:])
                out.append((s + t, (v.ids.get(w[:n], 0), *ids)))
        return max(out)

    assert pieces.SharedPrefixViterbi(v).encode_sorted(words) == [best(w)[1] for w in words]


def test_unigram_reading_of_the_vocabulary(spark, sf, docs):
    """Best sums over all cuts, and the round trip, of every word of the documents."""
    codec = pieces.Codec(pieces.default_model(), kind=pieces.UNIGRAM)
    v = codec.v
    words = sorted({w for _, t in texts(docs) for w in v.word.findall(v.marked(t or ""))})

    def best_sum(w):
        sums = [0.0] + [-math.inf] * len(w)
        for j in range(len(w)):
            for i in range(j + 1, len(w) + 1):
                s = v.scores.get(w[j:i], v.unknown_score if i == j + 1 else -math.inf)
                sums[i] = max(sums[i], sums[j] + s)
        return sums[-1]

    spelt = {i: p for p, i in v.ids.items()}
    some = [w for w in words if all(c in v.ids for c in w)]
    for w, ids in zip(some, codec.viterbi.encode_sorted(some), strict=True):
        assert "".join(spelt[i] for i in ids) == w and abs(sum(v.scores[spelt[i]] for i in ids) - best_sum(w)) < 1e-9
    assert len(some) > 1000
    expected = Counter()
    for i, t in texts(docs):
        ids = codec.encode([t or ""])[0]
        expected[i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32((t or "").replace("▁", " ").encode()), "▁" not in (t or "")] += 1
    assert Counter(rows(pieces.unigram_pieces(spark, sf))) == expected


# ---------------------------------------------------------------- 5


def waterfilled(sizes, weights, most=3):
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(spark, docs, empty):
    d = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), F.lit("own").alias("target"))
    got = mixing.mixed_sources(d, block=4, seed=3).collect()
    assert len(got) == docs.count() and got[0]["target"] != "own"
    sizes = Counter()
    for r in d.collect():
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = waterfilled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size and r.copies <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 4 for s in order)
    again = mixing.mixed_sources(d.repartition(7), block=4, seed=3, buckets=5).collect()
    key = lambda r: (str(r.doc_id), r.size, r.source or "", r.taken)
    assert Counter(map(key, again)) == Counter(map(key, mixing.mixed_sources(d, block=4, seed=3, buckets=5).collect()))
    assert mixing.mixed_sources(empty.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0


def test_shards_take_their_quotas(spark):
    """Each shard takes its quota of each source, from consecutive words of the run."""
    d = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None, i % 9) for i in range(300)], "doc_id long, source string, size long")
    got = mixing.mixed_sources(d, block=4, shards=3, seed=3).collect()
    targets = mixing.source_targets(d)
    quotas = mixing.block_quotas(targets, 4, 3).join(targets.select("source_no", "source", "source_size"), "source_no").collect()
    assert all(sum(r.taken_by_shard) == r.taken and len(r.taken_by_shard) == 3 for r in got)
    for q in quotas:
        most = 3 * q.source_size
        words = sum(r.taken_by_shard[q.shard] for r in got if r.source == q.source)
        assert words == min(4 * q.seats, most) - min(4 * (q.seats - q.quota), most) > 0


def test_quotas_are_highest_quotients(spark):
    t = [700.0, 300.5, 120.25, 9.0, 0.0, 300.5]
    q = mixing.block_quotas(spark.createDataFrame(list(enumerate(t)), "source_no int, target double"), block=10, shards=3).collect()
    seats = -(-int(sum(t) * 4) // 40)
    for shard in range(3):
        end = seats * (shard + 1) // 3
        won = Counter(s for _, s in sorted((-x / (2 * j + 1), s) for s, x in enumerate(t) for j in range(seats) if x)[:end])
        assert {r.source_no: r.seats for r in q if r.shard == shard and r.seats} == dict(won)
    assert all(r.quota >= 0 for r in q)


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1009])
def test_permutation(spark, n):
    got = rows(spark.range(n).select("id", sharding.permuted(F.col("id"), n, seed=9)))
    assert sorted(p for _, p in got) == list(range(n)) and all(p == sharding.permuted_int(i, n, 9) for i, p in got)


def test_shards(spark, sf, empty):
    got = sharding.op6(spark, sf).collect()
    expected = Counter((r.doc_id, 16 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(got, key=str) == sorted(sharding.op6(spark, sf).collect(), key=str)
    # brute force: the sorted rows' places, one by one
    order = sorted(expected.elements(), key=lambda r: (r[0] is not None, r))
    places = Counter((*r, *divmod(sharding.permuted_int(i, len(order), 6), 40)) for i, r in enumerate(order))
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.slot, r.shard) for r in got) == places
    clash = spark.createDataFrame([(i, "own", "own", "own") for i in range(9)], "id long, row_no string, shard string, slot string")
    assert sorted(r.row_no for r in sharding.shard_rows(clash, ["id"], 4).collect()) == list(range(9))
    with pytest.raises(ValueError):
        sharding.shard_rows(clash, ["id", "slot"], 4)
    assert sharding.shard_rows(empty.select("doc_id"), ["doc_id"], 4).count() == 0


# ---------------------------------------------------------------- 7


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    segments, dictionary = token_files.write_tokens(docs)
    got = sorted(rows(token_files.read_tokens(segments, dictionary)), key=lambda r: r[1])
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in texts(docs)]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((i, len(x), crc(x)) for i, x in ids) == Counter((r[0], r[2], r[3]) for r in got)
    assert [r[0] if r[0] is not None else -1 for r in got] == sorted(r[0] if r[0] is not None else -1 for r in got)
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    s, raw = segments.orderBy("part", "place").first(), bytes(dictionary.first().dictionary)
    for i, x in enumerate(token_files.documents_of(s.content, raw)):
        assert (token_files.document_at(s.content, i, raw) == x).all()
    with pytest.raises(ValueError):
        list(token_files.documents_of(s.content, raw + b"x"))
    assert token_files.read_tokens(*token_files.write_tokens(empty)).count() == 0


TRICKY = [
    "a\x0bb", "It's  don't\t<|endoftext|> x<|startoftext|>y", "é \u0301x", "\xa0a\u2003b\x85c", "ΑΣ Σ", "", "x\x1cy", "İ", "ÉTÉ!! Haus.&&& h\u0331 H\u0331. dogs' ''s x'' naïve'", "w" * 3000 + " " + "Z." * 900,
    "a×b ÷ ªº µm, Ünï. Ø", "it's? we'LL. 12,5% (so) ... end",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_encoded_as_the_library_does(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    t, mine = Tokenizer.from_file(path), token_files.WordEncoder(path)
    texts = [*TRICKY, None, prose(5, 3000)]
    assert mine.by_word == mine.by_letters == (name == "word_bpe_49k.json")
    for part in (texts, texts[::-1], texts[:1], []):
        ids, at = mine.encode(pa.array(part, pa.string()), 1)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in part]
    assert all(len(w) <= 64 for w in mine.known.young)


def test_memory_is_bounded():
    m = common.Memory(100_000)
    for i in range(0, 50_000, 100):
        words = [b"w%d" % j for j in range(i, i + 100)] + [b"always", b"x" * 65]
        assert m.look(words, lambda ws: [w * 2 for w in ws]) == [w * 2 for w in words]
        assert b"always" in m.young | m.old and len(m.young) + len(m.old) < 600 and b"x" * 65 not in m.young


def test_token_files_of_many_documents(spark):
    import zstandard

    rows_ = [(i, prose(i, 40)) for i in range(700)]
    segments, dictionary = token_files.write_tokens(spark.createDataFrame(rows_, "doc_id long, text string"))
    again = token_files.write_tokens(spark.createDataFrame(rows_[::-1], "doc_id long, text string").repartition(5))[1]
    raw = bytes(dictionary.first().dictionary)
    assert raw == bytes(again.first().dictionary) and raw[:4] == b"\x37\xa4\x30\xec"  # trained: the format's magic number
    s = segments.orderBy("part", "place").first()
    n = len(s.doc_ids)
    offsets = np.frombuffer(s.content, "<u8", n + 1, 42)  # by hand, as another reader would
    frame = s.content[42 + 8 * (n + 1) :][offsets[3] : offsets[4]]
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompress(frame)
    assert plain == token_files.document_at(s.content, 3, raw).tobytes()
    assert len(segments.select("content").first()[0]) < 0.8 * sum(len(x) * 2 for x in token_files.documents_of(s.content, raw))


# ---------------------------------------------------------------- 8


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(pairs, k, percent=80):
    sets = defaultdict(list)
    for i, t in pairs:
        if i is not None:
            sets[i].append(shingles(t, k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in sets}


def test_near_duplicates(docs, empty):
    pairs = texts(docs)
    expected = brute_components(pairs, 4)
    got = near_dedup.near_duplicates(docs, shingle=4).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t, 4))) for i, t in pairs)
    assert all(r.component_id == expected[r.doc_id] and r.kept == (expected[r.doc_id] == r.doc_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_around_the_threshold(spark):
    """A large group whose members link with some of the others only, and chains of links."""
    import random

    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(80):
        w = list(base)
        for j in r.sample(range(60), r.choice([0, 1, 1, 2, 3])):
            w[j] = f"e{i}x{j}"
        out.append((i * 3 + 1, " ".join(w)))
    chain = [f"c{i}" for i in range(80)]
    out += [(1000 - i, " ".join(chain[i * 2 : i * 2 + 40])) for i in range(18)]
    expected = brute_components(out, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(out, "doc_id long, text string"), shingle=4).collect()
    assert {x.doc_id: x.component_id for x in got} == expected and len(set(expected.values())) > 3


def test_near_duplicates_of_repeated_rows(spark):
    """Ids around the threshold of a group, half of which have a second row of the same words."""
    import random

    r = random.Random(11)
    out = []
    for i in range(80):
        w = [f"w{j}" for j in range(60)]
        for j in r.sample(range(60), r.choice([1, 1, 2, 2, 3])):
            w[j] = f"e{i // 2}x{j}"
        out.append((i * 3 + 1, " ".join(w)))
    out += [(i, t.upper().replace(" ", "  ")) for i, t in out[1::2]] + [(i, t) for i, t in out[3::8]]
    expected = brute_components(out, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(out, "doc_id long, text string"), shingle=4).collect()
    assert {x.doc_id: x.component_id for x in got} == expected and len(set(expected.values())) > 3 and len(got) == len(out)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 5), (200, 201), (203, 201), (9, 9)]
    got = dict(rows(near_dedup.components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**dict.fromkeys([*range(31), 100], 0), **dict.fromkeys([200, 201, 203], 200)}


# ---------------------------------------------------------------- 9


def test_language_id(spark, docs, empty):
    german, english = "der die das und nicht mit über sein haben ein schöner Tag".split(), "the of and with not over have being a fine day".split()
    made = [(i, " ".join((german if i % 2 else english)[(i * 7 + j) % 11] for j in range(12)), ("en", "de")[i % 2]) for i in range(400)]
    d = spark.createDataFrame([*made, (900, None, "en"), (901, "123 !?", "de"), (902, "der Tag", None)], "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in d.collect())
    got = language_id.identify(d, language_id.train(d.where("not held_out"))).collect()
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got if r.doc_id < 400 and r.held_out)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id >= 900} == {900: "und", 901: "und", 902: "de"}
    none = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"} and language_id.identify(empty, none).count() == 0
    model = language_id.train(d)
    unseen = model.word("schönes")
    assert model.languages[int(unseen.argmax())] == "de" and model.word("the").argmax() == 1


def plain_language(learned, text):
    """The same model, spelt out for one text."""
    import math

    words = lambda t: [w for w in language_id.words_in(t or "")]
    langs = sorted({x for x, _ in learned})
    counts = [defaultdict(Counter) for _ in range(5)]
    for lang, t in learned:
        for w in words(t):
            counts[0][w][lang] += 1
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    if (g := f" {w} "[i : i + n]) != " ":
                        counts[n][g][lang] += 1
    totals = [{x: sum(c[x] for c in table.values()) for x in langs} for table in counts]

    def of(n, g):
        logs = [math.log(max(counts[n][g][x], 0.5)) - math.log(totals[n][x] + 1) for x in langs]
        return [v - sum(logs) / len(logs) for v in logs]

    def backed_off(g, n):
        if g in counts[n]:
            return [of(n, g)]
        return [] if n == 1 else backed_off(g[:-1], n - 1) + backed_off(g[1:], n - 1)

    def score(w):
        if w in counts[0]:
            return of(0, w)
        m = f" {w} "
        parts = [p for i in range(len(m) - 3) for p in backed_off(m[i : i + 4], 4)] if len(m) >= 4 else backed_off(m, len(m))
        return [sum(p[i] for p in parts) / max(1, len(parts)) for i in range(len(langs))]

    ws = words(text)
    if not ws:
        return "und", 0.0
    sums = [sum(x) * min(len(ws), 12) / len(ws) for x in zip(*map(score, ws))]
    best = max(range(len(langs)), key=lambda i: sums[i])
    return langs[best], 1 / sum(math.exp(v - sums[best]) for v in sums)


def test_language_id_equals_a_plain_model(spark, sf, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(r.lang, r.text) for r in docs.collect() if r.lang is not None and r.text is not None and not (r.doc_id is not None and held(r.doc_id))]
    want = Counter()
    known = {}
    for i, t in texts(docs):
        known[t] = known.get(t) or plain_language(learned, t)
        want[i, i is not None and held(i), known[t][0], round(known[t][1], 6)] += 1
    got = rows(language_id.op9(spark, sf))
    assert Counter((i, h, lang, round(x, 6)) for i, h, lang, x in got) == want
    clash = docs.withColumns({"lang_pred": F.lit("own"), "held_out": F.lit("own"), "n": F.lit(1)})
    assert language_id.identify(clash, language_id.train(clash)).columns == [*docs.columns, "held_out", "n", "lang_pred", "score"] or "score" in docs.columns


# ---------------------------------------------------------------- 10


def brute_removed(pairs, window):
    lists, own = [(i, WORD.findall(t or "")) for i, t in pairs], {}
    for i, w in lists:
        for j in range(len(w) - window + 1 if i is not None else 0):
            k = tuple(w[j : j + window])
            own[k] = min(own.get(k, i), i)
    out = []
    for i, w in lists:
        gone = set()
        for j in range(len(w) - window + 1 if i is not None else 0):
            if own[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_substring_dedup(docs, empty):
    docs = docs.withColumn("found", F.lit("own")).withColumn("owned", F.lit(1)).withColumn("_found0", F.lit(2))
    got = substring_dedup.remove_repeats(docs)
    assert set(docs.columns) - {"n_words"} <= set(got.columns)
    assert Counter(rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256"))) == Counter(brute_removed(texts(docs), 13))
    for r in got.collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == r.kept_sha256
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("words", [64, 1 << 16])
def test_substring_dedup_of_overlapping_passages(spark, monkeypatch, words):
    import random

    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", words)  # with few words, all shards are split
    monkeypatch.setattr(common, "HOT_ROWS", words // 8)
    r = random.Random(7)
    source = [f"v{r.randrange(30)}" for _ in range(120)]
    out = []
    for i in range(60):
        a, b = r.randrange(100), r.randrange(10, 40)
        out.append((r.randrange(40), " ".join([f"u{r.randrange(5)}" for _ in range(r.randrange(15))] + source[a : a + b] + [f"u{r.randrange(5)}" for _ in range(r.randrange(15))])))
    got = substring_dedup.remove_repeats(spark.createDataFrame(out, "doc_id long, text string"), texts=False)
    assert Counter(rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256"))) == Counter(brute_removed(out, 13))


def _contexts(n: int) -> list[tuple[int, str]]:
    """Documents with one phrase of four words, whose hash is the least of all runs in them, between words of which few repeat."""
    import random

    r = random.Random(11)
    some = [f"c{i}" for i in range(4000)]
    tried = [" ".join(r.sample(some, 4)) for _ in range(60000)]
    words, begins = common.words_of(*next((b, o) for _, _, b, o in common.text_buffers(pa.array([" ".join(tried)]))))
    runs = common.runs_of(words, substring_dedup.M, seed=31)[::4]
    phrase = tried[int(np.argmin(runs))]
    out = []
    for i in range(n):
        around = [f"a{r.randrange(10**9)}" for _ in range(24)]
        if i % 5 == 1:  # some share what comes before or after with the document before
            around = (before[:12] + around[12:]) if i % 2 else (around[:12] + before[12:])
        before = around
        out.append((i, " ".join([*around[:12], phrase, *around[12:]])))
    return out


def test_substring_dedup_of_a_hot_phrase(spark, monkeypatch):
    """A phrase in ever other contexts: right, and rows sent grow with the windows alone, not with the automata."""
    seen = {}
    spans = substring_dedup._spans
    for n in (500, 1000):
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 1 << 9)
        docs = _contexts(n)
        sent = spark.sparkContext.accumulator(0)

        def counted(window, sent=sent):
            inner = spans(window)

            def run(batches):
                for b in inner(batches):
                    sent.add(len(b))
                    yield b

            return run

        monkeypatch.setattr(substring_dedup, "_spans", counted)
        got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), texts=False)
        assert Counter(rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256"))) == Counter(brute_removed(docs, 13))
        assert got.where("n_removed > 0").count() > n // 10
        seen[n] = sent.value
    # a reference and a question for each window (16 a document) at most
    assert 0 < seen[1000] <= 2.2 * seen[500] and seen[1000] <= 2 * 16 * 1000, seen


def test_suffix_automaton():
    import random

    r = random.Random(1)
    a, b = [[r.randrange(3) for _ in range(60)] for _ in range(2)]
    m = substring_dedup.SuffixAutomaton()
    m.add(a, 7)
    m.add(b, 5)
    m.finish()
    q = [r.randrange(3) for _ in range(80)]
    has = lambda s: any(s == x[i : i + len(s)] for x in (a, b) for i in range(len(x)))
    for i, n in enumerate(m.matching(q)):
        assert has(q[i - n + 1 : i + 1]) and not (n <= i and has(q[i - n : i + 1]))
    windows = lambda x: {tuple(x[i : i + 4]) for i in range(len(x) - 3)}
    want = [5 if tuple(q[i : i + 4]) in windows(b) else 7 if tuple(q[i : i + 4]) in windows(a) else substring_dedup.NOBODY for i in range(len(q) - 3)]
    assert m.holders_of(q, 4) == want and len(set(want)) > 1


def test_skewed_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    big = spark.createDataFrame([(i % 3 if i < 40 else 0, i) for i in range(400)] + [(None, 1), (9, 9)], "k int, x int")
    small = spark.createDataFrame([(0, 374, "a"), (1, 13, "b"), (2, 13, None), (7, 0, "d")], "k int, n int, y string")
    assert Counter(rows(common.join_skewed(big, small, ["k"], "n"))) == Counter(rows(big.join(small.drop("n"), "k")))
