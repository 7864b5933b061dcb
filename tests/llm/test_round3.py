"""Conversation prefix trie, SimHash near-dedup and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scrublake.llm import infill, near_dedup, prefix_trie, simhash, substring_dedup, webp

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- 11


def conversations() -> list[tuple]:
    """Shared beginnings, copies, nulls in every column, repeated rows, a turn that is a beginning of another, a long conversation."""
    r = random.Random(3)
    rows = []
    for c in [*range(0, 64), 100, 101, 119, 140, 141, 142, 150]:
        if c in (20, 33):
            continue
        n = r.randrange(0, 5)
        rows += [(c, t, ("user", "assistant")[t % 2], f"turn {r.randrange(3)}\tof  {t}", "x", 1) for t in range(n)]
    for c in range(200, 210):
        rows += [(c, t, "user", f"copied {t}", None, 2) for t in range(9)]
    rows += [(207, 9, "user", "and one more", None, 2), (300, None, None, "null turn", "y", 0), (300, 1, "user", None, "y", 0), (300, 0, "", "", "y", 0), (None, 1, "user", "no id", None, 0)]
    rows += [(301, 5, "user", "same place"), (301, 5, "user", "same place"), (301, 5, "user", "other place"), (None, None, None, None), (302, 1, "us", "erbody"), (303, 1, "user", "body")]
    rows += [(400, t, "user", prose(t, 3)) for t in range(150)] + [(401, 0, "user", prose(0, 3))]
    return [(*x, None, None)[:6] for x in rows]


def trie_of(rows: list[tuple]) -> set:
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((t is not None, t or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    again = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in again.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(again[c]) == len(p)).encode()).hexdigest()
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, ends))
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURN = "conv_id long, turn long, role string, text string, words string, level int"


@pytest.mark.parametrize("piece", [4096, 3])
def test_prefix_trie(spark, monkeypatch, tmp_path, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = conversations()
    spark.createDataFrame(rows, TURN).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = [tuple(x) for x in prefix_trie.op11(spark, str(tmp_path)).select(NODE).collect()]
    assert len(out) == len(set(out)) and set(out) == trie_of(rows)


def test_prefix_trie_without_conversations(spark):
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(*prefix_trie.ordered_turns(spark.createDataFrame([], TURN)))).count() == 0
    turnless = prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, depth long, key binary, words long"), spark.createDataFrame([(7, 0), (5, 0)], "conv_id long, n_turns long"))
    assert [tuple(x) for x in turnless.select(NODE).collect()] == [(5, 0, None, 2, 0, 1, 0, hashlib.sha256(b"5,7").hexdigest())]


# ---------------------------------------------------------------- 12


def fingerprint_of(text: str | None) -> int:
    words = [w.encode().lower() for w in WORD.findall(text or "")]
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def connected(of: dict, linked) -> dict:
    root = {i: i for i in of}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(of)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in of}


def test_simhash(spark, docs, empty):
    assert simhash.near_duplicates(empty).count() == 0
    r = random.Random(1)
    words = prose(9, 400).split()
    near = [(1000 + i, " ".join(words[:200] + [f"w{r.randrange(9)}"] + words[201:])) for i in range(12)] + [(1100, "a B c"), (1101, "A b C"), (1102, "a  b\tc"), (1103, "é É")]
    rows = [(x.doc_id, x.text) for x in docs.collect()] + near
    out = [tuple(x) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).repartition(4)).collect()]
    fps = defaultdict(set)
    for i, t in rows:
        if i is not None:
            fps[i].add(fingerprint_of(t))
    component = connected(fps, lambda a, b: any((x ^ y).bit_count() <= 2 for x in fps[a] for y in fps[b]))
    assert sorted(out, key=str) == sorted(((i, f"{fingerprint_of(t):016x}", component.get(i)) for i, t in rows), key=str)


@pytest.mark.parametrize("small", [32, 2, 1])
def test_fingerprints_meet(spark, monkeypatch, small):
    """Random fingerprints and chains of others one to three bits away, in small buckets and in large ones: all links are kept."""
    monkeypatch.setattr(simhash, "SMALL", small)
    r = random.Random(small)
    fps = {r.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:20]:
        for _ in range(12):
            for _ in range(r.randrange(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    pairs = {(p.a, p.b) for p in simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert all((a ^ b & (1 << 64) - 1).bit_count() <= 2 or ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in pairs)
    same = {x: x for x in signed}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    assert connected(same, lambda a, b: (min(a, b), max(a, b)) in pairs) == connected(same, near)
    if small == 32:
        assert {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and near(a, b)} == pairs


def test_segments_cover_the_ring():
    assert sum(simhash.segment(i) for i in range(simhash.SEGMENTS)) == (1 << 64) - 1
    assert simhash.MOST * simhash.CHAIN < simhash.SEGMENTS <= simhash.MOST * (simhash.CHAIN + 1)


# ---------------------------------------------------------------- 13


def cut_of(doc_id, text: str | None) -> tuple:
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        form, out, sizes = "plain", text, (None, None)
    elif h[3] % 100 < 50:
        form, out, sizes = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, sizes = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    return (doc_id, len(units), form, *sizes, out, text)


def test_fill_in_middle(spark, docs, empty):
    assert infill.restore(infill.fill_in_middle(empty)).count() == 0
    r = random.Random(4)
    more = [(500 + i, "".join(r.choice(["\n", "é", "🙂\n", "a\r\n", "word ", "<P", ">", "<", "<M"]) for _ in range(r.randrange(40)))) for i in range(200)]
    more += [(800, "a<S>\nb"), (801, "\n"), (802, "\n\n\n"), (803, "no newline"), (804, "last without\nnewline"), (805, "x\n" * 50_000), (None, "of no one\nat all\n")]
    d = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).withColumns({"form": F.lit(3), "output": F.lit(None), "n": F.lit("own")})
    out = infill.restore(infill.fill_in_middle(d))
    assert out.columns == ["doc_id", "text", "lang", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = [(x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.restored) for x in out.collect()]
    assert sorted(got, key=str) == sorted((cut_of(x.doc_id, x.text) for x in d.select("doc_id", "text").collect()), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_rates(spark, docs):
    forms = lambda **o: {x.form for x in infill.fill_in_middle(docs.where("length(text) > 0 and doc_id < 40 and not contains(text, '<')"), **o).select("form").distinct().collect()}
    assert forms(rate=0) == {"plain"} and forms(spm=0) == {"psm"} and forms(spm=100) == {"spm"} and len(forms(rate=50)) == 3


@pytest.mark.parametrize("width", [1, 2, 3, 64, 1000])
def test_place_of_a_bit(width):
    bits = random.Random(width).getrandbits(width) | 1
    places = [i for i in range(width) if bits >> i & 1]
    assert [infill.place_of(bits, width, k) for k in range(len(places) + 1)] == [*places, width]


def test_star_steps_are_small_plans(spark, monkeypatch):
    """Each table that a star step writes comes from a plan of few aggregates and joins, as every exchange costs the driver a stage of as many tasks as partitions."""
    operators, kept = [], near_dedup.materialize

    def counted(df, *args):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        operators.append(plan.count("HashAggregate") + plan.count("Join"))
        return kept(df, *args)

    monkeypatch.setattr(near_dedup, "materialize", counted)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(100, 101), (7, 100)]
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["component"] for r in got} == {1} and sorted(r["doc_id"] for r in got) == [*range(1, 41), *range(100, 130)]
    assert max(operators) <= 5


def test_single_symbol_codes_and_copies():
    """A code of one symbol is told without its lengths; values cross words of 64 bits at any place, and copies stand at their first pixels."""
    assert webp.Code.single(7).read(webp.Bits(b"")) == 7
    w, want = webp.Writer(), []
    w.put(0x1FFFFFFFFFFFFFFFFFF, 73)
    want += [1] * 73
    for n in (63, 1, 0, 62, 5, 63, 0):
        w.put_many(np.array([(1 << n) - 1, 0], np.int64), np.array([n, 3], np.int64))
        want += [1] * n + [0] * 3
    assert np.unpackbits(np.frombuffer(w.data(), np.uint8), bitorder="little")[: len(want)].tolist() == want
    px = np.tile(np.arange(40, dtype=np.uint32) << np.uint32(8) | np.uint32(webp.BLACK), 6)
    copies = [(40, 40, 40), (80, 100, 80), (190, 50, 40)]
    assert (webp.decode(webp.encode(px, 24, copies=copies))[2] == px).all()


def test_only_cut_texts_are_segmented_again(monkeypatch):
    """Documents of which nothing was found aren't hashed a second time."""
    seen, kept = [], substring_dedup.words_of
    monkeypatch.setattr(substring_dedup, "words_of", lambda buf, offsets, **k: seen.append(len(offsets) - 1) or kept(buf, offsets, **k))
    words = [f"w{i}" for i in range(40)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": [1, 2, 3, 4], "text": [" ".join(words), " ".join(reversed(words)), None, " ".join(words)],
        "found": pa.array([None, None, None, None], pa.list_(pa.struct([("content", pa.int64()), ("gone", pa.list_(pa.int64()))]))),
    })
    _, _, _, _, (_, _, _, content, _) = next(substring_dedup._each(batch.slice(3), 13))
    seen.clear()
    found = [None, None, None, [{"content": int(c), "gone": substring_dedup.ALL} for c in content.view(np.int64)]]
    batch = batch.set_column(2, "found", pa.array(found, batch.column("found").type))
    (out,) = substring_dedup._cut(13, False, "found")(iter([batch]))
    assert out.column("n_removed").to_pylist() == [0, 0, 0, 40] and out.column("n_words").to_pylist() == [40, 40, 0, 40]
    assert sum(seen) == 1
