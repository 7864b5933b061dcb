"""The WebP encoder's choices, and queries over whole documents against their SQL."""

import duckdb
import numpy as np
import pytest

from scrublake.llm import media, mixing, sharding, webp

BLACK = np.uint32(webp.BLACK)


def grey(values) -> np.ndarray:
    return np.asarray(values).astype(np.uint32) % 256 * np.uint32(0x10101) | BLACK


def images() -> dict[str, tuple[np.ndarray, int, list[int], bool]]:
    """Pixels, width, the transforms that suit them, and whether a colour cache does."""
    r = np.random.default_rng(2)
    steps = r.integers(-2, 3, (64, 80))
    many = r.integers(0, 1 << 32, 3000, dtype=np.uint32)
    return {
        "noise": (grey(r.integers(0, 256, 4000)), 80, [webp.SUBTRACT_GREEN], False),
        "along": (grey(np.cumsum(steps.ravel())), 80, [webp.PREDICTOR, webp.SUBTRACT_GREEN], False),
        "down": (grey((np.cumsum(steps, axis=0) + r.integers(0, 256, 80)).ravel()), 80, [webp.PREDICTOR, webp.SUBTRACT_GREEN], False),
        "stripes": (grey(np.tile([7, 8, 9, 10], 900)), 30, [webp.PALETTE], False),
        "palette": (many[r.integers(0, 200, 4000)], 50, [webp.PALETTE], False),
        "cache": (many[r.integers(0, 900, 9000)], 90, [], True),
        "tinted": (grey(r.integers(0, 256, 4000)) + np.uint32(0x050009), 50, [webp.SUBTRACT_GREEN], False),
        "one": (np.array([0x01020304], np.uint32), 1, [webp.PALETTE], False),
    }


@pytest.mark.parametrize("name", images())
def test_transforms_are_chosen(name):
    px, width, kinds, cached = images()[name]
    transforms, cache = webp.chosen(px, width)
    if name != "one":  # any will do for one pixel
        assert [k for k, *_ in transforms] == kinds and bool(cache) == cached
    data = webp.smallest(px, width)
    w, h, out = webp.decode(data)
    assert (w, h) == (width, len(px) // width) and (out == px).all()
    assert len(data) <= len(webp.encode(px, width, [], copies=[])) + 16


@pytest.mark.parametrize("mode", [1, 2])
@pytest.mark.parametrize("width", [1, 2, 7, 40])
def test_one_mode_is_the_loop_in_one_step(mode, width):
    """Constant modes go along an axis at once; a mode block of another kind, out of the picture's way, takes the loop."""
    px = np.random.default_rng(width).integers(0, 1 << 32, 5 * width, dtype=np.uint32)
    modes = np.full(-(-width >> 2) * 2, mode << 8, np.uint32)
    fast = webp._predictor(px, width, modes, 2, -1)
    slow = webp._predictor(px, width, np.append(modes, np.uint32(0)), 2, -1)
    assert (fast == slow).all() and (webp._predictor(fast, width, modes, 2, 1) == px).all()


@pytest.mark.parametrize(("colours", "least"), [(1, 5900), (3, 600), (200, 2600), (60_000, 2600), (1 << 32, 2600)])
def test_matches_stood_before(colours, least):
    """With few colours short runs stand everywhere, and the nearest of them breaks long stretches."""
    r = np.random.default_rng(colours)
    px = r.integers(0, colours, 6000, dtype=np.uint64).astype(np.uint32)
    px[2000:3000], px[4000:5200], px[5300:5900] = px[500:1500], px[1900:3100], px[5290]
    found, done = webp.matches(px), 0
    for at, length, dist in found:
        assert at >= done and dist <= at and all(px[i] == px[i - dist] for i in range(at, at + length)) and 1 <= length <= 4096
        done = at + length
    assert sum(length for _, length, _ in found) > least and webp.matches(px[:1]) == []
    width = 60
    assert (webp.decode(webp.encode(px, width))[2] == px).all()


def test_repeats_take_little_room():
    text = bytes(np.random.default_rng(0).integers(32, 120, 5760).astype(np.uint8))
    once, thrice = len(media.store(text)), len(media.store(text * 3))
    assert thrice < once + 64 and len(media.store(b"ab" * 288 * 9)) < 100


@pytest.mark.parametrize(("query", "sql"), [(mixing.op5, mixing.OP5_SQL), (sharding.op6, sharding.OP6_SQL), (media.webp_pixels, media.WEBP_PIXELS_SQL)])
def test_same_as_sql(spark, sf, query, sql):
    """Nulls, empty texts, repeated rows and a text of 40,000 words are among the documents."""
    got = query(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    expected = con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
    shown = lambda rows: sorted("|".join(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(map(tuple, got.collect())) == shown(expected)


def test_pixels_of_no_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert media.webp_pixels(spark, str(tmp_path)).count() == 0


def test_rows_without_an_id_are_spread(spark):
    """Ids that are null don't make one place of the ring, and the sizes of all rows are taken as often as the quotas say."""
    rows = [(None, "a", i % 300) for i in range(3000)]
    got = mixing.mixed_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"), seed=5, buckets=64)
    total = sum(s for _, _, s in rows)
    assert abs(sum(r.taken for r in got.collect()) - total) <= mixing.BLOCK
    keys = spark.createDataFrame(rows, "doc_id long, source string, size long").select(mixing.seeded(mixing.F.coalesce("doc_id", -1 - mixing.F.col("size")), 5).alias("k"))
    assert keys.distinct().count() >= 299


def test_back_references_over_the_end_of_a_window(monkeypatch):
    """The decoder looks at so many bits at once; a window may end with a back-reference that reaches past it."""
    r = np.random.default_rng(5)
    px = grey(np.concatenate([r.integers(0, 256, 300), *(r.permutation(np.tile(r.integers(0, 256, 40), 3)) for _ in range(40))]))
    px = np.concatenate([px, *(px[at : at + 60] for at in r.integers(0, 4000, 40))])
    px = px[: len(px) // 60 * 60]
    data = webp.encode(px, 60)
    for bits in range(40, 2000, 8):
        monkeypatch.setattr(webp, "_STEP", bits)
        assert (webp.decode(data)[2] == px).all()


def test_media_are_written_in_slices():
    """Many short texts, or few long ones, in one go; a long one alone."""
    import pyarrow as pa

    n = media.SLICE_BYTES
    of = lambda sizes: list(media._slices(pa.array([None if k is None else "x" * k for k in sizes], pa.string())))
    assert of([1] * 600) == [(0, 256), (256, 512), (512, 600)] and of([]) == [] and of([None]) == [(0, 1)]
    assert of([5, n, 3, None, n - 3, 1]) == [(0, 1), (1, 2), (2, 5), (5, 6)]


def test_pixels_are_digested_in_pieces():
    import hashlib

    px = np.random.default_rng(3).integers(0, 1 << 32, (1 << 16) + 7, dtype=np.uint32)
    assert media.pixels_sha256(px) == hashlib.sha256(",".join(map(str, px.view(np.int32).tolist())).encode()).hexdigest()
