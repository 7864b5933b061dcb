"""Pixels against plain loops, face passes, models that fail, layouts, overlays, payloads, memories, tab streams, metrics."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrublake import queries_frames as Q
from scrublake.functions import boxes as G
from scrublake.functions import tables
from scrublake.operators import images, merge, models, vision
from scrublake.plans import detect
from scrublake.queries import prefilter
from scrublake.sources import inventory, memory, pages
from scrublake.streaming import detect as stream
from scrublake.streaming import metrics, tabs

IMAGE = "frame_id long, width int, height int, rgba binary"


def half_up(x):
    return math.floor(x + 0.5)


def plain_resample(px, x, y, w, h, tw, th):
    """px[row][column] of four values; one target pixel after another."""
    out = []
    for j in range(th):
        row = []
        for i in range(tw):
            fx, fy = min(max((i + 0.5) * (w / tw) - 0.5, 0), w - 1), min(max((j + 0.5) * (h / th) - 0.5, 0), h - 1)
            x0, y0 = math.floor(fx), math.floor(fy)
            x1, y1, t, u = min(x0 + 1, w - 1), min(y0 + 1, h - 1), fx - x0, fy - y0
            row.append([half_up((px[y + y0][x + x0][c] * (1 - t) + px[y + y0][x + x1][c] * t) * (1 - u) + (px[y + y1][x + x0][c] * (1 - t) + px[y + y1][x + x1][c] * t) * u) for c in range(4)])
        out.append(row)
    return out


def plain_tensor(px, region, size):
    H, W = len(px), len(px[0])
    x, y = max(0, min(W - 1, half_up(region[0]))), max(0, min(H - 1, half_up(region[1])))
    w, h = max(1, min(W - x, half_up(region[2]))), max(1, min(H - y, half_up(region[3])))
    scale = min(size / w, size / h)
    left, top, dw, dh = half_up((size - w * scale) / 2), half_up((size - h * scale) / 2), half_up(w * scale), half_up(h * scale)
    drawn = plain_resample(px, x, y, w, h, dw, dh) if dw and dh else []
    out = []
    for c in range(3):
        for j in range(size):
            for i in range(size):
                inside = drawn and 0 <= i - left < dw and 0 <= j - top < dh
                p = drawn[j - top][i - left] if inside else None
                out.append(half_up((p[c] * p[3] + 128 * (255 - p[3])) / 255) if inside else 128)
    return out


def some_images(n, seed):
    r = random.Random(seed)
    sizes = [(r.randrange(1, 14), r.randrange(1, 14)) for _ in range(n)] + [(1, 1), (60, 1), (1, 60), (300, 2)]
    return [(i, w, h, bytearray(r.randrange(256) for _ in range(4 * w * h)), (r.uniform(-3, w), r.uniform(-3, h), r.uniform(0, 2 * w), r.uniform(0, 2 * h))) for i, (w, h) in enumerate(sizes)]


@pytest.mark.parametrize("size", [7, 16])
def test_tensors_equal_plain_loops(spark, size):
    rows = some_images(20, size)
    bad = [(900, 2, 2, bytearray(3), (0.0, 0.0, 1.0, 1.0)), (901, None, 2, bytearray(16), None), (902, 0, 0, bytearray(0), (0.0, 0.0, 1.0, 1.0)), (903, 2, 2, None, (0.0, 0.0, 1.0, 1.0))]
    d = spark.createDataFrame(rows + bad, IMAGE + ", region struct<left:double,top:double,width:double,height:double>").repartition(3)
    got = {r.frame_id: r for r in images.letterboxed(d, size).collect()}
    for i, w, h, raw, region in rows:
        px = np.frombuffer(bytes(raw), np.uint8).reshape(h, w, 4).tolist()
        assert [round(v * 255) for v in got[i].tensor] == plain_tensor(px, region, size), i
        assert got[i].letterbox.scale == min(size / got[i].letterbox.source.width, size / got[i].letterbox.source.height)
    assert all(got[i].tensor is None for i in (900, 901, 902, 903))
    flat = {r.frame_id: r.tensor for r in images.cropped(d, 5, 3).collect()}
    for i, w, h, raw, _ in rows:
        p = plain_resample(np.frombuffer(bytes(raw), np.uint8).reshape(h, w, 4).tolist(), 0, 0, w, h, 5, 3)
        assert [round(v * 255) for v in flat[i]] == [p[j][k][c] for c in range(3) for j in range(3) for k in range(5)]
    assert images.letterboxed(spark.createDataFrame([], IMAGE), size).count() == 0


@pytest.mark.parametrize("scale", [1.0, 2.0, 0.5, None])
def test_readable_equals_plain_loops(spark, scale):
    rows = [x[:4] for x in some_images(12, 5) if x[1] * x[2] < 200]
    got = {r.frame_id: r for r in images.readable(spark.createDataFrame(rows, IMAGE), asked=F.lit(scale).cast("double"), edge=20.0).collect()}
    for i, w, h, raw in rows:
        s = scale or max(0.5, min(4, 20 / max(w, h, 1)))
        tw, th = max(1, half_up(w * s)), max(1, half_up(h * s))
        p = [v for row in plain_resample(np.frombuffer(bytes(raw), np.uint8).reshape(h, w, 4).tolist(), 0, 0, w, h, tw, th) for v in row]
        luma = [a * 299 + b * 587 + c * 114 for a, b, c, _ in p]
        counts, upto, low, high = [0] * 256, 0, None, None
        for y in luma:
            counts[y // 1000] += 1
        for v in range(256):
            upto += counts[v]
            low = v if low is None and upto >= len(p) * 0.02 else low
            high = v if high is None and upto >= len(p) * 0.98 else high
        out = bytearray()
        for y in luma:
            v = round(min(255.0, max(0.0, (round(y / 1000) - low) * (255 / max(1, high - low)))))
            out += bytes([v, v, v, 255])
        assert (got[i].width, got[i].height, got[i].low, got[i].high, bytes(got[i].rgba)) == (tw, th, low, high, bytes(out)), i


def test_read_scale(spark):
    asked = [0.0, -1.0, float("nan"), float("inf"), None, 0.1, 3.0, 9.0]
    d = spark.createDataFrame([(a,) for a in asked], "a double").select(G.read_scale(F.col("a"), F.lit(0.0), F.lit(0.0)).alias("s"), G.read_scale(F.col("a"), F.lit(2000.0), F.lit(10.0)).alias("t"))
    assert [tuple(r) for r in d.collect()] == [(4.0, 1.4)] * 5 + [(0.5, 0.5), (3.0, 3.0), (4.0, 4.0)]


def test_faces_of_all_passes(spark):
    """A face seen in a crop, a tile and the frame is one; the crop's row stays as it comes first among equals; padding and small ones go."""
    frames = spark.createDataFrame([(1, 800.0, 400.0, 400.0, 200.0)], "frame_id long, width double, height double, vp_width double, vp_height double")
    box = "bbox struct<left:double,top:double,width:double,height:double>"
    e = spark.createDataFrame([(1, 4, "a", "div", "img", "", {}, (10.0, 10.0, 50.0, 50.0)), (1, 5, "b", "div", "img", "", {}, (0.0, 0.0, 7.0, 7.0))], f"frame_id long, el_idx int, id string, tag_name string, role string, selector string, attributes map<string,string>, {box}")
    regions = vision.face_regions(frames, e)
    at = {(r.pass_no, r.region_no): tuple(r.bbox) for r in regions.collect()}
    assert at[0, 4] == (20.0, 20.0, 100.0, 100.0) and (0, 5) not in at and at[2, 0] == (0.0, 0.0, 800.0, 400.0) and at[1, 0] == (0.0, 0.0, 384.0, 384.0)
    raw = [(0, 4, 0, 0.0, 0.0, 1.0, 1.0, 0.9), (1, 0, 0, 20 / 384, 20 / 384, 120 / 384, 120 / 384, 0.9), (2, 0, 0, 20 / 800, 0.25 + 20 / 800, 120 / 800, 0.25 + 120 / 800, 0.8)]
    raw += [(2, 0, 1, 0.0, 0.0, 1.0, 0.2, 0.99), (2, 0, 2, 0.5, 0.5, 0.51, 0.51, 0.99), (2, 0, 3, 0.6, 0.4, 0.7, 0.5, 0.49), (2, 0, 4, 0.6, 0.4, float("nan"), 0.5, 0.9), (2, 0, 5, 0.6, 0.4, 0.8, 0.6, 0.5004)]
    rows = spark.createDataFrame([(1, *x) for x in raw], "frame_id long, pass_no int, region_no long, face_no int, x0 double, y0 double, x1 double, y1 double, score double")
    got = sorted((r.pass_no, r.face_no, r.score, *r.bbox) for r in vision.merged_faces(frames, regions, rows).collect())
    assert got == [(0, 0, 0.9, 10.0, 10.0, 50.0, 50.0), (2, 5, 0.5, 240.0, 60.0, 80.0, 80.0)]
    assert vision.merged_faces(frames, regions, rows.where("pass_no = 1")).count() == 1  # the other passes failed
    assert vision.merged_faces(frames, regions, rows.limit(0)).count() == 0


def test_models_fail_alone(spark):
    frames = spark.createDataFrame([(i, [0.5, -1.0]) for i in range(30)], "frame_id long, v array<float>").repartition(3)
    hosted = models.host(frames, [models.Model("faces", Q._faces), models.Model("objects", Q._objects), models.Model("absent", Q._absent, ("cpu",))], Q._MODEL_ROWS)
    rows = hosted.collect()
    told = {(r.frame_id, r.model): (r.status, r.provider, r.error) for r in rows if r.kind == "status"}
    assert len(told) == 90 and sum(r.kind == "status" for r in rows) == 90
    assert told[1, "faces"] == ("done", "cpu", None) and told[7, "objects"] == ("failed", "gpu", "frame can't be read") and told[8, "objects"] == ("done", "gpu", None)
    assert told[3, "absent"] == ("missing", None, "cpu: weights are missing")
    assert sum(r.kind == "row" and r.model == "objects" for r in rows) == 25 and sum(r.kind == "row" and r.model == "faces" for r in rows) == 30
    runs = {r.frame_id: r for r in models.runs(hosted).collect()}
    assert runs[7].models_failed == ["objects"] and runs[7].models_used == ["faces", "objects"] and runs[7].n_rows == 1 and runs[7].error is None
    none = models.runs(models.host(frames, [models.Model("absent", Q._absent)], Q._MODEL_ROWS)).first()
    assert none.error == "No model could be loaded." and none.statuses[0].loaded is False and none.n_rows == 0
    assert models.host(frames.limit(0), [models.Model("faces", Q._faces)], Q._MODEL_ROWS).count() == 0


def test_a_session_is_made_once_in_a_worker():
    made = []
    model = models.Model("m", lambda provider: made.append(provider) or (lambda frames: frames), ("a",), key="once")
    assert models.session(model) is models.session(model) and made == ["a"]


def test_css_names():
    cases = {"a:b": "a\\:b", "1a": "\\31 a", "-1": "-\\31 ", "-": "\\-", "--": "--", "x'y": "x\\'y", "\x01": "\\1 ", "\x7f": "\\7f ", "\0": "�", "é_-9": "é_-9", "a b": "a\\ b", "-a1": "-a1", "": ""}
    assert {k: pages.css_escaped(k) for k in cases} == cases
    page = pages.Page("<body><p id='a:b'>x<p id=twice>y<p id=twice>z<input name=\"x'y\"><div><input name=q></div><input name=q>")
    at = lambda tag: [page.selector(n) for n in page.nodes if n.tag == tag]
    assert at("p") == ["#a\\:b", "body:nth-of-type(1) > p:nth-of-type(2)", "body:nth-of-type(1) > p:nth-of-type(3)"]
    assert at("input")[0].endswith('input[name="x\\\'y"]') and at("input")[1].endswith('div:nth-of-type(1) > input[name="q"]') and at("input")[2] == "body:nth-of-type(1) > input:nth-of-type(1)"


def test_deep_and_wide_pages():
    began = time.process_time()
    deep = pages.Page("<body>" + "<div> \n" * 4000 + "call 212-555-1234" + "</div>" * 4000)
    assert {deep.seen_text(n, 300) for n in deep.nodes} == {"call 212-555-1234"} and sum(n.inside for n in deep.nodes) == 0
    assert deep.xpath(deep.nodes[-1]).count("div[1]") == 4000
    nested = pages.Page("<body>" + "<p><button>" + "<div>" * 2000 + "<input name=a>")
    assert [n.inside for n in nested.nodes if n.tag == "button"] == [1]
    wide = pages.Page("<table>" + "<tr><td>a<td>b" * 5000)
    assert wide.seen_text(wide.nodes[0], 10).startswith("a b a b")
    assert time.process_time() - began < 5


def test_text_around_hidden_parts():
    page = pages.Page("<body>A<div hidden>no <i>no</i>\n</div>B<span style='visibility:hidden'>c</span>D<script>x()</script><b>E</b><div></div>F</body>")
    assert page.seen_text(page.nodes[0], 300) == "A BDE F"
    assert page.seen_text(next(n for n in page.nodes if n.tag == "i"), 300) == "no"


OVER = "<body><div id='kw-detection-overlay-root'><a>own</a><p>a@b.co</p></div><a id=z>zero</a><a id=o>out</a><a id=h style='opacity: 0'>clear</a><a id=v>seen</a><p>mail c@d.io</p><p>mail c@d.io</p>"


def test_visibility_by_layout(spark):
    d = spark.createDataFrame([(1, "u", OVER)], "page_id long, url string, html string")
    rows = [("/html[1]", 0, 0, 0, 0)] + [(f"/body[1]/a[{i}]", *b) for i, b in enumerate([(5, 5, 0, 9), (5, 900.6, 10, 9), (5.5, 6.4, 10, 9), (7, 8, 10.5, 9)], 1)] + [("/body[1]/p[1]", 0, 1000, 10, 10), ("/body[1]/p[2]", 0, 10, 10, 10)]
    layout = spark.createDataFrame([(1, p, *map(float, b)) for p, *b in rows], "page_id long, xpath string, left double, top double, width double, height double")
    views = spark.createDataFrame([(1, 500.0, None, None)], "page_id long, width double, height double, device_pixel_ratio double")
    got = [(r.id, r.reason, r.details) for r in pages.candidates(d, layout=layout, viewports=views).orderBy("el_idx").collect()]
    assert got == [
        ("kw-el-0", "EXTENSION_OVERLAY", "Belongs to extension overlay"), ("z", "ZERO_DIMENSIONS", "width=0, height=9"), ("o", "OUT_OF_VIEWPORT", "top=901, bottom=910, vh=800"),
        ("h", "CSS_HIDDEN", "display=inline, visibility=visible, opacity=0"), ("v", None, None),
    ]
    assert [(r.id, tuple(r.bbox)) for r in pages.elements(d, layout=layout, viewports=views).collect()] == [("v", (7.0, 8.0, 11.0, 9.0))]
    # the first of the equal texts is out of view, so the second is taken; the overlay's own never
    assert [(r.text, r.bbox.top) for r in pages.static_nodes(d, prefilter, layout=layout, viewports=views).collect()] == [("mail c@d.io", 10.0)]
    plain = {r.id: (r.reason, r.details) for r in pages.candidates(d).collect()}
    assert plain["kw-el-0"][0] == "EXTENSION_OVERLAY" and plain["h"] == ("CSS_HIDDEN", "display=inline, visibility=visible, opacity=0") and plain["z"] == (None, None)
    assert pages.elements(d, overlays=()).count() == 4 and pages.skipped(d).count() == 2


def test_one_parse_for_a_scan(spark):
    d = spark.createDataFrame([(1, "u", "<input type=password name=p value=x><input name=m value='me@x.org'><p>call 212-555-1234<p>call 212-555-1234<a href=q>card 4111 1111 1111 1111</a>"), (2, "v", None)], "page_id long, url string, html string")
    found = detect.scan_rows(pages.taken(pages.judged(pages.rows(d)), prefilter))
    none = lambda x: x.withColumn("bbox", F.lit(None).cast(merge.BOX))
    apart = detect.scan(none(pages.elements(d)), none(pages.static_nodes(d, prefilter)))
    assert sorted(map(str, found.collect())) == sorted(map(str, apart.collect())) and found.count() == 5  # the second field's text and value are told apart, as boxes are unknown
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_overlay_layers(spark):
    v = spark.createDataFrame([(1, 0, "face", 0.945, (-5.0, 3.0, 9.0, 4.0)), (1, 1, "card", None, (1.0, 1.0, -4.0, 9.0)), (1, 2, "person", 0.5, (float("nan"), 1.0, 4.0, 9.0)), (1, 3, "person", 0.5, (1.0, 1.0, 0.5, 9.0))], f"frame_id long, vision_no int, label string, score double, bbox {merge.BOX}")
    p = spark.createDataFrame([(1, 0, "EMAIL", "someone@x.org", "DOM", ["DOM", "OCR"], (-2.0, 1.0, 0.0, 0.0)), (1, 1, "NAME", "Al", "OCR", None, (2.0, 1.0, 5.0, 5.0))], f"page_id long, det_no int, type string, text string, source string, sources array<string>, bbox {merge.BOX}")
    w = spark.range(310).select(F.lit(1).cast("long").alias("frame_id"), F.col("id").alias("token_no"), F.lit("w" * 30).alias("text"), G.box(F.lit(1.0), F.lit(1.0), F.when(F.col("id") == 5, 0.9).otherwise(4.0), F.lit(2.0)).cast(merge.BOX).alias("bbox"))
    rows = detect.overlay_layers(v, p, w)
    got = {(r.layer, r.no): (r.style, r.solid, r.label, r.left, r.top, r.width, r.height) for r in rows.where("layer <> 'ocr' or no in (0, 5)").collect()}
    assert got == {
        ("vision", 0): ("face", True, "FACE 95%", 0.0, 3.0, 4.0, 4.0), ("vision", 1): ("default", True, "CARD 0%", 0.0, 1.0, 1.0, 9.0), ("pii", 0): ("person", True, "EMAIL · DOM+OCR · someon…", 0.0, 1.0, 1.0, 1.0),
        ("pii", 1): ("pii", False, "NAME · OCR · Al…", 2.0, 1.0, 5.0, 5.0), ("ocr", 0): ("ocr", True, "w" * 22, 1.0, 1.0, 4.0, 2.0),
    }
    assert tuple(detect.overlay_counts(rows).first()) == (1, 1, 1, 2, 299)
    assert {r.layer for r in detect.overlay_layers(v, p, w, {"ocr": False, "pii": True}).collect()} == {"vision", "pii"}


def test_payload(spark):
    d = spark.createDataFrame([(1, "u", "<input name=m value='me@x.org'><p>call 212-555-1234"), (2, "v", "<p>nothing")], "page_id long, url string, html string")
    none = lambda x: x.withColumn("bbox", F.lit(None).cast(merge.BOX))
    e, s = none(pages.elements(d)), none(pages.static_nodes(d, prefilter))
    words = spark.createDataFrame([(1, 1, "b", 81.0), (1, 0, "a", 90.0)], "frame_id long, token_no long, text string, confidence double")
    lines = spark.createDataFrame([(1, 0, "a b"), (1, 1, "")], "frame_id long, line_no int, text string")
    seen = spark.createDataFrame([(1, 0, "face"), (1, 1, "card")], "frame_id long, vision_no int, label string")
    views = spark.createDataFrame([(1, 9.0, 8.0, 2.0)], "page_id long, width double, height double, device_pixel_ratio double")
    got = {r.page_id: r for r in detect.payload(d.drop("html"), e, detect.scan(e, s), s, words, lines, seen, views).collect()}
    one, two = got[1], got[2]
    assert one.elements[0].attributes == {"name": "m", "value": "me@x.org"} and [w.text for w in one.words] == ["a", "b"] and tuple(one.viewport) == (9.0, 8.0, 2.0)
    assert tuple(one.ocr_meta) == ("done", 2, 2, "a b", 86.0, None) and tuple(one.vision_meta) == (1, 1, None) and tuple(one.pii_meta) == (4, 3, 3, 0, 0, 0)
    assert two.elements == [] and tuple(two.pii_meta) == (0, 0, 0, 0, 0, 0) and two.viewport is None
    alone = detect.payload(d.drop("html"), e, detect.scan(e)).where("page_id = 1").first()
    assert alone.words is None and alone.ocr_meta.status == "error" and alone.vision_meta.error.startswith("The vision stage")


def test_locale_order(spark):
    paths = ["b/x", "B/x", "a-b", "a_b", "ab", "é", "e", "f", "Z", "a/b", "a.b", "a b", "10", "9"]
    d = spark.createDataFrame([(p,) for p in paths * 2], "rel string").repartition(5)
    got = [r.rel for r in inventory.ranked(d).orderBy("rank").collect()]
    order = [r.rel for r in d.orderBy(F.collate("rel", "UNICODE"), "rel").collect()]
    assert got == order and got.index("e") < got.index("é") < got.index("f") < got.index("Z") and got.index("b/x") < got.index("B/x") < got.index("e")
    assert sorted(r["rank"] for r in inventory.ranked(d).collect()) == list(range(1, 29)) and inventory.ranked(d.limit(0)).count() == 0


def plain_block(text, begin, end):
    """One line after another."""
    import re

    fence, start, body = None, False, []
    for line in re.split(r"\r?\n", text):
        m = re.match(r"^ {0,3}(`{3,})", line)
        if m:
            if fence is None:
                fence = m[1]
            elif len(m[1]) >= len(fence) and not line[len(m[1]) :].strip():
                fence = None
            continue
        if fence is not None:
            continue
        if not start:
            start = line.strip() == begin
        elif line.strip() == end:
            return body
        else:
            body.append(line)
    return body


def test_blocks_outside_fences(spark):
    r = random.Random(8)
    texts = ["\n".join(r.choice(["B", " B ", "E", "x", "```", "````", "```ts", "   ```", "    ```", "`````  ", "", "y`", "B\r", "E \r"]) for _ in range(r.randrange(40))) for _ in range(300)]
    got = {}
    for x in memory.block(memory.text_lines(spark.createDataFrame(list(enumerate(texts)), "project int, text string").repartition(4)), "B", "E").orderBy("project", "line_no").collect():
        got.setdefault(x.project, []).append(x.value)
    assert got == {i: b for i, t in enumerate(texts) if (b := plain_block(t, "B", "E"))}


def test_memories_round_trip(spark):
    contents = ["plain", "```\n<!-- MANIFEST:BEGIN -->\nno\n```", "a\r\nb````", "", None, "<!-- MANIFEST:END -->", "x" * 130_000]
    rows = [(i % 2, f"d/{n} {i}.ts", len(c or ""), f"{i:064x}", i == 5, c) for i, (c, n) in enumerate(zip(contents, "aBcDeFg", strict=True))]
    files = spark.createDataFrame(rows, "project int, rel string, size long, sha256 string, binary boolean, content string")
    out = memory.write_memories(memory.memory_lines(files))
    assert [(r.project, r.verbatim) for r in out.orderBy("project").collect()] == [(0, True), (1, True)]
    assert sorted(map(tuple, memory.previous_state(out).collect())) == sorted((p, rel, sha) for p, rel, _, sha, _, _ in rows)
    text = out.where("project = 0").first().text
    assert text.startswith("<!-- MANIFEST:BEGIN -->\n" + "0" * 64 + "  d/a 0.ts\n") and "````ts" not in text.split("d/c 2.ts`")[0] and "`````ts\na\r\nb````\n`````" in text


def test_tab_contexts(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    files = [[(1, 10, at(5), "a"), (2, 11, at(5), "b")], [(1, 10, at(5), "a"), (1, 9, at(4), "late"), (None, 1, at(1), "x")], [(1, 12, at(9), "c"), (1, 13, at(9), None), (3, 14, at(1), "d")]]
    schema = "tab_id long, event_id long, ts string, event string"
    for f in files:
        spark.createDataFrame(f, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read by their times
    kind = spark.read.parquet(f"{tmp_path}/in").schema
    tabs.write_contexts(stream.read(spark, f"{tmp_path}/in", kind, 1), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = tabs.last_contexts(spark.read.schema(f"{tabs.CONTEXT}, batch long").parquet(f"{tmp_path}/out")).orderBy("tab_id").collect()
    assert [(r.tab_id, r.event_id, r.event, r.n_read, r.n_dropped) for r in got] == [(1, 13, "", 3, 2), (2, 11, "b", 1, 0), (3, 14, "d", 1, 0)]


def test_metrics(spark, tmp_path):
    d = spark.createDataFrame([("DOM", ["DOM", "OCR"], 0.9), ("OCR", None, 0.7)], "source string, sources array<string>, confidence double")
    rows, seen = metrics.metered(d, metrics.scan_metrics(), "pii")
    rows.write.parquet(f"{tmp_path}/pii")
    s = metrics.status(spark, "pii", seen).first()
    assert s.status == "done" and s.metrics == {"flagged_count": 2.0, "dom_flagged_count": 1.0, "ocr_flagged_count": 1.0, "ocr_matched_count": 2.0, "corroborated_count": 1.0, "mean_confidence": 0.8}
    assert metrics.status(spark, "vision", None, "no model").first().error == "no model"
    spark.createDataFrame([("a", 90.0), ("bcd", 70.0)], "text string, confidence double").repartition(2).write.parquet(f"{tmp_path}/w")
    meter = metrics.Meter()
    spark.streams.addListener(meter)
    try:
        words = stream.read(spark, f"{tmp_path}/w", "text string, confidence double").observe("words", *metrics.word_metrics())
        stream.write(words, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
        assert meter.ended.wait(30)
        assert [(n, m["token_count"], m["n_chars"], m["mean_confidence"]) for _, _, n, m in meter.rows if m["token_count"]] == [("words", 2, 4, 80.0)] and not meter.errors
    finally:
        spark.streams.removeListener(meter)


def test_numbers_in_order(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert all(r.x == r.n for r in tables.numbered(d, [F.col("x")], "n").collect())
