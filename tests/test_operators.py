"""Merging, sanitising, boxes, lines, pages, inventories, streaming."""

import random
import time

from pyspark.sql import functions as F

from scrublake.functions import boxes as G
from scrublake.operators import lines, merge, sanitize, vision
from scrublake.plans import detect
from scrublake.queries import _fixture_detections, _on_grid, prefilter
from scrublake.sources import inventory, pages
from scrublake.streaming import detect as stream

SANITIZED = [
    ("a@b.co 212-555-1234 api_key=ABCDEFGHIJKLMNOPQR 10.0.0.1 127.0.0.1 c@d.io", "[REDACTED_EMAIL_1] [REDACTED_PHONE_3] api_key=[REDACTED_SECRET_KEY] [REDACTED_IP_5] 127.0.0.1 [REDACTED_EMAIL_2]", 5),
    ("card 4785380592391139 end", "card [REDACTED_PHONE_1]139 end", 1), ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 'token = "[REDACTED_SECRET_KEY]"', 1),
    ("bearer: aaaaaaaa1234567890bbbbbb", "bearer: aaaaaaaa[REDACTED_PHONE_1]bbbbbb", 1), ("ip 999.1.1.1", "ip [REDACTED_IP_1]", 1), ("", "", 0), (None, "", 0), ("a@b.co", "[REDACTED_EMAIL_1]", 1),
]


def test_sanitize(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(SANITIZED)], "i int, text string")
    got = sanitize.sanitize(d).orderBy("i").collect()
    assert [(r.sanitized, r.masked_count) for r in got] == [(s, n) for _, s, n in SANITIZED]
    assert got[0].entities == ["Email (b.co)", "Email (d.io)", "Phone Number", "Secret / API Key", "IP Address"] and len(got[0].all_entities) == 5


def test_routes_and_tabs(spark):
    d = spark.createDataFrame([("Summarize this",), ("check my BRIEF",), ("is it secure?",), ("hello",), (None,)], "p string")
    assert [r[0] for r in d.select(sanitize.route(F.col("p"))).collect()] == ["SUMMARIZE_LOCAL", "SUMMARIZE_LOCAL", "ANALYZE_SECURITY", "SANITIZE_PII", "SANITIZE_PII"]
    tabs = [
        (1, 0, "about:x", True, False), (1, 1, "http://a", False, False), (1, 2, "https://b", True, False), (2, 0, "about:y", True, True), (2, 1, "http://c", True, False),
        (3, 0, None, True, None), (4, 0, "http://d", False, True), (4, 1, None, None, None),
    ]
    tabs = spark.createDataFrame([(*t[:3], f"t{t[1]}", *t[3:]) for t in tabs], "session_id int, tab_no int, url string, title string, active boolean, focused boolean")
    got = {r.session_id: (r.tab_no, r.title, r.url) for r in sanitize.active_tab(tabs).collect()}
    assert got == {1: (2, "t2", "https://b"), 2: (0, "t0", "about:y"), 3: (0, "t0", None), 4: (None, "No active tab", "about:blank")}


def test_inputs_and_views(spark):
    p = spark.createDataFrame([(1, "<input><INPUT type=hidden><p>input</p><select></select>"), (2, "<p>x"), (3, None)], "page_id long, html string")
    assert sorted((r.page_id, r.field_count) for r in pages.count_inputs(p).collect()) == [(1, 2), (2, 0), (3, 0)]
    found = spark.createDataFrame([("OCR", None), ("OCR", []), ("DOM", ["DOM", "OCR"]), ("DOM", ["DOM"])], "source string, sources array<string>")
    assert [merge.view(found, v).count() for v in ("ocr", "ocr_only", "dom", "corroborated")] == [3, 2, 2, 1]
    text = "write to a.b@x.org now or call 212-555-1234 please"
    box = dict.fromkeys(("left", "top"), 0.0) | dict.fromkeys(("width", "height"), 1e6)
    node = spark.createDataFrame([(1, 0, box, "body", text)], f"page_id long, node_idx int, bbox {merge.BOX}, selector string, text string")
    words = _on_grid(spark.createDataFrame([(1, text)], "frame_id long, text string"))
    both = detect.scan(static_nodes=node, words=words).collect()
    assert sorted((r.type, r.text, tuple(r.sources)) for r in both) == [("EMAIL", "a.b@x.org", ("DOM", "OCR")), ("PHONE", "212-555-1234", ("DOM", "OCR"))]


def test_merge(spark):
    m = merge.merge_sources(_fixture_detections(spark)).orderBy("page_id", "det_no").collect()
    assert [(r.page_id, r.id, r.source, r.sources, r.confidence) for r in m] == [
        (1, "d0", "DOM", ["DOM", "OCR"], 0.97), (1, "d1", "DOM", ["DOM"], 0.99), (1, "o1", "OCR", ["OCR"], 0.88), (2, "d2", "DOM", ["DOM", "OCR"], 0.96), (2, "o3", "OCR", ["OCR"], 0.72), (2, "d3", "DOM", ["DOM"], 0.86),
    ]
    again = merge.merge_sources(spark.createDataFrame(m, merge.merge_sources(_fixture_detections(spark)).schema)).orderBy("page_id", "det_no").collect()
    assert again == m
    s = merge.summarize(merge.merge_sources(_fixture_detections(spark))).first()
    assert tuple(s) == (6, 4, 2, 4, 2)
    assert merge.view(merge.merge_sources(_fixture_detections(spark)), "ocr_only").count() == 2
    labels = [r.label for r in detect.overlay(merge.merge_sources(_fixture_detections(spark))).collect()]
    assert all(any(x.endswith(f" · {v}…") for x in labels) for v in ("john.d", "Ann Le"))


def py_iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return 0.0 if w <= 0 or h <= 0 else w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_suppression(spark):
    r = random.Random(3)
    data = [(i // 20, i % 20, (r.randrange(50) * 1.0, r.randrange(50) * 1.0, 30.0, 20.0), r.randrange(10) / 10, r.choice("ab")) for i in range(200)]
    d = spark.createDataFrame(data, "frame int, box_no int, bbox struct<left:double,top:double,width:double,height:double>, score double, kind string")
    kept = {(x.frame, x.box_no) for x in vision.suppress(d, "frame", "kind", "score", 0.4).collect()}
    expected = set()
    for f in range(10):
        mine = []
        for x in sorted((x for x in data if x[0] == f), key=lambda x: (-x[3], x[1])):
            if not any(y[4] == x[4] and py_iou(y[2], x[2]) > 0.4 for y in mine):
                mine.append(x)
        expected |= {(x[0], x[1]) for x in mine}
    assert kept == expected


def test_boxes(spark):
    b = lambda *v: G.box(*(F.lit(float(x)) for x in v))
    r = spark.range(1).select(
        G.overlap_ratio(b(0, 0, 10, 10), b(5, 5, 5, 5)).alias("o"), G.overlap_ratio(b(0, 0, 0, 10), b(0, 0, 5, 5)).alias("z"), G.viewport_box(b(-3.5, 2.5, 10, 200), F.lit(100.0), F.lit(50.0)).alias("v"),
        G.letterbox(b(0, 0, 200, 100), 100.0).alias("l"), G.unletterboxed(*(F.lit(x) for x in (0.0, 0.25, 1.0, 0.75)), b(10, 20, 200, 100), 100.0).alias("u"),
        G.unletterboxed(*(F.lit(x) for x in (0.0, 0.0, 1.0, 0.2)), b(10, 20, 200, 100), 100.0).alias("none"), G.axis_positions(F.lit(1000.0), 384.0, 288.0).alias("a"), G.read_scale(F.lit(None).cast("double"), F.lit(10.0), F.lit(20.0)).alias("s"),
    ).first()
    assert (r.o, r.z, tuple(r.v), tuple(r.l), tuple(r.u), r.none) == (1.0, 0.0, (0.0, 3.0, 7.0, 47.0), (0.5, 0.0, 25.0, 100.0, 50.0), (10.0, 20.0, 200.0, 100.0), None)
    assert r.a == [0.0, 288.0, 576.0, 616.0] and r.s == 4.0
    frames = spark.createDataFrame([(1, 1920.0, 1080.0), (2, 100.0, 100.0)], "frame_id int, width double, height double")
    t = vision.tiles(frames, 384.0, 0.25).collect()
    assert sum(1 for x in t if x.frame_id == 1) == 24 and [tuple(x.bbox) for x in t if x.frame_id == 2] == [(0.0, 0.0, 100.0, 100.0)]


def test_lines(spark):
    words = [(1, 0, "98765", 0, 10, 40, 12, 90.0), (1, 1, "43210", 48, 12, 40, 12, 80.0), (1, 2, "x", 90, 10, 8, 12, 70.0), (1, 3, "below", 0, 40, 40, 12, 60.0), (2, 0, "only", 5, 5, 10, 0, 50.0)]
    w = spark.createDataFrame([(f, t, s, float(a), float(b), float(c), float(d), e) for f, t, s, a, b, c, d, e in words], "frame_id long, token_no long, text string, left double, top double, width double, height double, confidence double")
    got = lines.group_lines(w).orderBy("frame_id", "line_no").collect()
    assert [(r.frame_id, r.text, r.confidence) for r in got] == [(1, "98765 43210x", 80.0), (1, "below", 60.0), (2, "only", 50.0)]
    found = detect.scan(words=w.where("text <> 'x'")).collect()
    assert [(r.type, r.text, tuple(r.bbox), r.source) for r in found] == [("PHONE", "98765 43210", (0.0, 10.0, 88.0, 14.0), "OCR")]
    page = "frame_id long, blocks array<struct<paragraphs:array<struct<lines:array<struct<text:string,confidence:double,words:array<struct<text:string,confidence:double>>>>>>>>"
    nested = spark.createDataFrame([(1, [([([(" a b ", 90.0, [("a", 91.0), (None, 1.0)]), (None, None, [("c", 80.0), ("d", 70.0)])],)],)])], page)
    assert [(r.line_no, r.text, r.confidence, len(r.words)) for r in lines.flatten_pages(nested).orderBy("line_no").collect()] == [(0, "a b", 90.0, 1), (1, "c d", 0.0, 2)]


HTML = """<html><head><title> My  page </title><meta name="description" content="about"></head><body><nav><a href="/x">Go</a></nav>
<main><h1>Head</h1><h2></h2><h2>Two</h2><p>Call 212-555-1234 now<p>Call  212-555-1234 NOW<p style="display: none">a@b.co</p>
<form><label for="m">Mail</label><input id="m" name="mail" value=" x@y.org " placeholder="you@site.com"><label>Key <input type="password" value="s3cret"></label>
<div>Town <input name="town"></div><div hidden><button>no</button></div><img alt="Face" src="f.png"><span role="button" aria-label=" Send ">S</span></form></main><script>var t="</p>";</script></body></html>"""


def test_pages(spark):
    d = spark.createDataFrame([(1, "http://a", HTML), (2, "http://b", ""), (3, None, None)], "page_id long, url string, html string")
    e = pages.elements(d).orderBy("el_idx").collect()
    assert [(r.tag_name, r.text, r.label_text) for r in e] == [("a", "Go", None), ("input", "you@site.com", "Mail"), ("input", "", "Key"), ("input", "", "Town"), ("img", "Face", None), ("span", "Send", None)]
    assert e[1].selector == "#m" and e[1].attributes == {"name": "mail", "value": "x@y.org", "placeholder": "you@site.com"} and e[2].attributes["value"] == "[PROTECTED]"
    assert e[3].xpath == "/html[1]/body[1]/main[1]/form[1]/div[1]/input[1]" and e[3].selector.endswith('input[name="town"]') and e[5].id == "kw-el-6"
    a = pages.audit(d).first()
    assert (a.total, a.kept, a.css_hidden) == (7, 6, 1)
    s = pages.static_nodes(d, prefilter).collect()
    assert [(r.text, r.matched_patterns) for r in s] == [("Call 212-555-1234 now", ["PHONE"])]
    c = {r.page_id: r for r in pages.context(d).collect()}
    assert (c[1].title, c[1].meta_description, c[1].headings, c[2].title, c[3].title) == ("My page", "about", ["Head", "Two"], "Untitled Page", None)
    assert c[1].simplified_content.startswith("HeadTwoCall 212-555-1234 now")
    box = lambda x: x.withColumn("bbox", F.lit(None).cast(merge.BOX))
    found = detect.scan(box(pages.elements(d)), box(pages.static_nodes(d, prefilter))).orderBy("page_id", "det_no").collect()
    assert [(r.type, r.text) for r in found] == [("EMAIL", "you@site.com"), ("EMAIL", "x@y.org"), ("EMAIL", "you@site.com"), ("PASSWORD", MASKED), ("PHONE", "212-555-1234")]


MASKED = "••••••••"


def test_visible_text_and_long_pages(spark):
    html = "<p>Phone<br>2125551234</p><div>Call<p>212-555-1234</p>now</div><table><tr><td>a@b.org</td><td>x</td></tr></table><input type=hidden value=q><div style='opacity:0'><input value=seen></div>"
    d = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    # the table cell and the two blocks: values keep their bounds
    assert {r.text for r in pages.static_nodes(d, prefilter).collect()} == {"Phone 2125551234", "Call 212-555-1234 now", "212-555-1234", "a@b.org"}
    assert [(r.reason, r.selector) for r in pages.candidates(d).orderBy("el_idx").collect()][0][0] == "ZERO_DIMENSIONS" and pages.elements(d).count() == 1
    began = time.process_time()
    page = pages.Page("".join(f"<input name=n{i} id=''>" for i in range(10_000)))
    inputs = [n for n in page.nodes if n.tag == "input"]
    assert [page.selector(n) for n in inputs[:2]] == ['input[name="n0"]', 'input[name="n1"]'] and all(page.label(n) is None for n in inputs)
    assert time.process_time() - began < 10


def test_overlay_keeps_all_detections(spark):
    box = F.struct(F.lit(-5.0).alias("left"), F.lit(2.0).alias("top"), F.lit(0.0).alias("width"), F.lit(9.0).alias("height"))
    many = spark.range(400).select(F.lit(1).alias("page_id"), F.col("id").alias("det_no"), F.lit("EMAIL").alias("type"), F.lit("someone@x.org").alias("text"), box.alias("bbox"), F.lit("DOM").alias("source"), F.array(F.lit("DOM"), F.lit("OCR")).alias("sources"))
    got = detect.overlay(many).collect()
    assert len(got) == 400 and {(r.label, r.left, r.top, r.width, r.height) for r in got} == {("EMAIL · DOM+OCR · someon…", 0.0, 2.0, 1.0, 9.0)}
    words = many.select(F.col("page_id").alias("frame_id"), F.col("det_no").alias("token_no"), "text", "bbox")
    assert detect.word_overlay(words).count() == 300 and detect.overlay(many, {"DOM": False}).count() == 0


def test_inventory(spark, tmp_path):
    for name, data in {"a.txt": b"x", "d/b.PNG": b"yy", ".git/c": b"z", "d/e.md": b"````"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    s = inventory.snapshot(spark, str(tmp_path)).orderBy("rel").collect()
    assert [(r.rel, r.size, r.binary) for r in s] == [("a.txt", 1, False), ("d/b.PNG", 2, True), ("d/e.md", 4, False)]
    now = spark.createDataFrame(s).withColumn("sha256", F.when(F.col("rel") == "a.txt", "new").otherwise(F.col("sha256"))).where("rel <> 'd/e.md'")
    assert sorted(map(tuple, inventory.diff(spark.createDataFrame(s), now).collect())) == [("a.txt", "modified"), ("d/e.md", "removed")]
    r = spark.range(1).select(inventory.fence_length(F.lit("a ```` b `")).alias("f"), inventory.human_size(F.lit(1280)).alias("k"), inventory.human_size(F.lit(12)).alias("b")).first()
    assert tuple(r) == (5, "1.3 KB", "12 B")


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(i, f"mail u{i}@x.org or 212-555-01{i:02d}") for i in range(40)], "doc_id long, text string")
    d.repartition(5).write.parquet(f"{tmp_path}/in")
    step = lambda x: sanitize.sanitize(x).select("doc_id", "sanitized", "masked_count")
    out = stream.run(spark, f"{tmp_path}/in", d.schema, step, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, step(d).collect()))


def test_models(spark):
    anchors = spark.createDataFrame([(1, [0.1, 0.5, 0.5]), (2, [0.0, 0.0, 0.3]), (3, [0.9, 0.1, 0.1]), (4, [0.1, 0.2, 0.36])], "anchor_no int, scores array<double>")
    labels = spark.createDataFrame([(0, "person"), (1, "card")], "class_idx int, label string")
    got = {r.anchor_no: (r.class_idx, r.label) for r in vision.decode_classes(anchors, labels).collect()}
    assert got == {1: (1, "card"), 3: (0, "person"), 4: (2, "ui_element")}
    assert vision.run_model(anchors, None, "anchor_no int").count() == 0
    assert vision.run_model(anchors, lambda b: b[["anchor_no"]], "anchor_no int").count() == 4


def test_regions_and_tensors(spark):
    frames = spark.createDataFrame([(1, 500.0, 300.0)], "frame_id long, width double, height double")
    e = spark.createDataFrame(
        [(1, i, f"e{i}", "img" if i % 2 else "div", None, "", {"alt": "x"}, (0.0, 0.0, 400.0 if i == 3 else 40.0, 400.0 if i == 3 else 40.0)) for i in range(40)],
        "frame_id long, el_idx int, id string, tag_name string, role string, selector string, attributes map<string,string>, bbox struct<left:double,top:double,width:double,height:double>",
    )
    got = vision.face_regions(frames, e).collect()
    assert [sum(1 for r in got if r.pass_no == k) for k in range(3)] == [15, 2, 1] and 3 not in [r.region_no for r in got if r.pass_no == 0]
    t = vision.tensors(spark.createDataFrame([(1, 2, bytearray(range(16)))], "frame_id long, size int, rgba binary")).first()
    assert [round(x * 255) for x in t.tensor] == [0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14]
    v = spark.range(1).select(G.viewport(F.lit(None).cast("double"), F.lit(5.0), F.lit(0.0)).alias("v")).first().v
    assert tuple(v) == (1280.0, 5.0, 1.0)
