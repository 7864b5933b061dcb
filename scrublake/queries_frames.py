"""Registered queries over frames: images made of the documents' bytes, face passes, models, overlays, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrublake import oracle as O
from scrublake.functions import boxes as G
from scrublake.functions.tables import shared_path, written
from scrublake.operators import images, lines, merge, models, scan, vision
from scrublake.plans import detect
from scrublake.queries import _AXIS, _IOU, _on_grid, table
from scrublake.sources import inventory, memory, pages
from scrublake.streaming import detect as stream
from scrublake.streaming import metrics, tabs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- pixels


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's UTF-8 bytes as pixels of a nearly square image; the last row is filled up with 255."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), raw.alias("_b"), F.octet_length(raw).alias("_n"))
    d = d.withColumn("width", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n") / 4.0))).cast("int"))
    d = d.withColumn("height", F.greatest(F.lit(1), F.ceil(F.col("_n") / (4.0 * F.col("width")))).cast("int"))
    return d.select("frame_id", "width", "height", F.rpad("_b", 4 * F.col("width") * F.col("height"), F.lit(b"\xff")).alias("rgba"))


_IMAGES = """
b AS (SELECT doc_id, encode(coalesce(text, '')) e FROM documents), n AS (SELECT *, octet_length(e) n, greatest(1, ceil(sqrt(octet_length(e) / 4.0::DOUBLE)))::BIGINT w FROM b),
m AS (SELECT doc_id, n, w, greatest(1, ceil(n / (4.0::DOUBLE * w)))::BIGINT h, list_transform(regexp_extract_all(hex(e), '..'), lambda x: ('0x' || x)::INTEGER) p FROM n),
i AS (SELECT doc_id, w, h, list_concat(p, list_transform(range(0, 4 * w * h - n), lambda x: 255)) p FROM m)"""


@query(
    f"WITH {_IMAGES}, y AS (SELECT doc_id, w, h, list_transform(range(0, w * h), lambda k: p[4 * k + 1] * 299 + p[4 * k + 2] * 587 + p[4 * k + 3] * 114) y FROM i),"
    "c AS (SELECT doc_id, v, count(*) c FROM (SELECT doc_id, unnest(list_transform(y, lambda t: t // 1000)) v FROM y) GROUP BY ALL),"
    "u AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY v) upto, sum(c) OVER (PARTITION BY doc_id) n FROM c),"
    "k AS (SELECT doc_id, min(v) FILTER (upto >= n * 0.02::DOUBLE) low, min(v) FILTER (upto >= n * 0.98::DOUBLE) high FROM u GROUP BY doc_id)"
    "SELECT doc_id, w::INTEGER width, h::INTEGER height, low::INTEGER low, high::INTEGER high, sha256(unhex(array_to_string(list_transform(y, lambda t: repeat(printf('%02x', round_even(greatest(0.0::DOUBLE, least(255.0::DOUBLE,"
    " (round_even(t / 1000::DOUBLE, 0) - low) * (255.0::DOUBLE / greatest(1, high - low)))), 0)::INTEGER), 3) || 'ff'), ''))) pixels_sha256 FROM y JOIN k USING (doc_id)"
)
def readable_pixels(spark, sf_dir):
    """Every document as an image, grey and stretched for a recogniser, pixels written back as bytes."""
    r = images.readable(_images(spark, sf_dir), asked=F.lit(1.0))
    return r.select(F.col("frame_id").alias("doc_id"), "width", "height", "low", "high", F.sha2("rgba", 256).alias("pixels_sha256"))


_SIDE = 16


def _digest(tensors: DataFrame) -> DataFrame:
    """The sum of each plane's bytes, and of all bytes times their places."""
    v = F.transform("tensor", lambda x: F.floor(x.cast("double") * 255 + 0.5).cast("long"))
    n = F.size("_v") / 3
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    plane = lambda i: total(F.slice("_v", (n * i + 1).cast("int"), n.cast("int")))
    places = total(F.transform("_v", lambda x, i: x * (i + 1)))
    return tensors.withColumn("_v", v).withColumns({"red": plane(0), "green": plane(1), "blue": plane(2), "places": places}).drop("_v", "tensor")


def _taps(x: str, n: str, to: str) -> str:
    """In SQL, for target k: the lower source place and the weight of the next."""
    return f"greatest(0, least({n} - 1, ({x} + 0.5::DOUBLE) * ({n} / {to}) - 0.5::DOUBLE))"


#: The region's pixel at (cx, cy) of a target of dw x dh, channel ch from 1.
_PIXEL = (
    "floor((p[4 * ((ry + y0) * w + rx + x0) + {c}] * (1 - t) + p[4 * ((ry + y0) * w + rx + least(x0 + 1, rw - 1)) + {c}] * t) * (1 - u)"
    " + (p[4 * ((ry + least(y0 + 1, rh - 1)) * w + rx + x0) + {c}] * (1 - t) + p[4 * ((ry + least(y0 + 1, rh - 1)) * w + rx + least(x0 + 1, rw - 1)) + {c}] * t) * u + 0.5)::BIGINT"
)
_COLOURS = ", ".join(f"{_PIXEL.format(c=c)} c{c}" for c in (1, 2, 3, 4))


@query(
    f"WITH {_IMAGES}, r AS (SELECT *, w // 8 rx, 0 ry, greatest(1, least(w - w // 8, w // 2 + 1)) rw, h rh FROM i), s AS (SELECT *, least({_SIDE} / rw::DOUBLE, {_SIDE} / rh::DOUBLE) scale FROM r),"
    f"l AS (SELECT *, ({_SIDE} - rw * scale) / 2 pad_x, ({_SIDE} - rh * scale) / 2 pad_y, floor(({_SIDE} - rw * scale) / 2 + 0.5)::BIGINT ax, floor(({_SIDE} - rh * scale) / 2 + 0.5)::BIGINT ay, floor(rw * scale + 0.5)::BIGINT dw, floor(rh * scale + 0.5)::BIGINT dh FROM s),"
    f"k AS (SELECT doc_id, unnest(range(0, {_SIDE * _SIDE})) k FROM l), q AS (SELECT l.*, k, k % {_SIDE} - ax cx, k // {_SIDE} - ay cy FROM l JOIN k USING (doc_id)),"
    f"f AS (SELECT *, {_taps('cx', 'rw', 'dw::DOUBLE')} fx, {_taps('cy', 'rh', 'dh::DOUBLE')} fy FROM q WHERE cx BETWEEN 0 AND dw - 1 AND cy BETWEEN 0 AND dh - 1),"
    f"g AS (SELECT *, floor(fx)::BIGINT x0, floor(fy)::BIGINT y0, fx - floor(fx) t, fy - floor(fy) u FROM f), d AS (SELECT doc_id, k, {_COLOURS} FROM g),"
    "v AS (SELECT k.doc_id, k.k, " + ", ".join(f"CASE WHEN c4 IS NULL THEN 128 ELSE floor((c{c} * c4 + 128 * (255 - c4)) / 255::DOUBLE + 0.5)::BIGINT END v{c}" for c in (1, 2, 3)) + " FROM k LEFT JOIN d USING (doc_id, k)),"
    f"o AS (SELECT doc_id, sum(v1)::BIGINT red, sum(v2)::BIGINT green, sum(v3)::BIGINT blue, sum(v1 * (k + 1) + v2 * (k + 1 + {_SIDE * _SIDE}) + v3 * (k + 1 + {2 * _SIDE * _SIDE}))::BIGINT places FROM v GROUP BY doc_id)"
    "SELECT doc_id, scale, pad_x, pad_y, red, green, blue, places FROM l JOIN o USING (doc_id)"
)
def image_tensors(spark, sf_dir):
    """A region of every document's image, letterboxed into a small square on grey."""
    i = _images(spark, sf_dir)
    left, none = F.floor(F.col("width") / 8).cast("double"), F.lit(0.0)
    i = i.withColumn("region", G.box(left, none, F.floor(F.col("width") / 2).cast("double") + 1, F.col("height").cast("double")))
    t = _digest(images.letterboxed(i, _SIDE))
    return t.select(F.col("frame_id").alias("doc_id"), "letterbox.scale", "letterbox.pad_x", "letterbox.pad_y", "red", "green", "blue", "places")


@query(
    f"WITH {_IMAGES}, r AS (SELECT *, 0 rx, 0 ry, w rw, h rh FROM i), q AS (SELECT *, unnest(range(0, 60)) k FROM r), f AS (SELECT *, {_taps('(k % 12)', 'rw', '12::DOUBLE')} fx, {_taps('(k // 12)', 'rh', '5::DOUBLE')} fy FROM q),"
    f"g AS (SELECT *, floor(fx)::BIGINT x0, floor(fy)::BIGINT y0, fx - floor(fx) t, fy - floor(fy) u FROM f), d AS (SELECT doc_id, k, {_COLOURS} FROM g)"
    "SELECT doc_id, sum(c1)::BIGINT red, sum(c2)::BIGINT green, sum(c3)::BIGINT blue, sum(c1 * (k + 1) + c2 * (k + 61) + c3 * (k + 121))::BIGINT places FROM d GROUP BY doc_id"
)
def stretched_tensors(spark, sf_dir):
    """Every document's image stretched to 12 by 5."""
    return _digest(images.cropped(_images(spark, sf_dir), 12, 5)).select(F.col("frame_id").alias("doc_id"), "red", "green", "blue", "places")


# ---------------------------------------------------------------- faces in three passes

_FRAME_SQL = "fr AS (SELECT p_partkey frame_id, (p_size * 40)::DOUBLE w, (p_partkey % 700 + 20)::DOUBLE h, (p_size * 20)::DOUBLE vw, ((p_partkey % 700 + 20) / 2)::DOUBLE vh FROM part)"
#: Elements of frames: images, a telling selector, or a small box.
_ELEMENT_SQL = (
    "el AS (SELECT l_partkey frame_id, l_orderkey * 8 + l_linenumber el_idx, l_linenumber % 3 = 0 img, l_returnflag = 'R' hint, (l_orderkey % 300)::DOUBLE ex, (l_linenumber * 20)::DOUBLE ey,"
    " (l_quantity * 7)::DOUBLE ew, (l_quantity * 5)::DOUBLE eh FROM lineitem),"
    "cand AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY el_idx) r FROM el WHERE (img OR hint OR (ew BETWEEN 16 AND 300 AND eh BETWEEN 16 AND 300)) AND ew > 0 AND eh > 0)"
)
_REGION_SQL = (
    "crop0 AS (SELECT frame_id, el_idx, w, h, ew, eh, vw, vh, greatest(0.0::DOUBLE, least(w - 1, floor(ex * (w / vw) + 0.5))) x, greatest(0.0::DOUBLE, least(h - 1, floor(ey * (h / vh) + 0.5))) y FROM cand JOIN fr USING (frame_id) WHERE r <= 15),"
    "crop AS (SELECT frame_id, 0 pass_no, el_idx::BIGINT region_no, x, y, greatest(1.0::DOUBLE, least(w - x, floor(ew * (w / vw) + 0.5))) rw, greatest(1.0::DOUBLE, least(h - y, floor(eh * (h / vh) + 0.5))) rh FROM crop0),"
    f"ax AS (SELECT frame_id, w, h, {_AXIS('w')} xs, {_AXIS('h')} ys FROM fr), ay AS (SELECT *, unnest(ys) y FROM ax), axy AS (SELECT *, unnest(xs) x FROM ay),"
    "tile AS (SELECT frame_id, 1 pass_no, row_number() OVER (PARTITION BY frame_id ORDER BY y, x) - 1 region_no, x, y, least(384, w) rw, least(384, h) rh FROM axy),"
    "reg AS (SELECT * FROM crop WHERE rw >= 16 AND rh >= 16 UNION ALL SELECT * FROM tile WHERE region_no < 24 UNION ALL SELECT frame_id, 2, 0, 0.0, 0.0, w, h FROM fr)"
)
#: What stands in for a model: two rows for a region by arithmetic on its numbers, some of them invalid or unsure.
_FACE = {
    "x0": "((frame_id * 31 + pass_no * 17 + region_no * 7 + face_no * 13) % 60) / 100.0", "y0": "((frame_id * 13 + region_no * 11 + face_no * 5) % 70) / 100.0",
    "dx": "((frame_id * 5 + region_no * 3) % 40) / 100.0", "dy": "((frame_id * 7 + region_no * 2 + face_no) % 40 + 5) / 100.0", "score": "((frame_id * 3 + region_no * 5 + pass_no * 7 + face_no * 11) % 64 + 40) / 100.0",
}
_FOLD = (
    "STRUCT(pass_no INTEGER, region_no BIGINT, face_no INTEGER, score DOUBLE, l DOUBLE, t DOUBLE, w DOUBLE, h DOUBLE)"
)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.col("p_partkey") % 700 + 20
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame_id"), (F.col("p_size") * 40).alias("width"), high.alias("height"), (F.col("p_size") * 20).alias("vp_width"), (high / 2).alias("vp_height"))


def _frame_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    b = G.box((F.col("l_orderkey") % 300).cast("double"), (F.col("l_linenumber") * 20).cast("double"), F.col("l_quantity") * 7.0, F.col("l_quantity") * 5.0)
    return li.select(
        F.col("l_partkey").alias("frame_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("el_idx"), F.lit("e").alias("id"), F.lit("div").alias("tag_name"), F.when(F.col("l_linenumber") % 3 == 0, "img").alias("role"),
        F.when(F.col("l_returnflag") == "R", "#profile").otherwise("div").alias("selector"), F.create_map().cast("map<string,string>").alias("attributes"), b.alias("bbox"),
    )


def _rows_of_a_model(regions: DataFrame) -> DataFrame:
    rows = regions.select("frame_id", "pass_no", "region_no", F.explode(F.array(F.lit(0), F.lit(1))).alias("face_no"))
    v = {k: F.expr(x).cast("double") for k, x in _FACE.items()}
    return rows.select("*", v["x0"].alias("x0"), v["y0"].alias("y0"), (v["x0"] + v["dx"]).alias("x1"), (v["y0"] + v["dy"]).alias("y1"), v["score"].alias("score"))


@query(f"WITH {_FRAME_SQL}, {_ELEMENT_SQL}, {_REGION_SQL} SELECT frame_id, pass_no::INTEGER pass_no, region_no::BIGINT region_no, x::DOUBLE \"left\", y::DOUBLE top, rw::DOUBLE width, rh::DOUBLE height FROM reg")
def face_regions(spark, sf_dir):
    return vision.face_regions(_frames(spark, sf_dir), _frame_elements(spark, sf_dir)).select("frame_id", "pass_no", "region_no", "bbox.*")


_D = {k: x.replace("/ 100.0", "/ 100.0::DOUBLE") for k, x in _FACE.items()}


@query(
    f"WITH {_FRAME_SQL}, {_ELEMENT_SQL}, {_REGION_SQL}, k AS (SELECT reg.*, f.face_no FROM reg, (VALUES (0), (1)) f(face_no)),"
    f"raw AS (SELECT *, {_D['x0']} x0, {_D['y0']} y0, {_D['x0']} + {_D['dx']} x1, {_D['y0']} + {_D['dy']} y1, {_D['score']} score FROM k),"
    "ok AS (SELECT * REPLACE (greatest(0, least(1, x0)) AS x0, greatest(0, least(1, y0)) AS y0, greatest(0, least(1, x1)) AS x1, greatest(0, least(1, y1)) AS y1, floor(score * 1000 + 0.5) / 1000 AS score) FROM raw WHERE score >= 0.5::DOUBLE AND x1 > x0 AND y1 > y0),"
    "sc AS (SELECT *, least(128 / rw, 128 / rh) s FROM ok), pd AS (SELECT *, (128 - rw * s) / 2 px, (128 - rh * s) / 2 py, rw * s cw, rh * s ch FROM sc),"
    "mo AS (SELECT *, x0 * 128 - px a0, y0 * 128 - py b0, x1 * 128 - px a1, y1 * 128 - py b1 FROM pd),"
    "un AS (SELECT *, greatest(0, least(cw, a0)) / s a, greatest(0, least(ch, b0)) / s b, greatest(0, least(cw, a1)) / s c, greatest(0, least(ch, b1)) / s d FROM mo WHERE a1 > 0 AND b1 > 0 AND a0 < cw AND b0 < ch),"
    "vi AS (SELECT un.*, vw, vh, (x + a) * (1 / (w / vw)) vx, (y + b) * (1 / (h / vh)) vy, (c - a) * (1 / (w / vw)) ww, (d - b) * (1 / (h / vh)) hh FROM un JOIN fr USING (frame_id) WHERE c - a > 1 AND d - b > 1),"
    "bx AS (SELECT *, greatest(0, least(vw, floor(vx + 0.5))) bl, greatest(0, least(vh, floor(vy + 0.5))) bt, greatest(0, least(vw, floor(vx + ww + 0.5))) br, greatest(0, least(vh, floor(vy + hh + 0.5))) bb FROM vi WHERE ww >= 10 AND hh >= 10),"
    f"g AS (SELECT frame_id, list([{{'pass_no': pass_no, 'region_no': region_no, 'face_no': face_no, 'score': score, 'l': bl, 't': bt, 'w': greatest(br - bl, 0), 'h': greatest(bb - bt, 0)}}::{_FOLD}] ORDER BY score DESC, pass_no, region_no, face_no) d FROM bx GROUP BY frame_id),"
    f"kept AS (SELECT frame_id, unnest(list_reduce(list_prepend([]::{_FOLD}[], d), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: " + _IOU.replace("b.", "x[1].") + " > 0.4::DOUBLE)) > 0 THEN acc ELSE list_concat(acc, x) END)) r FROM g)"
    "SELECT frame_id, r.pass_no pass_no, r.region_no region_no, r.face_no face_no, r.score score, r.l \"left\", r.t top, r.w width, r.h height FROM kept"
)
def face_passes(spark, sf_dir):
    """Faces of crops, tiles and the whole frame, mapped back and suppressed across passes."""
    frames = _frames(spark, sf_dir)
    regions = vision.face_regions(frames, _frame_elements(spark, sf_dir))
    found = vision.merged_faces(frames, regions, _rows_of_a_model(regions))
    return found.select("frame_id", "pass_no", "region_no", "face_no", "score", "bbox.*")


# ---------------------------------------------------------------- pages with a layout

#: Pages with a part of our own overlay and a hidden link before what they hold.
_WITH_PARTS = "replace(html, '<body>', '<body><div id=\"kw-detection-overlay-root\"><a href=\"/o\">o</a></div><a href=\"/h\" style=\"display: none\">h</a>')"
#: Boxes by arithmetic; k counts the links of a page.
_LAYOUT = {
    "left": "(page_id * 37 + k * 211) % 1500 - 60.5", "top": "(page_id * 53 + k * 97) % 1000 - 40.25", "width": "((k + page_id) % 4) * 25.0", "height": "18.0",
    "visibility": "CASE WHEN (page_id + k) % 5 = 0 THEN 'hidden' ELSE 'visible' END", "opacity": "CASE WHEN k % 6 = 5 THEN 0.0 ELSE 1.0 END", "display": "CASE WHEN k = 1 THEN 'none' ELSE 'inline' END",
}
_PATH = "CASE WHEN k = 0 THEN '/html[1]/body[1]/div[1]/a[1]' WHEN k = 1 THEN '/html[1]/body[1]/a[1]' ELSE concat('/html[1]/body[1]/nav[1]/ul[1]/li[', k - 1, ']/a[1]') END"


def _laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, their layout rows and viewports; some viewports are unknown."""
    p = table(spark, sf_dir, "pages")
    p = p.withColumn("html", F.expr(_WITH_PARTS))
    k = p.select("page_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.regexp_count("html", F.lit('<a href=')).cast("int") - 1))).alias("k"))
    layout = k.select("page_id", F.expr(_PATH).alias("xpath"), *(F.expr(x).cast("string" if c in ("visibility", "display") else "double").alias(c) for c, x in _LAYOUT.items()))
    views = p.select("page_id", F.when(F.col("page_id") % 3 != 0, F.lit(1000.0)).alias("width"), F.when(F.col("page_id") % 2 != 0, F.lit(600.0)).alias("height"), F.lit(2.0).alias("device_pixel_ratio"))
    return p, layout, views


_JUDGED = (
    f"WITH p AS (SELECT page_id, {_WITH_PARTS} html FROM pages), n AS (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\"[^>]*>([^<]*)</a>', 1) t FROM p), k AS (SELECT page_id, unnest(range(0, len(t))) k, unnest(t) \"text\" FROM n),"
    "l AS (SELECT page_id, k, \"text\", " + ", ".join(f'({x}){"::DOUBLE" if c not in ("visibility", "display") else ""} "{c}"' for c, x in _LAYOUT.items()) + f", {_PATH} xpath, CASE WHEN page_id % 3 <> 0 THEN 1000 ELSE 1280 END vw, CASE WHEN page_id % 2 <> 0 THEN 600 ELSE 800 END vh FROM k),"
    "j AS (SELECT *, CASE WHEN k = 0 THEN 'EXTENSION_OVERLAY' WHEN width = 0 OR height = 0 THEN 'ZERO_DIMENSIONS' WHEN top + height <= 0 OR \"left\" + width <= 0 OR top >= vh OR \"left\" >= vw THEN 'OUT_OF_VIEWPORT'"
    " WHEN display = 'none' OR visibility = 'hidden' OR opacity = 0 THEN 'CSS_HIDDEN' END reason FROM l),"
    "d AS (SELECT *, CASE reason WHEN 'EXTENSION_OVERLAY' THEN 'Belongs to extension overlay' WHEN 'ZERO_DIMENSIONS' THEN 'width=' || floor(width + 0.5)::BIGINT || ', height=' || floor(height + 0.5)::BIGINT"
    " WHEN 'OUT_OF_VIEWPORT' THEN 'top=' || floor(top + 0.5)::BIGINT || ', bottom=' || floor(top + height + 0.5)::BIGINT || ', vh=' || vh WHEN 'CSS_HIDDEN' THEN 'display=' || display || ', visibility=' || visibility || ', opacity=' || opacity::BIGINT END details FROM j)"
)
_ROUNDED = 'floor("left" + 0.5) "left", floor(top + 0.5) top, floor(width + 0.5) width, floor(height + 0.5) height'


@query(f"{_JUDGED} SELECT page_id, k::INTEGER el_idx, xpath, reason, details, {_ROUNDED} FROM d")
def page_visibility(spark, sf_dir):
    """Every element of every page with its box and the first reason why it isn't visible."""
    p, layout, views = _laid_out(spark, sf_dir)
    return pages.candidates(p, layout=layout, viewports=views).select("page_id", "el_idx", "xpath", "reason", "details", "bbox.*")


@query(f"{_JUDGED} SELECT page_id, k::INTEGER el_idx, 'a' tag_name, \"text\", reason, details, {_ROUNDED} FROM d WHERE reason IS NOT NULL")
def skipped_elements(spark, sf_dir):
    p, layout, views = _laid_out(spark, sf_dir)
    return pages.skipped(p, layout=layout, viewports=views).select("page_id", "el_idx", "tag_name", "text", "reason", "details", "bbox.*")


@query(
    f"{_JUDGED} SELECT page_id, count(*)::BIGINT total, count(*) FILTER (reason IS NULL)::BIGINT kept, " + ", ".join(f"count(*) FILTER (reason = '{r}')::BIGINT {r.lower()}" for r in ("EXTENSION_OVERLAY", "ZERO_DIMENSIONS", "OUT_OF_VIEWPORT", "CSS_HIDDEN")) + " FROM d GROUP BY page_id"
)
def layout_audit(spark, sf_dir):
    p, layout, views = _laid_out(spark, sf_dir)
    return pages.audit(p, layout=layout, viewports=views)


# ---------------------------------------------------------------- models

_MODEL_ROWS = "label string, score double, x0 double, y0 double, x1 double, y1 double"


def _faces(provider: str):
    """A stand-in that runs on one provider only: a face where the first number of a vector is above 0.05."""
    if provider == "gpu":
        raise RuntimeError("no such device")

    def run(frames):
        first = frames["v"].map(lambda v: float(v[0]))
        hit = frames[first > 0.05]
        return hit[["frame_id"]].assign(label="face", score=first[first > 0.05], x0=0.1, y0=0.2, x1=0.5, y1=0.75)

    return run


def _objects(provider: str):
    """A stand-in that fails for every seventh frame; for others a row for each of the first two numbers above 0."""

    def run(frames):
        import pandas as pd

        if (frames["frame_id"] % 7 == 0).any():
            raise ValueError("frame can't be read")
        rows = [(i, ("person", "card")[k], float(v[k]), 0.0, 0.0, 1.0, 0.5) for i, v in zip(frames["frame_id"], frames["v"], strict=True) for k in range(2) if v[k] > 0]
        return pd.DataFrame(rows, columns=["frame_id", "label", "score", "x0", "y0", "x1", "y1"])

    return run


def _absent(provider: str):
    raise FileNotFoundError("weights are missing")


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("v"))
    return models.host(frames, [models.Model("faces", _faces), models.Model("objects", _objects), models.Model("absent", _absent)], _MODEL_ROWS)


_E = "SELECT vec_id frame_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b FROM embeddings"


@query(
    f"WITH e AS ({_E}) SELECT frame_id, 'faces' model, 'face' label, a score, 0.1::DOUBLE x0, 0.2::DOUBLE y0, 0.5::DOUBLE x1, 0.75::DOUBLE y1 FROM e WHERE a > 0.05::DOUBLE UNION ALL"
    " SELECT frame_id, 'objects', 'person', a, 0.0, 0.0, 1.0, 0.5 FROM e WHERE a > 0 AND frame_id % 7 <> 0 UNION ALL SELECT frame_id, 'objects', 'card', b, 0.0, 0.0, 1.0, 0.5 FROM e WHERE b > 0 AND frame_id % 7 <> 0"
)
def model_rows(spark, sf_dir):
    """Rows of three models over all vectors as frames; one of them fails for some frames, one can't be loaded."""
    return _hosted(spark, sf_dir).where("kind = 'row'").select("frame_id", "model", "label", "score", "x0", "y0", "x1", "y1")


@query(
    f"WITH e AS ({_E}) SELECT frame_id, 'absent:false:null:cpu: weights are missing|faces:true:cpu:null|objects:true:gpu:' || CASE WHEN frame_id % 7 = 0 THEN 'frame can''t be read' ELSE 'null' END statuses, 'faces,objects' models_used,"
    " CASE WHEN frame_id % 7 = 0 THEN 'objects' ELSE '' END models_failed, ((a > 0.05::DOUBLE)::INTEGER + CASE WHEN frame_id % 7 = 0 THEN 0 ELSE (a > 0)::INTEGER + (b > 0)::INTEGER END)::BIGINT n_rows FROM e"
)
def model_statuses(spark, sf_dir):
    r = models.runs(_hosted(spark, sf_dir))
    word = lambda c: F.coalesce(c, F.lit("null"))
    told = F.transform("statuses", lambda s: F.concat_ws(":", s["model"], s["loaded"].cast("string"), word(s["provider"]), word(s["error"])))
    return r.select("frame_id", F.array_join(told, "|").alias("statuses"), F.array_join("models_used", ",").alias("models_used"), F.array_join("models_failed", ",").alias("models_failed"), "n_rows")


# ---------------------------------------------------------------- overlays


def _vision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of models."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_id"), F.lit(0).alias("vision_no"), F.element_at(F.array(*(F.lit(x) for x in ("face", "person", "card"))), (F.col("vec_id") % 3 + 1).cast("int")).alias("label"),
        F.abs(F.col("embedding")[0].cast("double")).alias("score"), G.box((F.col("vec_id") % 50 - 20).cast("double"), F.lit(5.0), (F.col("vec_id") % 45 - 10).cast("double"), F.lit(9.0)).alias("bbox"),
    )


def _overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vision rows of vectors, detections and words of documents, by number; boxes by arithmetic, some of them too small to draw."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan.scan_text(d)
    source = F.when(F.col("det_no") % 2 == 0, F.array(F.lit("DOM"), F.lit("OCR"))).otherwise(F.array(F.lit("DOM")))
    pii = found.select(F.col("doc_id").alias("page_id"), "det_no", "type", F.col("value").alias("text"), F.lit("DOM").alias("source"), source.alias("sources"), G.box(F.col("start") - 40.0, F.col("start") % 100 + 0.0, F.col("end") - F.col("start") - 15.0, F.lit(12.0)).alias("bbox"))
    words = _on_grid(d.where("text is not null").select(F.col("doc_id").alias("frame_id"), "text"))
    words = words.select("frame_id", "token_no", "text", G.box(F.col("left") - 30.0, F.col("top"), F.when(F.col("token_no") % 11 == 0, 0.5).otherwise(60.0), F.col("height")).alias("bbox"))
    return detect.overlay_layers(_vision_rows(spark, sf_dir), pii, words)


_OVERLAID = (
    "WITH v0 AS (SELECT vec_id frame_id, ['face', 'person', 'card'][vec_id % 3 + 1] label, abs(embedding[1]::DOUBLE) score, (vec_id % 50 - 20)::DOUBLE l, (vec_id % 45 - 10)::DOUBLE w FROM embeddings),"
    "v AS (SELECT *, greatest(0.0, least(l, l + w)) a, greatest(greatest(0.0, least(l, l + w)), greatest(l, l + w)) b FROM v0),"
    f"s AS ({O.scan('SELECT doc_id k, text FROM documents WHERE text IS NOT NULL')}),"
    "w0 AS (SELECT doc_id, unnest(range(0, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))) n, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) t FROM documents WHERE text IS NOT NULL),"
    "w AS (SELECT *, greatest(0.0, n % 8 * 100.0 - 30) a, greatest(greatest(0.0, n % 8 * 100.0 - 30), n % 8 * 100.0 - 30 + CASE WHEN n % 11 = 0 THEN 0.5 ELSE 60.0 END) b FROM w0 WHERE n < 300),"
    "o AS (SELECT frame_id, 'vision' layer, 0 \"no\", CASE WHEN label = 'card' THEN 'default' ELSE label END style, true solid, upper(label) || ' ' || floor(score * 100 + 0.5)::BIGINT || '%' label, a \"left\", 5.0 top, b - a width, 9.0 height FROM v WHERE b - a >= 1"
    " UNION ALL SELECT doc_id, 'pii', det_no, CASE WHEN det_no % 2 = 0 THEN 'person' ELSE 'pii' END, det_no % 2 = 0, \"type\" || ' · ' || CASE WHEN det_no % 2 = 0 THEN 'DOM+OCR' ELSE 'DOM' END || ' · ' || substr(\"value\", 1, 6) || '…',"
    " greatest(0.0, \"start\" - 40), \"start\" % 100, greatest(1.0, \"end\" - \"start\" - 15), 12.0 FROM s"
    " UNION ALL SELECT doc_id, 'ocr', n, 'ocr', true, substr(t, 1, 22), a, (n // 8) * 30.0 + n % 8, b - a, 12.0 FROM w WHERE b - a >= 1)"
)


@query(f"{_OVERLAID} SELECT frame_id, layer, \"no\"::BIGINT \"no\", style, solid, label, \"left\"::DOUBLE \"left\", top::DOUBLE top, width::DOUBLE width, height::DOUBLE height FROM o")
def overlay_boxes(spark, sf_dir):
    return _overlaid(spark, sf_dir)


@query(
    f"{_OVERLAID} SELECT frame_id, count(*) FILTER (layer = 'vision' AND style = 'face')::BIGINT faces, count(*) FILTER (layer = 'vision' AND style <> 'face')::BIGINT objects, count(*) FILTER (layer = 'pii')::BIGINT pii, count(*) FILTER (layer = 'ocr')::BIGINT ocr FROM o GROUP BY frame_id"
)
def overlay_totals(spark, sf_dir):
    return detect.overlay_counts(_overlaid(spark, sf_dir))


# ---------------------------------------------------------------- inventories in locale order, memories

_RANKED_SQL = "coalesce(regexp_extract(text, '[A-Za-zÀ-ÿ]+'), '') || '/' || CASE WHEN doc_id % 3 = 0 THEN 'File-' WHEN doc_id % 3 = 1 THEN 'file_' ELSE 'fïle.' END || doc_id"


@query(f"WITH f AS (SELECT doc_id, {_RANKED_SQL} rel FROM documents) SELECT doc_id, rel, row_number() OVER (ORDER BY icu_sort_key(rel, 'en'), rel) \"rank\" FROM f")
def ranked_paths(spark, sf_dir):
    """Paths made of the documents' first words, ranked as people sort them."""
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, "File-").when(F.col("doc_id") % 3 == 1, "file_").otherwise("fïle.")
    rel = F.concat(F.coalesce(F.regexp_extract("text", "[A-Za-zÀ-ÿ]+", 0), F.lit("")), F.lit("/"), name, F.col("doc_id").cast("string"))
    return inventory.ranked(d.select("doc_id", rel.alias("rel")))


#: Contents that hold fences and the very marks of a memory.
_TRICKY = "CASE WHEN doc_id % 5 = 0 THEN concat('```\\n<!-- MANIFEST:BEGIN -->\\n', coalesce(text, ''), '\\n````\\nx\\n<!-- MANIFEST:END -->') WHEN doc_id % 5 = 1 THEN concat('~ `a` ```', coalesce(text, '')) ELSE text END"
_SUFFIX = "CASE doc_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.PNG' WHEN 2 THEN '.json' ELSE '.txt' END"


def _project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_TRICKY).alias("content"), F.expr(_SUFFIX).alias("_s"))
    text = F.coalesce("content", F.lit(""))
    rel = F.concat(F.lit("src/File "), F.col("doc_id").cast("string"), "_s")
    return d.select((F.col("doc_id") % 40).alias("project"), rel.alias("rel"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"), "content").withColumn("binary", inventory.is_binary(F.col("rel")))


@query(f"SELECT doc_id % 40 project, 'src/File ' || doc_id || {_SUFFIX} rel, sha256(coalesce({_TRICKY.replace(chr(92) + 'n', chr(10))}, '')) sha256 FROM documents")
def memory_state(spark, sf_dir):
    """Memories of all documents as files of projects, written as text and read again: what their manifests tell."""
    return memory.previous_state(memory.write_memories(memory.memory_lines(_project_files(spark, sf_dir))).select("project", "text"))


_HUMAN = "CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', floor(size / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.2f MB', floor(size / 1048576.0 * 100 + 0.5) / 100) END"


@query(
    f"WITH f0 AS (SELECT doc_id % 40 project, doc_id % 4 k, 'src/File ' || doc_id || {_SUFFIX} rel, coalesce({_TRICKY.replace(chr(92) + 'n', chr(10))}, '') t FROM documents),"
    "f AS (SELECT *, strlen(t) size, sha256(t) h, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) + 1)::BIGINT) fence FROM f0),"
    "m AS (SELECT project, string_agg(h || '  ' || rel, '\n' ORDER BY icu_sort_key(rel, 'en'), rel) m, string_agg(CASE WHEN k <> 1 AND size < 122880 THEN '### `' || rel || '`\n\n' ||"
    f" {_HUMAN} || ' · sha256 `' || substr(h, 1, 16) || '` · 1 level(s) deep\n\n' || fence || CASE k WHEN 0 THEN 'ts' WHEN 2 THEN 'json' ELSE '' END || '\n' || t || '\n' || fence || '\n' END, '\n' ORDER BY icu_sort_key(rel, 'en'), rel) c FROM f GROUP BY project),"
    "w AS (SELECT project, '<!-- MANIFEST:BEGIN -->\n' || m || '\n<!-- MANIFEST:END -->\n<!-- CONTENT:BEGIN -->\n' || coalesce(c || '\n', '') || '<!-- CONTENT:END -->\n' t FROM m)"
    "SELECT project, (len(t) - len(replace(t, '\n', '')))::BIGINT n_lines, sha256(t) sha256, true verbatim FROM w"
)
def memory_written(spark, sf_dir):
    return memory.write_memories(memory.memory_lines(_project_files(spark, sf_dir))).select("project", "n_lines", "sha256", "verbatim")


# ---------------------------------------------------------------- streams and metrics


@query("SELECT user_id::BIGINT tab_id, max_by(event_id, (ts, event_id)) event_id, max(ts) \"at\", max_by(event_type, (ts, event_id)) \"event\" FROM events GROUP BY user_id")
def tab_contexts(spark, sf_dir):
    """Events as of tabs, by user, in eight arrivals: one in three events comes again with the next one, and the third arrival comes before the second.

    Each arrival is one batch, however many files it has, so that batches and their state don't grow in number with the table.
    """
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("tab_id"), "event_id", "ts", F.col("event_type").alias("event"))
    base = shared_path(spark, "tabs")
    bounds = e.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    step = max(1, -(-((bounds["hi"] or 0) - (bounds["lo"] or 0) + 1) // 8))
    part = F.floor((F.col("event_id") - F.lit(bounds["lo"])) / step)
    for no in (0, 2, 1, 3, 4, 5, 6, 7):
        e.where((part == no) | ((part == no - 1) & (F.col("event_id") % 3 == 0))).write.mode("append").parquet(f"{base}/in")
        tabs.write_contexts(stream.read(spark, f"{base}/in", e.schema), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    written = spark.read.schema(f"{tabs.CONTEXT}, batch long").parquet(f"{base}/out")
    return tabs.last_contexts(written).select("tab_id", "event_id", F.col("at").cast("timestamp_ntz").alias("at"), "event")


_COUNTED = f"SELECT count(*) flagged_count, coalesce(round(avg(confidence), 4), 0) mean_confidence FROM ({O.scan('SELECT doc_id k, text FROM documents WHERE text IS NOT NULL')})"


@query(
    f"WITH c AS ({_COUNTED}) SELECT 'pii' stage, 'done' status, m.metric, m.v::DOUBLE \"value\" FROM c, LATERAL (VALUES ('flagged_count', flagged_count::DOUBLE), ('dom_flagged_count', flagged_count::DOUBLE), ('ocr_flagged_count', 0.0::DOUBLE), ('ocr_matched_count', 0.0::DOUBLE), ('corroborated_count', 0.0::DOUBLE), ('mean_confidence', mean_confidence)) m(metric, v)"
)
def scan_status(spark, sf_dir):
    """Detections of all documents are written; their numbers are observed on the way."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, seen = metrics.metered(scan.scan_text(d).withColumns({"source": F.lit("DOM"), "sources": F.array(F.lit("DOM"))}), metrics.scan_metrics(), "pii")
    written(found, "found")
    return metrics.status(spark, "pii", seen).select("stage", "status", F.explode("metrics").alias("metric", "value"))


# ---------------------------------------------------------------- nested pages of a recogniser, files, whole payloads


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a recogniser gives pages: a block of paragraphs (lines of text) of lines (sentences) of words; every third line
    has no text of its own."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    word = lambda w, i: F.struct(F.when(w != "", w).alias("text"), (i % 50 + 50.0).alias("confidence"))
    line = lambda x, i: F.struct(F.when(i % 3 != 2, F.concat(x, F.lit(" "))).alias("text"), F.when(i % 4 != 3, i % 30 + 60.0).alias("confidence"), F.transform(F.split(x, " ", -1), word).alias("words"))
    paragraphs = F.transform(F.split("text", "\n", -1), lambda p: F.struct(F.transform(F.split(p, r"\. ", -1), line).alias("lines")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("frame_id"), F.array(F.struct(paragraphs.alias("paragraphs"))).alias("blocks"))


@query(
    "WITH p AS (SELECT conv_id * 1000 + turn frame_id, text, unnest(range(0, len(string_split(text, '\n')))) pn, unnest(string_split(text, '\n')) p FROM conversations WHERE text IS NOT NULL),"
    "l AS (SELECT frame_id, pn, unnest(range(0, len(string_split(p, '. ')))) n, unnest(string_split(p, '. ')) x FROM p),"
    "w AS (SELECT *, list_filter(string_split(x, ' '), lambda y: y <> '') w FROM l)"
    "SELECT frame_id, (row_number() OVER (PARTITION BY frame_id ORDER BY pn, n) - 1)::INTEGER line_no, trim(CASE WHEN n % 3 <> 2 THEN x ELSE array_to_string(w, ' ') END) \"text\", CASE WHEN n % 4 <> 3 THEN n % 30 + 60.0 ELSE 0.0 END::DOUBLE confidence, len(w)::INTEGER n_words FROM w"
)
def nested_lines(spark, sf_dir):
    found = lines.flatten_pages(_nested(spark, sf_dir))
    return found.select("frame_id", "line_no", "text", "confidence", F.size("words").alias("n_words"))


@query(
    ORACLE_SQL["memory_written"].replace("SELECT project, (len(t) - len(replace(t, '\n', '')))::BIGINT n_lines, sha256(t) sha256, true verbatim FROM w", "SELECT project::INTEGER project, strlen(t)::BIGINT size, sha256(t) sha256, false \"binary\" FROM w")
)
def memory_files(spark, sf_dir):
    """The folder of memories as an inventory sees it: files found, read and hashed."""
    folder = shared_path(spark, "memories")
    memory.write_memories(memory.memory_lines(_project_files(spark, sf_dir)), folder)
    found = inventory.snapshot(spark, folder).where(F.col("rel").rlike(r"\.txt$"))
    return found.select(F.regexp_extract("rel", r"project=(\d+)", 1).cast("int").alias("project"), "size", "sha256", "binary")


@query("SELECT vec_id frame_id, 'face' label, abs(embedding[1]::DOUBLE) score FROM embeddings WHERE vec_id % 3 = 0")
def inspector_faces(spark, sf_dir):
    return merge.vision_view(_vision_rows(spark, sf_dir)).select("frame_id", "label", "score")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of pages as recognised words, those of a page one after another."""
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("frame_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    w = _on_grid(t.repartition("frame_id").sortWithinPartitions("frame_id"))
    return w.withColumn("confidence", F.col("token_no") % 40 + 60.0)


_TITLE_WORDS = "list_filter(regexp_split_to_array(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+'), lambda w: w <> '')"


@query(
    f"WITH t AS (SELECT page_id, url, len(regexp_extract_all(html, '<a href=')) e, {_TITLE_WORDS} w FROM pages), n AS (SELECT *, len(w) n FROM t),"
    f"e AS ({_E}), m AS (SELECT frame_id, ((a > 0.05::DOUBLE)::INTEGER + CASE WHEN frame_id % 7 = 0 THEN 0 ELSE (a > 0)::INTEGER + (b > 0)::INTEGER END) n_rows, (a > 0.05::DOUBLE)::INTEGER faces FROM e)"
    "SELECT page_id, url, e::INTEGER n_elements, n::INTEGER token_count, ceil(n / 8.0)::INTEGER line_count, coalesce(list_reduce(list_prepend('', list_transform(range(0, ceil(n / 8.0)::BIGINT), lambda i: array_to_string(w[8 * i + 1:8 * i + 8], ' '))), lambda a, x: CASE WHEN a = '' THEN x ELSE a || '\n' || x END), '') full_text,"
    " coalesce(round(list_sum(list_transform(range(0, n), lambda i: i % 40 + 60.0))::DOUBLE / nullif(n, 0)), 0.0)::DOUBLE mean_confidence, coalesce(faces, 0)::INTEGER face_count, coalesce(n_rows - faces, 0)::INTEGER object_count,"
    " CASE WHEN m.frame_id IS NOT NULL THEN 'faces,objects' END models_used, (e + n)::INTEGER total_scanned, (page_id % 3 * 100 + 900)::DOUBLE width FROM n LEFT JOIN m ON m.frame_id = page_id"
)
def payload_metas(spark, sf_dir):
    """Whole payloads of all pages: links, titles as recognised words and lines, rows and statuses of models, viewports.

    What takes Python (elements, lines, models) is made once and written, as several parts of a payload read it.
    """
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    none = F.lit(None).cast(merge.BOX)
    e = written(pages.elements(p).withColumn("bbox", none), "elements")
    words = _titles(spark, sf_dir)
    grouped = written(lines.group_lines(words, together=True), "lines")
    text = grouped.select("frame_id", "line_no", "text")
    hosted = written(_hosted(spark, sf_dir), "models")
    seen = hosted.where("kind = 'row'").select("frame_id", F.struct("model", "label").alias("vision_no"), "label", "score")
    views = p.select("page_id", (F.col("page_id") % 3 * 100 + 900.0).alias("width"), F.lit(700.0).alias("height"), F.lit(1.0).alias("device_pixel_ratio"))
    both = detect.payload(p.drop("html"), e, detect.scan(e, lines=grouped), words=words, lines=text, vision=seen, viewports=views, runs=models.runs(hosted))
    return both.select(
        "page_id", "url", F.size("elements").alias("n_elements"), *(F.col(f"ocr_meta.{c}") for c in ("token_count", "line_count", "full_text", "mean_confidence")), "vision_meta.face_count", "vision_meta.object_count",
        F.array_join("vision_meta.models_used", ",").alias("models_used"), "pii_meta.total_scanned", "viewport.width",
    )
