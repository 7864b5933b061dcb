"""Whole pipelines: fields, static text and recognised lines of pages to merged detections; payloads; overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrublake.functions.text import around, half_up
from scrublake.operators.fields import field_detections, fields_in, text_pool
from scrublake.operators.lines import group_lines, span_box
from scrublake.operators.merge import BOX, merge_sources
from scrublake.operators.scan import detections_in, may_match, scan_text

COLUMNS = ("page_id", "_stage", "_row", "_no", "id", "type", "text", "bbox", "source", "sources", "selector", "confidence", "context")


def _rows(found: DataFrame, stage: int, row: str, bbox: Column, source: str, selector: Column) -> DataFrame:
    return found.select(
        "page_id", F.lit(stage).alias("_stage"), F.col(row).alias("_row"), "det_no", "id", "type", F.col("value").alias("text"), bbox.cast(BOX).alias("bbox"), F.lit(source).alias("source"),
        F.array(F.lit(source)).alias("sources"), selector.alias("selector"), "confidence", "context",
    ).withColumnRenamed("det_no", "_no")


def scan(elements: DataFrame | None = None, static_nodes: DataFrame | None = None, words: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Merged detections of pages: elements' fields, then their text; static nodes; lines of recognised words (frame_id is the page), or the
    ``lines`` that ``group_lines`` made of them.

    Order within a page decides what merges: elements first, then static text, then lines, each in its own order.
    """
    parts = []
    if elements is not None:
        kept = elements.select("page_id", "el_idx", "id", "type", "label_text", "attributes", "bbox", "selector")
        f = field_detections(kept).withColumns({"type": F.col("kind"), "id": F.concat(F.lit("dom-heuristic-"), F.lower("kind"), F.lit("-"), F.col("el_idx").cast("string"))})
        parts.append(_rows(f, 0, "el_idx", F.col("bbox"), "DOM", F.col("selector")).withColumn("_row", F.col("_row") * 2))
        pool = elements.select("page_id", "el_idx", "bbox", "selector", text_pool().alias("text"))
        t = scan_text(pool, base=F.concat(F.lit("dom-"), F.col("el_idx").cast("string")))
        parts.append(_rows(t, 0, "el_idx", F.col("bbox"), "DOM", F.col("selector")).withColumn("_row", F.col("_row") * 2 + 1))
    if static_nodes is not None:
        n = static_nodes.select("page_id", "node_idx", "bbox", "selector", "text")
        t = scan_text(n, base=F.concat(F.lit("static-"), F.col("node_idx").cast("string")))
        parts.append(_rows(t, 1, "node_idx", F.col("bbox"), "DOM", F.col("selector")))
    if words is not None and lines is None:
        lines = group_lines(words)
    if lines is not None:
        lines = lines.withColumnRenamed("frame_id", "page_id")
        whole = F.struct("left", "top", "width", "height")
        lines = lines.select("page_id", "line_no", "text", "spans", whole.alias("whole"))
        t = scan_text(lines, base=F.concat(F.lit("ocr-line-"), F.col("line_no").cast("string")), lenient=True)
        parts.append(_rows(t, 2, "line_no", span_box(F.col("spans"), F.col("start"), F.col("end"), F.col("whole")), "OCR", F.lit(None).cast("string")))
    if not parts:
        raise ValueError("nothing to scan")
    every = reduce(DataFrame.unionByName, parts)
    return merge_sources(every.withColumn("det_no", F.struct("_stage", "_row", "_no")).drop("_stage", "_row", "_no"))


_FOUND = "array<struct<no:int,id:string,type:string,text:string,confidence:double,context:string>>"


def scan_rows(rows: DataFrame) -> DataFrame:
    """As ``scan``, of the rows that ``sources.pages.taken`` gives for elements and static nodes: pages are parsed and rules run once.

    Boxes come with the rows (bbox); without any, nothing of different places merges.
    """
    rows = rows.repartition("page_id")
    element = F.col("kind") == "element"
    fields, hint = fields_in()
    number = F.col("idx").cast("string")
    of_fields = F.transform(fields, lambda d, i: F.struct(i.alias("no"), F.concat(F.lit("dom-heuristic-"), F.lower(d["kind"]), F.lit("-"), number).alias("id"), d["kind"].alias("type"), d["value"].alias("text"), d["confidence"].alias("confidence"), hint.alias("context")))
    text = F.when(element, text_pool()).otherwise(F.col("text"))
    base = F.concat(F.when(element, "dom-").otherwise("static-"), number)
    rows = rows.withColumns({"_t": text, "_b": base, "_f": F.when(element, of_fields)})
    t = F.col("_t")
    found = F.when(may_match(t), detections_in(t))
    of_text = F.transform(found, lambda d, i: F.struct(
        (i + 100).alias("no"), F.concat_ws("-", F.col("_b"), F.lower(d["type"]), i.cast("string")).alias("id"), d["type"].alias("type"), d["value"].alias("text"),
        half_up(d["confidence"], 2).alias("confidence"), around(t, d["start"], d["end"]).alias("context"),
    ))
    none = F.array().cast(_FOUND)
    every = F.concat(F.coalesce(F.col("_f").cast(_FOUND), none), F.coalesce(of_text.cast(_FOUND), none))
    # outer, as the filter that Spark infers for a plain explode would run the rules again
    found = rows.select("page_id", element.alias("_el"), "idx", "selector", F.col("bbox").cast(BOX).alias("bbox"), F.explode_outer(every).alias("_d")).where("_d is not null")
    found = found.select(
        "page_id", F.struct((~F.col("_el")).alias("stage"), "idx", F.col("_d.no")).alias("det_no"), "_d.id", "_d.type", "_d.text", "bbox", F.lit("DOM").alias("source"),
        F.array(F.lit("DOM")).alias("sources"), "selector", "_d.confidence", "_d.context",
    )
    return merge_sources(found)


def totals(elements: DataFrame, static_nodes: DataFrame, words: DataFrame) -> DataFrame:
    """Of each page, how many elements, static nodes and words were scanned."""
    count = lambda d, key, name: d.groupBy(F.col(key).alias("page_id")).agg(F.count(F.lit(1)).alias(name))
    t = count(elements, "page_id", "n_elements").join(count(static_nodes, "page_id", "n_static"), "page_id", "full").join(count(words, "frame_id", "n_words"), "page_id", "full")
    t = t.na.fill(0)
    return t.withColumn("total_scanned", F.col("n_elements") + F.col("n_static") + F.col("n_words"))


def _gathered(d: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """The rows of each page as an array, in order; maps may be among the columns."""
    cols = [c for c in d.columns if c not in (key, order)]
    less = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    return d.groupBy(F.col(key).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(order, *cols)), less).alias(name))


def payload(
    pages: DataFrame, elements: DataFrame, detections: DataFrame, static_nodes: DataFrame | None = None, words: DataFrame | None = None, lines: DataFrame | None = None, vision: DataFrame | None = None,
    viewports: DataFrame | None = None, runs: DataFrame | None = None,
) -> DataFrame:
    """A row for each page: its columns, viewport, and as arrays in order elements (attributes too), static_nodes, words, lines, vision and
    detections; then vision_meta, ocr_meta and pii_meta.

    Words, lines and vision rows have frame_id; ``runs`` is what ``models.runs`` gives. A part that is not given is null and says so in its meta's
    error; a page without rows of a part that was given has an empty array.
    """
    parts = {
        "elements": (elements, "page_id", "el_idx"), "static_nodes": (static_nodes, "page_id", "node_idx"), "words": (words, "frame_id", "token_no"), "lines": (lines, "frame_id", "line_no"),
        "vision": (vision, "frame_id", "vision_no"), "detections": (detections, "page_id", "det_no"),
    }
    out = pages
    for name, (d, key, order) in parts.items():
        if d is None:
            out = out.withColumn(name, F.lit(None).cast("array<struct<_none:int>>"))
        else:
            got = _gathered(d, key, order, name)
            out = out.join(got, "page_id", "left").withColumn(name, F.coalesce(name, F.array().cast(got.schema[name].dataType)))
    if viewports is not None:
        out = out.join(viewports.select("page_id", F.struct("width", "height", "device_pixel_ratio").alias("viewport")), "page_id", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) if parts[c][0] is not None else F.lit(0)
    missing = lambda c, what: F.lit(None).cast("string") if parts[c][0] is not None else F.lit(f"The {what} stage did not return a result.")
    is_face = lambda v: v["label"] == "face"
    faces = F.size(F.filter("vision", is_face)) if vision is not None else F.lit(0)
    if runs is not None:
        out = out.join(runs.select(F.col("frame_id").alias("page_id"), "models_used", "statuses", F.col("error").alias("_error")), "page_id", "left")
    used = [F.col("models_used"), F.col("statuses")] if runs is not None else []
    error = F.coalesce("_error", missing("vision", "vision")) if runs is not None else missing("vision", "vision")
    dom, ocr = (lambda d: F.array_contains(d["sources"], "DOM")), (lambda d: F.array_contains(d["sources"], "OCR"))
    count = lambda f: F.size(F.filter("detections", f))
    text = F.array_join(F.filter(F.transform("lines", lambda x: x["text"]), lambda t: t != ""), "\n") if lines is not None else F.lit("")
    mean = F.coalesce(F.round(F.aggregate("words", F.lit(0.0), lambda s, w: s + w["confidence"]) / F.nullif(F.size("words"), F.lit(0))), F.lit(0.0)) if words is not None else F.lit(0.0)
    out = out.withColumns({
        "vision_meta": F.struct(*used, faces.alias("face_count"), (n("vision") - faces).alias("object_count"), error.alias("error")),
        "ocr_meta": F.struct(F.when(missing("words", "OCR").isNull(), "done").otherwise("error").alias("status"), n("words").alias("token_count"), n("lines").alias("line_count"), text.alias("full_text"), mean.alias("mean_confidence"), missing("words", "OCR").alias("error")),
        "pii_meta": F.struct(
            (n("elements") + n("static_nodes") + n("words")).alias("total_scanned"), F.size("detections").alias("flagged_count"), count(lambda d: d["source"] == "DOM").alias("dom_flagged_count"),
            count(lambda d: d["source"] != "DOM").alias("ocr_flagged_count"), count(ocr).alias("ocr_matched_count"), count(lambda d: ocr(d) & dom(d)).alias("corroborated_count"),
        ),
    })
    return out.drop("models_used", "statuses", "_error")


def drawn(b: Column) -> Column:
    """A box as it is drawn: cut at 0, with its sides in order; null if a side isn't finite or under a pixel."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def side(at: Column, size: Column) -> tuple[Column, Column]:
        lo = F.greatest(F.lit(0.0), F.least(at, at + size))
        return lo, F.greatest(lo, F.greatest(at, at + size)) - lo

    (left, width), (top, height) = side(b["left"], b["width"]), side(b["top"], b["height"])
    good = finite(b["left"]) & finite(b["top"]) & finite(width) & finite(height) & (width >= 1) & (height >= 1)
    return F.when(good, F.struct(left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height")))


LAYERS = ("vision", "pii", "ocr")


def overlay_layers(vision: DataFrame | None = None, detections: DataFrame | None = None, words: DataFrame | None = None, layers: dict[str, bool] | None = None, most: int = 300) -> DataFrame:
    """What is drawn over frames: frame_id, layer, no, style, solid, label, left, top, width, height.

    ``vision`` (frame_id, vision_no, label, score, bbox): faces, persons and others, labelled with their score in hundredths. ``detections`` (page_id,
    det_no, type, text, source, sources, bbox): all of them, at least a pixel each way; those of several sources look like persons and solid.
    ``words`` (frame_id, token_no, text, bbox): the first ``most`` of each frame. Vision and words under a pixel aren't drawn. A layer is left out if
    ``layers`` says False.
    """
    on = {k for k in LAYERS if (layers or {}).get(k, True) is not False}
    parts = []
    if vision is not None and "vision" in on:
        name = F.upper(F.col("label"))
        percent = F.floor(F.coalesce("score", F.lit(0.0)) * 100 + 0.5).cast("long").cast("string")
        style = F.when(F.col("label").isin("face", "person"), F.col("label")).otherwise("default")
        rows = vision.withColumn("_b", drawn(F.col("bbox"))).where("_b is not null")
        parts.append(rows.select("frame_id", F.lit("vision").alias("layer"), F.col("vision_no").cast("long").alias("no"), style.alias("style"), F.lit(True).alias("solid"), F.concat(name, F.lit(" "), percent, F.lit("%")).alias("label"), "_b.*"))
    if detections is not None and "pii" in on:
        several = F.coalesce(F.size("sources"), F.lit(0)) > 1
        at = lambda k, least: F.greatest(F.lit(least), F.col("bbox")[k]).alias(k)
        parts.append(detections.select(
            F.col("page_id").alias("frame_id"), F.lit("pii").alias("layer"), F.col("det_no").cast("long").alias("no"), F.when(several, "person").otherwise("pii").alias("style"), several.alias("solid"),
            overlay_label().alias("label"), at("left", 0.0), at("top", 0.0), at("width", 1.0), at("height", 1.0),
        ))
    if words is not None and "ocr" in on:
        rows = word_overlay(words, most).withColumn("_b", drawn(F.col("bbox"))).where("_b is not null")
        parts.append(rows.select("frame_id", F.lit("ocr").alias("layer"), F.col("token_no").cast("long").alias("no"), F.lit("ocr").alias("style"), F.lit(True).alias("solid"), "label", "_b.*"))
    if not parts:
        raise ValueError("no layer to draw")
    return reduce(DataFrame.unionByName, parts)


def overlay_counts(drawn_rows: DataFrame) -> DataFrame:
    """Boxes of each frame: faces, objects, pii, ocr."""
    layer = lambda k: F.col("layer") == k
    return drawn_rows.groupBy("frame_id").agg(
        F.count_if(layer("vision") & (F.col("style") == "face")).alias("faces"), F.count_if(layer("vision") & (F.col("style") != "face")).alias("objects"), F.count_if(layer("pii")).alias("pii"),
        F.count_if(layer("ocr")).alias("ocr"),
    )


def overlay_label() -> Column:
    """Type, sources and six characters of the value."""
    sources = F.array_join(F.coalesce("sources", F.array("source")), "+")
    return F.concat("type", F.lit(" · "), sources, F.lit(" · "), F.substring("text", 1, 6), F.lit("…"))


def overlay(detections: DataFrame, layers: dict[str, bool] | None = None) -> DataFrame:
    """Boxes to draw for all detections: cut at 0, at least a pixel each way; the label has type, sources and six characters of the value."""
    off = [k for k, on in (layers or {}).items() if not on]
    at = lambda k, least: F.greatest(F.lit(least), F.col("bbox")[k]).alias(k)
    label = overlay_label()
    rows = detections.where(~F.col("source").isin(*off)) if off else detections
    return rows.select("page_id", "det_no", F.col("source").alias("layer"), "type", label.alias("label"), at("left", 0.0), at("top", 0.0), at("width", 1.0), at("height", 1.0))


def word_overlay(words: DataFrame, most: int = 300) -> DataFrame:
    """The first ``most`` recognised words of each frame, by token_no, with 22 characters each as label."""
    from scrublake.sources.inventory import capped

    return capped(words.withColumn("label", F.substring("text", 1, 22)), "frame_id", [F.col("token_no")], most)
