"""Detection boxes of models: suppression, tiles, class decoding, and a place to plug models in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrublake.functions.boxes import at_least, axis_positions, box, iou, source_rect, unletterboxed, viewport_box
from scrublake.functions.text import half_up

# Thresholds and limits of the models, and the classes that have a label.
FACE = {"size": 128.0, "confidence": 0.5, "iou": 0.3, "most": 20, "merge_iou": 0.4, "tiles": 24, "candidates": 15, "least_px": 10.0}
OBJECT = {"size": 640.0, "confidence": 0.25, "iou": 0.45, "unlabelled": 0.35}

HINT = r"(?i)avatar|profile|user|author|thumb|photo|portrait|picture"
# Classes of the object model that have a label.
CLASS_LABELS = {
    0: "person", 24: "ui_element", 26: "ui_element", 28: "ui_element", 56: "ui_element", 57: "ui_element", 62: "ui_element", 63: "ui_element",
    64: "ui_element", 65: "ui_element", 66: "ui_element", 67: "ui_element", 73: "document", 74: "ui_element", 76: "card", 77: "ui_element",
}


def suppress(boxes: DataFrame, frame: str, kind: str, score: str, threshold: float, order: str = "box_no") -> DataFrame:
    """Greedy suppression by frame: boxes by falling score (ties in ``order``), dropped if a kept one of its kind overlaps by over
    ``threshold``. ``boxes`` has bbox; the columns stay."""
    rest = [c for c in boxes.columns if c != frame]
    row = F.struct((-F.col(score)).alias("_s"), F.col(order).alias("_o"), F.struct(*rest).alias("d"))
    items = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["d"])
    gathered = boxes.groupBy(frame).agg(items.alias("_items"))
    kind_of = gathered.schema["_items"].dataType.simpleString()

    def step(kept: Column, c: Column) -> Column:
        hit = F.exists(kept, lambda k: (k[kind] == c[kind]) & (iou(k["bbox"], c["bbox"]) > threshold))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(c)))

    kept = F.aggregate("_items", F.array().cast(kind_of), step)
    return gathered.select(frame, F.inline(kept)).select(*boxes.columns)


def tiles(frames: DataFrame, tile: float, overlap: float, most: int = int(FACE["tiles"])) -> DataFrame:
    """Tiles over each frame (frame_id, width, height), row by row, at most ``most`` of them."""
    step = float(max(1, int(tile * (1 - overlap) + 0.5)))
    ys, xs = axis_positions(F.col("height"), tile, step), axis_positions(F.col("width"), tile, step)
    size = lambda side: F.least(F.lit(float(tile)), F.col(side))
    grid = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: box(x, y, size("width"), size("height")))))
    return frames.select("frame_id", F.posexplode(F.slice(grid, 1, most)).alias("tile_no", "bbox"))


def decode_classes(anchors: DataFrame, labels: DataFrame, least: float = OBJECT["confidence"], unlabelled: float = OBJECT["unlabelled"]) -> DataFrame:
    """``anchors`` (with scores) with class_idx, the first of the greatest scores, score and label.

    Scores up to ``least`` go, and those up to ``unlabelled`` of classes that ``labels`` (class_idx, label) doesn't have, which
    are called ui_element.
    """
    best = F.array_max("scores")
    a = anchors.withColumns({"score": best, "class_idx": (F.array_position("scores", best) - 1).cast("int")}).where(F.col("score") > least)
    a = a.join(labels, "class_idx", "left").where(F.col("label").isNotNull() | (F.col("score") > unlabelled))
    return a.withColumns({"label": F.coalesce("label", F.lit("ui_element")), "score": half_up(F.col("score"), 3)})


def valid_faces(raw: DataFrame, least: float = FACE["confidence"]) -> DataFrame:
    """Model rows x0, y0, x1, y1, score that are finite, ordered and sure enough, cut to [0, 1]; scores to three places."""
    sides = ("x0", "y0", "x1", "y1")
    finite = F.lit(True)
    for c in (*sides, "score"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    cut = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in sides} | {"score": half_up(F.col("score"), 3)}
    return raw.where(finite & (F.col("score") >= least) & (F.col("score") > 0) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).withColumns(cut)


def face_candidates(elements: DataFrame, page: str = "page_id", most: int = int(FACE["candidates"])) -> DataFrame:
    """Elements that may show a face: images, a telling name, or 16 to 300 pixels; the first of each page."""
    attr = lambda k: F.coalesce(F.col("attributes").getItem(k), F.lit(""))
    hint = F.concat_ws(" ", F.coalesce("id", F.lit("")), F.coalesce("selector", F.lit("")), attr("class"), attr("alt"), attr("src")).rlike(HINT)
    side = lambda c: F.col(f"bbox.{c}").between(16, 300)
    image = F.col("tag_name").isin("IMG", "PICTURE") | F.coalesce(F.col("role") == "img", F.lit(False))
    rows = elements.where((image | hint | (side("width") & side("height"))) & (F.col("bbox.width") > 0) & (F.col("bbox.height") > 0))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy("el_idx"))).where(F.col("_n") <= most).drop("_n")


def run_model(frames: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] | None, schema: str) -> DataFrame:
    """Rows of a model for each batch of frames, in Arrow batches; without a model there are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if model is not None:
                yield model(batch)

    return frames.mapInPandas(run, schema)


def _with_viewport(frames: DataFrame) -> DataFrame:
    """frame_id, width and height in pixels, vp_width and vp_height; without a viewport, that of the pixels."""
    side = lambda c: F.coalesce(f"vp_{c}", c) if f"vp_{c}" in frames.columns else F.col(c)
    return frames.select("frame_id", *(F.col(c).cast("double").alias(c) for c in ("width", "height")), *(side(c).cast("double").alias(f"vp_{c}") for c in ("width", "height")))


def face_regions(frames: DataFrame, elements: DataFrame, tile: float = 384.0, overlap: float = 0.25) -> DataFrame:
    """Where faces are looked for, in this order: likely elements, tiles, the whole frame: frame_id, pass_no, region_no, bbox (in the image's
    pixels).

    ``frames``: frame_id, width, height and perhaps vp_width, vp_height. ``elements`` have frame_id and what ``face_candidates`` looks at, with boxes in
    the viewport's pixels; their crops are cut to the image and go below an eighth of the model's size.
    """
    frames = _with_viewport(frames)
    by = lambda c: F.col(c) / F.col(f"vp_{c}")
    e = F.col("_e")
    scaled = box(e["left"] * by("width"), e["top"] * by("height"), e["width"] * by("width"), e["height"] * by("height"))
    crops = face_candidates(elements, "frame_id").select("frame_id", "el_idx", F.col("bbox").alias("_e")).join(frames, "frame_id")
    crops = crops.select("frame_id", F.lit(0).alias("pass_no"), F.col("el_idx").cast("long").alias("region_no"), source_rect(scaled, F.col("width"), F.col("height")).alias("bbox"))
    crops = crops.where(at_least(F.col("bbox"), FACE["size"] / 8))
    grid = tiles(frames, tile, overlap).select("frame_id", F.lit(1).alias("pass_no"), F.col("tile_no").cast("long").alias("region_no"), "bbox")
    whole = frames.select("frame_id", F.lit(2).alias("pass_no"), F.lit(0).cast("long").alias("region_no"), box(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")).alias("bbox"))
    return crops.unionByName(grid).unionByName(whole).where((F.col("bbox.width") > 0) & (F.col("bbox.height") > 0))


def merged_faces(frames: DataFrame, regions: DataFrame, raw: DataFrame) -> DataFrame:
    """Faces of all passes in the viewport's pixels: frame_id, pass_no, region_no, face_no, label, score, bbox.

    ``raw``: the model's rows (frame_id, pass_no, region_no, face_no, x0, y0, x1, y1, score) for ``regions``. Valid ones are mapped back through
    their region's letterbox; those in its padding or under 10 pixels go. Of faces that overlap, in whatever pass, the surest stays, and of
    equally sure ones that of the earlier pass, region and row. A region without rows, for one whose model failed, takes nothing from the others.
    """
    frames = _with_viewport(frames)
    found = valid_faces(raw).join(regions, ["frame_id", "pass_no", "region_no"]).withColumn("_m", unletterboxed(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("bbox"), FACE["size"]))
    found = found.where("_m is not null").join(frames, "frame_id")
    by = lambda c: F.lit(1.0) / (F.col(c) / F.col(f"vp_{c}"))
    m = F.col("_m")
    found = found.withColumn("_v", box(m["left"] * by("width"), m["top"] * by("height"), m["width"] * by("width"), m["height"] * by("height"))).where(at_least(F.col("_v"), FACE["least_px"]))
    at = F.struct("pass_no", "region_no", "face_no").alias("_at")
    found = found.select("frame_id", "pass_no", "region_no", "face_no", F.lit("face").alias("label"), "score", viewport_box(F.col("_v"), F.col("vp_width"), F.col("vp_height")).alias("bbox"), at)
    return suppress(found, "frame_id", "label", "score", FACE["merge_iou"], order="_at").drop("_at")


def counts_by_label(detections: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Faces and other objects of each frame."""
    return detections.groupBy(frame).agg(F.count_if(F.col("label") == "face").alias("n_faces"), F.count_if(F.col("label") != "face").alias("n_objects"))


def tensors(images: DataFrame) -> DataFrame:
    """Square images (frame_id, size, rgba: bytes) as planes of red, green and blue in [0, 1]: frame_id, tensor."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(np.frombuffer(b, np.uint8).reshape(n * n, 4)[:, :3].T / np.float32(255)).astype(np.float32).ravel() for b, n in zip(batch["rgba"], batch["size"], strict=True)]
            yield pd.DataFrame({"frame_id": batch["frame_id"], "tensor": made})

    return images.select("frame_id", "size", "rgba").mapInPandas(run, "frame_id long, tensor array<float>")
