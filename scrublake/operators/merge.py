"""Detections of several sources: merged by page, summarised, filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrublake.functions.boxes import overlap_ratio
from scrublake.functions.text import fingerprint

BOX = "struct<left:double,top:double,width:double,height:double>"
DETECTION = f"struct<id:string,type:string,text:string,bbox:{BOX},source:string,sources:array<string>,selector:string,confidence:double,context:string>"


def merge_sources(detections: DataFrame, page: str = "page_id", order: str = "det_no") -> DataFrame:
    """One row for what several sources found: a fold over each page's detections in ``order``.

    An item joins the first kept one of its type that overlaps it by over 0.3 of the smaller box and has the same text or
    fingerprint. A newer DOM item becomes the primary, in the old place; sources are united and sorted, the greater confidence
    stays, selector and context fall back to the other's. Pages are gathered one by one, never the whole table.
    """
    item = F.struct("id", "type", "text", F.col("bbox").cast(BOX).alias("bbox"), "source", "sources", "selector", F.col("confidence").cast("double").alias("confidence"), "context")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), item.alias("d")))), lambda x: x["d"].cast(DETECTION))

    def same(a: Column, b: Column) -> Column:
        alike = (fingerprint(a["text"]) == fingerprint(b["text"])) | (a["text"] == b["text"])
        return (a["type"] == b["type"]) & (overlap_ratio(a["bbox"], b["bbox"]) > 0.3) & alike

    def joined(old: Column, new: Column) -> Column:
        dom = new["source"] == "DOM"
        pick = lambda f: F.when(dom, new[f]).otherwise(old[f])
        other = lambda f: F.when(dom, old[f]).otherwise(new[f])
        return F.struct(
            pick("id").alias("id"), pick("type").alias("type"), pick("text").alias("text"), pick("bbox").alias("bbox"), pick("source").alias("source"),
            F.array_sort(F.array_union(old["sources"], new["sources"])).alias("sources"), F.coalesce(pick("selector"), other("selector")).alias("selector"),
            F.greatest(F.coalesce(old["confidence"], F.lit(0.0)), F.coalesce(new["confidence"], F.lit(0.0))).alias("confidence"),
            F.coalesce(pick("context"), other("context")).alias("context"),
        ).cast(DETECTION)

    def step(kept: Column, new: Column) -> Column:
        hits = F.transform(kept, lambda k: same(k, new))
        first = F.array_position(hits, True)
        return F.when(first == 0, F.concat(kept, F.array(new))).otherwise(F.transform(kept, lambda k, i: F.when(i + 1 == first, joined(k, new)).otherwise(k)))

    kept = F.aggregate("_items", F.array().cast(f"array<{DETECTION}>"), step)
    pages = detections.groupBy(page).agg(ordered.alias("_items")).select(page, F.posexplode(kept).alias("det_no", "_d"))
    return pages.select(page, "det_no", "_d.*")


def _sources() -> Column:
    return F.coalesce("sources", F.array("source"))


def summarize(detections: DataFrame, *by: str) -> DataFrame:
    """Counts by provenance: total, dom_flagged, ocr_flagged, ocr_matched, corroborated."""
    ocr, dom = F.array_contains(_sources(), "OCR"), F.array_contains(_sources(), "DOM")
    return detections.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("source") == "DOM").alias("dom_flagged"), F.count_if(F.col("source") != "DOM").alias("ocr_flagged"),
        F.count_if(ocr).alias("ocr_matched"), F.count_if(ocr & dom).alias("corroborated"),
    )


VIEWS = ("ocr", "ocr_only", "dom", "corroborated")


def _shown() -> dict[str, Column]:
    s = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array("source"))
    return {"ocr": F.array_contains(s, "OCR"), "ocr_only": (F.size(s) == 1) & (s[0] == "OCR"), "dom": F.array_contains(s, "DOM"), "corroborated": F.size(s) > 1}


def view(detections: DataFrame, which: str) -> DataFrame:
    """Detections that an inspector shows: ocr, ocr_only, dom or corroborated. Without sources, or with none in the array, the source counts."""
    return detections.where(_shown()[which])


def views(detections: DataFrame) -> DataFrame:
    """A row for each detection and view that shows it, the view's name as view, from one pass."""
    keep = _shown()
    return detections.select("*", F.explode(F.array_compact(F.array(*(F.when(keep[v], F.lit(v)) for v in VIEWS)))).alias("view"))


def vision_view(vision: DataFrame, which: str = "faces") -> DataFrame:
    """Rows of models (label, ...) that an inspector shows: faces, or all."""
    return vision.where("label = 'face'") if which == "faces" else vision


def masked(value: Column) -> Column:
    """The first six characters, for display."""
    return F.when(F.length(value) > 6, F.concat(F.substring(value, 1, 6), F.lit("…"))).otherwise(value)
