"""Recognised words: flattening of page structures, lines, and boxes of spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrublake.functions.boxes import box
from scrublake.functions.text import trim

LINE = "frame_id long, line_no int, text string, left double, top double, width double, height double, confidence double, spans array<struct<start:int,end:int,token_no:long,left:double,top:double,width:double,height:double>>"


def upper_median(x: Column) -> Column:
    """As an aggregate: the middle of the sorted values, the upper one of two; 0 for none."""
    v = F.array_sort(F.collect_list(x))
    return F.coalesce(F.get(v, F.floor(F.size(v) / 2).cast("int")), F.lit(0.0))


def _upper_medians(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The upper median of each of ``n`` groups, whose numbers come in order; NaN for a group without values."""
    order = np.lexsort((values, group))
    size = np.bincount(group, minlength=n)
    out = np.full(n, np.nan)
    has = size > 0
    out[has] = values[order][(np.cumsum(size) - size + size // 2)[has]]
    return out


def _heights(height: np.ndarray, group: np.ndarray, n: int, other) -> np.ndarray:
    """The upper median of each group's heights above 0, else ``other``."""
    real = height > 0
    found = _upper_medians(height[real], group[real], n)
    return np.where(np.isnan(found), other, found)


def _begins(centre: np.ndarray, frame: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which words, by frame and vertical centre, begin a line.

    Words come by vertical centre; each joins the nearest line within reach, whose centre is its words' median. That can only be the line begun
    last: its first word was out of reach of all lines before, and as words come in order, its median never goes down, while the others' stay. A
    line's centres are in order too, so its median is the middle one. A word out of reach of the one before begins a line in any case, and words
    that are all in reach of their first one are one line; only what is neither is walked word by word.
    """
    begins = np.ones(len(centre), bool)
    begins[1:] = (frame[1:] != frame[:-1]) | (np.diff(centre) > reach[1:])
    at = np.flatnonzero(begins)
    end = np.append(at[1:], len(centre))
    wide = centre[end - 1] - centre[at] > reach[at]
    for i, j in zip(at[wide].tolist(), end[wide].tolist(), strict=True):
        c, far, first = centre[i:j].tolist(), float(reach[i]), 0
        for k in range(1, j - i):
            if c[k] - c[first + (k - first) // 2] > far:
                begins[i + k], first = True, k
    return begins


_NUMBERS = ("left", "top", "width", "height", "confidence")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token_no", pa.int64()), *((c, pa.float64()) for c in _NUMBERS[:4])]))


def _lines_of(words: pa.Table) -> pa.RecordBatch:
    """Lines of whole frames, whose rows stand side by side."""
    ids = words.column("frame_id").combine_chunks()
    n = len(ids)
    run = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
    both_null = pc.and_(pc.is_null(ids[1:]), pc.is_null(ids[:-1])).to_numpy(zero_copy_only=False) if n > 1 else run
    frame = np.append(0, np.cumsum(run & ~both_null))
    numbers = [words.column(c).to_numpy().astype(np.float64) for c in _NUMBERS]
    token = words.column("token_no").to_numpy().astype(np.int64)
    usual = _heights(numbers[3], frame, int(frame[-1]) + 1, 12.0)
    centre = numbers[1] + numbers[3] / 2
    order = np.lexsort((token, centre, frame))
    frame = frame[order]
    begins = _begins(centre[order], frame, np.maximum(4.0, usual * 0.6)[frame])
    line = np.cumsum(begins) - 1
    count = int(line[-1]) + 1
    order = order[np.lexsort((numbers[0][order], line))]  # stable: of words equally far left, the upper one first
    left, top, width, height, confidence = (x[order] for x in numbers)
    at = np.flatnonzero(begins)
    tall = _heights(height, line, count, usual[frame[at]])
    spaced = np.zeros(n, bool)
    spaced[1:] = left[1:] - (left[:-1] + width[:-1]) > tall[line[1:]] * 0.45
    spaced[at] = False
    text = pc.fill_null(words.column("text").combine_chunks().take(pa.array(order)), "")
    size = pc.utf8_length(text).to_numpy().astype(np.int64)
    end = np.cumsum(size + spaced)
    end -= (end - size - spaced)[at][line]
    offsets = pa.array(np.append(at, n), pa.int32())
    pieces = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(spaced.astype(np.int8))), text, "")
    spans = pa.StructArray.from_arrays(
        [pa.array(end - size, pa.int32()), pa.array(end, pa.int32()), pa.array(token[order]), *(pa.array(x) for x in (left, top, width, height))], fields=list(_SPANS.value_type)
    )
    x0, y0 = np.minimum.reduceat(left, at), np.minimum.reduceat(top, at)
    first = np.append(True, frame[at][1:] != frame[at][:-1])
    no = np.arange(count) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(order[at])), pa.array(no, pa.int32()), pc.binary_join(pa.ListArray.from_arrays(offsets, pieces), ""), pa.array(x0), pa.array(y0), pa.array(np.maximum.reduceat(left + width, at) - x0),
            pa.array(np.maximum.reduceat(top + height, at) - y0), pa.array(_upper_medians(confidence, line, count)), pa.ListArray.from_arrays(offsets, spans),
        ],
        ["frame_id", "line_no", "text", "left", "top", "width", "height", "confidence", "spans"],
    )


#: Words that are looked at in one go, if frames are short.
_AT_ONCE = 1 << 16


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    due, last = _AT_ONCE, None
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < due:
            continue
        table = pa.Table.from_batches(held)
        ids = table.column("frame_id").combine_chunks()
        last = ids[-1]
        other = np.flatnonzero((pc.is_valid(ids) if not last.is_valid else pc.fill_null(pc.not_equal(ids, last), True)).to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last frame may go on
        if cut:
            yield _lines_of(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
        due = max(_AT_ONCE, 2 * sum(map(len, held)))  # a long frame isn't put together again with each batch
    if held:
        yield _lines_of(pa.Table.from_batches(held))


def group_lines(words: DataFrame, together: bool = False) -> DataFrame:
    """Lines of each frame's words (frame_id, token_no, text, left, top, width, height, confidence), in Arrow batches; a frame meets in one task.

    ``together`` says that the rows of a frame stand side by side in one partition already, so that words needn't be shuffled.
    """
    cols = [F.col(c).cast(kind).alias(c) for c, kind in (("frame_id", "long"), ("token_no", "long"), ("text", "string"), *((c, "double") for c in _NUMBERS))]
    words = words.select(*cols)
    return (words if together else words.repartition("frame_id").sortWithinPartitions("frame_id")).mapInArrow(_grouped, LINE)


def span_box(spans: Column, start: Column, end: Column, whole: Column) -> Column:
    """The box around the words that [start, end) touches, or the line's if it touches none."""
    hit = F.filter(spans, lambda w: (w["end"] > start) & (w["start"] < end))
    left, top = F.array_min(F.transform(hit, lambda w: w["left"])), F.array_min(F.transform(hit, lambda w: w["top"]))
    right = F.array_max(F.transform(hit, lambda w: w["left"] + w["width"]))
    bottom = F.array_max(F.transform(hit, lambda w: w["top"] + w["height"]))
    return F.when(F.size(hit) > 0, box(left, top, F.greatest(right - left, F.lit(0.0)), F.greatest(bottom - top, F.lit(0.0)))).otherwise(whole)


def flatten_pages(pages: DataFrame) -> DataFrame:
    """Lines of nested pages (frame_id, blocks): line_no, text (the line's or its words', trimmed), confidence, words."""
    lines = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["paragraphs"], lambda p: p["lines"]))))
    rows = pages.select("frame_id", F.posexplode(lines).alias("line_no", "_l"))
    words = F.filter(F.coalesce(F.col("_l.words"), F.array().cast(rows.select("_l.words").schema[0].dataType)), lambda w: w["text"].isNotNull())
    text = F.coalesce(F.col("_l.text"), F.array_join(F.transform(words, lambda w: w["text"]), " "))
    return rows.select("frame_id", "line_no", trim(text).alias("text"), F.coalesce("_l.confidence", F.lit(0.0)).alias("confidence"), words.alias("words"))


def sure_words(words: DataFrame, least: float = 30.0) -> DataFrame:
    return words.where((F.col("confidence") >= least) & (trim(F.col("text")) != ""))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 80, "high").when(confidence >= 50, "medium").otherwise("low")


def full_text(lines: DataFrame) -> DataFrame:
    """The non-empty lines of each frame, joined by newlines, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return lines.where("text <> ''").groupBy("frame_id").agg(F.array_join(ordered, "\n").alias("full_text"))


def stretch(pixels: DataFrame, key: str) -> DataFrame:
    """Grey values (``key``, luma) stretched between their 2nd and 98th percentile: ``key``, low, high, and n pixels at each stretched value.

    Counts of the 256 values are gathered, not pixels.
    """
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("luma")))
    counts = pixels.groupBy(key, F.floor(v).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("v"))
    total = F.sum("n").over(Window.partitionBy(key))
    c = counts.withColumns({"_upto": upto, "_total": total})
    cut = c.groupBy(key).agg(F.min(F.when(F.col("_upto") >= F.col("_total") * 0.02, F.col("v"))).alias("low"), F.min(F.when(F.col("_upto") >= F.col("_total") * 0.98, F.col("v"))).alias("high"))
    scale = 255.0 / F.greatest(F.col("high") - F.col("low"), F.lit(1))
    out = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v") - F.col("low")) * scale))
    return c.join(cut, key).select(key, "low", "high", "v", out.alias("stretched"), "n")


def search_words(words: DataFrame, wanted: str) -> DataFrame:
    """Words that hold ``wanted``, case and outer blanks aside; a blank wish takes all."""
    wanted = wanted.strip().lower()
    return words.where(F.contains(F.lower("text"), F.lit(wanted))) if wanted else words


def mean_confidence(crops: DataFrame, *by: str) -> DataFrame:
    """The mean of the confidences of crops that were read, 0 if none was; and how many were."""
    return crops.groupBy(*by).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.count("confidence").alias("n_crops"))
