"""Boxes: overlap, mapping between images, models and viewports. Boxes are structs of left, top, width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up


def _sides(a: Column, b: Column) -> tuple[Column, Column]:
    w = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    return w, h


def area(a: Column) -> Column:
    return a["width"] * a["height"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap."""
    w, h = _sides(a, b)
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / (area(a) + area(b) - w * h))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 without overlap or area."""
    w, h = _sides(a, b)
    least = F.least(area(a), area(b))
    return F.when((w <= 0) | (h <= 0) | (least <= 0), 0.0).otherwise(w * h / least)


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"))


def clamped(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo) if not isinstance(lo, Column) else lo, F.least(hi, x))


def viewport_box(b: Column, width: Column, height: Column) -> Column:
    """Rounded and cut to the viewport."""
    left, top = clamped(half_up(b["left"]), 0.0, width), clamped(half_up(b["top"]), 0.0, height)
    right, bottom = clamped(half_up(b["left"] + b["width"]), 0.0, width), clamped(half_up(b["top"] + b["height"]), 0.0, height)
    return box(left, top, F.greatest(right - left, F.lit(0.0)), F.greatest(bottom - top, F.lit(0.0)))


def source_rect(b: Column, width: Column, height: Column) -> Column:
    """A region cut to an image of at least one pixel."""
    x, y = clamped(half_up(b["left"]), 0.0, width - 1), clamped(half_up(b["top"]), 0.0, height - 1)
    return box(x, y, clamped(half_up(b["width"]), 1.0, width - x), clamped(half_up(b["height"]), 1.0, height - y))


def letterbox(b: Column, size: float) -> Column:
    """Scale and padding that fit a region into a square of ``size``."""
    scale = F.least(size / b["width"], size / b["height"])
    w, h = b["width"] * scale, b["height"] * scale
    return F.struct(scale.alias("scale"), ((size - w) / 2).alias("pad_x"), ((size - h) / 2).alias("pad_y"), w.alias("content_width"), h.alias("content_height"))


def unletterboxed(x0: Column, y0: Column, x1: Column, y1: Column, region: Column, size: float) -> Column:
    """A normalised model box in the image's pixels; null in the padding or up to a pixel wide or high."""
    f = letterbox(region, size)
    a, b, c, d = x0 * size - f["pad_x"], y0 * size - f["pad_y"], x1 * size - f["pad_x"], y1 * size - f["pad_y"]
    outside = (c <= 0) | (d <= 0) | (a >= f["content_width"]) | (b >= f["content_height"])
    cut = lambda v, side: clamped(v, 0.0, f[side]) / f["scale"]
    x, y = cut(a, "content_width"), cut(b, "content_height")
    w, h = cut(c, "content_width") - x, cut(d, "content_height") - y
    return F.when(~outside & (w > 1) & (h > 1), box(region["left"] + x, region["top"] + y, w, h))


def axis_positions(total: Column, tile: float, step: float) -> Column:
    """Offsets of tiles along a side; the last one is flush with its end."""
    last = total - tile
    count = F.ceil(last / step).cast("int")
    inner = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i * F.lit(float(step)))
    return F.when(total <= tile, F.array(F.lit(0.0))).otherwise(F.array_distinct(F.concat(inner, F.array(last))))


def read_scale(asked: Column, width: Column, height: Column, edge: float = 2800.0) -> Column:
    """The scale at which an image is read: the one asked for, if finite and above 0, else such that its longer side, of 1 at least, fits;
    between 0.5 and 4."""
    fit = F.lit(edge) / F.greatest(width, height, F.lit(1.0))
    good = (asked > 0) & ~F.isnan(asked) & (asked < float("inf"))
    return clamped(F.when(good, asked).otherwise(fit), 0.5, F.lit(4.0))


def percent_of(b: Column, width: Column, height: Column) -> Column:
    """A box in hundredths of a viewport."""
    return box(b["left"] / width * 100, b["top"] / height * 100, b["width"] / width * 100, b["height"] / height * 100)


def scaled(b: Column, sx: Column, sy: Column, dx: Column | None = None, dy: Column | None = None) -> Column:
    """An image's box in the viewport's pixels: corner and size are scaled and rounded one by one, the corner after moving it."""
    zero = F.lit(0.0)
    left, top = half_up(b["left"] * sx + (dx if dx is not None else zero)), half_up(b["top"] * sy + (dy if dy is not None else zero))
    return box(left, top, half_up(b["width"] * sx), half_up(b["height"] * sy))


def at_least(b: Column, side: float) -> Column:
    """Whether a box is ``side`` pixels wide and high."""
    return (b["width"] >= side) & (b["height"] >= side)


def viewport(width: Column, height: Column, ratio: Column) -> Column:
    """A viewport's size and pixel ratio, with fallbacks for what isn't known."""
    return F.struct(F.coalesce(width, F.lit(1280.0)).alias("width"), F.coalesce(height, F.lit(800.0)).alias("height"), F.coalesce(F.nullif(ratio, F.lit(0.0)), F.lit(1.0)).alias("device_pixel_ratio"))
