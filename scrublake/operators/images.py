"""Pixels of images held as bytes (red, green, blue, alpha, row by row): model tensors, and grey images stretched for reading.

Geometry is in DataFrame functions; a NumPy kernel in Arrow batches resamples. An image is one row. Images without an id, sizes below one or bytes
that don't fit their size give null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrublake.functions.boxes import box, letterbox, read_scale, source_rect
from scrublake.functions.text import half_up

#: What a letterboxed region stands on.
GREY = 128
#: Images in a batch that Python gives back.
BATCH = 16


def resampled(pixels: np.ndarray, x: int, y: int, w: int, h: int, to_w: int, to_h: int) -> np.ndarray:
    """The region of an image in another size: between the four nearest pixels' centres, held at the region's edges, rounded half up."""

    def places(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(to) + 0.5) * (n / to) - 0.5, 0, n - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, n - 1), at - low

    left, right, t = places(w, to_w)
    upper, lower, u = places(h, to_h)
    part = pixels[y : y + h, x : x + w].astype(np.float64)
    row = lambda rows: part[rows][:, left] * (1 - t)[None, :, None] + part[rows][:, right] * t[None, :, None]
    v = row(upper) * (1 - u)[:, None, None] + row(lower) * u[:, None, None]
    return np.floor(v + 0.5).astype(np.uint8)


def planes(pixels: np.ndarray) -> np.ndarray:
    """Red, green and blue one after another, in [0, 1]."""
    return (pixels[:, :, :3].transpose(2, 0, 1).astype(np.float32) / np.float32(255)).ravel()


def boxed(pixels: np.ndarray, region: tuple[int, int, int, int], size: int, at: tuple[int, int, int, int]) -> np.ndarray:
    """A grey square with the region drawn into ``at`` (left, top, width, height); nothing is drawn where a side rounds to 0."""
    out = np.full((size, size, 3), GREY, np.uint8)
    left, top, w, h = at
    if w > 0 and h > 0:
        drawn = resampled(pixels, *region, w, h).astype(np.int64)
        alpha = drawn[:, :, 3:]
        mixed = np.floor((drawn[:, :, :3] * alpha + GREY * (255 - alpha)) / 255 + 0.5).astype(np.uint8)
        bottom, right = min(size, top + h), min(size, left + w)
        out[top:bottom, left:right] = mixed[: bottom - top, : right - left]
    return out


def _each(images: DataFrame, keep: list[str], make: Callable[[np.ndarray, dict], tuple | None], schema: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``keep`` and what ``make`` gives for an image's pixels and other columns; nulls where it can't be read."""
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                found = []
                for row in part.drop_columns(["rgba"]).to_pylist():
                    raw, w, h = part.column("rgba")[len(found)].as_buffer(), row["width"], row["height"]
                    good = raw is not None and w is not None and h is not None and min(w, h) > 0 and raw.size == 4 * int(w) * int(h)
                    found.append(make(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 4), row) if good else None)
                made = [pa.array([None if f is None else f[i] for f in found], kind) for i, (_, kind) in enumerate(schema.values())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], [*keep, *schema])

    return images.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{k} {kind}" for k, (kind, _) in schema.items())]))


def _tensor_of(images: DataFrame, make) -> DataFrame:
    return _each(images, ["frame_id", "letterbox"], make, {"tensor": ("array<float>", pa.list_(pa.float32()))})


def letterboxed(images: DataFrame, size: int) -> DataFrame:
    """Tensors of regions: frame_id, letterbox (source, scale, pad_x, pad_y, content_width, content_height), tensor (3 * size * size).

    ``images`` has frame_id, width, height, rgba and perhaps region (left, top, width, height); without, the whole image is the region. The
    region is cut to the image, fitted into the square keeping its shape, and centred on grey.
    """
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    region = F.col("region") if "region" in images.columns else box(F.lit(0.0), F.lit(0.0), w, h)
    cut = images.select("frame_id", "width", "height", "rgba", source_rect(region, w, h).alias("_r"))
    cut = cut.withColumn("_l", letterbox(F.col("_r"), float(size)))
    whole = lambda x: half_up(x).cast("int")
    at = F.array(*(whole(F.col(f"_l.{c}")) for c in ("pad_x", "pad_y", "content_width", "content_height"))).alias("_at")
    cut = cut.select("frame_id", F.struct(F.col("_r").alias("source"), "_l.*").alias("letterbox"), "width", "height", "rgba", at, F.array(*(whole(F.col(f"_r.{c}")) for c in ("left", "top", "width", "height"))).alias("_of"))
    return _tensor_of(cut, lambda pixels, row: (planes(boxed(pixels, row["_of"], size, row["_at"])),))


def stretched(images: DataFrame, width: int, height: int) -> DataFrame:
    """Tensors of whole images in another size, whatever their shape; the letterbox has no padding and a scale of 1."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    whole = box(F.lit(0.0), F.lit(0.0), w, h)
    region = source_rect(F.col("region") if "region" in images.columns else whole, w, h)
    none = {"scale": 1.0, "pad_x": 0.0, "pad_y": 0.0, "content_width": float(width), "content_height": float(height)}
    rows = images.select("frame_id", F.struct(region.alias("source"), *(F.lit(v).alias(k) for k, v in none.items())).alias("letterbox"), "width", "height", "rgba")
    return _tensor_of(rows, lambda pixels, row: (planes(resampled(pixels, 0, 0, pixels.shape[1], pixels.shape[0], width, height)),))


def cropped(images: DataFrame, width: int, height: int) -> DataFrame:
    """Regions letterboxed into a square; a size that is no square stretches the whole image."""
    return letterboxed(images, width) if width == height else stretched(images, width, height)


def percentiles(grey: np.ndarray) -> tuple[int, int]:
    """The values at which two and 98 hundredths of the pixels are reached."""
    upto = np.cumsum(np.bincount(grey.ravel(), minlength=256))
    return int(np.argmax(upto >= grey.size * 0.02)), int(np.argmax(upto >= grey.size * 0.98))


def _readable(pixels: np.ndarray, row: dict) -> tuple:
    """First the histogram of the resampled image's brightness, then each pixel stretched between its percentiles."""
    to_w, to_h = (max(1, int(np.floor(n * row["_scale"] + 0.5))) for n in (pixels.shape[1], pixels.shape[0]))
    drawn = resampled(pixels, 0, 0, pixels.shape[1], pixels.shape[0], to_w, to_h).astype(np.int64)
    thousandths = drawn[:, :, 0] * 299 + drawn[:, :, 1] * 587 + drawn[:, :, 2] * 114
    low, high = percentiles(thousandths // 1000)
    v = np.rint((np.rint(thousandths / 1000) - low) * (255 / max(1, high - low)))  # both are held as bytes, rounded half to even
    out = np.empty((to_h, to_w, 4), np.uint8)
    out[:, :, :3] = np.clip(v, 0, 255).astype(np.uint8)[:, :, None]
    out[:, :, 3] = 255
    return to_w, to_h, low, high, out.tobytes()


def readable(images: DataFrame, asked: Column | None = None, edge: float = 2800.0) -> DataFrame:
    """Images as a recogniser reads them: frame_id, width, height, low, high, rgba: grey, stretched between the 2nd and 98th percentile of
    brightness, opaque. The scale is the one ``asked`` for, or fits the longer side to ``edge``; between 0.5 and 4."""
    asked = F.lit(None).cast("double") if asked is None else asked
    rows = images.select("frame_id", "width", "height", "rgba", read_scale(asked, F.col("width").cast("double"), F.col("height").cast("double"), edge).alias("_scale"))
    made = {"w": ("int", pa.int32()), "h": ("int", pa.int32()), "low": ("int", pa.int32()), "high": ("int", pa.int32()), "grey": ("binary", pa.binary())}
    return _each(rows, ["frame_id"], _readable, made).withColumnsRenamed({"w": "width", "h": "height", "grey": "rgba"})
