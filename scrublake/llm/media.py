"""Media columns: bytes stored as lossless WebP images, and pixel arrays read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import webp
from .common import load

#: Samples in a row; payloads are padded with bytes 255 to a positive multiple of it.
ROW = 576
_IMAGE = ROW * webp.MAX_SIDE
#: Bytes of texts whose media are written in one go.
SLICE_BYTES = 1 << 23


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % ROW or (0 if raw else ROW))


def store(payload: bytes) -> bytes:
    """The payload as grey images of ROW samples a line, one file after another if it needs over 16,384 lines.

    Each image has the transforms that suit it best and back-references to whatever stood before.
    """
    out = []
    for at in range(0, len(payload), _IMAGE):
        grey = np.frombuffer(payload, np.uint8, min(_IMAGE, len(payload) - at), at).astype(np.uint32)
        out.append(webp.smallest(grey * np.uint32(0x10101) | np.uint32(webp.BLACK), ROW))
    return b"".join(out)


def images(media: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """Width, height and ARGB pixels of each file in ``media``."""
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield webp.decode(media[at : at + size])
        at += size


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Places at which a column is cut: 256 rows or SLICE_BYTES at most, one row at least."""
    at = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > at and (i - at == 256 or held + n > SLICE_BYTES):
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for at, end in _slices(column):
            sizes, media = [], []
            for v in column[at:end]:
                raw = (v.as_py() or "").encode()
                sizes.append(len(raw))
                media.append(store(payload_of(raw)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at:end], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, padded to a positive multiple of ROW, as lossless WebP.

    A null or empty text is one line of padding. Equal texts have equal media; repeated rows stay. Other columns are
    not looked at.
    """
    return docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, v in enumerate(batch.column("media")):
            found = list(images(v.as_py())) if v.is_valid else []
            rows = [{"width": w, "height": h, "pixels": px.view(np.int32)} for w, h, px in found]
            yield pa.RecordBatch.from_pydict({c: batch.column(c)[i : i + 1] for c in batch.schema.names} | {"images": pa.array([rows], _IMAGES)})


_IMAGES = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int32()))]))


def decode_media(df: DataFrame) -> DataFrame:
    """``df`` (with a binary column media) with the images' widths, heights and ARGB pixel arrays; null media: none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop("images").schema)
    return df.drop("images").mapInArrow(_decoded, f"{fields}, images array<struct<width int, height int, pixels array<int>>>")


def features(width: int, height: int, grey: np.ndarray) -> str:
    """Size, mean grey in thousandths, and which of 64 equal stretches of samples are lighter than the mean."""
    means = grey.reshape(64, -1).mean(axis=1)
    light = np.packbits(means > means.mean()).tobytes().hex()
    return f"{width}x{height} {int(grey.mean(dtype=np.float64) * 1000 + 0.5)} {light}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for v in batch.column("media"):
            media = v.as_py()
            grey = np.concatenate([px.astype(np.uint8) for _, _, px in images(media)])
            raw = grey.tobytes()
            rows.append((
                len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(ROW, len(raw) // ROW, grey),
            ))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names]
        )


def read_texts(stored: DataFrame) -> DataFrame:
    """Digests and features of what ``store_texts`` stored, from the decoded pixels."""
    return stored.mapInArrow(
        _read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, stored and read back."""
    return read_texts(store_texts(load(spark, sf_dir, "documents")))


def pixels_sha256(px: np.ndarray) -> str:
    """Of the pixels' numbers, as signed ones, comma-joined."""
    told = hashlib.sha256()
    for at in range(0, len(px), 1 << 16):
        values, place = np.unique(px[at : at + (1 << 16)], return_inverse=True)
        names = np.array([f",{v}" for v in values.view(np.int32).tolist()], "S12").view(np.uint8).reshape(-1, 12)[place]
        told.update(names[names > 0].tobytes()[0 if at else 1 :])
    return told.hexdigest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (i, no, w, h, pixels_sha256(px)) for i, v in enumerate(batch.column("media")) for no, (w, h, px) in enumerate(images(v.as_py()) if v.is_valid else ())
        ]
        at, *cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "image_no", "width", "height", "pixels_sha256"]
        )


def webp_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of all documents' stored images: doc_id, image_no (from 0), width, height, and a digest of the ARGB numbers, comma-joined.

    Digests are made beside the decoded pixels, so that no array of numbers becomes one of texts in the JVM; ``decode_media`` gives the arrays.
    """
    stored = store_texts(load(spark, sf_dir, "documents"))
    return stored.mapInArrow(_digested, "doc_id long, image_no int, width int, height int, pixels_sha256 string")


#: Pixels straight from the texts' bytes.
WEBP_PIXELS_SQL = f"""
WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') b FROM documents),
p AS (SELECT doc_id, list_concat(b, list_transform(range(CASE WHEN len(b) = 0 THEN {ROW} ELSE (-len(b) % {ROW} + {ROW}) % {ROW} END), lambda i: 'FF')) b FROM b),
i AS (SELECT doc_id, unnest(range((len(b) - 1) // {_IMAGE} + 1)) no, b FROM p),
x AS (SELECT doc_id, no, b[no * {_IMAGE} + 1 : (no + 1) * {_IMAGE}] b FROM i)
SELECT doc_id, no::INTEGER image_no, {ROW} width, (len(b) // {ROW})::INTEGER height,
  sha256(array_to_string(list_transform(b, lambda v: ('0x' || v)::INTEGER * 65793 - 16777216), ',')) pixels_sha256 FROM x
"""
