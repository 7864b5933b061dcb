"""Fill-in-middle: whole texts cut at two drawn line ends into prefix, middle and suffix, and put together in another order.

The UTF-8 bytes of a text become big integers with a bit for each byte: ``bytes.translate`` marks a class of bytes, a shift by one turns line
ends into line starts, ``bit_count`` counts lines or characters, and the place of the k-th line comes from halving the integer again and
again, counting the bits of the lower half. So no line or character is looked at by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

# Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Texts in a batch that Python gives back.
BATCH = 64
_LINE_ENDS = bytes(49 if b == 10 else 48 for b in range(256))
_CHARACTERS = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))
MADE = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def marked(data: bytes, table: bytes) -> int:
    """Bit i tells whether byte i is in the class that ``table`` maps to the digit 1."""
    return int(data.translate(table)[::-1], 2) if data else 0


def line_starts(data: bytes) -> int:
    """Bits at the first bytes of lines; a line ends after its newline, the last one perhaps without."""
    return (marked(data, _LINE_ENDS) << 1 | 1) & ((1 << len(data)) - 1)


def place_of(bits: int, width: int, k: int) -> int:
    """The place of the bit that has k set bits below it; ``width`` if there are no more than k."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - below, at + half
    return at


def characters(data: bytes, *ends: int) -> list[int]:
    """How many characters end before each of these bytes."""
    bits = marked(data, _CHARACTERS)
    return [(bits & ((1 << e) - 1)).bit_count() for e in ends]


def arranged(data: bytes, h: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n lines, form, characters of prefix and middle, and the text in its new order, by four drawn numbers."""
    starts = line_starts(data)
    n = starts.bit_count()
    if not data or h[2] % 100 >= rate or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = place_of(starts, len(data), a), place_of(starts, len(data), b)
    before, upto = characters(data, a, b)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h[3] % 100 < spm:
        return n, "spm", before, upto - before, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", before, upto - before, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def rebuilt(output: bytes, form: str) -> bytes:
    """The text again; texts that hold a mark are plain, so the first mark of each kind is the one that was put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return b"".join((prefix, middle, suffix))


def _drawn(doc_id: Column, seed: int) -> Column:
    """Four whole numbers below 2^32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            yield batch.slice(at, BATCH)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and any others), then n (lines), form, prefix_chars, middle_chars and output.

    Of 100 documents about ``rate`` are cut, and of these ``spm`` put the suffix first. Prefix ends and middle begins after a drawn number of
    lines between 0 and n, so that each part may be empty. Null and empty texts are plain with an empty output; so are, as they
    stand, texts that hold one of the marks. A null doc_id draws as an empty one; rows that repeat an id draw the same numbers. Columns of
    ``docs`` with a name of the new ones are replaced.
    """
    names = [c for c in docs.columns if c not in MADE and c != "_drawn"]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            found = [arranged(t, h, rate, spm) for t, h in zip(_bytes(part.column("text")), part.column("_drawn").to_pylist(), strict=True)]
            n, form, before, middle, output = ([f[i] for f in found] for i in range(5))
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], [*names, *MADE])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{k} {v}" for k, v in MADE.items())])
    return docs.withColumn("_drawn", _drawn(F.col("doc_id"), seed)).mapInArrow(run, schema)


def restore(cut: DataFrame) -> DataFrame:
    """The columns of ``cut`` (form, output and any others), then restored, the exact text that output was made of."""
    names = [c for c in cut.columns if c != "restored"]
    cut = cut.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            texts = [rebuilt(o, f) for o, f in zip(_bytes(part.column("output")), part.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.binary()).cast(pa.string())], [*names, "restored"])

    return cut.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema), "restored string"]))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, every one cut, half of them with the suffix first."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    cut = restore(fill_in_middle(docs).drop("text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: Lines as lists, joined again.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) x FROM documents),
h AS (SELECT *, len(u) n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) a, greatest(h[1] % (n + 1), h[2] % (n + 1)) b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s FROM c)
SELECT doc_id, n::BIGINT n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) output_sha256, sha256(p || m || s) restored_sha256 FROM p
"""
