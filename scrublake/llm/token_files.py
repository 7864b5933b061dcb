"""Token-ID output: id arrays compressed one by one with a shared zstandard dictionary, in ordered segments with an offset index.

A segment (one row of the written table, so that any store Spark writes to will do) is ``SLTK``, the version, the bytes of an id, the
SHA-256 of the dictionary, the number of documents n, n + 1 offsets of 8 bytes, and n frames. A document is read by slicing one
frame out. Beside it stand the documents' doc_ids, the segment's place in its partition and the ids before it there.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memory, kept_by_worker, load, materialize

#: The dictionary is trained on so many documents, those of the smallest hashes of doc_id, and on so many bytes of ids of each; bounds of
#: their own, whatever the corpus.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 1 << 15, 1 << 16
LEVEL = 3
#: A segment ends at so many documents or bytes of frames, whichever comes first.
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 4 << 20
#: Bytes of memory for words that a worker remembers from task to task.
REMEMBERED = 192 << 20
#: Text bytes encoded in one go; a longer text is encoded by itself.
PIECE = 8 << 20
_HEAD = struct.Struct("<4sBB32sI")
SEGMENT = "part int, place int, ids_before long, n_ids long, doc_ids array<long>, content binary"
#: Words of plain letters (of Latin 1) may have ASCII signs behind: a token run of their own.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_PROBES = ("hello big world", " two  spaces ", "Line one.\nline\ttwo\r\n", "don't stop, it's '90s", "\u00c9t\u00e9 stra\u00dfe \u4f60\u597d \u3042", "x1 22 3.5% (a+b)", "a \u0301b c\u0301")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, of which each distinct word goes through the tokenizers library once while it is remembered.

    That needs a tokenizer whose rules don't look over white space, which is tried on probe texts first; with another one whole texts go
    through the library. Of words of plain letters with signs behind, the letters in lower case and the signs are encoded
    by themselves, if the tokenizer cuts there and has no case.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = all(one(p) == [i for w in p.encode().split() for i in one(w.decode())] for p in _PROBES)
        self.by_letters = self.by_word and all(one(a + b) == one(a.lower()) + one(b) for a in ("Hello", "\u00c9T\u00c9", "we") for b in (".", "'", "!?", ",\"", "&&&", "'-"))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Memory(REMEMBERED)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, each with ``end`` behind, and where each text's begin (and the last one's end)."""
        if not self.by_word:
            found = self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            ids = [np.array([*e.ids, end], self.dtype) for e in found]
            return np.concatenate(ids or [np.zeros(0, self.dtype)]), np.append(0, np.cumsum([len(x) for x in ids], dtype=np.int64))
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        cut = words.offsets.to_numpy()
        flat = words.values.slice(cut[0], cut[-1] - cut[0]).dictionary_encode()
        size, spelt = self._spelt(flat.dictionary)
        index, cut, begin = flat.indices.to_numpy(), cut - cut[0], np.cumsum(size) - size
        counts = size[index]
        upto = np.append(0, np.cumsum(counts))
        bounds = upto[cut] + np.arange(len(cut))  # with an end for each text before
        out = np.full(int(bounds[-1]), end, self.dtype)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = spelt[_ranges(begin[index], counts)]
        return out, bounds

    def _spelt(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of distinct words, and the ids one after another."""
        if not self.by_letters:
            return self._looked_up(words)
        heads = pc.ascii_rtrim(words, characters=_SIGNS)
        plain = pc.match_substring_regex(heads, _PLAIN)
        parts = (pc.if_else(plain, pc.ascii_lower(heads), words), pc.if_else(plain, pc.utf8_ltrim(words, characters=_LETTERS), ""))
        sizes, starts, spelt, base = [], [], [], 0
        for part in parts:
            coded = part.dictionary_encode()
            size, ids = self._looked_up(coded.dictionary)
            index = coded.indices.to_numpy()
            sizes.append(size[index])
            starts.append((np.cumsum(size) - size)[index] + base)
            spelt.append(ids)
            base += len(ids)
        size = np.stack(sizes, axis=1)
        return size.sum(axis=1), np.concatenate(spelt)[_ranges(np.stack(starts, axis=1).ravel(), size.ravel())]

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known = self.known.look(_bytes_of(words), self._encoded)
        return np.fromiter(map(len, known), np.int64, len(known)) // self.width, np.frombuffer(b"".join(known), self.dtype)

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        if not self.by_letters:
            return self._library(words)
        plain = pc.match_substring_regex(pa.array(words, pa.binary()).cast(pa.string()), _PLAIN).to_pylist()
        some = iter(self._runs([w for w, p in zip(words, plain, strict=True) if p]))
        others = iter(self._library([w for w, p in zip(words, plain, strict=True) if not p]))
        return [next(some if p else others) for p in plain]

    def _library(self, words: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 4096):
            found = self.tokenizer.encode_batch([w.decode() for w in words[at : at + 4096]], add_special_tokens=False)
            out += [np.array(e.ids, self.dtype).tobytes() for e in found]
        return out

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs of letters, many in one text: each ends at a piece that ends a word."""
        out = []
        for at in range(0, len(runs), 256):
            part = runs[at : at + 256]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                out += self._library(part)
                continue
            raw, stops = ids.tobytes(), (stops * self.width).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1 and so on, ``size`` of each, one range after another."""
    upto = np.cumsum(size)
    return np.repeat(begin - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)


def _bytes_of(strings: pa.Array) -> list[bytes]:
    """Like to_pylist, without an object for each scalar; no nulls."""
    strings = strings.cast(pa.large_string())
    if not len(strings):
        return []
    at = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    raw = memoryview(strings.buffers()[2] or b"")[at[0] : at[-1]].tobytes()
    at = (at - at[0]).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return kept_by_worker(("tokens", path), lambda: WordEncoder(path))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end: int):
    """For pieces of batches: the piece, its ids and where each text's begin."""
    words = encoder(path)
    for batch in batches:
        sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + PIECE, "right")) - 1)
            part = batch.slice(at, to - at)
            yield part, *words.encode(part.column("text"), end)
            at = to


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from serialized id arrays. Too few to train on (some dozens of documents) make a dictionary of plain content, which is
    as valid in the format: their own last bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    """Of no bytes (an empty table): none."""
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _samples(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, bounds in _encoded(batches, path, end):
            raw = [ids[a:b].tobytes()[:SAMPLE_BYTES] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "ids"])

    return run


def _frames(path: str, end: int, dictionary: bytes):
    """doc_id, n_ids and the frame of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _dictionary(dictionary)
        if shared is not None:
            shared.precompute_compress(level=LEVEL)  # once, not for each document
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        for part, ids, bounds in _encoded(batches, path, end):
            frames = [press.compress(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(frames, pa.binary())], ["doc_id", "n_ids", "frame"])

    return run


def segment_bytes(frames: list[bytes], width: int, digest: bytes) -> bytes:
    offsets = np.append(0, np.cumsum([len(f) for f in frames])).astype("<u8")
    return _HEAD.pack(b"SLTK", 1, width, digest, len(frames)) + offsets.tobytes() + b"".join(frames)


def _packed(width: int, digest: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        frames: list[bytes] = []
        total = held = 0

        def segment() -> pa.RecordBatch:
            content = segment_bytes(frames, width, digest)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()), "ids_before": pa.array([before], pa.int64()),
                "n_ids": pa.array([total], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "content": pa.array([content], pa.binary()),
            })

        for batch in batches:
            for i, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "frame")), strict=True):
                ids.append(i)
                frames.append(frame)
                total += n
                held += len(frame)
                if len(frames) >= SEGMENT_DOCS or held >= SEGMENT_BYTES:
                    yield segment()
                    place, before = place + 1, before + total
                    ids, frames, total, held = [], [], 0, 0
        if frames:
            yield segment()

    return run


def documents_of(content: bytes, dictionary: bytes) -> Iterator[np.ndarray]:
    """Id arrays of a segment. Raises an error if the dictionary isn't the one it was written with."""
    magic, version, width, digest, n = _HEAD.unpack_from(content)
    if magic != b"SLTK" or version != 1:
        raise ValueError("not a token segment")
    if digest != hashlib.sha256(dictionary).digest():
        raise ValueError("another dictionary")
    offsets = np.frombuffer(content, "<u8", n + 1, _HEAD.size)
    base = _HEAD.size + 8 * (n + 1)
    out = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.frombuffer(out.decompress(content[base + a : base + b]), "<u2" if width == 2 else "<u4")


def document_at(content: bytes, i: int, dictionary: bytes) -> np.ndarray:
    """The ids of one document of a segment, without touching the others."""
    _, _, width, _, n = _HEAD.unpack_from(content)
    a, b = struct.unpack_from("<QQ", content, _HEAD.size + 8 * i)
    base = _HEAD.size + 8 * (n + 1)
    raw = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(content[base + a : base + b])
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def write_tokens(docs: DataFrame, path: str | None = None, end: int = 1) -> tuple[DataFrame, DataFrame]:
    """Encode ``docs`` (doc_id, text) and write segments in ascending doc_id order (nulls first) and the dictionary, to the shared
    folder; returns both tables.

    A null or empty text has the end id alone. Rows that repeat an id stand side by side. Other columns are not written. A huge word is
    encoded like others, but not remembered. The dictionary comes from a bounded sample that depends on the rows alone;
    tables too small to train one on get plain content, empty ones none.
    """
    path = path or default_tokenizer()
    docs = docs.select("doc_id", "text")
    key = F.xxhash64("text").alias("_text")
    chosen = docs.where("doc_id is not null").select("doc_id", key).orderBy(F.xxhash64("doc_id"), "doc_id", "_text").limit(SAMPLE_DOCS).distinct()
    sample = docs.withColumn("_text", key).join(F.broadcast(chosen), ["doc_id", "_text"]).dropDuplicates(["doc_id", "_text"])  # SAMPLE_DOCS rows
    sample = sample.select("doc_id", "text").mapInArrow(_samples(path, end), "doc_id long, ids binary")
    raw = trained_dictionary([bytes(r.ids) for r in sample.orderBy("doc_id", "ids").collect()])  # SAMPLE_DOCS * SAMPLE_BYTES at most
    table = materialize(docs.sparkSession.createDataFrame([(hashlib.sha256(raw).hexdigest(), bytearray(raw))], "sha256 string, dictionary binary"), "dictionary")
    frames = materialize(docs.mapInArrow(_frames(path, end, raw), "doc_id long, n_ids long, frame binary"), "frames")
    placed = frames.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_ids", "frame")
    segments = placed.mapInArrow(_packed(encoder(path).width, hashlib.sha256(raw).digest()), SEGMENT)
    return materialize(segments, "tokens"), table


def _unpacked(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ids, content in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "content")), strict=True):
                counts, sums = [], []
                for x in documents_of(content, dictionary):
                    counts.append(len(x))
                    sums.append(zlib.crc32(x.astype("<u4").tobytes()))
                starts = start + np.append(0, np.cumsum(counts))[:-1]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                })

    return run


def read_tokens(segments: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per document, from the written segments: doc_id, start, n_tokens, ids_crc32."""
    raw = bytes(dictionary.first()["dictionary"])
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))  # a row for each partition
    placed = segments.join(F.broadcast(parts), "part").select((F.col("_before") + F.col("ids_before")).alias("start"), "doc_ids", "content")
    return placed.mapInArrow(_unpacked(raw), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and read back."""
    return read_tokens(*write_tokens(load(spark, sf_dir, "documents")))
