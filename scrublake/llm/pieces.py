"""SentencePiece encoding and decoding: shared-prefix Viterbi over sorted distinct words.

Text is marked (spaces become U+2581, one goes in front) and cut into words, each with the marks before it; no piece of the vocabulary
reaches from a word's end into the next mark. The distinct words of a batch are sorted, which lays them out as a trie in
depth-first order: of each word, the forward states of the prefix it has in common with the one before are kept, and
only the rest is computed.

Forward states: for a unigram model, the best sum of piece scores up to each place. For a BPE model, whose result isn't the best sum, the
last piece of the encoding of each prefix. A piece may follow another if encoding the two together gives just these two;
exactly one piece ending at a place may follow the encoding of what is before it, so the states need no scores.
A BPE vocabulary can be read as a unigram model too: the piece of rank r then scores -log(r + 2), as its frequency goes by Zipf's law.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LONG_WORD, kept_by_worker, load

MARK = "▁"
#: Words whose ids a worker remembers in each of two memories, from task to task, and as many pairs of pieces; by default.
REMEMBERED = 400_000
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class Vocabulary:
    """Pieces and rules of a model file; ``kind`` UNIGRAM reads a BPE model as a unigram one, with scores by rank."""

    def __init__(self, path: str, kind: int | None = None) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.processor = sp
        with open(path, "rb") as f:
            message = dict(_fields(f.read()))  # the last of repeated pieces is of no use here
        trainer, normalizer = (dict(_fields(message.get(k, b""))) for k in (2, 3))
        self.kind = trainer.get(3, UNIGRAM)
        self.identity = not normalizer.get(2) and not normalizer.get(4, 1)
        self.prefix = bool(normalizer.get(3, 1))
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if kind == UNIGRAM and self.kind != UNIGRAM:
            self.kind, self.scores = UNIGRAM, {p: -math.log(r + 2) for r, p in enumerate(self.ids)}
        self.longest = max(map(len, self.ids))
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        raw = {i: sp.id_to_piece(i).replace(MARK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.bytes.items()}
        spelt = [raw.get(i, b" \xe2\x81\x87 " if i == self.unknown else b"") for i in ids]
        self.raw = np.frombuffer(b"".join(spelt), np.uint8)
        self.raw_size = np.array([len(x) for x in spelt], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        cut = f"[{re.escape(alone)}]|" if alone else ""
        self.word = re.compile(f"{cut}{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over a word's end")

    def marked(self, text: str) -> str:
        if not text:
            return ""
        if not self.identity:
            return self.processor.normalize(text)
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def spelt(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece, or of a single character's bytes."""
        found = self.ids.get(piece)
        if found is not None:
            return (found,)
        return tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,)


class SharedPrefixViterbi:
    """Encodes sorted words, keeping the forward states of common prefixes."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        self.v, self.remembered = vocabulary, remembered
        self.may_follow: dict[tuple[str, str], bool] = {}

    def encode_sorted(self, words: list[str]) -> list[tuple[int, ...]]:
        step = self._bpe_steps if self.v.kind == BPE else self._unigram_steps
        before, state, back, last, out = "", [0.0], [0], [""], []
        for w in words:
            k, top = 0, min(len(before), len(w))
            while k < top and before[k] == w[k]:
                k += 1
            del state[k + 1 :], back[k + 1 :], last[k + 1 :]
            step(w, k + 1, state, back, last)
            ids: list[tuple[int, ...]] = []
            i = len(w)
            while i:
                ids.append(self.v.spelt(w[back[i] : i]))
                i = back[i]
            out.append(tuple(chain.from_iterable(reversed(ids))))
            before = w
        return out

    def _unigram_steps(self, w: str, start: int, state: list, back: list, last: list) -> None:
        """Best sums of the prefixes from ``start`` characters on."""
        for i in range(start, len(w) + 1):
            best, at = None, i - 1
            for j in range(max(0, i - self.v.longest), i):
                s = self.v.scores.get(w[j:i])
                if s is None:
                    if j < i - 1:
                        continue
                    s = self.v.unknown_score
                if best is None or state[j] + s > best:
                    best, at = state[j] + s, j
            state.append(best)
            back.append(at)

    def _bpe_steps(self, w: str, start: int, state: list, back: list, last: list) -> None:
        """Last pieces of the prefixes from ``start`` characters on."""
        known, follows, longest = self.v.ids, self.may_follow, self.v.longest
        for i in range(start, len(w) + 1):
            for j in range(i - longest if i > longest else 0, i):
                piece = w[j:i]
                if piece in known or j == i - 1:
                    left = last[j]
                    yes = follows.get((left, piece))
                    if yes is None:
                        if len(follows) > self.remembered:
                            follows.clear()
                        yes = follows[left, piece] = self.merged(left + piece) == ([left, piece] if left else [piece])
                    if yes:
                        back.append(j)
                        last.append(piece)
                        break
            else:
                raise ValueError("no encoding")

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored neighbours merge first, the left ones of equals."""
        parts, scores = list(text), self.v.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Codec:
    """Texts to ids and back."""

    def __init__(self, path: str, remembered: int = REMEMBERED, kind: int | None = None) -> None:
        self.v, self.remembered = Vocabulary(path, kind), remembered
        self.viterbi = SharedPrefixViterbi(self.v, remembered)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.plain = self.v.identity and self.v.prefix

    def _cut(self, text: str) -> list[str]:
        """Parts that are encoded by themselves: words, each with a mark to come in front; with runs of spaces, marked words as they are."""
        if self.plain and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        return [self.WHOLE + w for w in self.v.word.findall(self.v.marked(text))]

    #: In front of parts that are marked already; no text holds it, as it is no character.
    WHOLE = "\ud800"

    def _marked(self, part: str) -> list[str]:
        return [part[1:]] if part[0] == self.WHOLE else self.v.word.findall(MARK + part)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 256):
            parts = [self._cut(t) for t in texts[at : at + 256]]
            if len(self.known) > self.remembered:  # what is still in use moves on to the next memory
                self.before, self.known = self.known, {}
            new = set(chain.from_iterable(parts)).difference(self.known)
            if self.before:
                again = new.intersection(self.before)
                self.known.update((w, self.before[w]) for w in again)
                new -= again
            if new:
                words = {p: self._marked(p) for p in new}
                distinct = sorted(set(chain.from_iterable(words.values())))
                ids = dict(zip(distinct, (array("i", x).tobytes() for x in self.viterbi.encode_sorted(distinct)), strict=True))
                self.known.update((p, ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))) for p, ws in words.items())
            look = self.known.__getitem__
            out += [np.frombuffer(b"".join(map(look, ps)), np.int32) for ps in parts]
            for p in new:
                if len(p) > LONG_WORD:  # memories are bounded by numbers of short words
                    del self.known[p]
        return out

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        size = self.v.raw_size[ids]
        end = np.cumsum(size)
        at = np.repeat(self.v.raw_start[ids] - end + size, size)
        text = self.v.raw[at + np.arange(len(at))].tobytes()
        if self.v.prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


def codec_of(path: str, remembered: int = REMEMBERED, kind: int | None = None) -> Codec:
    """One codec for all tasks of a worker."""
    return kept_by_worker(("pieces", path, remembered, kind), lambda: Codec(path, remembered, kind))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids = codec.encode([t or "" for t in part.column("text").to_pylist()])
                offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                cols = {c: part.column(c) for c in part.schema.names} | {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
                yield pa.RecordBatch.from_pydict(cols)

    return run


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids, the pieces of the whole text; null and empty texts have none. A column named ids is replaced."""
    docs = docs.drop("ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_encoded(path or default_model()), f"{fields}, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            texts = [codec.decode(v.values.to_numpy()) if v.is_valid else None for v in batch.column("ids")]
            cols = {c: batch.column(c) for c in batch.schema.names} | {"decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def decode_pieces(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` (with ids) with decoded, the text that the ids spell; null ids: null. A column named decoded is replaced."""
    df = df.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_decoded(path or default_model()), f"{fields}, decoded string")


_CHECKED = ("n_pieces", "ids_crc32", "decoded_crc32", "same")


def _round_trips(path: str, with_ids: bool, remembered: int, kind: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, remembered, kind)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                every = codec.encode(texts)
                rows = []
                for text, ids in zip(texts, every, strict=True):
                    decoded = codec.decode(ids)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(decoded.encode()), decoded == text))
                cols = {c: part.column(c) for c in part.schema.names if c != "text"}
                cols |= {n: pa.array(c, t) for n, c, t in zip(_CHECKED, list(zip(*rows, strict=True)) or [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)}
                if with_ids:
                    cols["ids"] = pa.array(every, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = True, remembered: int = REMEMBERED, kind: int | None = None) -> DataFrame:
    """Encode and decode in one go: ``docs`` without text, with n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_crc32
    (UTF-8), whether the decoded text is the text, and the ids. Columns of these names are replaced. ``kind``: as in Vocabulary."""
    docs = docs.drop(*_CHECKED, "ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    out = f"{fields}, n_pieces long, ids_crc32 long, decoded_crc32 long, same boolean" + ", ids array<int>" * with_ids
    return docs.mapInArrow(_round_trips(path or default_model(), with_ids, remembered, kind), out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again."""
    return round_trip(load(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


def unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by best sums of scores, with the same vocabulary read as a unigram model, and decoded again."""
    return round_trip(load(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False, kind=UNIGRAM)
