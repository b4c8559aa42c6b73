"""Exact encoding and decoding with merge-type (BPE) SentencePiece models.

A text is encoded by backtracking instead of by a merge queue: an Aho-Corasick automaton over the
reachable pieces gives the longest match at each position; a match is appended if it is compatible with
the token before it, which holds when merging their joined text again gives just these two; otherwise its
next shorter prefix is tried; a position from which nothing fits is struck from a bitfield and the last
token is taken back. The first complete sequence found is the model's own segmentation.

Two cuts keep the work small without changing a result: a merge never crosses two neighbouring characters
that no piece holds side by side, so a text falls into independent segments; segments that come again are
taken from bounded caches.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, kept, table, together

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MAX_MODEL_BYTES = 64 << 20
#: entries of a cache's younger half
MAX_CHUNKS, MAX_SEGMENTS, MAX_PAIRS, LONG = 1 << 14, 1 << 17, 3 << 16, 48


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """Field number, wire type and value of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if kind == 1 else "<f", data[at : at + size])[0], at + size
        yield key >> 3, kind, value


class Model:
    """A merge-type SentencePiece model with identity normalisation. Others are refused."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        model_type, self.byte_fallback, self.bos, self.eos, self.unk_surface = 1, False, 1, 2, " ⁇ "
        self.dummy_prefix, squeeze, charsmap = True, True, b""
        for field, _, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, _, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = v
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif field == 2:
                for f, _, v in _fields(value):
                    if f == 3:
                        model_type = v
                    elif f == 35:
                        self.byte_fallback = bool(v)
                    elif f == 41:
                        self.bos = v
                    elif f == 42:
                        self.eos = v
                    elif f == 44:
                        self.unk_surface = v.decode()
            elif field == 3:
                for f, _, v in _fields(value):
                    if f == 2:
                        charsmap = v
                    elif f == 3:
                        self.dummy_prefix = bool(v)
                    elif f == 4:
                        squeeze = bool(v)
        if model_type != 2 or charsmap or squeeze or USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("only merge-type models with identity normalisation and no user-defined or unused pieces are supported")
        self.unk = self.types.index(UNKNOWN)
        self.rank = {p: (-s, i) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types, strict=True)) if t == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces with a space mark after another character are not supported")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.neighbours = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        #: whether a piece could reach over a line's end
        self.newline_joins = any("\n" in p for p in self.neighbours)
        reachable = [p for p in self.rank if len(p) == 1 or self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        known = set(reachable)
        #: length of the longest shorter prefix that is a piece; single characters always stand for themselves
        self.shorter = {p: next((n for n in range(len(p) - 1, 1, -1) if p[:n] in known), 1 if len(p) > 1 else 0) for p in reachable}
        self.surface = [
            b"" if t == CONTROL else self.unk_surface.encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode()
            for p, t in zip(self.pieces, self.types, strict=True)
        ]
        self.fits: dict[str, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.segments: dict[str, bytes] = {}
        self.old_segments: dict[str, bytes] = {}
        self.split = re.compile(" *[^ ]+| +").findall

    def merge(self, text: str) -> list[str]:
        """Segmentation by merging the best-scored neighbours again and again, leftmost first; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        pair = f"{a} {b}"  # a segment holds no space
        got = self.fits.get(pair)
        if got is None:
            if len(self.fits) >= MAX_PAIRS:
                self.fits.clear()
            got = self.fits[pair] = a[-1] + b[0] not in self.neighbours or self.merge(a + b) == [a, b]
        return got

    def backtrack(self, text: str) -> list[str]:
        """The model's segmentation of a segment."""
        n = len(text)
        longest = [1] * n
        for end, size in self.automaton.iter(text):
            start = end + 1 - size
            if size > longest[start]:
                longest[start] = size
        open_at = bytearray(b"\1") * (n + 1)
        out: list[str] = []
        at, size = 0, longest[0]
        while True:
            token = text[at : at + size]
            end = at + size
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, size = end, longest[end]
            elif size > 1:
                size = self.shorter[token]
            else:
                open_at[at] = 0
                last = out.pop()
                at, size = at - len(last), len(last)

    def _ids(self, pieces: list[str]) -> bytes:
        out = array("I")
        for p in pieces:
            known = self.rank.get(p)
            if known:
                out.append(known[1])
            elif self.byte_fallback:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unk)
        return out.tobytes()

    def _segment(self, text: str) -> bytes:
        ids = self.segments.get(text)
        if ids is None:
            ids = self.old_segments.get(text)
            if ids is None:
                ids = self._ids(self.backtrack(text))
            if len(text) <= LONG:
                if len(self.segments) >= MAX_SEGMENTS:
                    self.old_segments, self.segments = self.segments, {}
                self.segments[text] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        text = chunk.replace(" ", SPACE)
        start, parts, neighbours = 0, [], self.neighbours
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in neighbours:
                parts.append(self._segment(text[start:i]))
                start = i
        parts.append(self._segment(text[start:]))
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, without begin and end ids."""
        if not text:
            return b""
        chunks, out = self.chunks, []
        text = text.replace(SPACE, " ")  # the model takes both for the same
        for chunk in self.split(" " + text if self.dummy_prefix else text):
            ids = chunks.get(chunk)
            if ids is None:
                ids = self.old_chunks.get(chunk)
                if ids is None:
                    ids = self._chunk(chunk)
                if len(chunk) <= LONG:
                    if len(chunks) >= MAX_CHUNKS:  # what is still in use comes back from the older half
                        self.old_chunks = chunks
                        chunks = self.chunks = {}
                    chunks[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as encode gives them; null counts as empty.

        The words between single spaces and at line starts are told apart by Arrow, and each different one is
        encoded once. Texts with other runs of spaces or with space marks are encoded one by one.
        """
        texts = pc.fill_null(texts, "")
        if not self.dummy_prefix or self.newline_joins:
            return [np.frombuffer(self.encode(t.as_py()), "<u4") for t in texts]
        slow = pc.match_substring_regex(texts, r"  | \n|\A | \z|\A\z|▁").to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        for i in np.flatnonzero(slow).tolist():
            out[i] = np.frombuffer(self.encode(texts[i].as_py()), "<u4")
        fast = np.flatnonzero(~slow)
        if not len(fast):
            return out
        words = pc.split_pattern(pc.replace_substring(texts.take(pa.array(fast)), "\n", " \n"), " ")
        told = words.flatten().dictionary_encode()
        ids = [self._segment(SPACE + w) if w.isalpha() else self._chunk(w if w.startswith("\n") else " " + w) for w in told.dictionary.to_pylist()]
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(counts) - counts
        code = told.indices.to_numpy()
        size = counts[code]
        ends = np.cumsum(size)
        at = np.repeat((starts[code] - ends + size).astype(np.int32), size)  # a batch has far fewer than 2**31 ids
        at += np.arange(ends[-1], dtype=np.int32)
        found = np.frombuffer(b"".join(ids), "<u4")[at]
        last = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        for i, part in zip(fast.tolist(), np.split(found, ends[last - 1][:-1]), strict=True):
            out[i] = part
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces are empty, the first space mark goes, byte pieces join to characters."""
        data = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        lead = self.dummy_prefix and first is not None and self.types[first] == NORMAL and self.pieces[first].startswith(SPACE)
        try:
            return (data[1:] if lead else data).decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """Each byte of a run that is not part of a character becomes U+FFFD."""
        out: list[str] = []
        run = bytearray()
        seen = False

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                at += size
            run.clear()

        for i in ids:
            if self.types[i] == BYTE:
                run += self.surface[i]
                continue
            flush()
            text = self.surface[i].decode()
            if self.types[i] == NORMAL and not seen and not any(out) and self.dummy_prefix and text.startswith(" "):
                text, seen = text[1:], True
            out.append(text)
        flush()
        return "".join(out)


def model_of(data: bytes) -> Model:
    return kept(__name__, hashlib.sha256(data).hexdigest(), lambda: Model(data))


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
    return data


def encode_decode(docs: DataFrame, model_path: str, bos: bool = True, eos: bool = True) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string) for every row of docs (doc_id, text).

    A null text counts as empty: only the begin and end ids, decoded to the empty text. Rows that repeat
    are encoded each for itself; other columns are not looked at. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        head = struct.pack("<I", model.bos) if bos else b""
        tail = struct.pack("<I", model.eos) if eos else b""
        for batch in together(batches, 4 << 20):
            found = model.encode_batch(batch.column(1))
            for at in range(0, batch.num_rows, 256):
                encoded = [head + ids.tobytes() + tail for ids in found[at : at + 256]]
                decoded = [model.decode(memoryview(e).cast("I").tolist()) for e in encoded]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(encoded, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
