"""Token ids in files compressed by a Re-Pair grammar, with random access to each document.

A shard is a run of documents in doc_id order. In each round the pairs of neighbouring symbols inside a
document are counted, every pair that occurs often enough becomes a nonterminal, and its occurrences that
don't overlap are replaced; rounds go on until no pair is frequent, a round gains little, or the symbol
space is full. A shard
stores the rules, the expansion length of each nonterminal and, for each document, where its symbols and
its ids start, so that one document is decoded without the others.

Container (one binary value a shard, little-endian): magic, then the counts, then the arrays of `FIELDS`.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import in_batches, kept, shared_path, table, together

MAGIC = b"RPG2"
FIELDS = ("doc_id", "symbols_at", "ids_at", "left", "right", "length", "symbols")
MAX_TOKENIZER_BYTES = 64 << 20
#: ids in a shard, unless one document alone has more
SHARD_IDS = 1 << 21
MIN_COUNT = 12
MAX_ROUNDS = 12
#: a round that shortens the sequence by less than this share is the last
MIN_GAIN = 0.01
MAX_CHUNKS, MAX_WORDS, LONG = 5 << 18, 1 << 18, 48


class ByteBpe:
    """Encodes as the tokenizers library does with a byte-level BPE file, with the library's model called once for each distinct word.

    A text is cut before each single space between two characters that are not white space: there the
    pre-tokenizer always starts a new word, whatever stands around. The file's added tokens are cut out before,
    those that the library seeks in the text as it stands first.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
        self.tokenizer = Tokenizer.from_str(text)
        added = [a for a in spec.get("added_tokens") or [] if a["content"]]
        if any(a.get(flag) for a in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on the text around them are not supported")
        self.added = {a["content"]: struct.pack("<I", a["id"]) for a in added}
        groups = [sorted((a["content"] for a in added if a.get("normalized", True) == late), key=len, reverse=True) for late in (False, True)]
        self.cuts = [regex.compile(f"({'|'.join(map(regex.escape, g))})").split for g in groups if g]
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 in order
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in printable else next(rest)) for b in range(256)}
        self.latin = str.maketrans({chr(b): c for b, c in self.alphabet.items()})
        # the byte-level pre-tokenizer's published pattern (fixed value)
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.double = regex.compile(r"\s\s|^\s|\s$").search
        self.between = regex.compile(r"(?<=\S) (?=\S)")
        self.plain = _Chunks(self, "")
        self.spaced = _Chunks(self, " ")
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            spelled = word.encode().decode("latin-1").translate(self.latin)
            tokens = [t.id for t in self.model.tokenize(spelled)]
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
            if len(word) <= LONG:
                if len(self.known) >= MAX_WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        for token in self.added:
            if token in text:
                return self._around(text, 0)
        return self._between(text)

    def _around(self, text: str, k: int) -> bytes:
        if k == len(self.cuts):
            return self._between(text)
        return b"".join([self.added[part] if i % 2 else self._around(part, k + 1) for i, part in enumerate(self.cuts[k](text))])

    def _between(self, text: str) -> bytes:
        if not text:
            return b""
        plain, spaced = self.plain, self.spaced.__getitem__
        if self.double(text):
            first, *rest = self.between.split(text)
            return plain[first] + b"".join(map(spaced, rest))
        newline, out = plain["\n"], []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(plain[first] + b"".join(map(spaced, rest)))
        return newline.join(out)


class Batches:
    """Encodes whole batches: the pieces between cuts are told apart by Arrow, and ids are gathered piece by piece from one table.

    Texts where white space meets white space, stands at an end, or is other than space and newline, texts with
    a full stop or comma between white space and anything but a letter or digit, and texts with an added token
    go through the encoder one by one.
    """

    #: white space at which a text takes the slow way, in RE2's notation (a superset of what the pre-tokenizer calls white space)
    ODD = (
        r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
        r"|[ \n][ \n]|\A[ \n]|[ \n]\z|(?:[^\p{L}\p{N}]|\A)[.,][ \n]|\x00"
    )

    def __init__(self, encoder: ByteBpe):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        #: pieces by number; where each piece's ids start in `flat`, and how many it has
        self.codes: dict[str, int] = {}
        self.starts, self.counts, self.flat = array("q"), array("q"), array("I")

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces not seen before.

        A piece is what follows a space; one that starts a line has its newline before it, one that starts a text
        two. A full stop or comma after a word is a piece of its own, with a zero byte before it.
        """
        e, codes, starts, counts, flat = self.encoder, self.codes, self.starts, self.counts, self.flat
        tokenize, space = e.model.tokenize, e.alphabet[32]
        rest = []
        for p in pieces:
            if p.isalpha():  # one word
                starts.append(len(flat))
                flat.extend([t.id for t in tokenize(space + (p if p.isascii() else p.encode().decode("latin-1").translate(e.latin)))])
                counts.append(len(flat) - starts[-1])
                codes[p] = len(counts) - 1
            else:
                rest.append(p)
        for p in rest:
            text = p[2:] if p.startswith("\n\n") else p if p.startswith("\n") else p[1:] if p.startswith("\0") else " " + p
            at = len(flat)
            for w in (text[:-1], text[-1]) if p[:-1].isalpha() and p[-1] in ".,;:!?" else e.words(text):
                code = codes.get(w[1:]) if w[0] == " " else None
                if code is None:
                    flat.frombytes(e._word(w))
                else:
                    flat.extend(flat[starts[code] : starts[code] + counts[code]])
            starts.append(at)
            counts.append(len(flat) - at)
            codes[p] = len(counts) - 1

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        slow = pc.match_substring_regex(texts, self.ODD)
        for token in self.encoder.added:
            slow = pc.or_(slow, pc.match_substring(texts, token))
        slow = pc.or_(slow, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        for i in np.flatnonzero(slow).tolist():
            out[i] = np.frombuffer(self.encoder.encode(texts[i].as_py()), "<u4")
        fast = np.flatnonzero(~slow)
        if not len(fast):
            return out
        marked = pc.replace_substring(texts.take(pa.array(fast)), "\n", " \n")
        for mark in ".,":
            marked = pc.replace_substring(marked, f"{mark} ", f" \0{mark} ")
        marked = pc.binary_join_element_wise("\n\n", marked, "")
        pieces = pc.split_pattern(marked, " ")
        told = pieces.flatten().dictionary_encode()
        pieces_here = told.dictionary.to_pylist()
        of = list(map(self.codes.get, pieces_here))
        unknown = [i for i, code in enumerate(of) if code is None]
        if len(self.codes) + len(unknown) > MAX_CHUNKS:
            self.clear()
            unknown = range(len(pieces_here))
        if unknown:
            self._learn([pieces_here[i] for i in unknown])
            for i in unknown:
                of[i] = self.codes[pieces_here[i]]
        of = np.array(of, np.int64)
        starts, counts, flat = np.array(self.starts, np.int64), np.array(self.counts, np.int64), np.array(self.flat, np.uint32)
        code = of[told.indices.to_numpy()]
        size = counts[code]
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[code] - ends + size, size) + np.arange(ends[-1])]
        last = pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py()
        for i, part in zip(fast.tolist(), np.split(ids, ends[last - 1][:-1]), strict=True):
            out[i] = part
        return out


class _Chunks(dict):
    """Ids of the text between two cuts, by that text without the space before it."""

    def __init__(self, encoder: ByteBpe, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, chunk: str) -> bytes:
        e = self.encoder
        ids = b"".join([e._word(w) for w in e.words(self.before + chunk)])
        if len(chunk) <= LONG:
            if len(self) >= MAX_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


def _taken(at: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Indices of those of the marked positions (ascending) to replace: no two neighbours, better priority first, runs of one pair from the left."""
    if not len(at):
        return np.empty(0, np.int64)
    near = np.diff(at) == 1
    same = near & (priority[1:] == priority[:-1])
    start = np.ones(len(at), bool)
    start[1:] = ~same
    first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    odd = (np.arange(len(at)) - first) & 1
    keep = odd == 0
    worse_left = np.zeros(len(at), bool)
    worse_left[1:] = near & (priority[1:] > priority[:-1])
    worse_right = np.zeros(len(at), bool)
    worse_right[:-1] = near & (priority[:-1] > priority[1:])
    keep &= ~(worse_left | worse_right)
    kept = np.flatnonzero(keep)
    # a run's last pair may still touch a run that follows with an equal right to it
    clash = np.concatenate(([False], np.diff(at[kept]) == 1))
    return kept[~clash]


def compress(ids: np.ndarray, starts: np.ndarray, min_count: int = MIN_COUNT, max_rounds: int = MAX_ROUNDS) -> dict[str, np.ndarray]:
    """Grammar of one shard. ids: all documents' ids; starts: where each document begins."""
    seq = ids.astype(np.uint32)
    n = len(seq)
    ends = np.zeros(n, bool)
    bounds = np.append(starts, n).astype(np.int64)
    filled = bounds[1:] > bounds[:-1]
    if n:
        ends[bounds[1:][filled] - 1] = True
    first = int(seq.max()) + 1 if n else 0
    room = (1 << 16) - first if first < (1 << 16) else (1 << 32) - 1 - first
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    count, symbols_at = 0, bounds
    bits = 20
    for turn in range(max_rounds):
        if len(seq) < 2 or count >= room:
            break
        # pairs are counted in slots; a slot counts one of its pairs exactly, and another turn deals the pairs out anew
        with np.errstate(over="ignore"):
            slot = (seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] + np.uint32(turn)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)
        slot[ends[:-1]] = 0
        heavy = np.bincount(slot, minlength=1 << bits) >= min_count
        heavy[0] = False
        at = np.flatnonzero(heavy[slot])
        if not len(at):
            break
        slot = slot[at]
        key = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        of_slot = np.zeros(1 << bits, np.uint64)
        of_slot[slot] = key
        own = key == of_slot[slot]
        at, slot = at[own], slot[own]
        times = np.bincount(slot, minlength=1 << bits)
        often = np.flatnonzero(times >= min_count)
        if not len(often):
            break
        best = often[np.argsort(-times[often], kind="stable")][: room - count]
        order = np.full(1 << bits, -1, np.int32)
        order[best] = np.arange(len(best))
        rank = order[slot]
        marked = rank >= 0
        at, rank = at[marked], rank[marked]
        # ranks, not counts, decide, so that every choice is strict
        kept = _taken(at, rank)
        chosen = rank[kept]
        kept = at[kept]
        worth = np.bincount(chosen, minlength=len(best)) >= 3
        if not worth.any():
            break
        name = np.cumsum(worth) - 1
        hit = worth[chosen]
        kept, fresh = kept[hit], chosen[hit]
        new = of_slot[best[worth]]
        left.append((new >> np.uint64(32)).astype(np.uint32))
        right.append((new & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        seq[kept] = (first + count + name[fresh]).astype(np.uint32)
        ends[kept] = ends[kept + 1]
        stay = np.ones(len(seq), bool)
        stay[kept + 1] = False
        shift = np.concatenate(([0], np.cumsum(stay)))
        symbols_at = shift[symbols_at]
        gain = len(kept) / len(seq)
        seq, ends = seq[stay], ends[stay]
        count += int(worth.sum())
        if gain < MIN_GAIN:
            break
    rules = [np.concatenate(x) if x else np.empty(0, np.uint32) for x in (left, right)]
    length = np.ones(first + count, np.uint32)
    at = first
    for a, b in zip(left, right, strict=True):
        length[at : at + len(a)] = length[a] + length[b]
        at += len(a)
    kind = np.uint16 if first + count <= (1 << 16) else np.uint32
    return {
        "symbols_at": symbols_at.astype(np.uint64),
        "ids_at": bounds.astype(np.uint64),
        "left": rules[0].astype(kind),
        "right": rules[1].astype(kind),
        "length": length[first:],
        "symbols": seq.astype(kind),
        "first": np.array([first], np.uint32),
    }


def pack(doc_ids: np.ndarray, grammar: dict[str, np.ndarray], nameless: int = 0) -> bytes:
    """nameless: how many documents at the beginning have no doc_id."""
    arrays = [doc_ids.astype(np.int64), *(grammar[f] for f in FIELDS[1:])]
    head = struct.pack("<4sIII", MAGIC, int(grammar["first"][0]), arrays[-1].itemsize, nameless) + struct.pack(f"<{len(FIELDS)}Q", *(len(a) for a in arrays))
    return head + b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays)


@functools.lru_cache(4)
def _single(count: int) -> tuple[bytes, ...]:
    return tuple(struct.pack("<I", i) for i in range(count))


class Shard:
    """Random access to the documents of a packed shard."""

    def __init__(self, data: bytes):
        magic, self.first, width, self.nameless = struct.unpack_from("<4sIII", data)
        if magic != MAGIC:
            raise ValueError("not a grammar shard")
        sizes = struct.unpack_from(f"<{len(FIELDS)}Q", data, 16)
        at = 16 + 8 * len(FIELDS)
        kinds = ("<i8", "<u8", "<u8", f"<u{width}", f"<u{width}", "<u4", f"<u{width}")
        for name, size, kind in zip(FIELDS, sizes, kinds, strict=True):
            part = np.frombuffer(data, kind, size, at)
            setattr(self, name, part)
            at += part.nbytes
        self._bytes: list[bytes] | None = None

    def __len__(self) -> int:
        return len(self.doc_id)

    def _expansions(self) -> list[bytes]:
        if self._bytes is None:
            out = list(_single(self.first))
            for a, b in zip(self.left.tolist(), self.right.tolist(), strict=True):
                out.append(out[a] + out[b])
            self._bytes = out
        return self._bytes

    def ids(self, k: int) -> bytes:
        """Ids of the k-th document as little-endian unsigned 32-bit integers."""
        lo, hi = int(self.symbols_at[k]), int(self.symbols_at[k + 1])
        return b"".join(map(self._expansions().__getitem__, self.symbols[lo:hi].tolist()))

    def token(self, k: int, j: int) -> int:
        """The j-th id of the k-th document, found through expansion lengths without expanding what stands before it."""
        for s in self.symbols[int(self.symbols_at[k]) : int(self.symbols_at[k + 1])].tolist():
            size = 1 if s < self.first else int(self.length[s - self.first])
            if j >= size:
                j -= size
                continue
            while s >= self.first:
                a = int(self.left[s - self.first])
                size = 1 if a < self.first else int(self.length[a - self.first])
                if j < size:
                    s = a
                else:
                    s, j = int(self.right[s - self.first]), j - size
            return s
        raise IndexError(j)


def _encoder(text: str) -> Batches:
    return kept(__name__, hashlib.sha256(text.encode()).hexdigest(), lambda: Batches(ByteBpe(text)))


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> None:
    """Writes the documents' ids, each document's ended by end_id, to path in ascending doc_id order.

    Parquet files of one row a shard: part (number of the doc_id range), shard (number in it), before
    (ids of the part's earlier shards), docs, ids, body (the packed grammar). A null text counts as empty: the end id alone. Rows that repeat a
    doc_id are all written, in any order among themselves; rows without a doc_id come first. A shard is closed once it holds shard_ids ids.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(text) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} is too large")
    shared = spark.sparkContext.broadcast(text)
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "part int, shard int, before long, docs long, ids long, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        names: list[int | None] = []
        bodies: list[np.ndarray] = []
        shard = held = before = 0

        def flush() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
            ends = np.cumsum(sizes)
            ids = np.concatenate([x for body in bodies for x in (body, end)])
            nameless = sum(name is None for name in names)
            body = pack(np.array([0] * nameless + names[nameless:], np.int64), compress(ids, ends - sizes), nameless)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([body], pa.binary())],
                names=["part", "shard", "before", "docs", "ids", "body"],
            )

        for batch in together(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                names.append(doc_id)
                bodies.append(ids)
                held += len(ids) + 1
                if held >= shard_ids:
                    yield flush()
                    before += held
                    names, bodies, held, shard = [], [], 0, shard + 1
        if names:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(count, "doc_id")
        .sortWithinPartitions("doc_id")
    )
    in_batches(ordered, run, schema).write.parquet(path)


def read_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (binary) of every document of the files."""
    files = spark.read.parquet(path)
    # one number a range of doc_ids; their count is the writer's number of partitions
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    offsets, held = {}, 0
    for part in sorted(totals):
        offsets[part] = held
        held += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before_here, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(body.as_py())
                base = offsets[part] + before_here
                for at in range(0, len(shard), 256):
                    ks = range(at, min(len(shard), at + 256))
                    ids = [shard.ids(k) for k in ks]
                    columns = (
                        [
                            pa.array(shard.doc_id[at : at + 256], pa.int64(), mask=np.arange(at, at + len(ks)) < shard.nameless),
                            pa.array([base + int(shard.ids_at[k]) for k in ks], pa.int64()),
                            pa.array([len(x) // 4 for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        ]
                        + [pa.array(ids, pa.binary())] * with_ids
                    )
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return in_batches(files.select("part", "before", "body"), run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "repair")
    write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_shards(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
