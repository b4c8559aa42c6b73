"""HyperMinHash near-duplicate detection over word shingles.

A document's words are the runs of bytes other than space and 0x09-0x0D after lower-casing A-Z; its set
holds the distinct shingles of k words (with fewer words the whole sequence is the one shingle). Each
shingle hash selects one of m buckets; a bucket keeps its least hash as a register of a leading-zero
count and mantissa bits (HyperMinHash). Bands of registers propose candidates.

What is asked for are components, so links inside a component need not all be found:

1. Copies with equal sets collapse to one representative before banding.
2. In each band bucket the member that meets most others in all its buckets is the hub. Every document is
   held against the two hubs that it meets most often. What links with a hub is in its component.
3. Only pairs of different components are left. Buckets of at most SMALL members list theirs. For larger
   ones the shingles that occur in more than one component are counted: a set of n shingles of which u
   occur in its own component alone shares at most n - u with any set of another, and two sets at the
   threshold share one of their rarest shingles (prefix filter). A pair whose rarest common shingle is in at
   most RARE documents is proposed by that shingle; any other pair shares none of both sets' shingles up to
   that frequency, and is proposed by its first common bucket if what then remains could suffice.

All proposed pairs are screened by the collision-corrected Jaccard estimate of the registers and confirmed on
the full sets. No bucket is capped. Two chances of a lost link remain, both of sampling: that no band
agrees, (1 - s**rows)**bands for similarity s, and that the estimate lies five standard deviations under the
threshold (3e-7).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_ids, components, cut, in_batches, spread_join, table

#: members of a band bucket up to which its pairs are listed
SMALL = 24
#: hubs that a document is held against before the remaining pairs are sought
HUBS = 2
#: documents up to which a common shingle proposes its pairs
RARE = 16
MANTISSA = 10
EMPTY = 0xFFFF
MAX_WORDS_CACHED = 1 << 17

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS_CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    if not text:
        return np.empty(0, np.uint64)
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    size = min(n, k)
    with np.errstate(over="ignore"):
        h = np.full(n - size + 1, size, np.uint64)
        for j in range(size):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + ids[j : n - size + 1 + j])
    return np.unique(h)


def registers(shingles: np.ndarray, m: int) -> np.ndarray:
    """HyperMinHash registers, uint16: leading zeros (6 bits) of a bucket's least hash, then its mantissa; EMPTY without one."""
    out = np.full(m, EMPTY, np.uint16)
    if not len(shingles):
        return out
    with np.errstate(over="ignore"):
        h = _mix(shingles + _U(0x632BE59BD9B4E019))
    bucket = ((h >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    with np.errstate(over="ignore"):
        rest = _mix(h ^ _U(0xD6E8FEB86659FD93))
    low = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, bucket, rest)
    used = np.unique(bucket)
    x = low[used]
    top = np.floor(np.log2(np.maximum(x, _U(1)).astype(np.float64))).astype(np.int64)
    top = np.where((x >> np.minimum(top, 63).astype(np.uint64)) == 0, top - 1, top)  # rounding up to the next power of two
    zeros = 63 - top
    shift = top - MANTISSA
    body = np.where(shift >= 0, x >> np.maximum(shift, 0).astype(np.uint64), x << np.maximum(-shift, 0).astype(np.uint64))
    mantissa = body & _U((1 << MANTISSA) - 1)
    out[used] = (zeros.astype(np.uint64) << _U(MANTISSA) | mantissa).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band that has a register in use."""
    part = regs[: bands * rows].reshape(bands, rows).astype(np.uint64)
    used = (part != EMPTY).any(axis=1)
    with np.errstate(over="ignore"):
        h = np.arange(1, bands + 1, dtype=np.uint64)
        for j in range(rows):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + part[:, j] + _U(1))
    return h[used].view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for registers that agree by chance.

    Chance agreement of two different least hashes in a register: both have the same leading-zero count
    (at most 1/3 over the geometric distribution of one hash) and the same mantissa.
    """
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=1)
    n = np.maximum(used.sum(axis=1), 1)
    chance = n / 3 / 2**MANTISSA
    return np.clip((same - chance) / np.maximum(n - chance, 1e-9), 0, 1)


def sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tag (hash of the text), n, set_hi, set_lo (fingerprint of the set), regs (binary)."""
    m = bands * rows
    schema = "doc_id long, tag long, n long, set_hi long, set_lo long, regs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(2):
                s = shingle_set(text.as_py(), k, words)
                hi, lo = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                for column, value in zip(out, (len(s), int(hi), int(lo), registers(s, m).tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())],
                names=["doc_id", "tag", "n", "set_hi", "set_lo", "regs"],
            )

    return in_batches(docs.select("doc_id", "tag", "text"), run, schema)


def _banded(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """key, doc_id: a row for each band of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys = [band_keys(np.frombuffer(r.as_py(), np.uint16), bands, rows) for r in batch.column(1)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(ids, [len(x) for x in keys]))], names=["key", "doc_id"])

    return in_batches(reps.select("doc_id", "regs"), run, "key long, doc_id long")


def _shingles(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, label, s: a row for each shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets: list[np.ndarray] = []
            held = done = 0
            for at in range(len(batch)):
                sets.append(shingle_set(batch.column(2)[at].as_py(), k, words))
                held += len(sets[-1])
                if held >= 1 << 18 or at + 1 == len(batch):
                    sizes = [len(x) for x in sets]
                    of = [np.repeat(batch.column(c).slice(done, len(sets)).to_numpy(), sizes) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(of[0]), pa.array(of[1]), pa.array(np.concatenate(sets).view(np.int64))], names=["doc_id", "label", "s"])
                    sets, held, done = [], 0, at + 1

    return in_batches(texts.select("doc_id", "label", "text"), run, "doc_id long, label long, s long")


def _possible(n: str, u: str, m: str, v: str, threshold: int) -> Column:
    """Whether sets of n and m shingles, of which u and v cannot be shared, could reach the threshold."""
    shared = F.least(F.col(n) - F.col(u), F.col(m) - F.col(v))
    return F.lit(100 + threshold) * shared >= F.lit(threshold) * (F.col(n) + F.col(m))


def _confirm(pairs: DataFrame, known: DataFrame, docs: DataFrame, k: int, threshold: int, m: int) -> DataFrame:
    """src, dst of the pairs whose estimate is not far below the threshold and whose full sets reach it."""
    margin = threshold / 100 - 5 * math.sqrt(threshold / 100 * (1 - threshold / 100) / m)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (4, 5))
            few = np.minimum(batch.column(6).to_numpy(), batch.column(7).to_numpy()) < 4 * m  # registers of small sets depend on each other; those go on to the sets
            yield batch.select([0, 1, 2, 3]).filter(pa.array((estimate(x, y) >= margin) | few))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if last[0] != b:
                    last = (b, shingle_set(tb.as_py(), k, words))
                x, y = shingle_set(ta.as_py(), k, words), last[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name, x: known.select(F.col("doc_id").alias(name), *(F.col(c).alias(f"{c}_{x}") for c in ("tag", "regs", "n")))
    met = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("src", "tag_a", "dst", "tag_b", "regs_a", "regs_b", "n_a", "n_b")
    screened = cut(in_batches(met, screen, "src long, tag_a long, dst long, tag_b long"))
    wanted = screened.select(F.col("src").alias("doc_id"), F.col("tag_a").alias("tag")).unionByName(screened.select(F.col("dst").alias("doc_id"), F.col("tag_b").alias("tag"))).distinct()
    texts = by_ids(docs, wanted, "left_semi").select("doc_id", "text")
    # a hub is a dst: its text joins last and does not travel with every pair
    with_text = screened.join(texts.select(F.col("doc_id").alias("src"), F.col("text").alias("text_a")), "src").join(texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("text_b")), "dst")
    return in_batches(with_text.select("src", "dst", "text_a", "text_b"), run, "src long, dst long")


def _left_over(rows: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """src, dst: pairs of different labels that could reach the threshold. rows: key, members, doc_id, tag, n, label; keys have several labels."""
    t = int(threshold)
    small = rows.where(F.col("members") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n", "label"))).alias("v"))  # at most SMALL
    listed = small.select(
        F.explode(
            F.expr(
                "flatten(transform(v, (x, i) -> transform(filter(slice(v, i + 2, greatest(size(v) - i - 1, 0)),"
                f" y -> x.label != y.label and 100 * least(x.n, y.n) >= {t} * greatest(x.n, y.n)), y -> struct(x.doc_id as src, y.doc_id as dst))))"
            )
        ).alias("p")
    ).select("p.src", "p.dst")

    large = rows.where(F.col("members") > SMALL)
    wide = cut(large.groupBy("doc_id").agg(F.first("tag").alias("tag"), F.first("n").alias("n"), F.first("label").alias("label"), F.array_sort(F.collect_set("key")).alias("keys")))  # at most one a band
    texts = by_ids(docs, wide.select("doc_id", "tag", "label"), "inner", ["doc_id", "tag"])
    each = _shingles(texts, k)
    # shingles of several labels; the rest cannot link different components
    counts = cut(each.groupBy("s").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("s", "c"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    shared = spread_join(each.select("doc_id", "s"), counts, ["s"], "c", total)
    rare = F.col("c") <= RARE
    of_doc = shared.groupBy("doc_id").agg(F.count_if(~rare).alias("often"), F.array_sort(F.collect_list(F.when(rare, F.struct("c", "s")))).alias("rare"))  # at most a text's shingles
    wide = wide.join(of_doc, "doc_id").withColumn("u", F.col("n") - F.col("often") - F.size("rare")).where(f"100 * (n - u) >= {t} * n").withColumn("m", F.col("n") - F.col("often"))
    wide = cut(wide)
    # of the n - ceil(t n) + 1 rarest shingles the u that stand alone come first
    prefix = F.slice("rare", 1, F.greatest(F.col("n") - F.ceil(F.col("n") * t / F.lit(100)).cast("long") + 1 - F.col("u"), F.lit(0)).cast("int"))
    tokens = wide.select("doc_id", "n", "u", "label", F.explode(prefix.getField("s")).alias("s"))
    tokens = cut(tokens.join(tokens.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("s"), "s", "left_semi"))
    side = lambda df, on, columns, x: df.select(on, *(F.col(c).alias(f"{c}_{x}") for c in columns))
    by_token = side(tokens, "s", ("doc_id", "n", "u", "label"), "a").join(side(tokens, "s", ("doc_id", "n", "u", "label"), "b"), "s")
    by_token = by_token.where((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("label_a") != F.col("label_b")) & _possible("n_a", "u_a", "n_b", "u_b", t))

    # no rare shingle in common: what remains of both must suffice; one of the two is outside its bucket's main label
    open_rows = wide.where(f"100 * (n - m) >= {t} * n").select("doc_id", "n", "m", "label", "keys", F.explode("keys").alias("key"))
    main = open_rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("labels"), F.sum("c").alias("here"))
    main = cut(main.where("labels > 1").select("key", F.col("most.label").alias("main"), "here"))
    open_rows = cut(spread_join(open_rows, main, ["key"], "here", main.agg(F.sum("here")).first()[0] or 0))
    columns = ("doc_id", "n", "m", "label", "keys")
    by_key = side(open_rows.where("label != main"), "key", columns, "a").join(side(open_rows, "key", columns, "b"), "key")
    by_key = by_key.where(
        (F.col("label_a") != F.col("label_b")) & _possible("n_a", "m_a", "n_b", "m_b", t) & (F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b")))
    )
    pair = lambda df: df.select(F.least("doc_id_a", "doc_id_b").alias("src"), F.greatest("doc_id_a", "doc_id_b").alias("dst"))
    return listed.unionByName(pair(by_token)).unionByName(pair(by_key)).distinct()


def _one_a_document(sk: DataFrame) -> DataFrame:
    """Of rows that share a doc_id the one with the largest set (of equals the largest fingerprint) stands for it."""
    first = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("set_hi"), F.desc("set_lo"), F.desc("tag"))
    return cut(sk.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k"))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, bands: int = 31, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of docs (doc_id, text).

    threshold: per cent of Jaccard similarity at which two documents are linked. Null, empty and
    white-space-only texts have the empty set, n_shingles 0, and are their own component. Equal sets are
    linked. Rows that share a doc_id are one document, for which the row with the largest set stands. Each
    row without a doc_id is a document of its own: linked with nothing, component_id null, kept. Other columns
    of docs are not looked at. An empty table gives an empty result.
    """
    t = int(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    every = cut(sketch(docs, k, bands, rows))
    docs, sk = docs.where("doc_id is not null"), every.where("doc_id is not null")
    if not sk.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        docs, sk = docs.dropDuplicates(["doc_id", "tag"]), _one_a_document(sk)
    real = sk.where("n > 0")
    reps = real.groupBy("set_hi", "set_lo").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "tag")).alias("r"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    reps = cut(reps.select("r.doc_id", "r.tag", "n", "regs", "set_hi", "set_lo", "copies"))

    # band buckets of two representatives and more
    banded = _banded(reps, bands, rows)
    sizes = cut(banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    total = sizes.agg(F.sum("members")).first()[0] or 0
    hits = spread_join(banded, sizes, ["key"], "members", total)
    met = hits.groupBy("doc_id").agg(F.collect_list(F.struct("key", "members")).alias("keys"), F.sum("members").alias("degree"))  # at most one a band
    known = cut(met.join(reps.select("doc_id", "tag", "n", "regs"), "doc_id"))
    in_bucket = lambda df, *columns: df.select(F.explode("keys").alias("b"), "doc_id", "n", *columns).select("b.key", "b.members", "doc_id", "n", *columns)

    # every document against its hubs
    spokes = in_bucket(known, "degree")
    hubs = spokes.groupBy("key").agg(F.max(F.struct("degree", -F.col("doc_id"), F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"))).alias("h"), F.first("members").alias("members")).select("key", "members", "h.hub", "h.hub_n")
    spokes = spread_join(spokes.select("key", "doc_id", "n"), hubs, ["key"], "members", total).where(f"doc_id != hub and 100 * least(n, hub_n) >= {t} * greatest(n, hub_n)")
    spokes = spokes.groupBy("doc_id", "hub").agg(F.count("*").alias("often")).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(-F.col("often"), "hub"))), 1, HUBS).alias("h"))  # at most one a band
    spokes = spokes.select(F.col("doc_id").alias("src"), F.explode("h.hub").alias("dst"))
    labels = cut(components(_confirm(spokes, known, docs, k, t, bands * rows)))

    # what is left: pairs of different components
    labelled = cut(known.drop("regs").join(labels, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component"))
    open_rows = in_bucket(labelled, "tag", "label")
    mixed = open_rows.groupBy("key").agg(F.first("members").alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key", "members")
    open_rows = cut(spread_join(open_rows.drop("members"), mixed, ["key"], "members", total))
    far = cut(_confirm(_left_over(open_rows, docs, k, t), known, docs, k, t, bands * rows))

    # the last links join whole components
    of = labelled.select("doc_id", "label")
    joined = far.join(of.select(F.col("doc_id").alias("src"), F.col("label").alias("a")), "src").join(of.select(F.col("doc_id").alias("dst"), F.col("label").alias("b")), "dst")
    last = components(joined.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("label"), F.col("component").alias("last"))
    named = reps.drop("regs", "tag").join(of, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")).join(last, "label", "left").withColumn("component_id", F.coalesce("last", "label"))
    named = cut(named.select("doc_id", "n", "set_hi", "set_lo", "copies", "component_id"))
    copies = spread_join(real.select("doc_id", "n", "set_hi", "set_lo"), named.where("copies > 1").select("set_hi", "set_lo", "copies", "component_id"), ["set_hi", "set_lo"], "copies", real.count())
    found = (
        named.where("copies = 1")
        .select("doc_id", "n", "component_id")
        .unionByName(copies.select("doc_id", "n", "component_id"))
        .unionByName(sk.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
        .unionByName(every.where("doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    )
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=85, bands=25, rows=5)
