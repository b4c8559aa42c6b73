"""Toxicity by weak supervision.

Voters look at a text: one for each strong lexicon entry (a word or the start of a word), group voters over
the whole lexicon, pattern voters, and voters for the absence of any entry. A generative label model with one
hidden label estimates by expectation maximisation, over labelled and unlabelled rows alike and without
reading a row's label, how each voter behaves under either label, and the correlations along a maximum
spanning tree of conditional mutual information, so that voters that repeat each other don't count twice.
Labels of training rows pick the lexicon and give each voter's rates to begin with, which weigh as much as
PULL rows; no row's own label enters its posterior otherwise. A linear classifier is trained on the posterior
labels; it alone scores texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, first_by_hash, in_batches, table
from .language_id import held_out

#: rows that training looks at, by label and without one; lexicon entries; voters of single entries
ROWS_PER_LABEL = {0: 3000, 1: 2000}
UNLABELLED_ROWS = 3000
#: share of the toxic training rows that must hold a lexicon entry; rows that a voter's believed rates weigh
SUPPORT, PULL = 0.02, 30.0
MAX_ENTRIES, ENTRY_VOTERS = 1500, 40
STARTS = (4, 5, 6)
MAX_CACHED = 1 << 18
_words = re.compile(r"\w+").findall
_shout = re.compile(r"[!?]{3,}").search
_address = re.compile(r"\b(?:you|your|you're|du|ihr|tu|vous|usted)\b").search


def entries(word: str) -> list[str]:
    """The lexicon entries that a word could match: itself and its starts."""
    return [word, *(f"{word[:n]}*" for n in STARTS if len(word) > n)]


@dataclass
class Model:
    lexicon: dict[str, int]
    weights: np.ndarray
    extra: np.ndarray
    bias: float


class _Matches(dict):
    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MAX_CACHED:
            self.clear()
        found = self[word] = tuple(self.lexicon[e] for e in entries(word) if e in self.lexicon)
        return found


def look(text: str, matches: _Matches) -> tuple[list[int], list[float]]:
    """Distinct lexicon entries of a text, and the further features: share of matching words, their number, patterns."""
    words = _words(text.lower())
    hits = [m for m in map(matches.__getitem__, words) if m]
    found = sorted({i for m in hits for i in m})
    return found, [min(1.0, 20 * len(hits) / max(1, len(words))), min(len(hits), 8) / 8, float(bool(_shout(text))), float(bool(_address(text)))]


def votes(found: np.ndarray, extra: np.ndarray, singles: np.ndarray) -> np.ndarray:
    """Rows by voters, 0 or 1: whether the voter speaks up."""
    any_entry = found.any(axis=1)
    columns = [found[:, i] for i in singles] + [
        any_entry,
        ~any_entry,
        extra[:, 1] >= 2 / 8,
        extra[:, 1] < 2 / 8,
        found.sum(axis=1) >= 6,
        extra[:, 0] > 0.1,
        extra[:, 2] > 0,
        extra[:, 3] > 0,
    ]
    return np.array(columns, bool).T.astype(np.int64)


def label_model(v: np.ndarray, rates: np.ndarray, prior: float, rounds: int = 25, smooth: float = 0.5, pull: float = PULL) -> tuple[np.ndarray, dict]:
    """Posterior probability of label 1 for each row of votes, and the parameters.

    P(votes | label) factorises along a tree: each voter depends on the label and one other voter. rates
    (voters x 2) holds how often each voter is believed to speak up under either label: they give the first
    posterior, and weigh as much as `pull` rows in what is estimated afterwards. prior: the first share of label 1.
    """
    n, k = v.shape
    speak, hush = np.log(rates), np.log(1 - rates)
    odds = v @ (speak[:, 1] - speak[:, 0]) + (1 - v) @ (hush[:, 1] - hush[:, 0])
    # voters repeat each other: their evidence counts by the square root of their number until the tree is known
    post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + odds / np.sqrt(max(k, 1)), -60, 60)))
    parent = np.full(k, -1)
    cond = np.zeros((k, 2, 2, 2))
    for turn in range(rounds):
        w = np.stack([1 - post, post])
        total = w.sum(axis=1)
        if turn in (0, 5):  # the tree: correlations of the voters given the label
            info = np.zeros((k, k))
            for y in (0, 1):
                one = ((v * w[y][:, None]).T @ v + smooth) / (total[y] + 4 * smooth)
                p = (v.T @ w[y] + 2 * smooth) / (total[y] + 4 * smooth)
                joint = {(1, 1): one, (1, 0): p[:, None] - one, (0, 1): p[None, :] - one, (0, 0): 1 - p[:, None] - p[None, :] + one}
                for (a, b), q in joint.items():
                    pa_, pb = (p if a else 1 - p)[:, None], (p if b else 1 - p)[None, :]
                    q = np.maximum(q, 1e-9)
                    info += total[y] / n * q * np.log(q / (pa_ * pb))
            np.fill_diagonal(info, -1)
            parent[:] = -1
            inside = np.zeros(k, bool)
            inside[k - 1] = True
            best, near = info[k - 1].copy(), np.full(k, k - 1)
            for _ in range(k - 1):
                i = int(np.argmax(np.where(inside, -np.inf, best)))
                inside[i], parent[i] = True, near[i]
                better = info[i] > best
                best, near = np.where(better, info[i], best), np.where(better, i, near)
        log = np.log(np.array([[1 - prior], [prior]])) + np.zeros((2, n))
        for i in range(k):
            state = v[:, parent[i]] if parent[i] >= 0 else np.zeros(n, np.int64)
            for y in (0, 1):
                for s in (0, 1):
                    here = state == s
                    ones = (w[y] * v[:, i])[here].sum()
                    cond[i, y, s, 1] = (ones + smooth + pull * rates[i, y]) / (w[y][here].sum() + 2 * smooth + pull)
                    cond[i, y, s, 0] = 1 - cond[i, y, s, 1]
                log[y] += np.log(cond[i, y, state, v[:, i]])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
    return post, {"parent": parent, "conditional": cond}


def linear(x: np.ndarray, target: np.ndarray, steps: int = 400, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities as targets."""
    n, k = x.shape
    w, b = np.zeros(k, np.float64), 0.0
    m, s = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60)))
        d = (p - target) / max(n, 1)
        g = np.append(x.T @ d + penalty * w, d.sum())
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)


def _sample(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """doc_id, toxic (null: not labelled), text of the training rows, at most ROWS_PER_LABEL and UNLABELLED_ROWS, by a hash of doc_id.

    Rows that share a doc_id are one, with the least of their texts; of several labels the greatest holds.
    """
    y = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    most = docs.sparkSession.createDataFrame([*ROWS_PER_LABEL.items()], "toxic int, most int")
    y = first_by_hash(y, "toxic", most, "most")
    texts = docs.where(allowed).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    ids = texts.select("doc_id").distinct().join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti").withColumn("all", F.lit(1))
    rest = first_by_hash(ids, "all", docs.sparkSession.createDataFrame([(1, UNLABELLED_ROWS)], "all int, most int"), "most")
    chosen = y.unionByName(rest.select("doc_id", F.lit(None).cast("int").alias("toxic")))  # at most the sum of the limits
    return cut(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """A model from the rows that `allowed` (over doc_id) admits; where a label has no row, one that scores 0."""
    rows = _sample(docs, labels, allowed)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted({e for w in set(_words(t.as_py().lower())) for e in entries(w)}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.string()))], names=["toxic", "entries"])

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # three rows
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model({}, np.zeros(0), np.zeros(4), -30.0)
    counts = (
        in_batches(rows.where("toxic is not null").select("toxic", "text"), spell, "toxic int, entries array<string>")
        .select("toxic", F.explode("entries").alias("entry"))
        .groupBy("entry")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    )
    odds = F.log((F.col("a") + 0.5) / (n1 + 1) / ((F.col("b") + 0.5) / (n0 + 1)))
    found = (
        counts.where(F.col("a") >= max(3.0, SUPPORT * n1))
        .withColumn("odds", odds)
        .where(F.col("odds") >= np.log(8))
        .withColumn("worth", F.col("a") * F.col("odds"))
        .orderBy(F.desc("worth"), "entry")
        .limit(MAX_ENTRIES)
        .collect()
    )
    lexicon = {r["entry"]: i for i, r in enumerate(found)}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(lexicon)
        for batch in batches:
            seen = [look(t.as_py(), matches) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for f, _ in seen], pa.list_(pa.int32())), pa.array([x for _, x in seen], pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "found", "extra"],
            )

    seen = in_batches(rows.select("doc_id", "toxic", "text"), match, "doc_id long, toxic int, found array<int>, extra array<double>").collect()
    seen.sort(key=lambda r: r["doc_id"])
    x = np.zeros((len(seen), len(lexicon)), np.float32)
    for i, r in enumerate(seen):
        x[i, r["found"]] = 1
    extra = np.array([r["extra"] for r in seen])
    singles = np.argsort(-x.sum(axis=0), kind="stable")[:ENTRY_VOTERS] if len(lexicon) else np.zeros(0, int)
    v = votes(x > 0, extra, singles)
    gold = np.array([-1 if r["toxic"] is None else r["toxic"] for r in seen])
    rates = np.stack([(v[gold == t].sum(axis=0) + 0.5) / ((gold == t).sum() + 1) for t in (0, 1)], axis=1)
    # from here on no row's label is read
    post, _ = label_model(v, rates, prior=n1 / (n0 + n1))
    w, b = linear(np.column_stack([x, extra]).astype(np.float64), post)
    return Model(lexicon, w[: len(lexicon)], w[len(lexicon) :], b)


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of docs, then those of names: score (0 to 1) and label (1 from 0.5 on). Null and empty texts are scored as texts without words.

    Columns of docs that have these names give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in names]
    schema = docs.select(*columns).schema.add(names[0], "double").add(names[1], "integer")
    where = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matches = _Matches(model.lexicon)
        for batch in batches:
            out = []
            for t in batch.column(where):
                found, extra = look(t.as_py() or "", matches)
                raw = model.bias + float(model.weights[found].sum()) + float(model.extra @ extra)
                out.append(float(1 / (1 + np.exp(-np.clip(raw, -60, 60)))))
            arrays = [batch.column(i) for i in range(where)] + [pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *names])

    return in_batches(docs.select(*columns, F.col("text").cast("string").alias("__text")), run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of rows whose crc32(doc_id) leaves 0 by 5 are never read."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    return score(rows, model).drop("text")
