"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in segments, once forwards and once backwards; from both states it
gives every byte position a distribution over the languages. A document's distribution is the mean over
all its positions. Training is backpropagation through time in numpy on the driver, over a bounded sample
of labelled texts; scoring is one pass over the table without a shuffle.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_by_hash, in_batches, table

HIDDEN, WIDTH = 12, 8
#: bytes of a segment when scoring, and segments that are scored together
SEGMENT, TOGETHER = 128, 2048
#: labelled texts of each language that training looks at, languages at most, and characters of each text
TEXTS_PER_LANGUAGE, MAX_LANGUAGES, CHARACTERS = 400, 200, 480
UNDETERMINED = "und"
#: letters of Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul
SCRIPTS = ((0x3B1, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x939), (0xE01, 0xE30), (0x3041, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_letter = regex.compile(r"\p{L}").search


@dataclass
class Network:
    """Weights with features first.

    emb (256 x E): a byte's features, the first held at 1. For each direction a (2H x (H + E)) gives the
    update and reset gates of (state, byte), c (H x (H + E)) the candidate of (reset state, byte).
    v (L x 2H) and o (L) give the languages' scores of both states.
    """

    languages: list[str]
    emb: np.ndarray
    a: list[np.ndarray]
    c: list[np.ndarray]
    v: np.ndarray
    o: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.emb, *self.a, *self.c, self.v, self.o]


def _soft(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the candidate's squashing; a gate is half of it plus a half."""
    np.abs(x, out=room)
    room += 1
    x /= room
    return x


def _features(net: Network, x: np.ndarray) -> np.ndarray:
    """T x E x B."""
    return np.ascontiguousarray(net.emb[x].transpose(0, 2, 1))


def _scan(a: np.ndarray, c: np.ndarray, e: np.ndarray, mask: np.ndarray, backwards: bool, tape: list | None = None) -> np.ndarray:
    """States (T x H x B) of one direction. e: byte features (T x E x B); mask: 1 within a text (T x B)."""
    steps, width, batch = e.shape
    hidden = len(c)
    states = np.empty((steps, hidden, batch), np.float32)
    both, gates, n = (np.zeros((k, batch), np.float32) for k in (hidden + width, 2 * hidden, hidden))
    room, room2 = np.empty_like(gates), np.empty_like(n)
    h = np.zeros((hidden, batch), np.float32)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        both[:hidden] = h
        both[hidden:] = e[t]
        np.matmul(a, both, out=gates)
        _soft(gates, room)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:hidden], gates[hidden:]
        both[:hidden] *= r
        np.matmul(c, both, out=n)
        _soft(n, room2)
        if tape is not None:
            tape.append((t, h.copy(), z.copy(), r.copy(), n.copy()))
        new = states[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        new *= mask[t]
        h = new
    return states


def _probabilities(net: Network, states: list[np.ndarray], t: int) -> np.ndarray:
    hidden = len(net.c[0])
    p = net.v[:, :hidden] @ states[0][t]
    p += net.v[:, hidden:] @ states[1][t]
    p += net.o[:, None]
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    return p


def _gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
    hidden, batch = len(net.c[0]), x.shape[1]
    e = _features(net, x)
    tapes: list[list] = [[], []]
    states = [_scan(net.a[d], net.c[d], e, mask, bool(d), tapes[d]) for d in (0, 1)]
    dv, do = np.zeros_like(net.v), np.zeros_like(net.o)
    into = [np.zeros_like(s) for s in states]
    total, loss = mask.sum(), 0.0
    for t in range(len(x)):
        p = _probabilities(net, states, t)
        loss -= float((np.log(np.maximum(p[y, np.arange(batch)], 1e-9)) * mask[t]).sum())
        p[y, np.arange(batch)] -= 1
        p *= mask[t] / total
        do += p.sum(axis=1)
        for d in (0, 1):
            dv[:, d * hidden : (d + 1) * hidden] += p @ states[d][t].T
            into[d][t] = net.v[:, d * hidden : (d + 1) * hidden].T @ p
    demb, da, dc = np.zeros_like(net.emb), [np.zeros_like(m) for m in net.a], [np.zeros_like(m) for m in net.c]
    for d in (0, 1):
        dh = np.zeros((hidden, batch), np.float32)
        for t, h, z, r, n in reversed(tapes[d]):
            dh = (dh + into[d][t]) * mask[t]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            back = net.c[d].T @ dn
            gates = np.concatenate([dh * (h - n) * (1 - np.abs(2 * z - 1)) ** 2, back[:hidden] * h * (1 - np.abs(2 * r - 1)) ** 2]) / 2
            dc[d] += dn @ np.concatenate([r * h, e[t]]).T
            da[d] += gates @ np.concatenate([h, e[t]]).T
            under = net.a[d].T @ gates
            np.add.at(demb, x[t], (back[hidden:] + under[hidden:]).T)
            dh = dh * z + back[:hidden] * r + under[:hidden]
    demb[:, 0] = 0
    return loss / float(total), [demb, *da, *dc, dv, do]


def train(texts: list[str], labels: list[str], hidden: int = HIDDEN, steps: int = 260, batch: int = 160, length: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """A network fitted by Adam to random segments of the texts, each language drawn equally often."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    f32 = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network(languages, f32(256, WIDTH) * 2, [f32(2 * hidden, hidden + WIDTH) for _ in "12"], [f32(hidden, hidden + WIDTH) for _ in "12"], f32(len(languages), 2 * hidden), np.zeros(len(languages), np.float32))
    net.emb[:, 0] = 1
    by = [[np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t, lab in zip(texts, labels, strict=True) if lab == g and t] for g in languages]
    usable = [i for i, group in enumerate(by) if group]
    if not usable:
        return net
    m = [np.zeros_like(a) for a in net.arrays()]
    s = [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, steps + 1):
        y = rng.choice(usable, batch)
        x, mask = np.zeros((length, batch), np.uint8), np.zeros((length, batch), np.float32)
        for k, g in enumerate(y):
            text = by[g][rng.integers(len(by[g]))]
            at = rng.integers(max(1, len(text) - length + 1))
            part = text[at : at + length]
            x[: len(part), k], mask[: len(part), k] = part, 1
        _, grads = _gradients(net, x, mask, y)
        size = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        pace = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for a, g, mi, si in zip(net.arrays(), grads, m, s, strict=True):
            g = g * np.float32(min(1.0, 1.0 / max(size, 1e-9)))
            mi += 0.1 * (g - mi)
            si += 0.01 * (g * g - si)
            a -= np.float32(pace) * (mi / (1 - 0.9**step)) / (np.sqrt(si / (1 - 0.99**step)) + np.float32(1e-6))
    return net


def position_sums(net: Network, texts: list[bytes]) -> np.ndarray:
    """For each text the sums over its positions of the positions' distributions (n x L)."""
    out = np.zeros((len(texts), len(net.languages)), np.float64)
    owner, parts = [], []

    def flush() -> None:
        batch = len(parts)
        if not batch:
            return
        size = np.fromiter(map(len, parts), np.int64, batch)
        steps = int(size.max())
        x = np.frombuffer(b"".join(p.ljust(steps, b"\0") for p in parts), np.uint8).reshape(batch, steps).T.copy()
        mask = (np.arange(steps)[:, None] < size).astype(np.float32)
        e = _features(net, x)
        states = [_scan(net.a[d], net.c[d], e, mask, bool(d)) for d in (0, 1)]
        sums = np.zeros((len(net.languages), batch), np.float32)
        for t in range(steps):
            p = _probabilities(net, states, t)
            p *= mask[t]
            sums += p
        np.add.at(out, np.array(owner), sums.T)
        owner.clear()
        parts.clear()

    for k, text in enumerate(texts):
        for at in range(0, len(text), SEGMENT):
            owner.append(k)
            parts.append(text[at : at + SEGMENT])
            if len(parts) == TOGETHER:
                flush()
    flush()
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(modulus)) == remainder


def sample(docs: DataFrame, allowed: Column) -> list[tuple[str, str]]:
    """Text and language of at most TEXTS_PER_LANGUAGE texts of each language among the allowed rows with a language and a text.

    Of more than MAX_LANGUAGES languages the most frequent are taken.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    languages = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    languages = languages.select("lang", F.lit(TEXTS_PER_LANGUAGE).alias("most"))
    # a part of each text at a place that its id decides
    span = F.substring("text", F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - CHARACTERS, F.lit(1))).cast("int"), F.lit(CHARACTERS))
    found = first_by_hash(rows.withColumn("text", span), "lang", languages, "most").collect()  # at most both limits' product
    return sorted((r["text"], r["lang"]) for r in found)


def fit(docs: DataFrame, allowed: Column) -> Network:
    """Trains on a sample of the allowed rows."""
    found = sample(docs, allowed)
    return train([t for t, _ in found], [g for _, g in found])


def noise_texts(used: set[str], count: int = TEXTS_PER_LANGUAGE, seed: int = 17) -> list[str]:
    """Texts of no language: random letters, codes, digits and signs with few letters, and words of scripts without a used character."""
    r = random.Random(seed)
    scripts = [s for s in SCRIPTS if not any(s[0] <= ord(c) <= s[1] for c in used)]
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    signs = "0123456789" * 3 + "!#$%&*+-/<=>?@|~.,:;"
    out = []
    for k in range(count):
        if k % 2 and scripts:
            first, last = scripts[k // 2 % len(scripts)]
            letter = lambda: chr(r.randint(first, last))  # noqa: E731, B023
        else:
            letters = (alphabet, alphabet + alphabet.upper() + "0123456789+/", signs * 4 + r.choice(alphabet))[k // 2 % 3]
            letter = lambda: r.choice(letters)  # noqa: E731, B023
        out.append(" ".join("".join(letter() for _ in range(r.randint(1, 12))) for _ in range(r.randint(20, 60))))
    return out


def fit_with_noise(docs: DataFrame, allowed: Column) -> tuple[Network, float]:
    """A network that also knows UNDETERMINED, from noise_texts, and the share of it from which a text is of no learned language.

    That share lies midway between 1 and the highest of the labelled sample. Without labelled rows there are no languages.
    """
    found = sample(docs, allowed)
    if not found:
        return train([], []), 1.0
    noise = noise_texts(set().union(*(t for t, _ in found)))
    net = train([t for t, _ in found] + noise, [g for _, g in found] + [UNDETERMINED] * len(noise))
    sums = position_sums(net, [t.encode("utf-8", "replace") for t, g in found if g != UNDETERMINED])
    shares = sums[:, net.languages.index(UNDETERMINED)] / np.maximum(sums.sum(axis=1), 1e-9)
    return net, float(1 + shares.max(initial=0.0)) / 2


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def predict(docs: DataFrame, net: Network, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, then those of names: language and score. Null texts and texts without a letter get `und` and 0.

    Columns of docs that have these names give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    columns = [c for c in docs.columns if c not in names]
    kept = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    schema = docs.select(*columns).schema.add(names[0], "string").add(names[1], "double")
    where = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.as_py() or "" for t in part.column(where)]
                known = [bool(net.languages) and _letter(t) is not None for t in texts]
                sums = position_sums(net, [t.encode("utf-8", "replace") if k else b"" for t, k in zip(texts, known, strict=True)])
                total = np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)
                share = sums / total
                best = share.argmax(axis=1) if net.languages else np.zeros(len(texts), int)
                pred = [net.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                score = [float(min(1.0, share[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]
                arrays = [part.column(i) for i in range(where)] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *names])

    return in_batches(kept, run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32(doc_id) leaves 2 by 4 never train."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, ~held_out(F.col("doc_id"), 4, 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return predict_slim(slim, net)


def predict_slim(rows: DataFrame, net: Network) -> DataFrame:
    """As predict, without the text in the result."""
    return predict(rows, net).drop("text")
