"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with the tags, classes and ids
of its ancestors. Blocks are labelled as main text or not by a chain model with ancestor and text features,
trained by gradient descent on labelled pages (forward-backward) and decoded by Viterbi. The labelled pages
come from a generator of page layouts whose labels are known by construction.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, table

#: tags that open a block of their own
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: elements whose content is never text of the page
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video textarea select button head title datalist".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
#: one attribute: its name, then its value in double, single or no quotes
_attribute = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_name = re.compile(r"[a-z]+")
#: what class names and ids of surrounding matter are made of
HINTS = {
    "advert": "ad ads adv advert adverts advertisement advertising banner promo promoted sponsor sponsored teaser".split(),
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs tabs toolbar topbar pagination pager skip".split(),
    "frame": "header footer head foot masthead copyright legal colophon bottom".split(),
    "side": "sidebar side aside widget widgets related recommended trending rail popular".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall disclaimer".split(),
    "comment": "comment comments reply replies respond disqus discussion reader thread responses".split(),
    "form": "form search login input field share social".split(),
    "content": "article content post entry story main text body maincontent articlebody prose".split(),
}
_hint = {word: kind for kind, words in HINTS.items() for word in words}


@dataclass
class Block:
    """A leaf block: the distinct marks of the elements around it, the innermost of them, its text and how much of it is linked."""

    inside: frozenset[str]
    own: str
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; character references are decoded once, white space runs become one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: list[str] = []
    parts: list[str] = []
    #: how often each mark is on the path and each tag on the stack; the distinct marks, shared by the blocks
    counts: Counter[str] = Counter()
    open_tags: Counter[str] = Counter()
    inside: frozenset[str] | None = frozenset()
    linked = links = hidden = 0
    at = 0

    def flush() -> None:
        nonlocal linked, inside
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                if inside is None:
                    inside = frozenset(counts)
                out.append(Block(inside, path[-1] if path else "", text, linked))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links, hidden, inside
        for tag, marks in stack[k:]:
            links -= tag == "a"
            hidden -= tag in HIDDEN or "hidden" in marks
            open_tags[tag] -= 1
            for mark in marks:
                counts[mark] -= 1
                if not counts[mark]:
                    del counts[mark]
                    inside = None
            if marks:
                del path[len(path) - len(marks) :]
        del stack[k:]

    while at < len(page):
        m = _token.search(page, at)
        if m is None:
            if not hidden:
                parts.append(html.unescape(page[at:]))
            break
        if m.start() > at and not hidden:
            piece = html.unescape(page[at : m.start()])  # references don't reach across tags
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not hidden:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append("\n")
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if open_tags[tag] else None
            # an inline tag does not close the blocks around it
            if k is not None and (tag in BLOCK or not any(t in BLOCK for t, _ in stack[k + 1 :])):
                close(k)
            continue
        if tag in BLOCK and tag not in ("html", "body") and open_tags["p"]:
            k = max(i for i, (t, _) in enumerate(stack) if t == "p")  # a block-level tag ends an open paragraph
            close(k)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in (tag, "ul", "ol", "dl", "table", "select")), None)
            if k is not None and stack[k][0] == tag:
                close(k)
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        marks = _marks(tag, m[3]) if tag in BLOCK or tag in HIDDEN or m[3] else ()
        stack.append((tag, marks))
        open_tags[tag] += 1
        for mark in marks:
            if mark not in counts:
                inside = None
            counts[mark] += 1
        path.extend(marks)
        links += tag == "a"
        if tag in HIDDEN or "hidden" in marks:
            hidden += 1
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                at = end.start() if end else len(page)
    flush()
    return out


@functools.lru_cache(1 << 14)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the path of its blocks: its tag and what its class, id and role hint at."""
    marks = [tag] if tag in BLOCK or tag in HIDDEN else []
    for name, a, b, c in _attribute.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            marks.append("hidden")
        elif name in ("class", "id", "role"):
            for word in _name.findall(value):
                if word in _hint:
                    marks.append(f"hint:{_hint[word]}")
    return tuple(dict.fromkeys(marks))


_sentence = re.compile(r"[.!?][\"')\]]*(?:\s|$)").search


def features(found: list[Block]) -> list[list[str]]:
    out = []
    for b in found:
        n = len(b.text)
        share = b.linked / n
        out.append(
            [
                "bias",
                *(f"in:{p}" for p in b.inside),
                f"own:{b.own}",
                f"length:{min(8, n.bit_length())}",
                f"linked:{0 if not b.linked else 1 if share < 0.5 else 2}",
                f"sentence:{bool(_sentence(b.text))}",
                f"sign:{b.text[0] if b.text[0] in '©|»' else ''}",
            ]
        )
    return out


@dataclass
class Chain:
    """Weights of feature and label (0 around, 1 main), of label pairs, and of the first and last label."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    ends: np.ndarray

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        s = np.zeros((len(feats), 2))
        for i, names in enumerate(feats):
            known = [self.index[f] for f in names if f in self.index]
            s[i] = self.emit[known].sum(axis=0)
        if len(s):
            s[0] += self.ends[0]
            s[-1] += self.ends[1]
        return s

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not feats:
            return []
        m = self.move.tolist()
        s = self.scores(feats).tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            pa_, pb = a + m[0][0] >= b + m[1][0], a + m[0][1] > b + m[1][1]
            back.append((0 if pa_ else 1, 0 if pb else 1))
            a, b = x + (a + m[0][0] if pa_ else b + m[1][0]), y + (a + m[0][1] if pb else b + m[1][1])
        label = 1 if b > a else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, penalty: float = 1e-3) -> Chain:
    """Maximum likelihood by Adam; expectations by forward-backward."""
    names = sorted({f for feats, _ in pages for block in feats for f in block})
    chain = Chain({f: i for i, f in enumerate(names)}, np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros((2, 2)))
    params = [chain.emit, chain.move, chain.ends]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    coded = [([[chain.index[f] for f in block] for block in feats], labels) for feats, labels in pages if labels]
    for step in range(1, rounds + 1):
        grads = [penalty * p for p in params]
        for (codes, labels), (feats, _) in zip(coded, (p for p in pages if p[1]), strict=True):
            s = chain.scores(feats)
            n = len(s)
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0]
            for i in range(1, n):
                fwd[i] = s[i] + _logsum(fwd[i - 1][:, None] + chain.move, 0)
            for i in range(n - 2, -1, -1):
                bwd[i] = _logsum(chain.move + s[i + 1] + bwd[i + 1], 1)
            z = _logsum(fwd[-1], 0)
            p = np.exp(fwd + bwd - z)
            p[np.arange(n), labels] -= 1
            for code, d in zip(codes, p, strict=True):
                grads[0][code] += d / len(coded)
            grads[2][0] += p[0] / len(coded)
            grads[2][1] += p[-1] / len(coded)
            for i in range(1, n):
                pair = np.exp(fwd[i - 1][:, None] + chain.move + s[i] + bwd[i] - z)
                pair[labels[i - 1], labels[i]] -= 1
                grads[1] += pair / len(coded)
        for q, g, mi, vi in zip(params, grads, m, v, strict=True):
            mi += 0.1 * (g - mi)
            vi += 0.01 * (g * g - vi)
            q -= 0.15 * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-8)
    return chain


def labelled_pages(count: int = 160, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Generated pages and their main blocks: many layouts, with and without classes, closed and unclosed paragraphs."""
    r = random.Random(seed)
    syllables = "an be co du el fi ga ho in ja ke lo mi nu or pa qui re so tu un va wi xe yo za é ü ñ".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def prose(a: int = 1, b: int = 60) -> str:
        return " ".join(words(1, 14).capitalize() + r.choice(".....!?") for _ in range(r.randint(1, max(1, b // 12)))) if a < b else words(a, b)

    def box(kind: str, *, classes: bool = True) -> str:
        mark = f' {r.choice(["class", "id"])}="{r.choice(HINTS[kind])}"' if classes else ""
        return f"<div{mark}>{r.choice(['', '<p>'])}{prose()}{r.choice(['', ' <a href=x>' + words(1, 4) + '</a>'])}</div>"

    def links() -> str:
        items = "".join(f"<li><a href=/{i}>{words(1, 3)}</a></li>" for i in range(r.randint(2, 8)))
        shell = r.choice(["<nav><ul>{}</ul></nav>", "<ul class=menu>{}</ul>", "<header><ul>{}</ul></header>", "<div id=nav><ul>{}</ul></div>", "<aside><ul>{}</ul></aside>"])
        return shell.format(items)

    pages = []
    for _ in range(count):
        main: list[str] = []
        body: list[str] = []
        title = words(2, 9).capitalize()
        if r.random() < 0.9:
            main.append(title)
            body.append(f"<h1>{title}</h1>")
        for _ in range(r.choice([1, 2, 4, 8, 16])):
            kind = r.random()
            text = prose(1, 80)
            main.append(text)
            if kind < 0.6:
                body.append(f"<p>{text}</p>")
            elif kind < 0.75:
                body.append(f"<p><b>{text}<br>")
            elif kind < 0.85:
                body.append(f"<h2>{text}</h2>")
            elif kind < 0.93:
                body.append(f"<ul><li>{text}</li></ul>")
            else:
                body.append(f"<blockquote>{text}</blockquote>")
            if r.random() < 0.12:
                body.append(box(r.choice(["advert", "notice", "side"])))
        shell = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=content>{}</div>", "<div id=article>{}</div>", "<section class=post>{}</section>", "<div>{}</div>"])
        before = [links() for _ in range(r.randint(0, 2))] + [box(r.choice(["advert", "menu", "notice", "frame", "form"])) for _ in range(r.randint(0, 2))]
        after = []
        if r.random() < 0.4:
            after.append(f"<{r.choice(['section', 'div', 'ol'])} {r.choice(['class', 'id'])}={r.choice(HINTS['comment'])}>" + "".join(f"<{t}>{prose()}</{t}>" for t in [r.choice(["p", "div", "li", "article"])] for _ in range(r.randint(1, 5))) + "</section></div></ol>")
        if r.random() < 0.4:
            after.append(f"<aside>{r.choice(['<p>', '<h3>', ''])}{prose()}</aside>")
        if r.random() < 0.3:
            after.append(f"<form><label>{words(1, 3)}</label><p>{prose()}</p></form>")
        if r.random() < 0.3:
            after.append(box("side"))
        if r.random() < 0.8:
            after.append(f"<footer>{r.choice(['&copy; ', '<p>', ''])}{prose()}</footer>")
        head = f"<head><title>{title}</title><script>var a='<p>';</script></head>"
        cut = r.random() < 0.15
        pages.append((f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{shell.format(''.join(body))}{'' if cut else ''.join(after) + '</body></html>'}", main))
    return pages


@functools.lru_cache(1)
def default_chain() -> Chain:
    return train([(features(found), _align(found, main)) for page, main in labelled_pages() for found in [blocks(page)]])


def _align(found: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks that are the main blocks, in order."""
    at, labels = 0, []
    for b in found:
        hit = at < len(main) and b.text == main[at]
        labels.append(int(hit))
        at += hit
    return labels


def extract(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, chain.decode(features(found)), strict=True) if label)


def extract_text(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html). Null and empty pages give an empty text. No shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or default_chain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h.as_py() or "", chain) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_batches(rows, run, "page_id long, url string, text string, n_chars long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
