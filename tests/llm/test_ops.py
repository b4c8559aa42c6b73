"""Operators against brute force, exact round trips, libraries or held-out accuracy, on small tables with the awkward cases."""

import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, decontaminate, html_text, language_id, licences, minhash, registry, repair, sentencepiece_bpe, topk, toxicity
from quern.llm.common import components, first_by_hash

tok = pytest.importorskip("public_tokenizers")
AWKWARD = [(1, None), (2, ""), (3, "  \n "), (4, "a"), (5, "a"), (6, "Hello, wörld!  𠮶 \t x"), (7, "word " * 30_000), (8, "1 2 3 !!!"), (9, "z" * 20_000)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n"), F.lit("s").alias("score"))


def empty(df):
    return df.where("false")


# 1
def test_sentencepiece(spark, awkward):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tok.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Model(sentencepiece_bpe.model_bytes(path))
    rng = random.Random(1)
    pieces = list(own.rank)
    texts = [t for _, t in AWKWARD if t is not None]
    texts += ["".join(rng.choice("abc  ehntr.,\n▁é中#-01\x00") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(pieces) for _ in range(6)) for _ in range(1500)]
    for t in texts:
        ids = memoryview(own.encode(t)).cast("I").tolist() if t else []
        assert ids == lib.encode(t), t[:60]
        assert own.decode([1, *ids, 2]) == lib.decode([1, *ids, 2])
    texts += ["".join(rng.choice([" ", " ", "\n", "\n\n", "ab", "é中", "x.", "▁", "  ", "the"][: rng.choice((7, 10))]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for at in range(0, len(texts), 700):
        got = own.encode_batch(pa.array([*texts[at : at + 700], None], pa.string()).slice(3))
        assert [g.tolist() for g in got] == [*map(lib.encode, texts[at + 3 : at + 700]), []]
    for _ in range(500):
        ids = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(0, 32000) for _ in range(9)]
        assert own.decode(ids) == lib.decode(ids)
    got = {r["doc_id"]: r for r in sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(awkward, path)).collect()}
    for i, t in AWKWARD:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encode_decode(empty(awkward), path).count() == 0


# 2
def test_grammar_round_trip():
    rng = random.Random(2)
    for _ in range(120):
        n = rng.randint(0, 300)
        ids = np.array([rng.randint(0, 4) for _ in range(n)], np.uint32)
        starts = np.array(sorted({0, *(rng.randint(0, n) for _ in range(4))}))
        shard = repair.Shard(repair.pack(np.arange(len(starts)), repair.compress(ids, starts, 2)))
        ends = [*starts[1:], n]
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            assert shard.ids(k) == ids[a:b].astype("<u4").tobytes()
            assert [shard.token(k, j) for j in range(b - a)] == ids[a:b].tolist()


def test_repair_files(spark, awkward, tmp_path):
    from tokenizers import Tokenizer

    path = tok.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    own = repair.ByteBpe(open(path, encoding="utf-8").read())
    rng = random.Random(3)
    for t in ["".join(rng.choice("abst 's\n\t  é中1.,!\x1c\x85\r") for _ in range(rng.randint(0, 30))) for _ in range(2000)]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    repair.write_shards(awkward, path, str(tmp_path / "ids"), shard_ids=5000, partitions=3)
    got = sorted(repair.read_shards(spark, str(tmp_path / "ids"), with_ids=True).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, (i, t) in zip(got, AWKWARD, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        body = struct.pack(f"<{len(ids)}I", *ids)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, at, len(ids), zlib.crc32(body), body)
        at += len(ids)
    repair.write_shards(empty(awkward), path, str(tmp_path / "none"))
    assert repair.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_added_tokens(spark, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    path = tok.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    own = repair.ByteBpe(open(path, encoding="utf-8").read())
    want = lambda t: lib.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(own.encode("a <|endoftext|> b"), "<u4").tolist() == want("a <|endoftext|> b") == [64, 220, 50256, 275]
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 3), (3, "x\n<|endoftext|>\n y")]
    repair.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, str(tmp_path / "ids"))
    got = sorted(repair.read_shards(spark, str(tmp_path / "ids"), with_ids=True).collect(), key=lambda r: r["doc_id"])
    assert [bytes(r["ids"]) for r in got] == [struct.pack(f"<{len(ids)}I", *ids) for _, t in rows for ids in [[*want(t), 2]]]
    rng = random.Random(16)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "a", "é", "'s", "[x]", "[x][y]", "[y]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == want(t) for t in texts)
    lib.add_tokens([AddedToken("[x]", normalized=False), AddedToken("[x][y]", normalized=False), AddedToken("][", normalized=True)])
    own = repair.ByteBpe(lib.to_str())
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == want(t) for t in texts)


def test_batches_of_texts(spark, tmp_path):
    """Whole batches come out as the library encodes text by text, also after the table of pieces was cleared."""
    from tokenizers import Tokenizer

    path = tok.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    fast = repair.Batches(repair.ByteBpe(open(path, encoding="utf-8").read()))
    rng = random.Random(22)
    parts = ["a", "bc", "'s", "é中", "1.", ", ", " ", " ", "\n", "\n\n", "\t", "\u3000", "\x1c", "\x85", "\xa0", "\u200b", "<|endoftext|>", "the", "\r\n", "\x00"]
    texts = [None if rng.random() < 0.02 else "".join(rng.choice(parts[: rng.choice((9, 20))]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    repair.MAX_CHUNKS, held = 500, repair.MAX_CHUNKS
    try:
        for at in range(0, len(texts), 250):
            got = fast.encode(pa.array(texts[at : at + 300], pa.string()).slice(50))
            assert [g.tolist() for g in got] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts[at + 50 : at + 300]]
    finally:
        repair.MAX_CHUNKS = held
    rows = [(None, "a b"), (3, "c"), (3, "d e"), (None, None), (1, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("body"), F.lit(0).alias("part"))
    repair.write_shards(df, path, str(tmp_path / "ids"), shard_ids=3, partitions=2)
    got = repair.read_shards(spark, str(tmp_path / "ids"), with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 3, 3] and got[-1]["start"] + got[-1]["n_tokens"] == sum(len(lib.encode(t or "").ids) + 1 for _, t in rows)
    assert sorted(bytes(r["ids"]) for r in got) == sorted(struct.pack(f"<{len(i)}I", *i) for _, t in rows for i in [[*lib.encode(t or "", add_special_tokens=False).ids, 2]])


# 3
def test_language_gradients():
    net = language_id.train(["abc", "xyz"], ["a", "x"], hidden=4, steps=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 255, (7, 5)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    mask = np.ones((7, 5), np.float32)
    mask[4:, 2] = 0
    _, grads = language_id._gradients(net, x, mask, y)
    for a, g in zip(net.arrays(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        held = a[i]
        a[i] = held + 1e-2
        up, _ = language_id._gradients(net, x, mask, y)
        a[i] = held - 1e-2
        down, _ = language_id._gradients(net, x, mask, y)
        a[i] = held
        assert abs((up - down) / 2e-2 - g[i]) < 2e-3


def test_language_held_out(spark, awkward):
    got = language_id.op3(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == want.loc[held.index].lang).mean() > 0.97
    assert all(got.loc[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index)
    net = language_id.train(["abc abd", "xyz xyy"], ["a", "x"], hidden=4, steps=5)
    out = {r["doc_id"]: r for r in language_id.predict(awkward, net).collect()}
    assert all((out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 8))
    assert out[4]["lang_pred"] == out[5]["lang_pred"] != "und" and 0 < out[7]["score"] <= 1
    assert language_id.fit(awkward, F.lit(True)).languages == []
    odd = spark.createDataFrame([(1, "²"), (2, "½ ①"), (3, "ª"), (4, "中"), (4, "中"), (5, "_ 9")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["lang_pred"] != "und") for r in language_id.predict(odd, net).collect())
    assert got == [(i, any(map(str.isalpha, t))) for i, t in [(1, "²"), (2, "½①"), (3, "ª"), (4, "中"), (4, "中"), (5, "_9")]]
    assert sorted(r["doc_id"] for r in odd.where(language_id.has_letter(F.col("text"))).collect()) == [3, 4, 4]


# 4
def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.standard_normal(8)]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(60)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] + [0.0] * 7), (1150, [1.0]), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    v = topk.integers(df)
    got = sorted(tuple(r) for r in topk.top_k(v.where("vec_id % 50 = 0"), v, 5).collect())
    data = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], np.float64)).astype(np.int64) for r in df.where("vec_id < 1000").collect()}
    want = []
    for q in data:
        if q % 50 == 0:
            best = sorted((-int(data[q] @ data[c]), c) for c in data if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(empty(v), v, 5).count() == 0 and topk.top_k(v.limit(3), empty(v), 5).count() == 0
    few = v.where("vec_id < 3")
    assert topk.top_k(few, few, 5).count() == 6
    mixed = spark.createDataFrame([(50, [1.0, 2.0]), (50, [3.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0, 1.0]), (100, [1.0, 0.0, 0.0]), (150, [1.0])], "vec_id long, v array<double>")
    got = sorted(tuple(r) for r in topk.top_k(mixed.where("vec_id % 50 = 0"), mixed, 5).collect())
    assert got == [(50, 1, 1, 3), (50, 2, 1, 3), (100, 1, 2, 2)]
    with pytest.raises(OverflowError):
        topk.top_k(mixed.select("vec_id", F.transform("v", lambda x: x * 3e9).alias("v")).where("vec_id = 50"), mixed.select("vec_id", F.transform("v", lambda x: x * 3e9).alias("v")))


# 5
def test_licences(spark, awkward):
    s = licences.Scanner(licences.TEMPLATES)
    for name, text in licences.TEMPLATES.items():
        found = s.scan(f"some other words here\n\n\n{text}\n\n\nand more of them")
        assert (name, 1.0) in [(f[2], f[3]) for f in found]
    plain = lambda m: max(((2 * len(m & b) / (len(m) + len(b)), n) for n, b in zip(s.names, s.sets, strict=True)), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
    rng = random.Random(6)
    for text in licences.TEMPLATES.values():
        words = [w for w in text.split() if rng.random() > 0.1]
        m = licences.bigrams(" ".join(words))
        dice, name = plain(m)
        got = s.passage(m)
        assert (got is None) == (dice < s.threshold) and (got is None or abs(got[0] - dice) < 1e-12)
    out = {r["doc_id"]: r for r in licences.scan_licences(awkward).collect()}
    assert all(r["licence"] is None and r["dice"] == 0 and r["n_passages"] == 0 for r in out.values())
    assert licences.scan_licences(empty(awkward)).count() == 0


def test_licences_within_a_line():
    s = licences.Scanner(licences.TEMPLATES)
    for text in ("Copyright 2020 Acme Inc. {}", "One sentence before. Copyright 2020 Acme Inc. {} And one after it.", "word " * 3000 + "{}" + " more" * 3000):
        for name, template in licences.TEMPLATES.items():
            assert (name, 1.0) in [(f[2], f[3]) for f in s.scan(text.format(template))], (name, text[:30])
    assert [f[2] for f in s.scan("All rights reserved. " * 5000)] == ["Proprietary"] * 5000
    s = licences.Scanner({"x": "a b c d e", "y": "b c b a", "z": "d d a b c a e"}, 0.7)
    rng = random.Random(15)
    for _ in range(400):
        words = [rng.choice("abcdef") for _ in range(rng.randint(0, 25))]
        pairs = list(zip(words, words[1:]))
        found = []
        for i in range(len(pairs)):
            for j in range(i, len(pairs)):
                m = set(pairs[i : j + 1])
                for name, b in zip(s.names, s.sets, strict=True):
                    dice = 2 * len(m & b) / (len(m) + len(b))
                    if pairs[i] in b and pairs[j] in b and dice >= 0.7 - 1e-12:
                        found.append((-dice, -len(b), i, j + 1, name))
        want = []
        for dice, _, i, j, name in sorted(found):
            if all(j < w[0] or i > w[1] for w in want):
                want.append((i, j, name, -dice))
        assert s.scan("\n".join(words)) == s.scan(" ".join(words)) == sorted(want)


# 6
def test_label_model():
    rng = np.random.default_rng(7)
    y = rng.random(3000) < 0.3
    good = [np.where(y, rng.random(3000) < 0.8, rng.random(3000) < 0.05) for _ in range(5)]
    v = np.column_stack([*good, good[0], good[0], rng.random(3000) < 0.5]).astype(np.int64)
    # the beliefs are off, and orient the classes all the same; no label goes in
    rates = np.array([[0.15, 0.6]] * 7 + [[0.5, 0.5]])
    post, found = toxicity.label_model(v, rates, 0.3)
    assert ((post >= 0.5) == y).mean() > 0.97
    speaks = v[:, 1].astype(bool)
    assert abs(post[speaks].mean() - y[speaks].mean()) < 0.1
    # copies of one voter hang together in the tree
    assert {int(found["parent"][5]), int(found["parent"][6]), int(found["parent"][0])} & {0, 5, 6}


def test_toxicity(spark, awkward):
    rng = random.Random(8)
    clean = [" ".join(rng.choice("one two three four five six seven eight".split()) for _ in range(30)) for _ in range(300)]
    rows = [(i, t + (" vilewort gruntig" if i % 4 == 0 else "")) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, ~language_id.held_out(F.col("doc_id"), 5, 0))
    out = toxicity.score(docs, model).toPandas()
    assert (out.predicted == (out.doc_id % 4 == 0)).all() and out.score.between(0, 1).all()
    odd = toxicity.score(awkward, model).toPandas()
    assert len(odd) == len(AWKWARD) and (odd.predicted == 0).all()
    twice = toxicity.fit(docs.unionByName(docs), labels.unionByName(labels), ~language_id.held_out(F.col("doc_id"), 5, 0))
    assert toxicity.score(docs, twice).toPandas().predicted.equals(out.predicted)
    none = toxicity.fit(docs, empty(labels), F.lit(True))
    assert (toxicity.score(docs, none).toPandas().predicted == 0).all()


def test_toxicity_held_out(spark):
    got = toxicity.op6(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() >= 0.75 * (got.toxic == 1).sum() and hit.sum() >= 0.95 * (got.predicted == 1).sum()


def test_first_by_hash(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 1000 == 1, "b").otherwise("c").alias("g"))
    limits = spark.createDataFrame([("a", 50), ("b", 500)], "g string, most int")
    got = first_by_hash(rows, "g", limits, "most").collect()
    order = {r["doc_id"]: r["h"] for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = sorted((i for i in range(0, 20_000, 3)), key=order.get)[:50]
    assert sorted(r["doc_id"] for r in got if r["g"] == "a") == sorted(want)
    assert sum(r["g"] == "b" for r in got) == sum(i % 1000 == 1 and i % 3 != 0 for i in range(20_000)) and len(got) == 50 + sum(r["g"] == "b" for r in got)


# 7
def test_html(spark):
    chain = html_text.default_chain()
    pages = html_text.labelled_pages(60, seed=5)
    exact = sum(html_text.extract(p, chain) == "\n".join(m) for p, m in pages)
    assert exact >= 57
    page = "<body><nav><a href=x>Menu</a></nav><article><h1>T &amp;amp; t</h1><p>One\n  two&nbsp;x<p>Three.<script>var x='<p>no</p>'</script></article><div class=comments><p>Nice!</p></div><form><p>Mail</p></form><footer>&copy; me</footer>"
    assert html_text.extract(page, chain) == "T &amp; t\nOne two x\nThree."
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", page), (None, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = {r["page_id"]: r for r in html_text.extract_text(rows).collect()}
    assert out[1]["text"] == "" and out[2]["n_chars"] == 0 and out[4]["text"] == out[None]["text"]
    assert html_text.extract_text(empty(rows)).count() == 0


def test_hidden_is_an_attribute_name():
    for attribute in ('style="overflow:hidden"', 'href="/hidden-gems"', "title='the hidden valley'", 'data-hidden="false"', "href=/a/hidden", 'data-x = "a=b hidden"', 'aria-hidden="false"', 'data-aria-hidden="true"'):
        assert [b.text for b in html_text.blocks(f"<p {attribute}>One <a {attribute}>two</a> three.</p>")] == ["One two three."], attribute
    for attribute in ("hidden", 'class="x" hidden', 'hidden=""', "HIDDEN id=a", 'title="a"hidden', 'aria-hidden="true"', "aria-hidden = TRUE"):
        assert html_text.blocks(f"<p {attribute}>One</p>") == [], attribute
    page = "<body><nav><a href=x>Menu</a></nav><article style='overflow:hidden'><h1>Title</h1><p title='the hidden valley'>One is here. Two is there.</p></article><footer>&copy; me</footer>"
    assert html_text.extract(page, html_text.default_chain()) == "Title\nOne is here. Two is there."


def test_references_within_a_tag():
    got = [b.text for b in html_text.blocks("<p>R&<b>copy</b></p><p>A&am<i>p;</i> &amp;lt; x&#62;y</p><p>&copy<!-- -->; <![CDATA[&amp;]]></p>")]
    assert got == ["R&copy", "A&amp; &lt; x>y", "©; &amp;"]


def test_deep_pages():
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.time()
    found = html_text.blocks("<div class=nav>x" * 40_000 + "</b>" * 40_000)
    assert len(found) == 40_000 and found[-1].inside == {"div", "hint:menu"} and tracemalloc.get_traced_memory()[1] < 200 << 20 and time.time() - began < 30
    tracemalloc.stop()


def test_pages(spark):
    """Every page of the table against its article element, whose blocks are read by another parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.parts = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag in html_text.BLOCK:
                self.parts.append([])

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag in html_text.BLOCK:
                self.parts.append([])

        def handle_data(self, data):
            if self.depth:
                self.parts[-1].append(data)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: r for r in html_text.op7(spark, "/root/testdata/sf0.01").collect()}
    right = 0
    for i, page in pages.items():
        parser = Article()
        parser.feed(page or "")
        lines = [" ".join("".join(p).split()) for p in parser.parts]
        right += got[i]["text"] == "\n".join(x for x in lines if x)
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert right >= 0.98 * len(pages), (right, len(pages))


def test_viterbi():
    import itertools

    rng = np.random.default_rng(9)
    chain = html_text.Chain({str(i): i for i in range(6)}, rng.standard_normal((6, 2)), rng.standard_normal((2, 2)), rng.standard_normal((2, 2)))
    feats = [[str(i)] for i in (0, 3, 1, 5, 2)]
    s = chain.scores(feats)
    best = max(itertools.product((0, 1), repeat=5), key=lambda y: sum(s[i, a] for i, a in enumerate(y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:])))
    assert chain.decode(feats) == list(best)


# 8
def test_chat(spark):
    rng = random.Random(10)
    parts = [*chat.CONTROL, "\\", "a", "\n", "[", "<", "é"]
    for _ in range(500):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "[/NAME]"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0, 5))]
        text, found, rewrites = chat.spans(chat.render, turns)
        assert chat.read_back(text) == turns and not rewrites
        assert [chat.unescape(text[f[2] : f[3]]) for f in found] == [t for _, t in turns]
    p = chat.PROBE
    for turns in ([("assistant", p)], [("assistant", p * 3), (p, "a" + p), ("assistant", ""), ("user", p * 2)], [(p, ""), ("assistant", p)]):
        text, found, _ = chat.spans(chat.render, turns)
        assert [chat.unescape(text[f[2] : f[3]]) for f in found] == [t for _, t in turns]
    forgetful = lambda turns: "".join(f"<{r}>{t if k == len(turns) - 1 else ''}" for k, (r, t) in enumerate(turns))
    _, found, rewrites = chat.spans(forgetful, [("user", "a"), ("user", "b")])
    assert rewrites and found == [None, None]
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (None, None, "assistant", "y"), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert out[2]["n_turns"] == 3 and out[2]["loss_chars"] == 2 and out[1]["loss_chars"] == 0 and out[None]["n_turns"] == 1
    assert chat.format_conversations(empty(rows)).count() == 0


# 9
def test_masks_hold():
    import itertools

    places = [frozenset(o + s for o in m) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - max(m))]
    for bad in itertools.combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.NEED):
        assert any(not p & set(bad) for p in places)


def test_decontamination(spark, awkward, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    item = rng.sample(words, 30)
    changed = item[:]
    changed[4] = changed[9] = "other"
    docs = [(10, " ".join(rng.sample(words, 40) + item + rng.sample(words, 10))), (11, " ".join(["x"] * 20 + changed[:13])), (12, " ".join(item[:10] + rng.sample(words, 50))), (13, ", ".join(item).upper())]
    df = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (1, " ".join(item))], "item_id long, text string")
    flagged = {r["doc_id"]: r for r in decontaminate.decontaminate(df, bench).collect() if r["contaminated"]}
    assert sorted(flagged) == [10, 11, 13] and flagged[11]["matched"] == 11 and flagged[10]["first_item"] == 1
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    again = sorted(r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect() if r["contaminated"])
    assert again == [10, 11, 13]
    assert decontaminate.decontaminate(empty(df), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(df, empty(bench)).collect())


def test_decontamination_plan(spark, awkward):
    """The words are computed once, and the comparison of words is not a condition of the join."""
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    clash = awkward.select("*", F.lit("x").alias("item_id"), F.lit(0).alias("h"), F.lit(0).alias("seed"), F.lit(1).alias("at"), F.lit("y").alias("matched"))
    found = decontaminate.decontaminate(clash, bench.withColumn("need", F.lit(0)).withColumn("around", F.lit("z")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert not any("bit_count" in line for line in plan.splitlines() if "Join" in line)
    assert sorted(r["doc_id"] for r in found.collect()) == [i for i, _ in AWKWARD]


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_decontamination_of_short_items(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    docs = [
        (1, "I asked: what is the CAPITAL of France? Paris."),
        (2, "what is the capital of all France"),
        (3, "请问中国的首都是哪里？北京。"),
        (4, "中国的首都在哪里"),
        (5, "capital of"),
        (6, "Yes"),
        (7, "a b c d e f g h i 今天我们一起去公园里玩得很开心 z"),
        (8, None),
        (9, "x " * 500 + "one two three four five six seven eight"),
        (10, "ราคาเท่าไหร่ครับ"),
    ]
    items = [(1, "What is the capital of France?"), (2, "中国的首都是哪里?"), (3, "yes"), (4, "one two three four five six seven eight"), (5, ""), (6, None), (7, "今天我们一起去公园里玩得很开心"), (1, "Capital, of!"), (8, "ราคาเท่าไหร่")]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(1, 1, 6), (2, 1, 2), (5, 1, 2), (3, 2, 8), (6, 3, 1), (9, 4, 8), (7, 7, 13), (10, 8, 10)}
    assert {tuple(r) for r in got.collect()} == want


# 10
def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k, threshold):
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "threshold", "bands", "rows"), [(3, 85, 25, 5), (5, 80, 31, 4)])
def test_near_duplicates(spark, k, threshold, bands, rows):
    rng = random.Random(12)
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    docs = list(AWKWARD)
    for i in range(120):  # a hot group of near copies, chains included
        copy = base[:]
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        docs.append((100 + i, " ".join(copy)))
    docs += [(300 + i, " ".join(base)) for i in range(30)]
    docs += [(400 + i, " ".join(f"q{rng.randrange(60)}" for _ in range(rng.randint(1, 12)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("component_id", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k, threshold, bands, rows).collect()}
    assert got == brute(docs, k, threshold)
    assert minhash.near_duplicates(empty(df), k, threshold, bands, rows).count() == 0


def test_near_duplicates_of_a_hot_group(spark, monkeypatch):
    """Two bases at 0.83, near copies around the threshold whose edits coincide, a base repeated as a third of the rows."""
    rng = random.Random(21)
    one = [f"v{rng.randrange(500)}" for _ in range(140)]
    two = one[:122] + [f"w{j}" for j in range(18)]
    docs = []
    for i in range(500):
        copy = (one if i % 3 else two)[:]
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(len(copy))
            copy[at] = rng.choice([f"e{rng.randrange(10**6)}", f"f{at}", f"g{at % 9}"])
        docs.append((1000 + 7 * i, " ".join(copy)))
    docs += [(i, " ".join(two)) for i in range(250)]
    docs += [(20_000 + i, " ".join(f"p{rng.randrange(10**6)}" for _ in range(100)) + " " + " ".join(one[:20])) for i in range(60)]
    want = brute(docs, 3, 85)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for small, rare in ((24, 16), (2, 3), (10**6, 16)):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "RARE", rare)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 3, 85, 25, 5).collect()}
        assert got == want, (small, rare)


def test_near_duplicates_of_odd_ids(spark):
    long = " ".join(f"a{i}" for i in range(40))
    rows = [(1, long), (1, long), (2, "b c d"), (2, long), (3, "b c d"), (None, long), (None, None), (4, None), (4, "  "), (5, "x"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("k").alias("key"), F.lit(1).alias("tag"))
    got = sorted(minhash.near_duplicates(df, 5, 80).collect(), key=str)
    # the longer text stands for document 2
    want = [(1, 36, 1, True), (2, 36, 1, False), (3, 1, 3, True), (4, 0, 4, True), (5, 1, 5, True), (None, 36, None, True), (None, 0, None, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_estimate():
    rng = np.random.default_rng(13)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    x, y = (minhash.registers(np.unique(s), 1024)[None] for s in (a, b))
    assert abs(minhash.estimate(x, y)[0] - 1500 / 2500) < 0.06


def test_components(spark):
    rng = random.Random(14)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    key = list(got.columns)
    assert sorted(map(str, got[key].astype(object).where(got[key].notna(), None).values.tolist())) == sorted(map(str, want[key].astype(object).where(want[key].notna(), None).values.tolist())) or got[key].fillna(-1).astype(float).sort_values(key).values.tolist() == want[key].fillna(-1).astype(float).sort_values(key).values.tolist()
