"""Operators against golden values and plain Python models."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import consensus, joins, ordered, quality, report, score, select, split, tokens
from quern.sources import files


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t")).alias("x")).first()["x"]


def test_normalisation(spark):
    assert one(spark, "[NORM] 發展， 好！", T.normalize_reference) == "發展好"
    assert one(spark, "[RAW] 發展， 好！", T.normalize_prediction) == "发展好"
    assert one(spark, "x [RAW] y", T.normalize_reference) == "xRAWy"
    assert one(spark, "a　b c\td\x1ce", T.normalize_reference) == "abcde"
    assert one(spark, None, T.normalize_competition) == ""
    assert one(spark, " １２　 ab ", T.clean_text) == "12 ab"
    assert one(spark, "𠮶a", F.length) == 2


def test_ids_and_flags(spark):
    for raw, want in (("007", "7"), ("12.0", "12"), ("0", "0"), ("1.5", ""), ("x", "")):
        assert one(spark, raw, T.normalize_id) == want
    assert one(spark, "a/1003211号.wav", T.leading_id) == "10032"
    assert one(spark, "a\x01", T.abnormal_unicode) is True
    assert one(spark, "a\t\n\r", T.abnormal_unicode) is False
    assert one(spark, "", T.abnormal_unicode) is True
    assert one(spark, "�!!!!!!!!", T.abnormal_reasons) == ["unicode_replacement_character", "punctuation_run"]
    assert one(spark, "  ", T.abnormal_reasons) == ["empty_text"]
    assert one(spark, "a�\x01\n", T.abnormal_characters) == 2


def phrase(text, widths, tail=None, whole_bound=None):
    c = "".join(text.split())
    if any(c[i] * 8 == c[i : i + 8] for i in range(len(c))):
        return True
    if whole_bound is not None:
        return any(c[s : s + w] * 4 in c[s:] for s in range(len(c) - whole_bound) for w in widths if len(c[s : s + w]) == w)
    c = c[-tail:]
    return any(len(c[s : s + w]) == w and c[s : s + w] * 4 in c[s:] for s in range(len(c)) for w in widths)


def test_repetition(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([5, 60, 119, 122, 140, 170]))) for _ in range(60)]
    texts += ["x" * n + "ab" * 4 + "".join(rng.choice("cdefgh") for _ in range(k)) for n in (0, 7) for k in (0, 111, 112, 113, 121, 152, 153, 160)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.repeated_phrase(F.col("t")).alias("a"), T.repeated_runaway(F.col("t")).alias("b"), T.long_text_cycle(F.col("t")).isNotNull().alias("c")).collect()
    for r in rows:
        assert r["a"] == phrase(r["t"], (2, 3, 4), whole_bound=120), r["t"]
        assert r["b"] == phrase(r["t"], range(2, 13), tail=120), r["t"]
        assert r["c"] == phrase(r["t"], (2, 3, 4), tail=160), r["t"]


def test_bins(spark):
    edges = [0, 3, 5, 8]
    got = [r["x"] for r in spark.createDataFrame([(-1.0,), (0.0,), (3.0,), (7.9,), (8.0,)], "v double").select(T.half_open_bin(F.col("v"), edges, "dur").alias("x")).collect()]
    assert got == ["dur_below_0", "dur_0_3", "dur_3_5", "dur_5_8", "dur_8_plus"]


def test_alignment_and_metrics(spark):
    assert score.align("ab", "ba") == [("a", "b"), ("b", "a")]
    assert score.align("", "x") == [("<ins>", "x")]
    assert score.align("abc", "ac") == [("a", "a"), ("b", "<del>"), ("c", "c")]
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in "12")
        p = score.align(a, b)
        assert "".join(s for s, _ in p if s != "<ins>") == a and "".join(d for _, d in p if d != "<del>") == b
    rows = spark.createDataFrame([("發展", "发展"), ("", "")], "reference string, hypothesis string")
    m = score.corpus_metrics(rows).first()
    assert (m["edits"], m["characters"], m["tol2"]) == (1, 3, 1.0)
    empty = score.corpus_metrics(rows.limit(0)).first()
    assert (empty["samples"], empty["cer"], empty["tol2"]) == (0, 0.0, 0.0)


def fold(rows, keys):
    held, out = {k: {} for k in keys}, []
    for r in rows:
        why = next((f"duplicate_{k}" for k in keys if r[k] is not None and r[k] in held[k]), None)
        out.append((r["i"], why is None, why))
        if why is None:
            for k in keys:
                if r[k] is not None:
                    held[k][r[k]] = r["i"]
    return out


def test_greedy_acceptance(spark):
    rng = random.Random(3)
    for size in (3, 40):
        rows = [{"i": i, "k": rng.choice([*"abcdefgh", None]), "x": rng.choice([*"pqrstuvw", None])} for i in range(size)]
        if size == 3:
            rows = [{"i": 0, "k": "1", "x": "x"}, {"i": 1, "k": "1", "x": "y"}, {"i": 2, "k": "2", "x": "y"}]
        df = spark.createDataFrame([(r["i"], r["k"], r["x"]) for r in rows], "i long, k string, x string")
        got = sorted((r["i"], r["accepted"], r["reason"]) for r in quality.accept_in_order(df, "i", ["k", "x"]).collect())
        assert got == fold(rows, ["k", "x"])


def test_bands_and_boundaries(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(100)], "id long, loss double")
    got = sorted(r["id"] for r in ordered.loss_band(rows, "loss", "id", 0.1, 0.9).collect())
    assert got == list(range(10, 90))
    rows = spark.createDataFrame([(i, 1.0) for i in range(1, 101)], "i long, v double")
    s = ordered.running_sum(rows, "i", "v", "t", block=7)
    assert {r["i"]: int(r["t"]) for r in s.collect()} == {i: i for i in range(1, 101)}
    near = {r["target"]: r["boundary"] for r in ordered.nearest_boundary(s, "i", "t", [24.0, 40.0, 3.0], 16, with_zero=True).collect()}
    assert near == {24.0: 16, 40.0: 32, 3.0: 0}
    first = {r["target"]: r["boundary"] for r in ordered.first_reach(s, "i", "t", [24.0, 32.0], 16).collect()}
    assert first == {24.0: 32, 32.0: 32}
    assert ordered.prefix_check(rows.where("i < 5"), rows, "i", "v").first()["passed"]
    assert not ordered.prefix_check(rows, rows.where("i < 5"), "i", "v").first()["passed"]


def test_validation_selection(spark):
    rows = spark.createDataFrame([("validation", True, 0.90, 0.10, 1, 10), ("validation", True, 0.896, 0.09, 1, 20), ("validation", True, 0.80, 0.01, 0, 30)], "surface string, complete boolean, tol2 double, cer double, severe int, step int")
    assert ordered.select_validation(rows).first()["step"] == 20
    with pytest.raises(Exception, match="complete finite"):
        ordered.select_validation(rows.withColumn("cer", F.lit(float("nan")))).collect()


def test_counts_and_batches(spark):
    assert split.balanced_counts(17008, [8451, 64779]) == [8451, 8557]
    assert split.balanced_counts(7, [3, 3, 3]) == [3, 2, 2]
    rows = spark.range(100).withColumnRenamed("id", "i")
    b = split.batches(rows, "i", 2, 16, "s")
    per = {(r["epoch"], r["batch"]): r["n"] for r in b.groupBy("epoch", "batch").agg(F.count("*").alias("n")).collect()}
    assert len(per) == 14 and per[(0, 6)] == 4
    draws = [r["i"] for r in split.repeated_sample(rows, "i", 250, 0, "s").collect()]
    assert len(draws) == 250 and max(draws.count(x) for x in set(draws)) == 3
    fixed = split.repair_duplicates([1, 1, 2, 3, 4, 5], 2)
    assert sorted(fixed) == [1, 1, 2, 3, 4, 5] and all(fixed[k] != fixed[k + 1] for k in (0, 2, 4))
    with pytest.raises(ValueError):
        split.repair_duplicates([1, 1], 2)
    assert split.repair_duplicates([1, 1, 2, 3, 4, 5], 2) == [1, 2, 1, 3, 4, 5]
    assert split.repair_duplicates([1, 1, 2, 3, 4, 5], 2, {1: "a", 2: "b", 3: "b", 4: "a", 5: "b"}) == [1, 4, 2, 3, 1, 5]
    with pytest.raises(ValueError):
        split.repair_duplicates([1, 2, 3, 3], 2)
    numbered = lambda n: rows.where(f"i < {n}").withColumnRenamed("i", "b")
    for official, other in ((3, 7), (1, 3), (0, 4), (5, 0), (4, 4), (9, 2)):
        order = {r["place"]: r["kind"] for r in split.spread_batches(numbered(official), numbered(other), "b").collect()}
        held, want = 0, []
        for k in range(official + other):
            due = held * (official + other) <= k * official and held < official
            held += due
            want.append("official" if due else "other")
        assert [order[k] for k in range(official + other)] == want
    mixed = split.blocks_with_one(rows.where("i < 60"), rows.where("i >= 60"), "i", 5, 20, 0, "s").collect()
    assert sorted(r["draw"] for r in mixed) == list(range(100))
    assert all(sum(r["pool"] == "other" for r in mixed if r["draw"] // 5 == k) == 1 for k in range(20))
    even = split.source_balanced(rows.withColumn("s", F.when(F.col("i") < 90, "a").otherwise("b")), "s", "i", 30, 1, "s")
    assert {r["s"]: r["n"] for r in even.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 30, "b": 30}


def test_split_keeps_groups(spark):
    rows = spark.createDataFrame([(i, f"t{i // 3}", "x" if i < 60 else "y") for i in range(90)], "id long, text string, scene string")
    out = split.stratified_group_split(rows, "text", "scene", "id", 0.1, "42")
    assert out.groupBy("text").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r["scene"]: r["n"] for r in out.where("split = 'validation'").groupBy("scene").agg(F.count("*").alias("n")).collect()} == {"x": 6, "y": 3}


def test_ranking(spark):
    a = {"label": "a", "cer": 0.09, "tol2": 0.84, "severe": 0, "hours": 1.0}
    rows = [(0, "A", 0.0900, 0.8400), (1, "B", 0.0901, 0.8418), (2, "C", 0.0902, 0.8436)]
    df = spark.createDataFrame([(i, n, c, t, 0, 1.0) for i, n, c, t in rows], "i int, label string, cer double, tol2 double, severe int, hours double").withColumn("failures", F.array().cast("array<string>"))
    assert [r["label"] for r in select.rank_with_band(df, "i")] == ["A", "B", "C"]
    assert spark.createDataFrame([a]).select(F.round(select.proxy(F.col("cer"), F.col("tol2")), 6).alias("p")).first()["p"] == 80.5
    limits = {"validation_tol2_min": 0.8, "public_tol2_min": 0.8, "public_insertions_max": 9, "public_severe_max": 9, "public_repeated_runaway_max": 0, "public_replacement_max": 0, "public_effective_max_max": 99, "ood_tol2_min": 0.1, "ood_cer_max": 0.5}
    fields = {"validation_tol2": "0.7", "public_tol2": "0.9", "public_insertions": "10", "public_severe": "1", "public_repeated_runaway": "0", "public_replacement": "0", "public_effective_max": "5", "ood_tol2": "0.3", "ood_cer": "0.4"}
    good = spark.createDataFrame([{**fields, "complete": True}, {**fields, "ood_cer": "x", "complete": True}])
    got = sorted(r["failures"] for r in select.guardrails(good, limits).collect())
    assert got == [["incomplete"], ["validation_tol2", "public_insertions"]]
    parents = spark.createDataFrame([(1, "a", 1e-5), (2, "b", 2e-5)], "rank int, label string, learning_rate double")
    assert sorted(r["name"] for r in select.branches(parents, 40).collect()) == ["TOP1_CONSTANT_TO_40H", "TOP1_HALF_TO_40H", "TOP2_CONSTANT_TO_40H", "TOP2_HALF_TO_40H"]
    with pytest.raises(ValueError):
        select.branches(parents.limit(1), 40)


def test_extension(spark):
    cols = "seed int, step int, tol2 double, cer double, severe int, repeated_runaway int, replacement int, max_length int, integrity_pass boolean"
    rows = spark.createDataFrame([(s, k, 0.9, 0.1 - 0.01 * (k > 2), 1, 0, 0, 5, True) for s in (42, 43) for k in (1, 2, 3, 4)], cols)
    seeds = select.extension(rows, (1, 2), (3, 4))
    assert select.extend(seeds).first()["extend"]
    worse = select.extension(rows.withColumn("severe", F.when(F.col("step") > 2, 2).otherwise(1)), (1, 2), (3, 4))
    assert not select.extend(worse).first()["extend"] and worse.first()["failures"] == ["severe_regression"]


def test_consensus(spark):
    for texts, want in ((["a", "xxa", "a"], "a"), (["a", "xyza", "xyza"], "xyza"), (["", "", "xxxxx"], "")):
        assert all(consensus.rover(texts, k) == want for k in range(3))
    assert consensus.rover(["a", "xa", "ya"], 0) == "a"
    rows = spark.createDataFrame([(["ab", "ab", "zz"], "zz")], "texts array<string>, ref string")
    assert rows.select(consensus.medoid(rows, "texts").alias("m")).first()["m"] == 0
    assert rows.select(consensus.oracle(rows, "texts", "ref").alias("m")).first()["m"] == 2


def test_nearest(spark):
    """Against the plain table; two long texts, whose tables have 3.6e9 places each, within seconds."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    some = lambda most: "".join(rng.choice("abé𠮶") for _ in range(rng.randint(0, most)))
    cases = []
    for _ in range(300):
        ref = some(rng.choice([3, 12, 90]))
        texts = [rng.choice([some(90), some(4), ref, ref[::-1], ref.replace("a", "b"), ref.replace("ab", "é"), ref.replace("b", ""), ref[1:] + ref[:1], None]) for _ in range(rng.randint(0, 5))]
        cases.append((texts, ref))
        for t in filter(None, texts):
            assert consensus.edits(ref, t) == consensus.edits(t, ref) == distance(ref, t)
    cases += [(["a", "b"], None), (None, "a"), ([None, None], "a"), ([None, "zzz"], "a"), ([], "a")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, texts array<string>, ref string")
    for r in rows.select("i", consensus.oracle(rows, "texts", "ref").alias("m")).collect():
        texts, ref = cases[r["i"]]
        want = None if not texts else 0 if ref is None else min(range(len(texts)), key=lambda k: (texts[k] is None, texts[k] is not None and distance(texts[k], ref), k))
        assert r["m"] == want

    long = "".join(rng.choice("aehinrt ") for _ in range(60_000))
    rows = spark.createDataFrame([([long[::-1], long[9:] + "in the air", long.replace("th", "d")], long)], "texts array<string>, ref string")
    began = time.monotonic()
    assert rows.select(consensus.oracle(rows, "texts", "ref").alias("m")).first()["m"] == 1
    assert time.monotonic() - began < 15


def test_tokens(spark):
    def period(ids, widest):
        best = None
        for w in range(1, min(widest, len(ids) // 2) + 1):
            n, at = 1, len(ids) - w
            while at >= w and ids[at - w : at] == ids[-w:]:
                n, at = n + 1, at - w
            if n >= 2 and (best is None or (n * w, n, -w) > best):
                best = (n * w, n, -w)
        return best

    rng = random.Random(4)
    cases = [[rng.choice([1, 2]) for _ in range(rng.randint(0, 14))] for _ in range(60)] + [[7, 8, 9] * 30]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<int>").select("i", tokens.trailing_period(F.col("ids")).alias("p"), tokens.runaway_reasons(F.col("ids"), F.lit(True)).alias("r")).collect()
    for r in got:
        want = period(cases[r["i"]], 8)
        assert (want is None) == (r["p"] is None)
        if want:
            assert (r["p"]["coverage"], r["p"]["repeats"], -r["p"]["size"]) == want
    assert [r["r"] for r in got if r["i"] == 60] == [["trailing_ngram_cycle", "low_tail_token_diversity", "max_length_periodic_cycle"]]
    assert one(spark, [5, 2, 7, 2], lambda c: tokens.until_end(c, 2), "array<int>") == [5, 2]
    assert one(spark, [2, 5, 2, 7], lambda c: tokens.until_end(c, 2, 1), "array<int>") == [2, 5, 2]
    assert one(spark, [1, 2, 1], lambda c: tokens.drop_special(c, [2]), "array<int>") == [1, 1]


def test_end_cycles(spark):
    """Repeats at the end against their definition, nulls among the ids; cycles of 20,000 ids within seconds."""

    def repeats(ids, width):
        n = 0
        while (n + 1) * width <= len(ids) and ids[len(ids) - (n + 1) * width : len(ids) - n * width] == ids[len(ids) - width :]:
            n += 1
        return n

    rng = random.Random(6)
    cases = [[rng.choice([1, 2, None]) for _ in range(rng.randint(0, 9))] + [rng.choice([1, 2, None]) for _ in range(rng.randint(0, 6))] * rng.randint(0, 9) for _ in range(200)] + [None]
    ids = F.col("ids")
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, ids array<int>").withColumn("found", tokens.end_repeats(ids, 16))
    forms = rows.select("i", "found", tokens.trailing_cycle(ids).alias("c"), tokens.trailing_cycle(ids, F.col("found")).alias("d"), tokens.trailing_period(ids, 8).alias("p"), tokens.trailing_period(ids, 8, F.col("found")).alias("q"), tokens.runaway_reasons(ids, F.lit(True)).alias("r"), tokens.runaway_reasons(ids, F.lit(True), F.col("found")).alias("s")).collect()
    for r in forms:
        assert (r["c"], r["p"], r["r"]) == (r["d"], r["q"], r["s"])
        if cases[r["i"]] is None:
            assert r["c"] is None and r["p"] is None
            continue
        n = [repeats(cases[r["i"]], w) for w in range(1, 17)]
        assert r["found"] == n
        assert r["c"] == next((w for w in range(1, 5) if n[w - 1] >= 4 and n[w - 1] * w >= 8), None)
        best = max(((n[w - 1] * w, n[w - 1], -w) for w in range(1, 9) if n[w - 1] >= 2), default=None)
        assert best == (r["p"] and (r["p"]["coverage"], r["p"]["repeats"], -r["p"]["size"]))

    rows = spark.createDataFrame([([7] * 20_000,), ([3, 4, 5, 6] * 5_000,)], "ids array<int>")
    began = time.monotonic()
    got = rows.select(tokens.trailing_period(ids).alias("p"), tokens.trailing_cycle(ids).alias("c"), tokens.runaway_reasons(ids, F.lit(True)).alias("r")).collect()
    assert time.monotonic() - began < 15
    assert [(r["p"]["size"], r["p"]["repeats"], r["c"], len(r["r"])) for r in got] == [(1, 20_000, 1, 3), (4, 5_000, 4, 3)]


def test_joins_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 4, 4), (2, 9, 0)], "id int, x long, y long")
    cells = spark.createDataFrame([("a", 0, 0), ("b", 5, 5), ("c", 9, 1)], "cell string, x long, y long")
    assert {r["id"]: r["cell"] for r in joins.nearest_cell(rows, cells, "x", "y").collect()} == {1: "b", 2: "c"}
    kept, rest, ok = joins.exclude(rows, spark.createDataFrame([(1,), (5,)], "id int"), "id")
    assert kept.count() == 1 and rest.count() == 1 and not ok.first()["passed"]
    with pytest.raises(AssertionError):
        quality.require(ok)
    h = report.histogram(spark.createDataFrame([(0.0,), (30.0,), (31.0,)], "v double"), "v", [0, 10, 30]).collect()
    assert sorted((r["bin"], r["n"]) for r in h) == [(0, 1), (1, 1)]
    w = report.weighted_mean(spark.createDataFrame([(2.0, 2), (1.0, 6)], "l double, n long"), "l", "n").first()
    assert (w["mean"], w["weight"]) == (1.25, 8)
    path = str(tmp_path / "a.jsonl")
    (tmp_path / "a.jsonl").write_text('{"id": "x"}\n\n{"id": "y"}\n', encoding="utf-8")
    assert [(r["row_idx"], r["id"]) for r in files.read_jsonl_ordered(spark, path, "id string").orderBy("row_idx").collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "b.csv").write_text("﻿audio:file,text:label\na.wav,hello\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "b.csv"), aliases={"audio:file": "audio_path", "text:label": "text"})
    assert got.columns == ["audio_path", "text"] and got.count() == 1
