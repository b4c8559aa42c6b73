"""Queries over the test tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import consensus, joins, ordered, quality, report, score, select, split
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# conversation turns as references; hypotheses drop and replace letters. DuckDB counts edits in bytes, so the SQL
# first gives each letter outside ASCII a control character of its own.
PAIRS_SQL = """letters AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM conversations),
bytes AS (SELECT c, chr(CAST(CASE WHEN k < 10 THEN k ELSE k + 1 END AS INTEGER)) AS b FROM (SELECT c, row_number() OVER (ORDER BY c) AS k FROM letters WHERE ord(c) > 127)),
pairs AS (
  SELECT conv_id * 1000 + turn AS id, role, r AS reference, replace(replace(r, 'th', 'd'), 'in', 'n') AS hypothesis
  FROM (SELECT conv_id, turn, role, translate(text, (SELECT coalesce(string_agg(c, '' ORDER BY c), '') FROM bytes), (SELECT coalesce(string_agg(b, '' ORDER BY c), '') FROM bytes)) AS r FROM conversations)
), scored AS (SELECT *, levenshtein(reference, hypothesis) AS d, greatest(length(reference), 1) AS n FROM pairs)"""


def _pairs(read: Callable[[str], DataFrame]) -> DataFrame:
    r = F.col("text")
    hyp = F.regexp_replace(F.regexp_replace(r, "th", "d"), "in", "n")
    return read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", r.alias("reference"), hyp.alias("hypothesis"))


@query(f"""WITH {PAIRS_SQL}
SELECT role, count(*) AS samples, CAST(sum(d) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS characters, round(sum(d) / sum(n), 9) AS cer,
  round(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), 9) AS tol0, round(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0.0 END), 9) AS tol1, round(avg(CASE WHEN d <= 2 THEN 1.0 ELSE 0.0 END), 9) AS tol2
FROM scored GROUP BY role""")
def corpus_metrics_by_role(read):
    return score.corpus_metrics(_pairs(read), ["role"])


@query(f"""WITH {PAIRS_SQL}, u AS (SELECT *, d / n AS c FROM scored), top AS (SELECT sum(d) AS w FROM (SELECT d FROM scored ORDER BY d DESC, id LIMIT 20))
SELECT count(*) AS samples, CAST(sum(d) AS BIGINT) AS edits, count(*) FILTER (d = 0) AS edits_0, count(*) FILTER (d = 1) AS edits_1, count(*) FILTER (d = 2) AS edits_2, count(*) FILTER (d BETWEEN 3 AND 5) AS edits_3_5,
  count(*) FILTER (d > 5) AS edits_over_5, count(*) FILTER (d > 5) AS severe, round(avg(c), 9) AS cer_mean, round(quantile_cont(c, 0.5), 9) AS cer_median, round(quantile_cont(c, 0.9), 9) AS cer_p90,
  round(quantile_cont(c, 0.95), 9) AS cer_p95, round(max(c), 9) AS cer_max, round((SELECT w FROM top) / sum(d), 9) AS worst_share
FROM u""")
def diagnostic_buckets(read):
    return score.diagnostics(_pairs(read))


@query(f"""WITH {PAIRS_SQL}
SELECT id, CAST(d AS BIGINT) AS edit_distance, round(d / n, 9) AS utterance_cer, round(d / sum(n) OVER (), 12) AS corpus_cer_contribution FROM scored""")
def sample_scores(read):
    return score.sample_scores(_pairs(read)).select("id", "edit_distance", F.round("utterance_cer", 9).alias("utterance_cer"), F.round("corpus_cer_contribution", 12).alias("corpus_cer_contribution"))


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY d DESC, id) AS k FROM scored)
SELECT CAST(sum(d) AS BIGINT) AS edits, count(*) FILTER (d >= 0.8 * greatest(length(reference), length(hypothesis), 1)) AS misaligned,
  CAST(sum(d) FILTER (k <= 5) AS BIGINT) AS worst_5, CAST(sum(d) FILTER (k <= 10) AS BIGINT) AS worst_10, CAST(sum(d) FILTER (k <= 20) AS BIGINT) AS worst_20, CAST(sum(d) FILTER (k <= 50) AS BIGINT) AS worst_50 FROM k""")
def error_profile(read):
    return score.error_profile(_pairs(read))


def _short(read: Callable[[str], DataFrame]) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("reference"), F.regexp_replace(F.regexp_replace("text", "th", "d"), "on", "no").alias("hypothesis"))


@query()
def confusions(read):
    return score.confusions(_short(read))


@query()
def operation_counts(read):
    return _short(read).select("id", score.alignment("reference", "hypothesis").alias("p")).select("id", *(c.alias(n) for n, c in score.operation_counts(F.col("p")).items()))


@query()
def rover_vote(read):
    r = _short(read)
    return r.select("id", consensus.rover_vote(F.array("hypothesis", "reference", F.regexp_replace("reference", "er", "e")), F.lit(0)).alias("voted"))


EDGES = [0, 100, 300, 1000, 3000, 10000, 30000, 100000, 1000000]


@query(f"""WITH edges AS (SELECT unnest({EDGES}) AS e), bins AS (SELECT row_number() OVER (ORDER BY e) - 1 AS bin, e AS low, lead(e) OVER (ORDER BY e) AS high FROM edges)
SELECT CAST(bin AS INTEGER) AS bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, (SELECT count(*) FROM documents WHERE n_chars >= low AND (n_chars < high OR high = 1000000 AND n_chars = high)) AS n FROM bins WHERE high IS NOT NULL""")
def length_histogram(read):
    return report.histogram(read("documents"), "n_chars", EDGES)


@query("""SELECT source, count(*) AS n, round(sum(n_chars) / 3600, 4) AS hours, count(DISTINCT text) AS distinct_text, count(DISTINCT lang) AS distinct_lang FROM documents GROUP BY source""")
def source_report(read):
    return report.group_report(read("documents"), ["source"], "n_chars", ["text", "lang"])


@query("""SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95,
  CAST(min(n_chars) AS DOUBLE) AS least, CAST(max(n_chars) AS DOUBLE) AS most, CAST(sum(n_chars) AS DOUBLE) AS total FROM documents GROUP BY lang""")
def length_summary(read):
    return report.describe(read("documents"), "n_chars", ["lang"])


@query("""SELECT coalesce(lang, '') AS lang, count(*) AS n FROM documents GROUP BY 1""")
def language_distribution(read):
    return report.distribution(read("documents"), "lang")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'document_without_label' WHEN d.doc_id IS NULL THEN 'label_without_document' END AS reason
FROM (SELECT doc_id FROM documents WHERE lang <> 'en') d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def outer_join_quarantine(read):
    return joins.reconcile(read("documents").where("lang <> 'en'").select("doc_id"), read("labels"), "doc_id", "document_without_label", "label_without_document").select("doc_id", "reason")


@query("""SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'duplicate_text' END AS reason FROM documents""")
def duplicate_groups(read):
    return quality.quarantine_repeated(read("documents").select("doc_id", "text"), "text", "duplicate_text").select("doc_id", "reason")


@query("""WITH p AS (SELECT doc_id, text, source || ':' || n_chars AS size FROM documents WHERE lang = 'de' OR source = 'src0'), d AS (SELECT *, source || ':' || n_chars AS size FROM documents)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM p) THEN 'protected_id' WHEN text IN (SELECT text FROM p) THEN 'protected_text' WHEN size IN (SELECT size FROM p) THEN 'protected_size' END AS reason FROM d""")
def protected_overlap(read):
    d = read("documents").withColumn("size", F.concat_ws(":", "source", F.col("n_chars").cast("string")))
    p = d.where("lang = 'de' OR source = 'src0'")
    return joins.protect(d, p, [("doc_id", F.col("doc_id")), ("text", F.col("text")), ("size", F.col("size"))], ["protected_id", "protected_text", "protected_size"]).select("doc_id", "reason")


@query("""WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS text, source || ':' || n_chars AS size, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS doc_id, false AS a, false AS b, CAST([] AS VARCHAR[]) AS texts, CAST([] AS VARCHAR[]) AS sizes
  UNION ALL SELECT k, doc_id, a, b, CASE WHEN a OR b THEN texts ELSE list_append(texts, text) END, CASE WHEN a OR b THEN sizes ELSE list_append(sizes, size) END
  FROM (SELECT d.k, d.doc_id, d.text, d.size, texts, sizes, list_contains(texts, d.text) AS a, list_contains(sizes, d.size) AS b FROM r JOIN d ON d.k = r.k + 1))
SELECT doc_id, NOT (a OR b) AS accepted, CASE WHEN a THEN 'duplicate_text' WHEN b THEN 'duplicate_size' END AS reason FROM r WHERE k > 0""")
def greedy_acceptance(read):
    d = read("documents").select("doc_id", "text", F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("size"))
    return quality.accept_in_order(d, "doc_id", ["text", "size"]).select("doc_id", "accepted", "reason")


@query("""WITH g AS (SELECT text, arg_min(coalesce(lang, 'unknown'), doc_id) AS s, count(*) AS n FROM documents GROUP BY text),
r AS (SELECT *, row_number() OVER w AS k, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY s) AS m, greatest(1, round_even(sum(n) OVER (PARTITION BY s) * 0.1, 0)) AS target
  FROM g WINDOW w AS (PARTITION BY s ORDER BY sha256(concat_ws(':', '42', text)), text))
SELECT d.doc_id, CASE WHEN before < target AND k < m THEN 'validation' ELSE 'train' END AS split FROM documents d JOIN r ON d.text = r.text""")
def stratified_split(read):
    return split.stratified_group_split(read("documents"), "text", "lang", "doc_id", 0.1, "42").select("doc_id", "split")


@query("""WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(':', '43', doc_id::VARCHAR)), doc_id) AS k FROM documents)
SELECT doc_id FROM k ORDER BY k, lang LIMIT 100""")
def stratified_probe(read):
    return split.stratified_probe(read("documents").select("doc_id", "lang"), "lang", "doc_id", 100, "43").select("doc_id")


@query("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(concat_ws(':', 'panel', doc_id::VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 5""")
def panel_sample(read):
    return split.panel(read("documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 5, "panel")


@query("""WITH g AS (SELECT source, sum(n_chars) AS w FROM documents GROUP BY source), s AS (SELECT *, sum(w) OVER () AS t FROM g), f AS (SELECT source, w, CAST(1000 * w AS HUGEINT) // CAST(t AS HUGEINT) AS q, (1000 * w) % t AS r FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY r DESC, source) AS k, 1000 - sum(q) OVER () AS open FROM f)
SELECT source, CAST(w AS BIGINT) AS w, CAST(q + CASE WHEN k <= open THEN 1 ELSE 0 END AS BIGINT) AS share FROM k""")
def largest_remainder(read):
    return split.largest_remainder(read("documents").groupBy("source").agg(F.sum("n_chars").alias("w")), "source", "w", 1000)


@query("""WITH l AS (SELECT source, row_number() OVER (ORDER BY source) AS lane FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, CAST(lane AS INTEGER) AS lane, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(':', 'rr', doc_id::VARCHAR)), doc_id) AS INTEGER) AS turn FROM documents JOIN l USING (source)""")
def round_robin_stream(read):
    return split.round_robin(read("documents").select("doc_id", "source"), "source", "doc_id", "rr").select("doc_id", "lane", "turn")


@query("""SELECT doc_id, e AS epoch, (p // 16) AS batch, p % 16 AS "offset" FROM (
  SELECT doc_id, e, row_number() OVER (PARTITION BY e ORDER BY sha256(concat_ws(':', 'b', e::VARCHAR, doc_id::VARCHAR)), doc_id) - 1 AS p FROM documents, (SELECT unnest([0, 1]) AS e))""")
def epoch_batches(read):
    return split.batches(read("documents").select("doc_id"), "doc_id", 2, 16, "b")


@query("""WITH t AS (SELECT text, row_number() OVER (ORDER BY sha256(concat_ws(':', 'lm', text)), text) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT text FROM documents))
SELECT doc_id, CASE WHEN p < least(n - 1, greatest(1, round_even(n * 0.05, 0))) THEN 'dev' ELSE 'train' END AS split FROM documents JOIN t USING (text)""")
def text_split(read):
    return split.text_split(read("documents").select("doc_id", "text"), "text", 0.05, "lm").select("doc_id", "split")


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', 'c', doc_id::VARCHAR)), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, (((p - 360) % n) + n) % n AS draw FROM p WHERE (((p - 360) % n) + n) % n < 120""")
def cyclic_sample(read):
    return split.cyclic_sample(read("documents").select("doc_id"), "doc_id", 120, 3, "c")


@query("""WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY CAST(n_chars AS DOUBLE), doc_id::VARCHAR) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM k WHERE k >= ceil(n * 0.1) AND k < ceil(n * 0.9)""")
def loss_band(read):
    d = read("documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("loss"))
    return ordered.loss_band(d, "loss", "doc_id", 0.1, 0.9, ["lang"]).select("doc_id", "lang")


@query("""WITH s AS (SELECT CAST(p_partkey AS BIGINT) AS i, CAST(sum(CAST(p_retailprice AS DECIMAL(28, 6))) OVER (ORDER BY p_partkey) AS DOUBLE) AS t FROM part), a AS (SELECT * FROM s WHERE i % 16 = 0), g AS (SELECT unnest([10000.0, 50000.0, 100000.0]) AS target)
SELECT CAST(target AS DOUBLE) AS target, arg_min(i, (abs(t - target), i)) AS boundary FROM a, g GROUP BY target""")
def aligned_boundaries(read):
    s = ordered.running_sum(read("part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", "total")
    return ordered.nearest_boundary(s, "p_partkey", "total", [10000.0, 50000.0, 100000.0], 16)


@query("""WITH c AS (SELECT source, count(*) AS r FROM documents WHERE lang = 'en' GROUP BY source), k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(':', 'o', doc_id::VARCHAR)), doc_id) AS place FROM documents)
SELECT doc_id, CAST(place AS INTEGER) AS place, round(place / r, 9) AS priority FROM k JOIN c USING (source)""")
def balanced_order(read):
    d = read("documents").select("doc_id", "source", "lang")
    counts = d.where("lang = 'en'").groupBy("source").agg(F.count("*").alias("reference"))
    o = split.balanced_order(d, "source", [T.stable_digest("o", F.col("doc_id")), "doc_id"], counts, "reference")
    return o.select("doc_id", "place", F.round("priority", 9).alias("priority"))


@query("""SELECT event_id // 100 AS "window", event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def step_window_exposure(read):
    return ordered.exposure_windows(read("events"), "event_id", "event_type", 100)


@query("""SELECT user_id, arg_min(event_id, (-value, event_id)) AS event_id FROM events GROUP BY user_id""")
def best_event(read):
    e = read("events").select("user_id", "event_id", "value", F.lit(None).cast("double").alias("cer"))
    return ordered.best_row(e, "user_id", "value", "cer", "event_id").select("user_id", "event_id")


@query("""SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'view') AS "view", arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id""")
def merged_records(read):
    e = read("events").select("user_id", "event_id", F.create_map(F.col("event_type"), F.col("value")).alias("fields_map"))
    return ordered.merge_records(e, ["user_id"], "event_id", ["view", "click", "purchase"])


@query("""WITH f AS (SELECT source, count(*) AS reference FROM documents GROUP BY source), a AS (SELECT source, count(*) AS actual FROM documents WHERE lang = 'fr' GROUP BY source)
SELECT source, reference, coalesce(actual, 0) AS actual, round((SELECT sum(actual) FROM a) * reference / (SELECT sum(reference) FROM f), 6) AS expected FROM f LEFT JOIN a USING (source)""")
def quota_deviations(read):
    d = read("documents").select("source", "lang")
    return report.quota_deviations(d, d.where("lang = 'fr'"), "source").select("source", "reference", "actual", F.round("expected", 6).alias("expected"))


NGRAM_SQL = """chars AS (SELECT item_id, list_concat(['<s>', '<s>'], list_concat(list_filter(string_split(text, ''), lambda c: c <> ''), ['</s>'])) AS s FROM benchmark),
ev AS (SELECT s[i - 2:i - 1] AS context, s[i] AS token FROM (SELECT s, unnest(range(3, len(s) + 1)) AS i FROM chars)),
counts AS (SELECT context, token, count(*) AS n FROM ev GROUP BY ALL), totals AS (SELECT context, sum(n) AS total FROM counts GROUP BY context),
vocabulary AS (SELECT DISTINCT token FROM counts UNION SELECT unnest(['</s>', '<unk>']))"""


@query(f"""WITH {NGRAM_SQL} SELECT array_to_string(context, '|') AS context, token, n FROM counts""")
def ngram_counts(read):
    counts, _, _ = consensus.fit_ngrams(read("benchmark"), "item_id", "text", 3)
    return counts.select(F.array_join("context", "|").alias("context"), "token", "n")


@query(f"""WITH {NGRAM_SQL}, v AS (SELECT count(*) AS v FROM vocabulary),
sc AS (SELECT conv_id * 1000 + turn AS id, greatest(length(text), 1) AS len, list_concat(['<s>', '<s>'], list_concat(list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: CASE WHEN list_contains(known, c) THEN c ELSE '<unk>' END), ['</s>'])) AS s FROM conversations, (SELECT list(token) AS known FROM vocabulary)),
se AS (SELECT id, len, s[i - 2:i - 1] AS context, s[i] AS token FROM (SELECT id, len, s, unnest(range(3, len(s) + 1)) AS i FROM sc))
SELECT id, round(sum(ln((coalesce(n, 0) + 0.1) / (coalesce(total, 0) + 0.1 * v))) / max(len), 6) AS lm_score FROM se LEFT JOIN counts USING (context, token) LEFT JOIN totals USING (context), v GROUP BY id""")
def ngram_scores(read):
    model = consensus.fit_ngrams(read("benchmark"), "item_id", "text", 3)
    c = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return consensus.score_ngrams(c, "id", "text", model, 3).select("id", F.round("lm_score", 6).alias("lm_score"))


@query(f"""WITH {PAIRS_SQL}, h AS (SELECT id, [reference, hypothesis, replace(reference, 'er', 'e')] AS t FROM pairs), e AS (SELECT id, t, unnest([0, 1, 2]) AS i FROM h),
r AS (SELECT id, i, list_sum(list_transform(t, lambda x: levenshtein(t[i + 1], x) / greatest(length(t[i + 1]), length(x), 1))) / 2 AS risk FROM e)
SELECT id, CAST(arg_min(i, (risk, i)) AS INTEGER) AS medoid FROM r GROUP BY id""")
def medoid(read):
    p = _pairs(read).select("id", F.array("reference", "hypothesis", F.regexp_replace("reference", "er", "e")).alias("texts"))
    return p.select("id", consensus.medoid(p, "texts").alias("medoid"))


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT id // 1000 AS conv, id % 1000 AS i, CAST(d AS DOUBLE) AS a, CAST(length(reference) AS DOUBLE) AS b FROM scored),
z AS (SELECT conv, i, round(coalesce((a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0), 0) + 0.5 * coalesce((b - avg(b) OVER w) / nullif(stddev_pop(b) OVER w, 0), 0), 9) AS z FROM c WINDOW w AS (PARTITION BY conv))
SELECT conv, CAST(arg_min(i, (-z, i)) AS BIGINT) AS chosen FROM z GROUP BY conv""")
def reranked(read):
    p = _pairs(read).select(F.floor(F.col("id") / 1000).alias("conv"), (F.col("id") % 1000).alias("i"), F.levenshtein("reference", "hypothesis").cast("double").alias("a"), F.length("reference").cast("double").alias("b"))
    return consensus.rerank(p, "conv", "i", "a", "b", 0.5)


@query(r"""SELECT conv_id * 1000 + turn AS id, regexp_matches(text, '[A-Za-z]') AS has_latin, regexp_matches(text, '[0-9]') AS has_digit, regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[\x{3400}-\x{9FFF}]') AS has_code_switch, contains(text, 'ou') OR contains(text, '會') AS has_word
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '會' WHEN turn % 3 = 1 THEN '學 7' ELSE text END AS text FROM conversations)""")
def marker_flags(read):
    c = read("conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("會"))).when(F.col("turn") % 3 == 1, "學 7").otherwise(F.col("text")))
    return c.withColumn("has_word", T.has_any(F.col("text"), ["ou", "會"])).select("has_word", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), *(c.alias(n) for n, c in T.marker_flags(F.col("text")).items()))


REPEATS_SQL = r"""t AS (SELECT id, c, length(c) AS n, CASE WHEN length(c) > 120 THEN right(c, 120) ELSE c END AS short, CASE WHEN length(c) > 160 THEN right(c, 160) ELSE c END AS long
  FROM (SELECT id, regexp_replace(text, '\s', '', 'g') AS c FROM said)),
runs AS (SELECT *, coalesce(list_bool_or(list_transform(range(1, n - 6), lambda i: substr(c, i, 8) = repeat(substr(c, i, 1), 8))), false) AS run FROM t)"""


@query(f"""WITH said AS (SELECT conv_id * 1000 + turn AS id, CASE turn % 5 WHEN 0 THEN text || 'aaaaaaaa' || text WHEN 1 THEN 'xyxyxyxy' || text WHEN 2 THEN text || 'abcabcabcabc' WHEN 3 THEN text || 'abcdeabcdeabcdeabcde' ELSE text END AS text FROM conversations), {REPEATS_SQL}
SELECT id, run OR coalesce(list_bool_or(list_transform([2, 3, 4], lambda w: coalesce(list_bool_or(list_transform(range(1, n - 119), lambda i: contains(substr(c, i), repeat(substr(c, i, w), 4)))), false))), false) AS repeated_phrase,
  run OR coalesce(list_bool_or(list_transform(range(2, 13), lambda w: coalesce(list_bool_or(list_transform(range(1, length(short) - 4 * w + 2), lambda i: substr(short, i, 4 * w) = repeat(substr(short, i, w), 4))), false))), false) AS repeated_runaway,
  CASE WHEN run THEN 'character' WHEN list_bool_or(list_transform([2, 3, 4], lambda w: coalesce(list_bool_or(list_transform(range(1, length(long) - 4 * w + 2), lambda i: substr(long, i, 4 * w) = repeat(substr(long, i, w), 4))), false))) THEN 'phrase' END AS cycle_kind
FROM runs""")
def repetition_flags(read):
    text, turn = F.col("text"), F.col("turn") % 5
    added = F.when(turn == 0, F.concat(text, F.lit("aaaaaaaa"), text)).when(turn == 1, F.concat(F.lit("xyxyxyxy"), text)).when(turn == 2, F.concat(text, F.lit("abcabcabcabc"))).when(turn == 3, F.concat(text, F.lit("abcdeabcdeabcdeabcde"))).otherwise(text)
    t = F.col("text")
    return read("conversations").withColumn("text", added).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.repeated_phrase(t).alias("repeated_phrase"), T.repeated_runaway(t).alias("repeated_runaway"), T.long_text_cycle(t)["kind"].alias("cycle_kind"))


@query("""SELECT source AS label, count(*) AS hours, CASE WHEN count(*) FILTER (lang = 'en') < 20 THEN 'few_english' END AS reason FROM documents GROUP BY source""")
def label_rejections(read):
    d = read("documents").groupBy(F.col("source").alias("label")).agg(F.count("*").alias("hours"), F.count_if(F.col("lang") == "en").alias("en"))
    return select.reject(d, ((F.col("en") < 20, "few_english"),)).select("label", "hours", F.get("reasons", F.lit(0)).alias("reason"))


@query("""SELECT 1 AS n, count(*) AS rows, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS sha256 FROM documents""")
def ordered_receipt(read):
    return files.sha256_lines(read("documents"), "doc_id", "doc_id").select(F.lit(1).alias("n"), F.col("n").alias("rows"), "sha256")


@query("""SELECT 'labels have documents' AS "check", count(*) = 0 AS passed, count(*) AS violations FROM labels l ANTI JOIN documents d USING (doc_id)
UNION ALL SELECT 'unique doc_id', count(*) = 0, count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'text in one source', count(*) = 0, count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) > 1)""")
def integrity_checks(read):
    d = read("documents")
    a = quality.check("labels have documents", read("labels").join(d, "doc_id", "left_anti"))
    return a.unionByName(quality.unique(d, "doc_id")).unionByName(quality.one_split_per_name(d, "text", "source"))


@query("""WITH a AS (SELECT doc_id, quality = 1 AS x FROM labels), b AS (SELECT doc_id, toxic = 0 AS y FROM labels)
SELECT count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither FROM a JOIN b USING (doc_id)""")
def quadrants(read):
    lab = read("labels")
    return score.quadrants(lab.select("doc_id", (F.col("quality") == 1).alias("ok")), lab.select("doc_id", (F.col("toxic") == 0).alias("ok")), "doc_id", "ok")


@query("""WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY sha256(concat_ws(':', 'm', o_orderkey::VARCHAR)), o_orderkey) - 1 AS position FROM orders)
SELECT o_orderkey, position // 32 AS step, (position % 32) // 8 AS microbatch, (position % 8) // 4 AS rank, position % 4 AS "row" FROM p""")
def microbatches(read):
    p = split.permutation(read("orders").select("o_orderkey"), "o_orderkey", "m")
    return split.microbatches(p, "position", 2, 4, 4).drop("position")


@query("""SELECT CAST(sum(value * user_id) / sum(user_id) AS DECIMAL(18, 6))::DOUBLE AS mean, CAST(sum(user_id) AS BIGINT) AS weight FROM events""")
def weighted_mean(read):
    return report.weighted_mean(read("events"), "value", "user_id").select(F.round("mean", 6).alias("mean"), "weight")
