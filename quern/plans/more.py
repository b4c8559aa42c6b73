"""More queries over the test tables: normalisation, rules, checks, reports, sequences, selections and round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import consensus, evidence, joins, ordered, quality, report, score, select, split, tokens
from ..sources import files
from .queries import PAIRS_SQL, _pairs, query

TRADITIONAL_SQL = f"'{T.TRADITIONAL}', '{T.SIMPLIFIED}'"
PUNCTUATION_SQL = T.PUNCTUATION.replace("'", "''")
DRESSED_SQL = f"""dressed AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[RAW] ' WHEN 1 THEN '[NORM]' ELSE '' END || substr('{T.TRADITIONAL}', CAST(doc_id % 40 + 1 AS INTEGER), 6) || '，' || text AS t FROM documents)"""


def _dressed(read):
    d = read("documents")
    mark = F.when(F.col("doc_id") % 3 == 0, "[RAW] ").when(F.col("doc_id") % 3 == 1, "[NORM]").otherwise("")
    return d.select("doc_id", F.concat(mark, F.substring(F.lit(T.TRADITIONAL), (F.col("doc_id") % 40 + 1).cast("int"), F.lit(6)), F.lit("，"), "text").alias("t"))


def _plain_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '^\[(RAW|NORM)\]\s*', ''), '{PUNCTUATION_SQL}', '', 'g'), '\s', '', 'g')"


@query(rf"""WITH {DRESSED_SQL}, n AS (SELECT doc_id, t, translate(t, {TRADITIONAL_SQL}) AS s, trim(regexp_replace(replace(nfc_normalize(t), '，', ','), '\s+', ' ', 'g')) AS c FROM dressed)
SELECT doc_id, md5({_plain_sql("t")}) AS reference, md5({_plain_sql("s")}) AS prediction, md5({_plain_sql("s")}) AS competition, md5(c) AS clean, md5(translate(c, {TRADITIONAL_SQL})) AS training, md5({_plain_sql(f"translate(c, {TRADITIONAL_SQL})")}) AS leakage FROM n""")
def normalized_texts(read):
    """P1-P7."""
    t = F.col("t")
    forms = {"reference": T.normalize_reference, "prediction": T.normalize_prediction, "competition": T.normalize_competition, "clean": T.clean_text, "training": T.normalize_training_text, "leakage": T.leakage_key}
    return _dressed(read).select("doc_id", *(F.md5(f(t)).alias(n) for n, f in forms.items()))


@query(r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE '' END AS id, CASE WHEN event_id % 2 = 0 THEN lpad(CAST(user_id AS VARCHAR), 5, '0') ELSE '' END AS leading,
  CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE substr(event_type || '_scenery', 1, 8) END AS scene, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS DOUBLE) END AS step FROM events""")
def normalized_ids(read):
    """P8, P9, P23, P25."""
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    raw = F.when(event % 3 == 0, F.concat(F.lit(" 00"), user, F.lit(".0 "))).when(event % 3 == 1, user).otherwise(F.concat(F.lit("x"), user))
    path = F.concat(F.lit("/a/12345/"), F.when(event % 2 == 0, F.lpad(user, 5, "0")).otherwise(F.lit("b")), F.lit("_x.wav"))
    scene = F.when(event % 2 == 0, F.concat(user, F.lit(" hall"))).otherwise(F.concat("event_type", F.lit("_scenery")))
    step = F.when(event % 4 == 0, F.concat(F.lit("run/checkpoint-"), event.cast("string"))).otherwise("checkpoint-last")
    return read("events").select("event_id", T.normalize_id(raw).alias("id"), T.leading_id(path).alias("leading"), T.scene_label(scene).alias("scene"), T.checkpoint_step(step).cast("double").alias("step"))


ODD_SQL = """odd AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || chr(65533) WHEN 1 THEN text || chr(7) WHEN 2 THEN text || '!!!!!!!!' WHEN 3 THEN chr(57345) || text WHEN 4 THEN ' ' ELSE text END AS t FROM documents)"""


def _odd(read):
    k, text = F.col("doc_id") % 6, F.col("text")
    odd = F.when(k == 0, F.concat(text, F.lit("�"))).when(k == 1, F.concat(text, F.lit("\x07"))).when(k == 2, F.concat(text, F.lit("!" * 8))).when(k == 3, F.concat(F.lit(""), text)).when(k == 4, " ").otherwise(text)
    return read("documents").select("doc_id", odd.alias("t"))


RUNS_SQL = "|".join(f"[{c}]{{8}}" for c in "，。！？,.!?;；")


@query(rf"""WITH {ODD_SQL}
SELECT doc_id, regexp_matches(t, '\x{{FFFD}}|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]|\p{{Co}}') AS abnormal,
  array_to_string(list_filter([CASE WHEN trim(t) = '' THEN 'empty_text' END, CASE WHEN contains(t, chr(65533)) THEN 'unicode_replacement_character' END, CASE WHEN regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]') THEN 'control_or_surrogate_character' END,
    CASE WHEN regexp_matches(t, '{RUNS_SQL}') THEN 'punctuation_run' END], lambda x: x IS NOT NULL), ',') AS reasons,
  length(t) - length(regexp_replace(t, '[\x{{FFFD}}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS characters FROM odd""")
def abnormal_texts(read):
    """P10-P12."""
    t = F.col("t")
    return _odd(read).select("doc_id", T.abnormal_unicode(t).alias("abnormal"), F.array_join(T.abnormal_reasons(t), ",").alias("reasons"), T.abnormal_characters(t).alias("characters"))


@query(rf"""WITH {ODD_SQL}
SELECT CAST(0 AS BIGINT) AS nfkc_changed, CAST(sum(length(t) - length(regexp_replace(t, '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g'))) AS BIGINT) AS controls, CAST(sum(length(t) - length(replace(t, chr(65533), ''))) AS BIGINT) AS replacements FROM odd""")
def unicode_audit(read):
    """P27."""
    return _odd(read).agg(*(c.cast("long").alias(n) for n, c in T.unicode_audit(F.col("t")).items()))


@query("""SELECT event_id, CASE WHEN regexp_matches(event_type, '^c') THEN 'touch' WHEN regexp_matches(event_type, 'ew$') THEN 'look' ELSE 'other' END AS kind,
  CASE WHEN value < 1 THEN 'v_below_1' WHEN value < 5 THEN 'v_1_5' WHEN value < 20.5 THEN 'v_5_20.5' ELSE 'v_20.5_plus' END AS bin,
  round(CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN 0 ELSE (value + user_id) / 2 END, 6) AS mean, value > 0 AND value <= 30 AS valid, CASE WHEN event_id % 3 = 0 THEN value ELSE 9.5 END AS worst,
  CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'b' ELSE '' END AS filled FROM events""")
def binned_events(read):
    """P17-P19, P21, P22, P24, P29 and the fallback chains."""
    v, k = F.col("value"), F.col("event_id") % 3
    one, two = F.when(k != 1, v), F.when(k == 2, F.col("user_id").cast("double")).otherwise(F.lit(float("nan")))
    return read("events").select(
        "event_id",
        T.classify(F.col("event_type"), [("^c", "touch"), ("ew$", "look")], "other").alias("kind"),
        T.half_open_bin(v, [1, 5, 20.5], "v").alias("bin"),
        F.round(T.mean_present(one, two), 6).alias("mean"),
        T.valid_duration(v, 30.0).alias("valid"),
        T.worst_case(F.when(k == 0, v), worst=9.5).alias("worst"),
        T.first_filled(F.when(k == 0, F.col("event_type")).otherwise(""), F.when(k == 1, "b")).alias("filled"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/a/' || p_partkey WHEN 1 THEN '/root/b/' || p_partkey WHEN 2 THEN '/root/' || p_partkey ELSE '/far/' || p_partkey END AS resolved,
  CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_partkey || '__longname_' || substr(sha256(repeat(p_name, 40)), 1, 16) END AS member FROM part""")
def resolved_paths(read):
    """P26, P28."""
    k, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    listed = F.when(k == 0, F.concat(F.lit("/a/"), key)).otherwise(F.concat(F.lit("b/"), key))
    real = F.when(k == 0, F.concat(F.lit("/a/"), key)).when(k == 1, F.concat(F.lit("/root/b/"), key)).when(k == 2, F.concat(F.lit("/root/"), key)).otherwise(F.concat(F.lit("/far/"), key))
    rows = read("part").select("p_partkey", "p_name", listed.alias("listed"))
    out = evidence.resolve_paths(rows, "listed", "/root", read("part").select(real.alias("path")))
    long = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.repeat("p_name", 40))
    return out.select("p_partkey", "resolved", evidence.short_member_name(long, F.col("p_partkey")).alias("member"))


@query("""WITH e AS (SELECT * FROM labels WHERE toxic = 1), d AS (SELECT doc_id FROM documents)
SELECT 'excluded' AS part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM d SEMI JOIN e USING (doc_id) UNION ALL SELECT 'rest', count(*), CAST(sum(doc_id) AS BIGINT) FROM d ANTI JOIN e USING (doc_id)
UNION ALL SELECT 'missing', count(*), -1 FROM (SELECT DISTINCT doc_id FROM e) ANTI JOIN d USING (doc_id)""")
def excluded_rows(read):
    """J2."""
    gone, rest, check = joins.exclude(read("documents").select("doc_id"), read("labels").where("toxic = 1"), "doc_id")
    sums = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("doc_id").alias("total")).select(F.lit(name).alias("part"), "n", "total")
    return sums(gone, "excluded").unionByName(sums(rest, "rest")).unionByName(check.select(F.lit("missing").alias("part"), F.col("violations").alias("n"), F.lit(-1).cast("long").alias("total")))


@query("""WITH a AS (SELECT event_id, event_type FROM events), b AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'x' ELSE event_type END AS event_type FROM events WHERE event_id % 7 <> 0),
odd AS (SELECT event_id, event_type FROM a ANTI JOIN b USING (event_id, event_type) UNION ALL SELECT event_id, event_type FROM b ANTI JOIN a USING (event_id, event_type))
SELECT 'pairs' AS "check", count(*) > 0 AS passed, count(*) AS violations FROM a JOIN b USING (event_id, event_type)
UNION ALL SELECT 'same rows in the same order', false, count(*) FROM odd
UNION ALL SELECT 'event_id covered both ways', false, count(*) FROM a ANTI JOIN b USING (event_id)
UNION ALL SELECT 'shared', false, count(DISTINCT event_type) FROM a WHERE event_type IN (SELECT event_type FROM b)
UNION ALL SELECT '0 within 1', count(*) = 0, count(*) FROM b ANTI JOIN a USING (event_id)
UNION ALL SELECT '1 beyond 0', count(*) > 0, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM a ANTI JOIN b USING (event_id)
UNION ALL SELECT 'union is exact', true, 0
UNION ALL SELECT 'exact prefix', false, count(*) FROM b JOIN a USING (event_id) WHERE a.event_type <> b.event_type""")
def set_checks(read):
    """J7, J8, J13, J18, U3-U6, W6, C15, E9."""
    a = read("events").select("event_id", "event_type")
    b = a.where("event_id % 7 != 0").withColumn("event_type", F.when(F.col("event_id") % 10 == 3, "x").otherwise(F.col("event_type")))
    pairs, order = joins.pair_by_position(a, b, "event_id", "event_type")
    _, covered = joins.cover(a, b, "event_id")
    some = pairs.agg(F.count("*").alias("violations")).select(F.lit("pairs").alias("check"), (F.col("violations") > 0).alias("passed"), "violations")
    out = some.unionByName(order).unionByName(covered).unionByName(joins.overlap(a, b, "event_type", "shared")).unionByName(joins.nested_chain([b, a], "event_id"))
    return out.unionByName(joins.exact_union([b, a.where("event_id % 7 = 0")], a, "event_id")).unionByName(ordered.prefix_check(b, a, "event_id", "event_type"))


@query("""WITH e AS (SELECT event_type, user_id % 3 AS lane, count(*) AS n FROM events WHERE user_id % 3 <> 1 OR event_type = 'view' GROUP BY ALL)
SELECT t AS event_type, CAST(l AS BIGINT) AS lane, coalesce(n, 0) AS n, n IS NULL AS missing FROM (SELECT unnest(['view', 'click', 'none']) AS t), (SELECT unnest([0, 1, 2]) AS l) LEFT JOIN e ON t = event_type AND l = lane""")
def expected_grid(read):
    """J11."""
    e = read("events").withColumn("lane", F.col("user_id") % 3).where("lane != 1 or event_type = 'view'").groupBy("event_type", "lane").agg(F.count("*").alias("n"))
    return evidence.expected_grid(e, {"event_type": ["view", "click", "none"], "lane": [0, 1, 2]}).withColumn("n", F.coalesce("n", F.lit(0)))


@query("""WITH c AS (SELECT step, arg_min(name, (NOT starts_with(name, 'checkpoint-'), name)) AS name FROM (SELECT event_id // 4 AS step, CASE WHEN event_id % 4 = 2 THEN 'checkpoint-' || event_id // 4 ELSE event_type || event_id END AS name FROM events) GROUP BY step)
SELECT c.step, name, value FROM c LEFT JOIN (SELECT event_id AS step, value FROM events WHERE event_id % 5 = 0) USING (step)""")
def checkpoint_metrics(read):
    """J10."""
    e = read("events")
    step = F.floor(F.col("event_id") / 4)
    c = e.select(step.alias("step"), F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("checkpoint-"), step.cast("string"))).otherwise(F.concat("event_type", F.col("event_id").cast("string"))).alias("name"))
    return evidence.checkpoints_with_metrics(c, e.where("event_id % 5 = 0").select(F.col("event_id").alias("step"), "value"))


@query("""WITH l AS (SELECT user_id, arg_max(value, event_id) / 1000 AS duration_s FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT event_id, user_id, duration_s, CASE WHEN duration_s IS NULL THEN 'missing_duration' END AS reason FROM events LEFT JOIN l USING (user_id)""")
def clip_durations(read):
    """S6, J6."""
    e = read("events")
    return evidence.last_duration(e.where("event_type = 'click'").select("user_id", "event_id", F.col("value").alias("milliseconds")), e.select("event_id", "user_id"), "user_id", "event_id")


@query("""WITH cells AS (SELECT i AS cell, (i * 7) % 50 AS cx, (i * 13) % 60 AS cy FROM (SELECT unnest(range(0, 20)) AS i))
SELECT event_id, arg_min(cell, (abs(user_id - cx) + abs(CAST(floor(value) AS BIGINT) - cy), cell)) AS cell FROM events, cells GROUP BY event_id""")
def nearest_cells(read):
    """J14."""
    e = read("events").select("event_id", F.col("user_id").alias("x"), F.floor("value").alias("y"))
    cells = e.sparkSession.range(20).select(F.col("id").alias("cell"), (F.col("id") * 7 % 50).alias("x"), (F.col("id") * 13 % 60).alias("y"))
    return joins.nearest_cell(e, cells, "x", "y").select("event_id", "cell")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'deep' WHEN p_partkey % 2 = 0 THEN 'brand' WHEN p_partkey % 5 = 0 THEN 'root' END AS file FROM part""")
def ancestor_files(read):
    """Each part's nearest folder with a metadata file."""
    key = F.col("p_partkey")
    path = F.concat_ws("/", F.when(key % 2 == 0, "a/b").when(key % 5 == 0, "a/c").otherwise("z"), F.when(key % 4 == 0, "d").otherwise("e"), key.cast("string"))
    spark = read("part").sparkSession
    found = spark.createDataFrame([("a", 1, "root"), ("a/b", 2, "late"), ("a/b", 1, "brand"), ("a/b/d", 1, "deep")], "folder string, priority int, file string")
    return joins.ancestor_metadata(read("part").select("p_partkey", path.alias("path")), found, "path").select("p_partkey", "file")


@query("""SELECT 'declared files exist' AS "check", count(*) = 0 AS passed, count(*) AS violations FROM documents WHERE doc_id % 9 = 0
UNION ALL SELECT 'hashes agree', count(*) = 0, count(*) FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 11 = 0
UNION ALL SELECT 'required names exist', false, 1""")
def file_inventory(read):
    """J17, E4."""
    d = read("documents").select("doc_id", F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("sha256"))
    local = d.where("doc_id % 9 != 0").select("path", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return joins.inventory(d.select("path", "sha256"), local, ["1", "missing"])


@query("""SELECT path, trial FROM (SELECT source AS root, lang AS trial, CAST(doc_id AS VARCHAR) AS path FROM documents) WHERE root NOT IN ('src1', 'src2') OR trial = 'en'""")
def current_rows(read):
    """S10, K13 (all ids)."""
    rows = read("documents").select(F.col("source").alias("root"), F.col("lang").alias("trial"), F.col("doc_id").cast("string").alias("path"))
    index = rows.sparkSession.createDataFrame([("src1", "en"), ("src2", "en"), ("none", "de")], "root string, trial string")
    return evidence.current_rows(rows, index, "root", "trial").select("path", "trial")


@query("""SELECT doc_id FROM documents WHERE contains(source || '_' || doc_id, '_1') OR contains(source || '_' || doc_id, '77')""")
def known_rows(read):
    """K13."""
    d = read("documents").select("doc_id", F.concat(F.lit("x_1/77/"), "source", F.lit("_"), F.col("doc_id").cast("string")).alias("path"))
    return evidence.known_ids(d, "path", ["_1", "77"]).select("doc_id")


@query("""WITH f AS (SELECT event_id, user_id, event_type || value AS payload, event_id > min(event_id) OVER (PARTITION BY user_id // 1, event_id // 3) AS dup FROM events),
g AS (SELECT payload, min(event_id) AS first FROM f WHERE NOT dup GROUP BY payload)
SELECT event_id, CASE WHEN dup THEN 'duplicate_id' WHEN first < event_id THEN 'duplicate_payload' END AS reason FROM f LEFT JOIN g USING (payload)""")
def accepted_sources(read):
    """Q2."""
    e = read("events").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 3).cast("string")).alias("rid"), F.concat("event_type", F.col("value").cast("string")).alias("payload"))
    return quality.accept_sources(e, "event_id", "rid", "payload").select("event_id", "reason")


@query("""SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY user_id""")
def merged_labels(read):
    """Q7."""
    return quality.merge_labels(read("events").select("user_id", "event_id", "event_type"), "user_id", "event_type", "event_id")


@query("""SELECT count(*) AS n, count(*) FILTER (value > 40) AS severe, count(*) FILTER (event_type = 'error') AS runaway, quantile_cont(user_id, 0.5) AS tokens_p50, quantile_cont(user_id, 0.95) AS tokens_p95, max(user_id) AS tokens_max,
  quantile_cont(value, 0.5) AS latency_p50, round(sum(value) / sum(user_id + 1), 9) AS rtf FROM events""")
def surface_summary(read):
    """A13."""
    e = read("events").select(F.col("user_id").alias("tokens"), (F.col("value") > 40).alias("severe"), (F.col("event_type") == "error").alias("runaway"), F.col("value").alias("generation_s"), (F.col("user_id") + 1).alias("audio_s"))
    return report.surface_summary(e).withColumn("rtf", F.round("rtf", 9))


@query("""SELECT count(*) AS n, round(avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END), 9) AS high_rate, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 9) AS error_rate, round(sum(user_id % 2) / sum(user_id), 9) AS abnormal_rate FROM events""")
def flag_rates(read):
    """A14."""
    e = read("events").select((F.col("value") > 40).alias("high"), (F.col("event_type") == "error").alias("error"), (F.col("user_id") % 2).alias("odd"), "user_id")
    out = report.rates(e, ["high", "error"], "odd", "user_id")
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("high_rate", "error_rate", "abnormal_rate")))


@query("""SELECT event_id, round(value / greatest(user_id, 1), 9) AS token_mean_loss, round(value / greatest(user_id % 4, 1), 9) AS normalized_loss FROM events""")
def normalized_losses(read):
    """A16."""
    e = read("events").select("event_id", F.col("value").alias("l"), F.greatest("user_id", F.lit(1)).alias("t"), (F.col("user_id") % 4).alias("c"))
    named = e.select("event_id", F.col("l").alias("loss_sum"), F.col("t").alias("target_tokens"), F.col("c").alias("normalized_characters"))
    return report.normalized_losses(named).select("event_id", F.round("token_mean_loss", 9).alias("token_mean_loss"), F.round("normalized_loss", 9).alias("normalized_loss"))


@query("""SELECT user_id % 3 AS epoch, count(*) AS n, min(value) AS snr_min, max(value) AS snr_max, round(avg(value), 9) AS snr_mean, count(*) FILTER (b = 0) AS bin_0, count(*) FILTER (b = 1) AS bin_1, count(*) FILTER (b = 2) AS bin_2, count(*) FILTER (b = 3) AS bin_3, count(*) FILTER (b = 4) AS bin_4,
  round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 9) AS trigger_rate FROM (SELECT *, least(4, greatest(0, CAST(floor((value - 15) / 2) AS BIGINT))) AS b FROM events) GROUP BY 1""")
def augmentation_report(read):
    """A17."""
    e = read("events").select((F.col("user_id") % 3).alias("epoch"), F.col("value").alias("snr"), (F.col("event_type") == "click").alias("triggered"))
    return report.augmentation_report(e).withColumn("snr_mean", F.round("snr_mean", 9)).withColumn("trigger_rate", F.round("trigger_rate", 9))


@query("""SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 9) AS rate, round(count(*) / nullif(CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 0 WHEN 'purchase' THEN 7 END, 0), 9) AS epochs FROM events GROUP BY event_type""")
def exposure(read):
    """A18."""
    e = read("events")
    pools = e.sparkSession.createDataFrame([("view", 100), ("click", 0), ("purchase", 7)], "event_type string, pool long")
    return report.exposure(e, "event_type", pools).select("event_type", "n", F.round("rate", 9).alias("rate"), F.round("epochs", 9).alias("epochs"))


@query("""SELECT event_type AS source, count(*) AS n FROM (SELECT user_id, unnest([event_id, event_id // 2]) AS i FROM events WHERE event_id % 4 = 0) JOIN events ON events.event_id = i GROUP BY event_type""")
def batch_exposure(read):
    """A19."""
    e = read("events")
    b = e.where("event_id % 4 = 0").select(F.array("event_id", F.floor(F.col("event_id") / 2)).alias("indices"))
    return report.exposure_of_batches(b, "indices", e.select(F.col("event_id").alias("index"), F.col("event_type").alias("source")))


@query("""SELECT arg_max(value, event_id) AS train_runtime, max(user_id) AS gpu_peak, round(arg_max(value, event_id) * 8 / 3600, 9) AS gpu_hours FROM events WHERE true""")
def resource_summary(read):
    """The last row has no run time and does not count."""
    e = read("events").select("event_id", F.col("value").alias("train_runtime"), F.col("user_id").alias("gpu_peak"), F.lit(8).alias("world"))
    last = e.sparkSession.createDataFrame([(10**12, None, 0, 1)], "event_id long, train_runtime double, gpu_peak long, world int")
    return report.resource_summary(e.unionByName(last), "event_id").withColumn("gpu_hours", F.round("gpu_hours", 9))


@query("""SELECT event_type, round(avg(value), 9) AS mean, count(DISTINCT user_id) AS seeds FROM events GROUP BY event_type""")
def seed_agreement(read):
    """A26."""
    return report.seed_agreement(read("events"), "event_type", "user_id", "value").withColumn("mean", F.round("mean", 9))


@query("""SELECT count(*) AS n, sha256(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id)) AS sha256, round(sum(value), 4) AS seconds, count(*) // 16 AS steps FROM events""")
def manifest_receipt(read):
    """A27, A24 by its hash."""
    return report.manifest_receipt(read("events"), "event_id", "event_id", "value").withColumn("seconds", F.round("seconds", 4))


@query("""SELECT 'event_type is click' AS "check", count(*) = 0 AS passed, count(*) AS violations FROM events WHERE event_type IS DISTINCT FROM 'click'""")
def same_receipts(read):
    """A24."""
    return report.same_receipts(read("events"), "event_type", "click")


@query("""SELECT doc_id, CAST(source AS VARCHAR) AS a, TRY_CAST(n_chars AS DOUBLE) AS chars, CAST(NULL AS DOUBLE) AS none FROM documents""")
def numeric_columns(read):
    """A29."""
    d = read("documents")
    return report.numeric(d, {"doc_id": "doc_id", "n_chars": "chars", "nothing": "none"}).join(d.select("doc_id", F.col("source").alias("a")), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "a", "chars", "none")


@query("""WITH s AS (SELECT p_partkey AS i, sum(CAST(p_retailprice AS DECIMAL(28, 6))) OVER (ORDER BY p_partkey) AS t FROM part)
SELECT CAST(target AS DOUBLE) AS target, min(i) AS boundary FROM s, (SELECT unnest([10000.0, 50000.0, 100000.0]) AS target) WHERE i % 16 = 0 AND t >= target GROUP BY target""")
def first_boundaries(read):
    """W5."""
    s = ordered.running_sum(read("part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", "total")
    return ordered.first_reach(s, "p_partkey", "total", [10000.0, 50000.0, 100000.0], 16)


@query("""SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 = 1), 9) AS gap FROM events GROUP BY event_type""")
def generalization_gap(read):
    """W9."""
    e = read("events").groupBy("event_type").agg(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("user_id") % 2 == 1, F.col("value"))).alias("b"))
    return ordered.gap(e, "a", "b").select("event_type", F.round("gap", 9).alias("gap"))


CHECKPOINTS_SQL = """runs AS (SELECT user_id AS label, count(*) AS step, round(avg(value) / 100, 6) AS cer, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS tol2, count(*) FILTER (event_type = 'error') AS severe, round(sum(value), 4) AS loss FROM events GROUP BY user_id)"""


def _runs(read):
    v = F.col("value")
    return read("events").groupBy(F.col("user_id").alias("label")).agg(F.count("*").alias("step"), F.round(F.avg(v) / 100, 6).alias("cer"), F.round(F.count_if(F.col("event_type") == "click") / F.count("*"), 6).alias("tol2"), F.count_if(F.col("event_type") == "error").alias("severe"), F.round(F.sum(v), 4).alias("loss"))


@query(f"""WITH {CHECKPOINTS_SQL} SELECT label, step FROM runs WHERE (SELECT max(tol2) FROM runs) - tol2 <= 0.005 + 1e-12 ORDER BY cer, tol2 DESC, severe, step LIMIT 1""")
def selected_validation(read):
    """W10."""
    return ordered.select_validation(_runs(read).withColumn("surface", F.lit("validation")).withColumn("complete", F.lit(True))).select("label", "step")


@query(f"""WITH {CHECKPOINTS_SQL} SELECT label, surface, value FROM (SELECT label, cer, tol2 FROM runs) UNPIVOT (value FOR surface IN (cer, tol2))""")
def metric_curves(read):
    """W12."""
    return ordered.curves(_runs(read).select("label", "cer", "tol2"), ["label"], ["cer", "tol2"])


@query("""WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 30)
SELECT user_id, event_type, n, round(avg(value), 9) AS mean FROM events JOIN t USING (user_id) GROUP BY ALL""")
def top_matrix(read):
    """W13."""
    return ordered.top_matrix(read("events"), "user_id", "event_type", "value", 30).withColumn("mean", F.round("mean", 9))


@query("""SELECT e.user_id, e.event_id, e.value, round(e.value - b.value, 9) AS value_delta FROM events e JOIN (SELECT user_id, value, event_id FROM events QUALIFY event_id = min(event_id) OVER (PARTITION BY user_id)) b USING (user_id)""")
def arm_deltas(read):
    """W14."""
    e = read("events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    out = ordered.deltas(e.join(first, "user_id"), "user_id", "event_id", ["value"], F.col("event_id") == F.col("first"))
    return out.withColumn("value_delta", F.round("value_delta", 9))


@query("""SELECT round(sum(value), 4) AS seconds, count(*) AS draws FROM events WHERE event_id < 1234""")
def prefix_seconds(read):
    """W15."""
    return ordered.prefix_value(read("events"), "event_id", "value", 1234).withColumn("seconds", F.round("seconds", 4))


@query(f"""WITH {CHECKPOINTS_SQL} SELECT label, round((1 - cer) * 70 + tol2 * 20, 6) AS proxy FROM runs WHERE severe <= 40 ORDER BY tol2 DESC, cer, loss, step LIMIT 1""")
def best_candidate(read):
    """K1, K4."""
    rows = select.reject(_runs(read), ((F.col("severe") > 40, "severe"),))
    return select.best_candidate(rows).select("label", F.round(select.proxy(F.col("cer"), F.col("tol2")), 6).alias("proxy"))


@query(f"""WITH {CHECKPOINTS_SQL} SELECT label, CASE WHEN label % 5 = 0 THEN 'incomplete' ELSE array_to_string(list_filter([CASE WHEN tol2 < 0.2 THEN 'validation_tol2' END, CASE WHEN severe > 40 THEN 'public_severe' END, CASE WHEN cer > 0.2 THEN 'ood_cer' END, CASE WHEN label % 7 = 0 THEN 'incomplete' END], lambda x: x IS NOT NULL), ',') END AS failures FROM runs""")
def guardrails(read):
    """K5, P29 strict."""
    label = F.col("label")
    rows = _runs(read).select(
        "label", F.when(label % 5 == 0, "n/a").otherwise(F.col("tol2").cast("string")).alias("validation_tol2"), F.lit(1).alias("public_tol2"), F.lit(0).alias("public_insertions"), F.col("severe").alias("public_severe"),
        F.lit(0).alias("public_repeated_runaway"), F.lit(0).alias("public_replacement"), F.lit(9).alias("public_effective_max"), F.lit(0.5).alias("ood_tol2"), F.col("cer").alias("ood_cer"), (label % 7 != 0).alias("complete"),
    )
    limits = {"validation_tol2_min": 0.2, "public_tol2_min": 0.5, "public_insertions_max": 3, "public_severe_max": 40, "public_repeated_runaway_max": 1, "public_replacement_max": 1, "public_effective_max_max": 10, "ood_tol2_min": 0.4, "ood_cer_max": 0.2}
    return select.guardrails(rows, limits).select("label", F.array_join("failures", ",").alias("failures"))


@query("""SELECT 'TOP' || rank || '_' || upper(mode) || '_TO_1.5H' AS name, parent AS parent_label, mode, rate * scale AS learning_rate FROM (SELECT unnest([1, 2]) AS rank, unnest(['a', 'b']) AS parent, unnest([0.5, 0.25]) AS rate), (SELECT unnest(['constant', 'half']) AS mode, unnest([1.0, 0.5]) AS scale)""")
def branches(read):
    """K7."""
    parents = read("nation").sparkSession.createDataFrame([(1, "a", 0.5), (2, "b", 0.25)], "rank int, label string, learning_rate double")
    return select.branches(parents, 1.5)


SEEDS_SQL = """seeds AS (SELECT user_id % 3 AS seed, event_id % 6 AS step, round(avg(value) / 100, 6) AS cer, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS tol2, count(*) FILTER (event_type = 'error') AS severe, CAST(0 AS BIGINT) AS repeated_runaway, CAST(0 AS BIGINT) AS replacement, CAST(max(value) AS BIGINT) AS max_length FROM events GROUP BY ALL)"""


@query(f"""WITH {SEEDS_SQL}, pick AS (SELECT *, step >= 3 AS late, max(tol2) OVER (PARTITION BY seed, step >= 3) AS peak FROM seeds),
best AS (SELECT seed, late, arg_min(struct_pack(s := step, c := cer, t := tol2, v := severe, m := max_length), (cer, -tol2, severe, step)) AS r FROM pick WHERE peak - tol2 <= 0.005 + 1e-12 GROUP BY seed, late)
SELECT a.seed, a.r.s AS early_step, b.r.s AS late_step, round(a.r.c - b.r.c, 9) AS improvement, array_to_string(list_filter([CASE WHEN b.r.c > a.r.c + 1e-12 THEN 'cer_regression' END, CASE WHEN a.r.t - b.r.t > 0.005 + 1e-12 THEN 'tol2_regression' END, CASE WHEN b.r.v > a.r.v THEN 'severe_regression' END, CASE WHEN b.r.m > a.r.m THEN 'max_length_regression' END], lambda x: x IS NOT NULL), ',') AS failures
FROM best a JOIN best b ON a.seed = b.seed AND NOT a.late AND b.late""")
def extension_rule(read):
    """K9."""
    v = F.col("value")
    rows = read("events").groupBy((F.col("user_id") % 3).alias("seed"), (F.col("event_id") % 6).alias("step")).agg(
        F.round(F.avg(v) / 100, 6).alias("cer"), F.round(F.count_if(F.col("event_type") == "click") / F.count("*"), 6).alias("tol2"), F.count_if(F.col("event_type") == "error").alias("severe"),
        F.lit(0).cast("long").alias("repeated_runaway"), F.lit(0).cast("long").alias("replacement"), F.round(F.max(v)).cast("long").alias("max_length"), F.lit(True).alias("integrity_pass"),
    )
    return select.extension(rows, (0, 1, 2), (3, 4, 5)).select("seed", "early_step", "late_step", F.round("improvement", 9).alias("improvement"), F.array_join("failures", ",").alias("failures"))


@query(f"""WITH {CHECKPOINTS_SQL} SELECT label, row_number() OVER (ORDER BY label % 10 = 0, label % 7 = 0, tol2 DESC, cer NULLS LAST, label) AS place FROM runs""")
def scoreboard(read):
    """The place in the board."""
    rows = _runs(read).select("label", (F.col("label") % 10 == 0).alias("is_diagnostic"), (F.col("label") % 7 == 0).alias("is_baseline"), F.col("tol2").alias("accuracy"), "cer")
    board = select.scoreboard(rows.orderBy("label"))
    from pyspark.sql import Window

    order = Window.orderBy("is_diagnostic", "is_baseline", F.desc("accuracy"), F.asc_nulls_last("cer"), "label")  # one row a run
    return board.select("label", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {PAIRS_SQL} SELECT id, CAST(d AS BIGINT) AS edit_distance FROM scored ORDER BY d DESC, id LIMIT 25""")
def worst_examples(read):
    """K11."""
    return score.worst_examples(_pairs(read), 25).select("id", "edit_distance")


@query("""WITH a AS (SELECT event_id, 2 * row_number() OVER (ORDER BY value DESC, event_id) AS k FROM events QUALIFY row_number() OVER (ORDER BY value DESC, event_id) <= 40),
b AS (SELECT event_id, 2 * row_number() OVER (ORDER BY user_id DESC, event_id) + 1 AS k FROM events QUALIFY row_number() OVER (ORDER BY user_id DESC, event_id) <= 40)
SELECT event_id FROM (SELECT event_id, min(k) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY event_id) ORDER BY k LIMIT 40""")
def interleaved_top(read):
    """K12."""
    return select.interleaved_top(read("events"), "event_id", "value", "user_id", 40).select("event_id")


@query("""SELECT user_id FROM (SELECT user_id, event_type FROM events WHERE value < 30 GROUP BY ALL) GROUP BY user_id HAVING count(*) = 4""")
def complete_candidates(read):
    """K14, K16."""
    e = read("events").select("user_id", "event_type", F.when(F.col("value") < 30, F.col("value")).alias("cer"), F.lit(1.0).alias("tol2"))
    return select.complete_candidates(e, "user_id", "event_type", 4)


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'V' WHEN event_type = 'click' THEN 'C' ELSE 'rest' END AS label FROM events""")
def canonical_labels(read):
    """K15."""
    known = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("run_"), "event_type")).otherwise("run_none")
    return read("events").select("event_id", select.canonical_label(known, {"view": "V", "CLICK": "C", "none": "rest"}).alias("label"))


@query("""WITH o AS (SELECT count(*) FILTER (lang = 'en') AS o, count(*) AS t FROM documents)
SELECT k AS place, CASE WHEN k = 0 OR (k * o) // t > ((k - 1) * o) // t THEN 'official' ELSE 'other' END AS kind FROM (SELECT o, t, unnest(range(0, t)) AS k FROM o)""")
def spread_batches(read):
    """M20."""
    from pyspark.sql import Window

    numbered = lambda d: d.select((F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("batch"))
    d = read("documents")
    return split.spread_batches(numbered(d.where("lang = 'en'")), numbered(d.where("lang != 'en'")), "batch").select(F.col("place").cast("long").alias("place"), "kind")


@query("""WITH c AS (SELECT unnest([0, 1, 2]) AS c), p AS (SELECT item_id, c, row_number() OVER (PARTITION BY c ORDER BY sha256(concat_ws(':', 'r', '2', c::VARCHAR, item_id::VARCHAR)), item_id) - 1 AS p, (SELECT count(*) FROM benchmark) AS n FROM benchmark, c)
SELECT item_id, CAST(p + c * n AS BIGINT) AS draw FROM p WHERE p + c * n < 100""")
def repeated_draws(read):
    """M11, M23."""
    return split.repeated_sample(read("benchmark").select("item_id"), "item_id", 100, 2, "r").select("item_id", "draw")


@query("""SELECT item_id, [0.9, 1.0, 1.1][CAST((row_number() OVER (ORDER BY sha256(concat_ws(':', 's', item_id::VARCHAR)), item_id) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS speed FROM benchmark""")
def speed_assignments(read):
    """M14."""
    return split.speed_assignments(read("benchmark").select("item_id"), "item_id", "s")


@query("""SELECT event_id FROM events WHERE event_id >= 9000""")
def stream_tail(read):
    """M27."""
    return split.tail_after_prefix(read("events").select("event_id"), "event_id", 9000)


@query(f"""WITH {CHECKPOINTS_SQL} SELECT label AS weight FROM runs WHERE label % 2 = 0 ORDER BY tol2 DESC, cer, severe, label LIMIT 1""")
def selected_weight(read):
    """C4."""
    rows = _runs(read).select(F.col("label").alias("weight"), "tol2", "cer", "severe", F.when(F.col("label") % 2 == 0, "validation").otherwise("public").alias("surface"))
    return consensus.select_weight(rows).select("weight")


@query(f"""WITH {PAIRS_SQL}, h AS (SELECT id, reference, [hypothesis, replace(reference, 'e', 'é'), replace(reference, 'er', 'e')] AS t FROM pairs), e AS (SELECT id, reference, t, unnest([1, 2, 3]) AS i FROM (SELECT id, reference, [t[1], replace(reference, 'e', chr(30)), t[3]] AS t FROM h))
SELECT id, CAST(arg_min(i, (levenshtein(t[i], reference), i)) - 1 AS INTEGER) AS nearest FROM e GROUP BY id""")
def nearest_hypothesis(read):
    """C5."""
    p = _pairs(read).select("id", "reference", F.array("hypothesis", F.regexp_replace("reference", "e", "é"), F.regexp_replace("reference", "er", "e")).alias("texts"))
    return p.select("id", consensus.oracle(p, "texts", "reference").alias("nearest"))


@query("""SELECT user_id, coalesce(max(value) FILTER (event_type = 'click'), arg_min(value, event_id)) AS score FROM events GROUP BY user_id""")
def anchor_scores(read):
    """C7."""
    g = read("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("v"))
    return g.select("user_id", consensus.anchor_score(F.col("v.event_type"), F.col("v.value"), F.lit("click")).alias("score"))


@query("""SELECT event_id AS step, round(CASE WHEN event_id < 500 THEN event_id / 500.0 ELSE (cos((event_id - 500) / 9500.0 * pi()) + 1) * 0.5 END, 9) AS factor FROM events""")
def cosine_schedule(read):
    """C14."""
    return read("events").select(F.col("event_id").alias("step"), F.round(consensus.cosine_factor(F.col("event_id"), 500, 10000), 9).alias("factor"))


# token sequences: a start that differs by row, then a unit of 1 to 9 ids again and again, for some rows with an end id inside
SEQUENCES_SQL = """seqs AS (SELECT event_id, list_concat(list_transform(range(0, 20 + event_id % 60), lambda i: (i * i * 7 + event_id) % 50257), list_transform(range(0, CAST((event_id % 9 + 1) * (event_id % 14) AS BIGINT)), lambda i: 100 + i % (event_id % 9 + 1))) AS ids FROM events WHERE event_id % 10 = 0),
found AS (SELECT event_id, ids, len(ids) AS n, list_transform(range(1, 17), lambda w: list_max(list_transform(range(0, len(ids) // w + 1), lambda r: CASE WHEN r = 0 OR list_slice(ids, CAST(len(ids) - r * w + 1 AS BIGINT), len(ids)) = flatten(list_transform(range(0, r), lambda x: list_slice(ids, CAST(len(ids) - w + 1 AS BIGINT), len(ids)))) THEN r ELSE 0 END))) AS reps FROM seqs),
best AS (SELECT *, list_max(list_transform(list_filter(range(1, 9), lambda w: reps[w] >= 2), lambda w: [reps[w] * w, reps[w], -w])) AS near, list_max(list_transform(list_filter(range(1, 17), lambda w: reps[w] >= 2), lambda w: [reps[w] * w, reps[w], -w])) AS far FROM found)"""


def _sequences(read):
    return read("events").where("event_id % 10 = 0").select(
        "event_id",
        F.expr(
            "concat(transform(sequence(0, cast(19 + event_id % 60 as int)), i -> (cast(i as bigint) * i * 7 + event_id) % 50257),"
            " if((event_id % 9 + 1) * (event_id % 14) > 0, transform(sequence(0, cast((event_id % 9 + 1) * (event_id % 14) - 1 as int)), i -> cast(100 + i % (event_id % 9 + 1) as bigint)), cast(array() as array<bigint>)))"
        ).alias("ids"),
    )


@query(f"""WITH {SEQUENCES_SQL}
SELECT event_id, CAST(coalesce(-near[3], 0) AS BIGINT) AS size, CAST(coalesce(near[2], 0) AS BIGINT) AS repeats, CAST(coalesce(near[1], 0) AS BIGINT) AS coverage, CASE WHEN reps[1] >= 8 THEN 1 WHEN reps[2] >= 4 THEN 2 WHEN reps[3] >= 4 THEN 3 WHEN reps[4] >= 4 THEN 4 ELSE 0 END AS cycle,
  CASE WHEN n < 64 THEN '' ELSE array_to_string(list_filter([CASE WHEN near[2] >= 4 AND near[1] >= 24 THEN 'trailing_ngram_cycle' END, CASE WHEN len(list_distinct(list_slice(ids, n - 63, n))) / 64 < 0.25 THEN 'low_tail_token_diversity' END, CASE WHEN event_id % 3 = 0 AND far[2] >= 3 AND far[1] >= 18 THEN 'max_length_periodic_cycle' END], lambda x: x IS NOT NULL), ',') END AS runaway,
  len(list_slice(ids, 1, coalesce(nullif(list_position(ids, 101), 0), n))) AS until_end, len(list_filter(ids, lambda x: x NOT IN (100, 102))) AS content FROM best""")
def token_cycles(read):
    """C8, C9, C11, C12, C16."""
    ids, found, period = F.col("ids"), F.col("found"), F.col("period")
    rows = _sequences(read).select("event_id", "ids", tokens.end_repeats(ids, 16).alias("found")).select("*", tokens.trailing_period(ids, 8, found).alias("period"))
    return rows.select(
        "event_id", *(F.coalesce(period[c].cast("long"), F.lit(0)).alias(c) for c in ("size", "repeats", "coverage")), F.coalesce(tokens.trailing_cycle(ids, found), F.lit(0)).alias("cycle"), F.array_join(tokens.runaway_reasons(ids, F.col("event_id") % 3 == 0, found), ",").alias("runaway"),
        F.size(tokens.until_end(ids, 101)).cast("long").alias("until_end"), F.size(tokens.drop_special(ids, [100, 102])).cast("long").alias("content"),
    )


def _folder(read) -> str:
    """A new folder beside the checkpoints."""
    d = read("nation")
    quality.cut(d.limit(0))
    return f"{d.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/query-{uuid.uuid4().hex}"


@query("""SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row_idx, text, CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS DOUBLE) END AS even FROM benchmark""")
def jsonl_round_trip(read):
    """Written in order, read back with the place of each line."""
    path, d = _folder(read), read("benchmark")
    files.write_jsonl(d.select("item_id", "text", F.when(F.col("item_id") % 2 == 0, F.col("item_id")).alias("even"), F.col("item_id").alias("row_idx")).coalesce(1), path)
    back = files.read_jsonl_ordered(d.sparkSession, path, "item_id long, text string, even double")
    plain = files.read_jsonl(d.sparkSession, path, "item_id long, text string, even double")
    # parts follow each other in the order of their names
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("file", "row_idx")) - 1  # the lines of a benchmark
    return back.withColumn("row_idx", place.cast("long")).join(plain.select("item_id"), "item_id").select("item_id", "row_idx", "text", "even")


@query("""SELECT n_nationkey AS key, n_name AS name FROM nation""")
def csv_round_trip(read):
    """S3, S4, S12, S18."""
    path, d = _folder(read), read("nation")
    files.write_csv(d.select(F.col("n_nationkey").alias("﻿Nation_Key "), F.col("n_name").alias("NAME")), path)
    back = files.require_columns(files.read_csv(d.sparkSession, path, aliases={"nation_key": "key", "name": "name"}), ["key", "name"])
    return files.require_filled(back, "name").select(F.col("key").cast("long").alias("key"), "name")


@query("""SELECT n_nationkey, row_number() OVER () - 1 AS row_idx FROM nation""")
def parquet_rows(read):
    """S7, W1."""
    path = read("nation").select(F.input_file_name()).first()[0]
    return files.read_parquet_rows(read("nation").sparkSession, path, ["n_nationkey"]).select("n_nationkey", "row_idx")


@query("""SELECT n_name, CAST(n_nationkey AS BIGINT) AS key, 'r' || n_regionkey AS parent FROM nation""")
def scanned_records(read):
    """Files below folders, with the folder's name."""
    path, d = _folder(read), read("nation")
    d.select("n_name", F.col("n_nationkey").cast("long").alias("key"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("folder")).write.partitionBy("folder").json(path)
    rows = files.scan_records(d.sparkSession, path, "*.json", "n_name string, key long")
    sizes = files.scan_files(d.sparkSession, path, "*.json").select("path", "length")
    joined = rows.join(sizes, F.regexp_replace(rows.path, "^file:/+", "/") == F.regexp_replace(sizes.path, "^file:/+", "/")).where("length > 0")
    return joined.select("n_name", "key", F.regexp_replace("parent", "folder=", "").alias("parent"))


@query("""SELECT event_id, CAST(k AS BIGINT) AS k, "at", CAST(place AS INTEGER) AS place FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '$.a' AS "at", 0 AS place FROM events UNION ALL SELECT event_id, json_extract(props, '$.k')::BIGINT + 1, '$.b.c', 1 FROM events)""")
def nested_objects(read):
    """S17."""
    e = read("events")
    k = F.get_json_object("props", "$.k").cast("long")
    wrapped = e.select(F.format_string('{"a": {"k": %d, "event_id": %d}, "b": {"c": [{"k": %d, "event_id": %d}]}}', k, F.col("event_id"), k + 1, F.col("event_id")).alias("j"))
    return files.extract_objects(wrapped, "j", ["$.a", "$.b.c"], "struct<event_id: bigint, k: bigint>").select("event_id", "k", "at", "place")
