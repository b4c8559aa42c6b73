"""Reports: distributions, histograms, exposure, quotas, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """P20: every bin, empty ones too; half-open, the last closed. Values outside are not counted."""
    bins = rows.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    last = len(edges) - 2
    place = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        here = (F.col(value) >= a) & ((F.col(value) <= b) if i == last else (F.col(value) < b))
        place = F.when(here, i) if place is None else place.when(here, i)
    counts = rows.select(place.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(rows: DataFrame, key: str, missing: str = "") -> DataFrame:
    """A9."""
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(missing)).alias(key)).agg(F.count("*").alias("n"))


def group_report(rows: DataFrame, by: list[str], duration: str, keys: list[str]) -> DataFrame:
    """A10: rows, hours (4 places) and exact distinct counts."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(duration) / 3600, 4).alias("hours"), *(F.count_distinct(k).alias(f"distinct_{k}") for k in keys))


def describe(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Exact moments and percentiles; zeros of nothing."""
    c = F.col(value)
    zero = lambda x: F.coalesce(F.round(x, 6), F.lit(0.0))
    return rows.groupBy(*(by or [])).agg(
        F.count(c).alias("n"), zero(F.avg(c)).alias("mean"), *(zero(F.percentile(c, q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95)), zero(F.min(c).cast("double")).alias("least"), zero(F.max(c).cast("double")).alias("most"), zero(F.sum(c).cast("double")).alias("total")
    )


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """Fatal without weight."""
    total = F.sum(weight)
    return rows.agg(F.when(F.coalesce(total, F.lit(0)) == 0, F.raise_error(F.lit("no weight"))).otherwise(F.sum(F.col(value) * F.col(weight)) / total).alias("mean"), total.alias("weight"))


def normalized_losses(rows: DataFrame) -> DataFrame:
    """A16 over loss_sum, target_tokens, normalized_characters."""
    return rows.withColumn("token_mean_loss", F.col("loss_sum") / F.col("target_tokens")).withColumn("normalized_loss", F.col("loss_sum") / F.greatest(F.col("normalized_characters"), F.lit(1)))


def surface_summary(rows: DataFrame) -> DataFrame:
    """A13 over tokens, severe, runaway, generation_s, audio_s."""
    return rows.agg(
        F.count("*").alias("n"), F.count_if("severe").alias("severe"), F.count_if("runaway").alias("runaway"), *(F.percentile("tokens", q).alias(f"tokens_p{int(q * 100)}") for q in (0.5, 0.95)), F.max("tokens").alias("tokens_max"),
        F.percentile("generation_s", 0.5).alias("latency_p50"), (F.sum("generation_s") / F.sum("audio_s")).alias("rtf"),
    )


def rates(rows: DataFrame, flags: list[str], abnormal: str, characters: str) -> DataFrame:
    """Share of rows with each flag; the rate of abnormal characters is null without characters."""
    return rows.agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags), (F.sum(abnormal) / F.nullif(F.sum(characters), F.lit(0))).alias("abnormal_rate"))


def augmentation_report(rows: DataFrame) -> DataFrame:
    """A17 over epoch, snr, triggered: signal-to-noise moments, five clamped bins of 2 dB from 15, trigger rate."""
    b = F.least(F.lit(4), F.greatest(F.lit(0), F.floor((F.col("snr") - 15) / 2)))
    return rows.groupBy("epoch").agg(F.count("*").alias("n"), F.min("snr").alias("snr_min"), F.max("snr").alias("snr_max"), F.avg("snr").alias("snr_mean"), *(F.count_if(b == i).alias(f"bin_{i}") for i in range(5)), F.avg(F.col("triggered").cast("double")).alias("trigger_rate"))


def exposure(rows: DataFrame, source: str, pools: DataFrame) -> DataFrame:
    """Counts, rates and equivalent epochs (null for an empty pool). pools: source, pool."""
    counts = rows.groupBy(source).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.join(pools, source, "left").crossJoin(F.broadcast(total)).select(source, "n", (F.col("n") / F.col("__t")).alias("rate"), (F.col("n") / F.nullif("pool", F.lit(0))).alias("epochs"))  # one row


def exposure_of_batches(batches: DataFrame, indices: str, sources: DataFrame) -> DataFrame:
    """Draws by source. sources: index, source."""
    return batches.select(F.explode(indices).alias("index")).join(sources, "index").groupBy("source").agg(F.count("*").alias("n"))


def quota_deviations(reference: DataFrame, chosen: DataFrame, bucket: str) -> DataFrame:
    """Expected and actual rows of each reference bucket."""
    want = reference.groupBy(bucket).agg(F.count("*").alias("reference"))
    have = chosen.groupBy(bucket).agg(F.count("*").alias("actual"))
    totals = want.agg(F.sum("reference").alias("__r")).crossJoin(have.agg(F.coalesce(F.sum("actual"), F.lit(0)).alias("__a")))  # one row each
    joined = want.join(have, bucket, "left").crossJoin(F.broadcast(totals)).withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.withColumn("expected", F.col("__a") * F.col("reference") / F.col("__r")).select(bucket, "reference", "actual", "expected", (F.col("actual") - F.col("expected")).alias("deviation"))


def same_receipts(rows: DataFrame, column: str, expected: str) -> DataFrame:
    """Rows whose hash is not the expected one."""
    from .quality import check

    return check(f"{column} is {expected[:12]}", rows.where(~F.col(column).eqNullSafe(F.lit(expected))))


def resource_summary(rows: DataFrame, order: str) -> DataFrame:
    """A25 over train_runtime, gpu_peak, world: the last row with a run time, the largest peak, GPU hours."""
    last = F.max_by(F.struct("train_runtime", "world"), F.when(F.col("train_runtime").isNotNull(), F.col(order)))
    return rows.agg(last.alias("l"), F.max("gpu_peak").alias("gpu_peak")).select("l.train_runtime", "gpu_peak", (F.col("l.train_runtime") * F.col("l.world") / 3600).alias("gpu_hours"))


def manifest_receipt(rows: DataFrame, order: str, row_id: str, duration: str, step: int = 16) -> DataFrame:
    """Rows, whole steps, seconds and the hash of the ordered ids."""
    from ..sources.files import sha256_lines

    receipt = sha256_lines(rows, order, row_id)
    return receipt.crossJoin(rows.agg(F.sum(duration).alias("seconds"))).withColumn("steps", F.floor(F.col("n") / step))  # one row each


def numeric(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renamed doubles; a missing column is null."""
    return rows.select(*((F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")).alias(n) for c, n in names.items()))


def seed_agreement(rows: DataFrame, arm: str, seed: str, value: str) -> DataFrame:
    """Mean over seeds by arm."""
    return rows.groupBy(arm).agg(F.avg(value).alias("mean"), F.count_distinct(seed).alias("seeds"))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")
