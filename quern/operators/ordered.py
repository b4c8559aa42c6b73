"""Ordered analytics: bands by rank, running sums, aligned boundaries, prefixes, merged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import check

#: rows of a block of a running sum; blocks are summed apart and only their totals are ordered together
RUNNING_BLOCK = 100_000


def running_sum(rows: DataFrame, order: str, value: str, out: str, block: int = RUNNING_BLOCK, scale: int = 6) -> DataFrame:
    """Cumulative sum in the order of a dense whole-number column (0, 1, 2, ...).

    Rows are summed inside blocks of `block` numbers, then a block's start is the sum of the totals of
    the blocks before it; only one row a block meets in one task. Sums are exact decimals of `scale`
    places, so that block borders do not change them.
    """
    exact = F.col(value).cast(f"decimal(28,{scale})")
    cut = rows.withColumn("__b", F.floor(F.col(order) / block))
    inner = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy("__b").agg(F.sum(exact).alias("__t"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    return cut.withColumn("__s", F.sum(exact).over(inner)).join(before, "__b").withColumn(out, (F.col("__s") + F.col("__before")).cast(f"decimal(28,{scale})")).drop("__b", "__s", "__before")


def loss_band(rows: DataFrame, loss: str, row_id: str, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Rows whose rank by (loss, id), from 0, lies in [ceil(n * low), ceil(n * high)), in each group."""
    group = Window.partitionBy(*(by or []))
    ranked = rows.withColumn("__k", F.row_number().over(group.orderBy(loss, F.col(row_id).cast("string"))) - 1).withColumn("__n", F.count("*").over(group))
    return ranked.where((F.col("__k") >= F.ceil(F.col("__n") * low)) & (F.col("__k") < F.ceil(F.col("__n") * high))).drop("__k", "__n")


def first_reach(rows: DataFrame, index: str, total: str, targets: list[float], step: int) -> DataFrame:
    """For each target the first aligned index (1-based, divisible by step) whose running total reaches it."""
    aligned = rows.where(F.col(index) % step == 0)
    wanted = F.explode(F.array(*(F.lit(float(t)) for t in targets))).alias("target")
    return aligned.select(index, total, wanted).where(F.col(total) >= F.col("target")).groupBy("target").agg(F.min(index).alias("boundary"))


def nearest_boundary(rows: DataFrame, index: str, total: str, targets: list[float], step: int, with_zero: bool = False) -> DataFrame:
    """For each target the aligned index whose running total is nearest, ties to the smaller; with_zero admits the empty prefix."""
    aligned = rows.where(F.col(index) % step == 0).select(F.col(index).cast("long").alias("i"), F.col(total).cast("double").alias("t"))
    if with_zero:
        aligned = aligned.unionByName(rows.sparkSession.createDataFrame([(0, 0.0)], "i long, t double"))
    wanted = F.explode(F.array(*(F.lit(float(t)) for t in targets))).alias("target")
    return aligned.select("i", "t", wanted).groupBy("target").agg(F.min_by("i", F.struct(F.abs(F.col("t") - F.col("target")), "i")).alias("boundary"))


def prefix_check(shorter: DataFrame, longer: DataFrame, index: str, row_id: str) -> DataFrame:
    """The shorter's ids are exactly the longer's first ones."""
    both = shorter.select(index, F.col(row_id).alias("a")).join(longer.select(index, F.col(row_id).alias("b")), index, "left")
    return check("exact prefix", both.where(~F.col("a").eqNullSafe(F.col("b")) | F.col("b").isNull()))


def prefix_value(draws: DataFrame, position: str, value: str, cursor: int) -> DataFrame:
    """Sum over the first `cursor` draws."""
    return draws.where(F.col(position) < cursor).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("seconds"), F.count("*").alias("draws"))


def best_row(rows: DataFrame, by: str, accuracy: str, cer: str, tie: str) -> DataFrame:
    """Of each group the row of largest accuracy, then least CER (null last), then smallest tie."""
    rank = F.struct((-F.col(accuracy)).alias("a"), F.coalesce(F.col(cer), F.lit(float("inf"))).alias("b"), F.col(tie).alias("c"))
    return rows.groupBy(by).agg(F.min_by(F.struct(*[c for c in rows.columns if c != by]), rank).alias("r")).select(by, "r.*")


def merge_records(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """W8 over a map column `fields_map` (name to value): a later record overwrites each field that it has, also with null.

    Presence is a key of the map, so a field that is present as null differs from one that is absent.
    """
    wanted = [F.max_by(F.col("fields_map")[f], F.when(F.map_contains_key("fields_map", f), F.col(order))).alias(f) for f in fields]
    return rows.groupBy(*keys).agg(*wanted)


def select_validation(rows: DataFrame, band: float = 0.005) -> DataFrame:
    """Within `band` of the best tol2 the row of least (cer, -tol2, severe, step). Null or non-finite values and other surfaces are fatal."""
    bad = F.greatest(*(F.coalesce(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf")), F.lit(True)) for c in ("tol2", "cer", "severe", "step")))
    sound = rows.withColumn("tol2", F.when(bad | (F.col("surface") != "validation") | ~F.col("complete"), F.raise_error(F.lit("only complete finite validation rows may be selected"))).otherwise(F.col("tol2")))
    peak = sound.withColumn("__peak", F.max("tol2").over(Window.partitionBy(F.lit(1))))  # candidate checkpoints: a few rows
    kept = peak.where(F.col("__peak") - F.col("tol2") <= band + 1e-12)
    return kept.orderBy("cer", F.desc("tol2"), "severe", "step").limit(1).drop("__peak")


def exposure_windows(rows: DataFrame, step: str, source: str, size: int) -> DataFrame:
    """Counts by source in tumbling windows of `size` steps."""
    return rows.groupBy(F.floor(F.col(step) / size).alias("window"), source).agg(F.count("*").alias("n"))


def curves(rows: DataFrame, ids: list[str], surfaces: list[str]) -> DataFrame:
    """One row a surface."""
    return rows.unpivot(ids, surfaces, "surface", "value")


def top_matrix(rows: DataFrame, scene: str, trial: str, value: str, most: int = 30) -> DataFrame:
    """The scenes with most rows by (-count, scene), with the mean value by trial."""
    top = rows.groupBy(scene).agg(F.count("*").alias("n")).orderBy(F.desc("n"), scene).limit(most)
    return rows.join(top, scene).groupBy(scene, trial, "n").agg(F.avg(value).alias("mean"))


def deltas(rows: DataFrame, arm: str, step: str, metrics: list[str], baseline: Column) -> DataFrame:
    """Each row's metrics less those of its arm's baseline row."""
    base = rows.where(baseline).select(arm, *(F.col(m).alias(f"__{m}") for m in metrics))
    return rows.join(base, arm).select(arm, step, *metrics, *((F.col(m) - F.col(f"__{m}")).alias(f"{m}_delta") for m in metrics))


def gap(rows: DataFrame, probe: str, validation: str) -> DataFrame:
    """W9."""
    return rows.withColumn("gap", F.col(probe) - F.col(validation))
