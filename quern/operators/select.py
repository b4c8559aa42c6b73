"""Selection of candidates: vetoes as reason arrays, rankings, tie bands, branches and extension rules."""

from __future__ import annotations

from functools import cmp_to_key

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reasons

#: candidates that a ranking on the driver accepts at most
MAX_CANDIDATES = 1000


def proxy(cer: Column, tol2: Column, cer_weight: float = 70.0, tol2_weight: float = 20.0) -> Column:
    """K4."""
    return (F.lit(1.0) - cer) * cer_weight + tol2 * tol2_weight


def best_candidate(rows: DataFrame) -> DataFrame:
    """K1: the row of largest (tol2, -cer, -loss, -step) among rows without rejection reasons."""
    eligible = rows.where(F.size("reasons") == 0) if "reasons" in rows.columns else rows
    return eligible.orderBy(F.desc("tol2"), "cer", "loss", "step").limit(1)


def reject(rows: DataFrame, rules: tuple[tuple[Column, str], ...]) -> DataFrame:
    """K2: adds reasons, the names of the rules that hold, and eligible."""
    return rows.withColumn("reasons", reasons(rules)).withColumn("eligible", F.size("reasons") == 0)


def guardrails(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """K5: ten vetoes in order; a missing or uncastable field gives `incomplete` alone.

    limits: <column>_min or <column>_max for the columns validation_tol2, public_tol2, public_insertions,
    public_severe, public_repeated_runaway, public_replacement, public_effective_max, ood_tol2, ood_cer.
    """
    order = ["validation_tol2", "public_tol2", "public_insertions", "public_severe", "public_repeated_runaway", "public_replacement", "public_effective_max", "ood_tol2", "ood_cer"]
    value = {c: F.col(c).try_cast("double") for c in order}
    missing = F.col("complete").isNull()
    for c in order:
        missing = missing | value[c].isNull()
    rules = tuple((value[c] < limits[f"{c}_min"] if f"{c}_min" in limits else value[c] > limits[f"{c}_max"], c) for c in order)
    return rows.withColumn("failures", F.when(missing, F.array(F.lit("incomplete"))).otherwise(reasons((*rules, (~F.col("complete"), "incomplete")))))


def rank_with_band(rows: DataFrame, order: str, band: float = 0.05) -> list[dict]:
    """K6: eligible rows (no failures) ranked by a comparison with a tie band.

    The comparison is not transitive, so the result depends on the order of discovery; rows are therefore
    sorted stably in the order of column `order`. At most MAX_CANDIDATES rows; more are refused.
    """
    found = [r.asDict() for r in rows.where(F.size("failures") == 0).orderBy(order).limit(MAX_CANDIDATES + 1).collect()]
    if len(found) > MAX_CANDIDATES:
        raise ValueError("too many candidates")

    def compare(a: dict, b: dict) -> int:
        gap = (70.0 * (1.0 - a["cer"]) + 20.0 * a["tol2"]) - (70.0 * (1.0 - b["cer"]) + 20.0 * b["tol2"])
        if abs(gap) >= band:
            return -1 if gap > 0 else 1
        x = (a["cer"], -a["tol2"], a["severe"], a["hours"], a["label"])
        y = (b["cer"], -b["tol2"], b["severe"], b["hours"], b["label"])
        return (x > y) - (x < y)

    return sorted(found, key=cmp_to_key(compare))


def branches(parents: DataFrame, hours: float) -> DataFrame:
    """K7: two ranked parents (rank, label, learning_rate) by constant and half rate; any other number of parents is fatal."""
    if parents.limit(3).count() != 2:
        raise ValueError("exactly two parents are required")
    modes = F.explode(F.array(F.struct(F.lit("constant").alias("mode"), F.lit(1.0).alias("scale")), F.struct(F.lit("half").alias("mode"), F.lit(0.5).alias("scale")))).alias("m")
    return parents.select("*", modes).select(
        F.format_string(f"TOP%d_%s_TO_{hours:g}H", F.col("rank").cast("int"), F.upper("m.mode")).alias("name"), F.col("label").alias("parent_label"), F.col("m.mode").alias("mode"), (F.col("learning_rate") * F.col("m.scale")).alias("learning_rate")
    )


def extension(rows: DataFrame, early: tuple[int, ...], late: tuple[int, ...], counters: tuple[str, ...] = ("severe", "repeated_runaway", "replacement", "max_length")) -> DataFrame:
    """K9: of each seed the selected early and late row, the regressions between them, and the CER gained."""
    def pick(steps: tuple[int, ...], name: str) -> DataFrame:
        part = rows.where(F.col("step").isin(*steps))
        peak = part.groupBy("seed").agg(F.max("tol2").alias("__peak"))
        band = part.join(peak, "seed").where(F.col("__peak") - F.col("tol2") <= 0.005 + 1e-12)
        fields = F.struct("step", "cer", "tol2", *counters)
        return band.groupBy("seed").agg(F.min_by(fields, F.struct("cer", -F.col("tol2"), "severe", "step")).alias(name))

    both = pick(early, "a").join(pick(late, "b"), "seed").join(rows.groupBy("seed").agg(F.bool_and("integrity_pass").alias("sound")), "seed")
    rules = [(F.col("b.cer") > F.col("a.cer") + 1e-12, "cer_regression"), (F.col("a.tol2") - F.col("b.tol2") > 0.005 + 1e-12, "tol2_regression")]
    rules += [(F.col(f"b.{c}") > F.col(f"a.{c}"), f"{c}_regression") for c in counters] + [(~F.col("sound"), "integrity_not_passed")]
    return both.select("seed", F.col("a.step").alias("early_step"), F.col("b.step").alias("late_step"), (F.col("a.cer") - F.col("b.cer")).alias("improvement"), reasons(tuple(rules)).alias("failures"))


def extend(by_seed: DataFrame, least: float = 0.001) -> DataFrame:
    """K9: extend if no seed fails and the mean gain reaches `least`."""
    return by_seed.agg(F.avg("improvement").alias("mean_improvement"), F.sum(F.size("failures")).alias("failures")).withColumn("extend", (F.col("failures") == 0) & (F.col("mean_improvement") >= least - 1e-12))


def scoreboard(rows: DataFrame) -> DataFrame:
    """Diagnostics last, baselines after the others, then by accuracy and CER (null last)."""
    return rows.orderBy("is_diagnostic", "is_baseline", F.desc("accuracy"), F.asc_nulls_last("cer"))


def interleaved_top(rows: DataFrame, row_id: str, first: str, second: str, most: int) -> DataFrame:
    """The largest by two columns in turn, the first occurrence of an id stays, at most `most` rows."""
    a = rows.orderBy(F.desc(first), row_id).limit(most)
    b = rows.orderBy(F.desc(second), row_id).limit(most)
    numbered = [part.withColumn("__k", F.row_number().over(Window.orderBy(F.desc(c), row_id)) * 2 + shift) for part, c, shift in ((a, first, 0), (b, second, 1))]  # at most `most` rows
    both = numbered[0].unionByName(numbered[1]).groupBy(row_id).agg(F.min("__k").alias("__k"))
    return rows.join(F.broadcast(both.orderBy("__k").limit(most)), row_id).orderBy("__k").drop("__k")


def complete_candidates(rows: DataFrame, folder: str, surface: str, surfaces: int = 3) -> DataFrame:
    """Folders that have all surfaces with finite metrics."""
    sound = rows.where(~F.isnan("cer") & ~F.isnan("tol2") & F.col("cer").isNotNull() & F.col("tol2").isNotNull())
    return sound.groupBy(folder).agg(F.count_distinct(surface).alias("n")).where(F.col("n") == surfaces).select(folder)


def canonical_label(label: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of a label by suffix; an unknown label is an error."""
    case = None
    for suffix, name in aliases.items():
        hit = F.upper(label).endswith(suffix.upper())
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)))
