"""Scoring of hypotheses against references. Distances are Spark's own levenshtein; only alignments need Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .quality import cut

DELETED, INSERTED = "<del>", "<ins>"
PAIRS = ArrayType(StructType([StructField("src", StringType()), StructField("dst", StringType())]))


def align(reference: str, hypothesis: str) -> list[tuple[str, str]]:
    """A1: least-cost alignment; of equal costs a match or substitution goes before a deletion before an insertion (from the end)."""
    n, m = len(reference), len(hypothesis)
    cost = [list(range(m + 1))]
    for i, a in enumerate(reference, 1):
        above, row = cost[-1], [i]
        for j, b in enumerate(hypothesis, 1):
            row.append(min(above[j - 1] + (a != b), above[j] + 1, row[-1] + 1))
        cost.append(row)
    i, j, pairs = n, m, []
    while i or j:
        here = cost[i][j]
        if i and j and here == cost[i - 1][j - 1] + (reference[i - 1] != hypothesis[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((reference[i], hypothesis[j]))
        elif i and here == cost[i - 1][j] + 1:
            i -= 1
            pairs.append((reference[i], DELETED))
        else:
            j -= 1
            pairs.append((INSERTED, hypothesis[j]))
    return pairs[::-1]


@F.pandas_udf(PAIRS)
def alignment(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ref, hyp in batches:
        yield pd.Series([[{"src": s, "dst": d} for s, d in align(r or "", h or "")] for r, h in zip(ref, hyp, strict=True)])


def distance(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))).cast("long")


def operation_counts(pairs: Column) -> dict[str, Column]:
    """Substitutions, deletions, insertions of an alignment."""
    return {
        "substitutions": F.size(F.filter(pairs, lambda p: (p.src != p.dst) & (p.src != INSERTED) & (p.dst != DELETED))).cast("long"),
        "deletions": F.size(F.filter(pairs, lambda p: p.dst == DELETED)).cast("long"),
        "insertions": F.size(F.filter(pairs, lambda p: p.src == INSERTED)).cast("long"),
    }


def corpus_metrics(rows: DataFrame, by: list[str] | None = None, tolerances: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """A2 over columns reference, hypothesis: samples, edits, characters (an empty reference counts 1), cer, tolerance rates; zeros when empty."""
    scored = rows.withColumn("__d", distance(F.col("reference"), F.col("hypothesis"))).withColumn("__n", F.greatest(F.length(F.coalesce("reference", F.lit(""))), F.lit(1)))
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("samples"),
        F.coalesce(F.sum("__d"), F.lit(0)).alias("edits"),
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("characters"),
        F.coalesce(F.round(F.sum("__d") / F.sum("__n"), 9), F.lit(0.0)).alias("cer"),
        *(F.coalesce(F.round(F.avg((F.col("__d") <= t).cast("double")), 9), F.lit(0.0)).alias(f"tol{t}") for t in tolerances),
    )


def diagnostics(rows: DataFrame, severe: int = 5, worst: int = 20) -> DataFrame:
    """A4 over id, reference, hypothesis: distances' buckets, utterance CER moments and exact percentiles, share of edits in the worst rows."""
    d = cut(rows.select("id", distance(F.col("reference"), F.col("hypothesis")).alias("d"), F.greatest(F.length("reference"), F.lit(1)).alias("n")))  # distances once
    top = d.orderBy(F.desc("d"), "id").limit(worst).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("worst_edits"))
    u = F.col("d") / F.col("n")
    zero = lambda c: F.coalesce(F.round(c, 9), F.lit(0.0))
    whole = d.agg(
        F.count("*").alias("samples"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("edits"),
        *(F.count_if(c).alias(name) for name, c in (("edits_0", F.col("d") == 0), ("edits_1", F.col("d") == 1), ("edits_2", F.col("d") == 2), ("edits_3_5", F.col("d").between(3, 5)), ("edits_over_5", F.col("d") > 5), ("severe", F.col("d") > severe))),
        zero(F.avg(u)).alias("cer_mean"),
        *(zero(F.percentile(u, q)).alias(name) for name, q in (("cer_median", 0.5), ("cer_p90", 0.9), ("cer_p95", 0.95))),
        zero(F.max(u)).alias("cer_max"),
    )
    return whole.crossJoin(top).withColumn("worst_share", F.when(F.col("edits") > 0, F.round(F.col("worst_edits") / F.col("edits"), 9)).otherwise(F.lit(0.0))).drop("worst_edits")  # two rows of one


def sample_scores(rows: DataFrame) -> DataFrame:
    """Each row's distance, CER and contribution to the corpus CER."""
    d = rows.withColumn("edit_distance", distance(F.col("reference"), F.col("hypothesis"))).withColumn("reference_characters", F.greatest(F.length("reference"), F.lit(1)).cast("long"))
    total = d.agg(F.sum("reference_characters").alias("__total"))
    return d.crossJoin(F.broadcast(total)).select(  # one row
        *rows.columns,
        "reference_characters",
        "edit_distance",
        (F.col("edit_distance") / F.col("reference_characters")).alias("utterance_cer"),
        (F.col("edit_distance") / F.col("__total")).alias("corpus_cer_contribution"),
    )


def confusions(rows: DataFrame, most: int = 100) -> DataFrame:
    """A5 over id, reference, hypothesis: counted (src, dst) of unequal pairs, equal counts in the order first seen."""
    pairs = rows.where("reference is not null and hypothesis is not null and reference != hypothesis").select("id", F.posexplode(alignment("reference", "hypothesis")).alias("at", "p"))
    return pairs.where("p.src != p.dst").groupBy(F.col("p.src").alias("src"), F.col("p.dst").alias("dst")).agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first")).orderBy(F.desc("n"), "first").limit(most).select("src", "dst", "n")


def worst_examples(rows: DataFrame, most: int = 100) -> DataFrame:
    """K11."""
    return rows.withColumn("edit_distance", distance(F.col("reference"), F.col("hypothesis"))).orderBy(F.desc("edit_distance"), "id").limit(most)


def error_profile(rows: DataFrame, worst: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """Share of all edits in the worst n rows, and rows that look misaligned (distance of at least 0.8 of the longer side)."""
    d = cut(rows.select("id", distance(F.col("reference"), F.col("hypothesis")).alias("d"), F.greatest(F.length("reference"), F.length("hypothesis"), F.lit(1)).alias("n")))  # distances once
    top = d.orderBy(F.desc("d"), "id").limit(max(worst)).withColumn("k", F.row_number().over(Window.orderBy(F.desc("d"), "id")))  # at most max(worst) rows
    shares = top.agg(*(F.sum(F.when(F.col("k") <= k, F.col("d"))).alias(f"worst_{k}") for k in worst))
    return d.agg(F.sum("d").alias("edits"), F.count_if(F.col("d") >= 0.8 * F.col("n")).alias("misaligned")).crossJoin(shares)


def quadrants(a: DataFrame, b: DataFrame, key: str, right: str) -> DataFrame:
    """Rows that both models have right, one alone, or neither; `right` is a boolean column of both."""
    both = a.select(key, F.col(right).alias("x")).join(b.select(key, F.col(right).alias("y")), key)
    x, y = F.col("x"), F.col("y")
    return both.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def drift(rows: DataFrame, markers: dict[str, str]) -> DataFrame:
    """How often a marker character of the reference came out as its counterpart, and how often it stood in a reference."""
    pairs = rows.select(F.explode(alignment("reference", "hypothesis")).alias("p"))
    out = [F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in markers.items()]
    wanted = F.array(*out)
    seen = pairs.select(F.col("p.src").alias("s"), F.col("p.dst").alias("d"), F.explode(wanted).alias("w")).where("s = w.src")
    return seen.groupBy(F.col("w.src").alias("src"), F.col("w.dst").alias("dst")).agg(F.count_if(F.col("d") == F.col("w.dst")).alias("drifted"), F.count("*").alias("seen"))
