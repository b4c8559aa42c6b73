"""Joins with reasons, exclusions, completeness checks and nearest matches. Strategies are left to the optimiser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import check, first_reason


def reconcile(left: DataFrame, right: DataFrame, key: str, left_only: str, right_only: str) -> DataFrame:
    """Full outer join; rows of one side alone carry their reason."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    return a.join(b, key, "full_outer").withColumn("reason", F.when(F.col("__r").isNull(), left_only).when(F.col("__l").isNull(), right_only)).drop("__l", "__r")


def exclude(rows: DataFrame, excluded: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The excluded rows, the rest, and the check that every excluded key exists."""
    keys = excluded.select(key).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti"), check(f"excluded {key} exist", keys.join(rows, key, "left_anti"))


def protect(rows: DataFrame, protected: DataFrame, keys: list[tuple[str, Column]], names: list[str]) -> DataFrame:
    """For each named key of the protected set a flag, and the first in order as reason.

    keys: (protected column, key expression over rows), aligned with names.
    """
    flags = []
    for (column, expression), name in zip(keys, names, strict=True):
        hit = protected.where(F.col(column).isNotNull()).select(F.col(column).alias(f"__k_{name}")).distinct().withColumn(f"__{name}", F.lit(True))
        rows = rows.join(hit, expression == F.col(f"__k_{name}"), "left").drop(f"__k_{name}")
        flags.append((F.col(f"__{name}").isNotNull(), name))
    rows = rows.withColumn("reason", first_reason(flags))
    return rows.drop(*(f"__{n}" for n in names))


def pair_by_position(left: DataFrame, right: DataFrame, position: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows at the same position with the same path, and the check that nothing is left over or out of order."""
    pairs = left.join(right, [position, path])
    odd = left.select(position, path).exceptAll(right.select(position, path)).unionByName(right.select(position, path).exceptAll(left.select(position, path)))
    return pairs, check("same rows in the same order", odd)


def cover(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Inner join, and the check that each side has exactly the other's keys."""
    missing = left.select(key).join(right, key, "left_anti").unionByName(right.select(key).join(left, key, "left_anti"))
    return left.join(right, key), check(f"{key} covered both ways", missing)


def overlap(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys of both sides as violations."""
    return check(name, left.select(key).intersect(right.select(key)))


def nested_chain(frames: list[DataFrame], key: str) -> DataFrame:
    """Each frame's keys must be a strict subset of the next one's."""
    checks = []
    for i, (a, b) in enumerate(zip(frames, frames[1:])):
        checks.append(check(f"{i} within {i + 1}", a.select(key).subtract(b.select(key))))
        grown = b.select(key).subtract(a.select(key)).limit(1).agg(F.count("*").alias("n"))
        checks.append(grown.select(F.lit(f"{i + 1} beyond {i}").alias("check"), (F.col("n") > 0).alias("passed"), (1 - F.col("n")).alias("violations")))
    return reduce(DataFrame.unionByName, checks)


def exact_union(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """The parts' keys together are the whole's."""
    together = reduce(DataFrame.unionByName, [p.select(key) for p in parts]).distinct()
    keys = whole.select(key).distinct()
    return check("union is exact", together.subtract(keys).unionByName(keys.subtract(together)))


def nearest_cell(rows: DataFrame, cells: DataFrame, x: str, y: str) -> DataFrame:
    """The cell (cell, x, y) of least Manhattan distance, ties to the smaller cell. cells: at most a few dozen rows, checked."""
    found = cells.select(F.col("cell"), F.col(x).cast("long").alias("cx"), F.col(y).cast("long").alias("cy")).distinct().limit(1001).collect()
    if len(found) > 1000:
        raise ValueError("too many cells")
    listed = F.array(*(F.struct(F.lit(r["cx"]).alias("cx"), F.lit(r["cy"]).alias("cy"), F.lit(r["cell"]).alias("cell")) for r in sorted(found, key=lambda r: r["cell"])))
    scored = F.transform(listed, lambda c: F.struct((F.abs(F.col(x) - c["cx"]) + F.abs(F.col(y) - c["cy"])).alias("far"), c["cell"].alias("cell")))
    return rows.withColumn("cell", F.array_min(scored)["cell"])


def ancestor_metadata(rows: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """The metadata file in the nearest folder at or above a path, by (depth, priority). files: folder, priority, file."""
    above = rows.select(path, F.posexplode(F.expr(f"transform(sequence(size(split({path}, '/')), 1, -1), k -> array_join(slice(split({path}, '/'), 1, k), '/'))")).alias("depth", "folder"))
    best = above.join(files, "folder").groupBy(path).agg(F.min_by("file", F.struct("depth", "priority")).alias("file"))
    return rows.join(best, path, "left")


def inventory(declared: DataFrame, local: DataFrame, required: list[str]) -> DataFrame:
    """Declared (path, sha256) against local (path, sha256): checks on missing files, differing hashes and required base names."""
    joined = declared.select("path", F.col("sha256").alias("want")).join(local.select("path", F.col("sha256").alias("have")), "path", "left")
    names = local.sparkSession.createDataFrame([(r,) for r in required], "name string")
    have = local.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return (
        check("declared files exist", joined.where("have is null"))
        .unionByName(check("hashes agree", joined.where("have != want")))
        .unionByName(check("required names exist", names.join(have, "name", "left_anti")))
    )
