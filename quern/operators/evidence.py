"""Evidence around runs: expected grids, checkpoints with metrics, path resolution, indexes, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import nearest_boundary

MAX_REPORT_ROWS = 1000


def expected_grid(evidence: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes with its evidence; `missing` marks those without. Axes are short lists of values."""
    spark = evidence.sparkSession
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in axes.items()]
    grid = reduce(DataFrame.crossJoin, frames)  # a few values each
    return grid.join(evidence.withColumn("__e", F.lit(True)), list(axes), "left").withColumn("missing", F.col("__e").isNull()).drop("__e")


def checkpoints_with_metrics(checkpoints: DataFrame, metrics: DataFrame) -> DataFrame:
    """Checkpoints (name, step) with the metrics of their step; of one step a `checkpoint-*` goes before a copy of another name."""
    order = Window.partitionBy("step").orderBy(F.desc(F.col("name").startswith("checkpoint-")), "name")
    one = checkpoints.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
    return one.join(metrics, "step", "left")


def resolve_paths(rows: DataFrame, listed: str, folder: str, files: DataFrame) -> DataFrame:
    """The first existing of the listed path (if absolute), folder/listed, folder/base name; then the only file of that base name. files: path."""
    base = F.regexp_extract(listed, "([^/]*)$", 1)
    exist = files.select("path").distinct()
    names = exist.select(F.regexp_extract("path", "([^/]*)$", 1).alias("__base"), "path").groupBy("__base").agg(F.min("path").alias("__any"), F.count("*").alias("__n")).where("__n = 1")
    options = {"__a": F.when(F.col(listed).startswith("/"), F.col(listed)), "__b": F.concat(F.lit(folder.rstrip("/") + "/"), F.col(listed)), "__c": F.concat(F.lit(folder.rstrip("/") + "/"), base)}
    out = rows
    for name, option in options.items():
        out = out.withColumn(f"{name}_k", option).join(exist.select(F.col("path").alias(f"{name}_k"), F.col("path").alias(name)), f"{name}_k", "left").drop(f"{name}_k")
    out = out.withColumn("__base", base).join(names.select("__base", "__any"), "__base", "left")
    return out.withColumn("resolved", F.coalesce(*options, "__any")).drop(*options, "__any", "__base")


def current_rows(rows: DataFrame, index: DataFrame, root: str, trial: str) -> DataFrame:
    """Rows of trials that their root's index does not list are stale and go; a root without an index keeps all."""
    roots = index.select(root).distinct().withColumn("__has", F.lit(True))
    listed = index.select(root, trial).distinct().withColumn("__in", F.lit(True))
    return rows.join(roots, root, "left").join(listed, [root, trial], "left").where("__has is null or __in").drop("__has", "__in")


def short_member_name(name: Column, row_id: Column, most: int = 240) -> Column:
    """Names of more than `most` bytes are replaced by id, mark and the first 16 digits of their hash."""
    return F.when(F.octet_length(name) > most, F.concat(row_id.cast("string"), F.lit("__longname_"), F.substring(F.sha2(name, 256), 1, 16))).otherwise(name)


def remap_cursor(stream: DataFrame, index: str, total: str, same_stream: bool, cursor: int, seconds: float, step: int = 32) -> int:
    """The cursor itself on the same stream, if aligned; else the aligned prefix nearest to the seconds seen."""
    if same_stream:
        if cursor % step:
            raise ValueError("the cursor is not aligned")
        return cursor
    return int(nearest_boundary(stream, index, total, [seconds], step, with_zero=True).first()["boundary"])


def known_ids(rows: DataFrame, path: str, ids: list[str]) -> DataFrame:
    """Rows whose file name holds one of the ids."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return rows.where(reduce(lambda a, b: a | b, [name.contains(i) for i in ids], F.lit(False)))


def last_duration(durations: DataFrame, rows: DataFrame, clip: str, order: str) -> DataFrame:
    """Rows with their clip's duration in seconds, the last one listed; reason where there is none."""
    last = durations.groupBy(clip).agg((F.max_by("milliseconds", order) / 1000).alias("duration_s"))
    return rows.join(last, clip, "left").withColumn("reason", F.when(F.col("duration_s").isNull(), "missing_duration"))


def markdown(rows: DataFrame, title: str) -> str:
    """A table of at most MAX_REPORT_ROWS rows as text; more are refused."""
    found = rows.limit(MAX_REPORT_ROWS + 1).collect()
    if len(found) > MAX_REPORT_ROWS:
        raise ValueError("too many rows for a report")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)]) + "\n"
