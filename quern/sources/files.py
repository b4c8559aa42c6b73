"""Ordered readers and sinks. Row order is data here, so every reader gives a row_idx taken from the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, a bad line is fatal."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S1 with row_idx, the line's place in its file (blank lines do not count); files by their path."""
    lines = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.select("file", F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("row_idx", "line"))
    parsed = rows.select("file", F.col("row_idx").cast("long").alias("row_idx"), F.from_json("line", schema, {"mode": "FAILFAST"}).alias("o"))
    return parsed.select("file", "row_idx", "o.*")


def write_jsonl(rows: DataFrame, path: str, order: str = "row_idx", keep_null: bool = True) -> None:
    """Ordered by a column across the part files, null fields kept; refuses to overwrite."""
    rows.orderBy(order).drop(order).write.mode("errorifexists").option("ignoreNullFields", not keep_null).json(path)


def read_csv(spark: SparkSession, path: str, sep: str = ",", aliases: dict[str, str] | None = None) -> DataFrame:
    """With header; names are trimmed, matched without case and byte-order mark, and renamed by `aliases`."""
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", sep == ",").option("escape", '"').csv(path)
    wanted = {k.lower(): v for k, v in (aliases or {}).items()}
    names = [wanted.get(c.strip().lstrip("﻿").strip().lower(), c.strip().lstrip("﻿").strip()) for c in rows.columns]
    return rows.toDF(*names)


def require_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Missing columns are fatal."""
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows


def require_filled(rows: DataFrame, name: str) -> DataFrame:
    """S3: an empty value is fatal when the rows are read."""
    return rows.withColumn(name, F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", F.raise_error(F.lit(f"empty {name}"))).otherwise(F.col(name)))


def read_parquet_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A column list with the row's number in its file."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_idx"))


def scan_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Paths below a folder, without archive leftovers; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length").where(~F.col("path").contains("/__MACOSX/") & ~F.regexp_extract("path", "([^/]*)$", 1).startswith("._"))


def scan_records(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    """JSON records below a folder with the parent folder's name as default trial and the path."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    path = F.col("_metadata.file_path")
    return rows.select("*", path.alias("path"), F.regexp_extract(path, "([^/]+)/[^/]*$", 1).alias("parent"))


def write_csv(rows: DataFrame, path: str) -> None:
    """S12."""
    rows.write.mode("errorifexists").option("header", True).csv(path)


def sha256_lines(rows: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """SHA-256 of the values joined by line feeds in order, for each group. The joined text of a group is one value."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("string").alias("v")))), lambda x: x["v"])
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sha2(F.array_join(listed, "\n"), 256).alias("sha256"))


def extract_objects(rows: DataFrame, column: str, paths: list[str], schema: str) -> DataFrame:
    """Objects found at known JSON paths (an object or a list of objects), in the order of the paths."""

    def at(path: str) -> Column:
        listed = F.coalesce(F.from_json(F.get_json_object(column, path), f"array<{schema}>"), F.array())
        return F.coalesce(F.transform(listed, lambda o: F.struct(F.lit(path).alias("at"), o.alias("o"))), F.array())

    found = F.concat(*map(at, paths))
    return rows.select(F.posexplode(found).alias("place", "x")).select("place", "x.at", "x.o.*")
