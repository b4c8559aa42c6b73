from pyspark.sql import functions as F

from quern.operators import evidence


def test_grid_and_checkpoints(spark):
    seen = spark.createDataFrame([("a", 42)], "arm string, seed long")
    got = evidence.expected_grid(seen, {"arm": ["a", "b"], "seed": [42, 43]}).where("missing").count()
    assert got == 3
    points = spark.createDataFrame([("best_model", 10), ("checkpoint-10", 10), ("checkpoint-20", 20)], "name string, step long")
    metrics = spark.createDataFrame([(10, 0.5)], "step long, cer double")
    assert sorted((r["name"], r["cer"]) for r in evidence.checkpoints_with_metrics(points, metrics).collect()) == [("checkpoint-10", 0.5), ("checkpoint-20", None)]


def test_paths(spark):
    files = spark.createDataFrame([("/d/a.wav",), ("/d/x/b.wav",), ("/d/y/c.wav",)], "path string")
    rows = spark.createDataFrame([("a.wav",), ("x/b.wav",), ("q/c.wav",), ("/d/a.wav",), ("no.wav",)], "listed string")
    got = {r["listed"]: r["resolved"] for r in evidence.resolve_paths(rows, "listed", "/d", files).collect()}
    assert got == {"a.wav": "/d/a.wav", "x/b.wav": "/d/x/b.wav", "q/c.wav": "/d/y/c.wav", "/d/a.wav": "/d/a.wav", "no.wav": None}
    name = spark.createDataFrame([("é" * 121,), ("ok",)], "n string").select(evidence.short_member_name(F.col("n"), F.lit(7)).alias("x")).collect()
    assert name[0]["x"].startswith("7__longname_") and name[1]["x"] == "ok"


def test_index_cursor_report(spark):
    rows = spark.createDataFrame([("r", "a"), ("r", "old"), ("s", "any")], "root string, trial string")
    index = spark.createDataFrame([("r", "a")], "root string, trial string")
    assert sorted(r["trial"] for r in evidence.current_rows(rows, index, "root", "trial").collect()) == ["a", "any"]
    stream = spark.range(1, 97).select(F.col("id").alias("i"), F.col("id").cast("double").alias("t"))
    assert evidence.remap_cursor(stream, "i", "t", False, 0, 50.0) == 64
    assert evidence.remap_cursor(stream, "i", "t", True, 64, 0.0) == 64
    assert evidence.known_ids(rows.withColumn("p", F.concat(F.lit("/x/"), "trial")), "p", ["old"]).count() == 1
    assert evidence.markdown(index, "t").endswith("| r | a |\n")
    d = spark.createDataFrame([("c", 0, 1000.0), ("c", 1, 2000.0)], "clip string, o int, milliseconds double")
    got = evidence.last_duration(d, spark.createDataFrame([("c",), ("d",)], "clip string"), "clip", "o").collect()
    assert sorted((r["clip"], r["duration_s"], r["reason"]) for r in got) == [("c", 2.0, None), ("d", None, "missing_duration")]
