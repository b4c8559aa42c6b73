"""run() against a plain version of its stages on a small table."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
pytest.importorskip("sentencepiece")


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    import sentencepiece
    from pyspark.sql import functions as F
    from test_ops import brute, tok

    from quern.llm import decontaminate, toxicity
    from quern.llm.language_id import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lettered = [r for r in docs.select("doc_id", "text").collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    model = toxicity.fit(docs.where(F.col("doc_id").isin([r["doc_id"] for r in lettered])), labels, ~held_out(F.col("doc_id"), 5, 0))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
    left = [(r["doc_id"], r["text"]) for r in lettered if r["doc_id"] not in toxic]
    groups = brute(left, 5, 80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    bad = {r["doc_id"] for r in decontaminate.decontaminate(spark.createDataFrame(left, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r["contaminated"]}
    lib = sentencepiece.SentencePieceProcessor(model_file=tok.path("piece_bpe_32k.model"))
    want = {i: len(lib.encode(t)) + 2 for i, t in left if i not in bad}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "decontamination", "sentencepiece"]


def test_stages_on_nothing(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_language_stage(spark, sf_dir):
    import random

    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(3)
    odd = [
        (10**6, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 4),
        (10**6 + 1, "我们今天去公园玩,天气很好。" * 10),
        (10**6 + 2, " ".join(str(rng.randrange(10**6)) for _ in range(80)) + " a"),
        (10**6 + 3, "1 2 3"),
    ]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(more, allowMissingColumns=True), sf_dir).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
    unlabelled = docs.unionByName(more, allowMissingColumns=True).withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, unlabelled, sf_dir).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {10**6, 10**6 + 1, 10**6 + 2}
