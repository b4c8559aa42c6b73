"""A training-data pipeline over `documents`: STAGES in order, each over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, language_id, minhash, sentencepiece_bpe, toxicity
from quern.llm.common import by_ids, shared_path, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (and null texts) go, and those that the network finds in no learned language.

    The latter are those whose share of undetermined positions reaches the network's cutoff, calibrated on labelled rows.
    Where no language could be learned, only the letters count. Each row is judged by its text alone, so repeated rows
    share their fate; a null doc_id or lang only keeps a row from training. An empty table stays empty.
    """
    net, cutoff = language_id.fit_with_noise(docs, ~language_id.held_out(F.col("doc_id"), 4, 2))
    if not net.languages:
        return docs.where(language_id.has_letter(F.col("text").cast("string")))
    undetermined = (F.col("__language") == language_id.UNDETERMINED) & ((F.col("__share") == 0) | (F.col("__share") >= cutoff))
    return language_id.predict(docs, net, ("__language", "__share")).where(~undetermined).select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go.

    Null and empty texts are scored as texts without words and stay; without labels of both kinds nothing goes. Each
    row is judged by its text alone.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~language_id.held_out(F.col("doc_id"), 5, 0))
    return toxicity.score(docs, model, ("__score", "__toxic")).where("__toxic = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the smallest doc_id stays.

    Rows alike in doc_id and text are copies of each other, of which one stays; rows of one doc_id with different texts
    share its fate. Rows without a doc_id, and null, empty or blank texts, are near nothing.
    """
    gone = minhash.near_duplicates(docs, k=5, threshold=80, bands=31, rows=4).where("not kept").select("doc_id")
    left = by_ids(docs, gone, "left_anti")
    if docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return left
    return left.withColumn("__text", F.sha2("text", 256)).dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and empty texts overlap nothing, rows of one doc_id share its fate."""
    leaks = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return by_ids(docs, leaks, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256, for every row; a null text counts as empty."""
    encoded = sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: the networks, the label model and the tokenizer are not SQL; tests/llm/test_pipeline.py holds run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again. Further columns travel along."""
    folder = shared_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
