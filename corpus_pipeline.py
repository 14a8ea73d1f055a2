"""A training corpus from ``documents`` in five stages, each over all that the stage before has kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadvane.llm import decontam, fst, langid, line_dedup, minhash
from leadvane.llm.common import keyed, prepare, written
from leadvane.llm.queries import MODEL_FILE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; it learns from the labelled fold of the documents themselves."""
    prepare(spark)
    model = langid.train(langid.learnable(docs))
    return langid.predict(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller doc_id holds; n_chars follows the text."""
    prepare(spark)
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    prepare(spark)
    gone = written(minhash.near_groups(docs).where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    return keyed(docs, gone, "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    items = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = written(decontam.contamination(docs, items).where("contaminated AND doc_id IS NOT NULL").select("doc_id"), "contaminated")
    return keyed(docs, gone, "left_anti").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed piece ids of each text, their number, and whether decoding them gives the text back."""
    prepare(spark)
    pieces = fst.load(MODEL_FILE)
    return fst.round_trip(docs.select("doc_id", "lang", "source", "text"), pieces).drop("text")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]

#: The classifier's gradient descent and the transducer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
