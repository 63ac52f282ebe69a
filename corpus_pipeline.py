"""From raw documents to packed training sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quotegrid.llm import language_spans, prefix_join, quality_rules, sentence_spans, squares_packing
from quotegrid.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language holds at least half of their letters."""
    model = language_spans.learn_languages(docs)
    boxed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")  # no column clashes with a result
    kept = language_spans.label_languages(boxed, model).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and the learned list."""
    return quality_rules.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies; documents without an id stay."""
    classes = prefix_join.similar_components(docs, shingle=5, percent=80)
    dropped = classes.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; ``n_chars`` is the new length."""
    boxed = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("row"))  # as in the language stage
    cut = sentence_spans.drop_repeats(boxed)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    return cut.select(*[n_chars if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col("row")[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return squares_packing.pack(docs)


STAGES = [("language", language_stage), ("quality", quality_stage), ("jaccard", jaccard_stage), ("substring", substring_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
