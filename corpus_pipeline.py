"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import line_dedup, mixing, near_dedup, packing, quality
from bindery.llm.scratch import Scratch

#: No stage but the mixing's word counts can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, among them those with a null text or one without words. Repeated rows and rows with a
    null id are judged as rows; columns of any names stay."""
    return quality.keep(docs)


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and with them documents of which nothing is left. Null texts stay. Rows with one id and different texts are
    different documents here; a null id comes last when a template keeps its first place. Columns of any names stay; ``n_chars`` follows the text."""
    out = line_dedup.line_dedup(docs)
    out = out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(mixing.WORDS))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, one row of each document: of rows with one id the one whose text has the least hash, then the
    least as JSON, on every run. Rows with a null id all stay. Columns of any names stay."""
    found = Scratch(spark, "kept").save(near_dedup.near_dedup(docs, params=near_dedup.NearDedup()))
    gone = found.filter("not kept").select("doc_id").distinct().hint("merge")  # it grows with the input: no broadcast
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = out.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, F.struct(F.xxhash64("text"), F.to_json(row))).alias("__row"))
        out = one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]).unionByName(out.filter("doc_id is null"))
    return out


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is the last source; a row with a null id cannot be looked up and stays once.
    Columns of any names stay."""
    return mixing.repeated(docs, mixing.mix(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the training sequences; a null or empty text is one piece, the end id. Columns but id and text are ignored."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_templates),
    ("near_dedup", near_duplicates),
    ("mixing", mixing_sources),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
