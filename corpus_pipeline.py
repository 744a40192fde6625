"""From raw documents to packed training windows: toxicity filter, near-duplicate removal, repeat removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm import jaccard_join, packing, suffix_dedup, toxicity
from speechlake.llm.common import mark_of, stored, table

#: Near-duplicate stage: words of a shingle, and similarity in hundredths.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier does not predict as toxic, as they are."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id. Rows that have no link stay, with or without an id; of rows equal in id and text one stays."""
    found = jaccard_join.marked_components(docs, WORDS, PERCENT)
    heads = stored(found.where("is_first").select(F.col("mark").alias("_mark")), "pipeline-heads")
    kept = docs.withColumn("_mark", mark_of()).join(heads, "_mark", "left_semi")
    return kept.dropDuplicates(["_mark"]).select(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row without the strings that start earlier in the corpus; n_chars is counted anew."""
    texts = suffix_dedup.without_repeats(docs).select(F.col("mark").alias("_mark"), F.col("text").alias("_text"))
    kept = docs.withColumn("_mark", mark_of()).drop("text").join(texts, "_mark")
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of the source mixture, with their ids."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_duplicates), ("suffix-array dedup", remove_repeats), ("packing", pack)]
ORACLE_SQL = None  # a trained classifier and a tokenizer have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
