"""A corpus pipeline of the training-data operators; each stage's result is the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import containment, jaccard, line_frequency, packing, repeats
from pixelmill.llm.line_frequency import row_key
from pixelmill.session import cut_lineage, scratch_dir


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in the one column of ``gone``."""
    name = _fresh(docs, "_key")
    out = docs.withColumn(name, key).join(gone.toDF(name).distinct(), name, "left_anti")
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text statistics and keep most of their words, without frequent lines.

    A text that loses lines has the others as they were, and a new n_chars; texts without a
    frequent line stay as they are, to the byte.
    """
    judged = line_frequency.line_frequency(docs).filter(~F.col("kept") | (F.size("removed") > 0))
    # rows of one key are equal and judged alike
    judged = judged.groupBy("row_key").agg(F.first("kept"), F.first("removed"))
    name, kept, removed = (_fresh(docs, n) for n in ("_key", "_kept", "_removed"))
    out = docs.withColumn(name, row_key("doc_id", "text", "source")).join(judged.toDF(name, kept, removed), name, "left")
    out = out.filter(F.coalesce(kept, F.lit(True)))
    new = line_frequency.without_lines(F.col("text"), F.col(removed))
    size = F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.char_length(new))
    values = {
        "text": F.when(F.col(removed).isNull(), F.col("text")).otherwise(new),
        "n_chars": size.cast(docs.schema["n_chars"].dataType),
    }
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the one with the smallest id.

    Rows of one id and text are one document. Documents without words all stay.
    """
    key = row_key("doc_id", "text")
    keyed = docs.select(key.alias("row"), "doc_id", "text")
    found = cut_lineage(jaccard.jaccard_join(keyed, doc_id="row").withColumnRenamed("doc_id", "row"))
    # the row that stays: null ids last
    rows = found.join(keyed.select("row", "doc_id").distinct(), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    stays = rows.groupBy("component_id").agg(first.alias("row"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = cut_lineage(rows.join(stays.withColumnRenamed("row", "stays"), "component_id").filter("row != stays").select("row"))
    kept = _without(docs, key, gone)
    # equal rows: the same document several times over
    again = cut_lineage(found.filter("n_shingles > 0").groupBy("row").count().filter("count > 1").select("row"))
    if again.isEmpty():
        return kept
    name = _fresh(docs, "_key")
    repeated = kept.withColumn(name, key).join(again.toDF(name), name, "left_semi").dropDuplicates([name])
    return _without(kept, key, again).unionByName(repeated.select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that recur.

    A text that loses words has the others joined by one space, and a new n_chars; the rest
    stay as they are, to the byte. A document that loses all its words stays, empty.
    """
    decided = repeats.decide(repeats.recurring_passages(docs), docs).filter("n_removed > 0")
    new = F.when(F.col("whole"), F.lit("")).otherwise(F.col("kept_text"))
    k1, k2, text = (_fresh(docs, n) for n in ("_k1", "_k2", "_new"))
    changed = decided.select(F.col("k1").alias(k1), F.col("k2").alias(k2), new.alias(text))
    out = docs.withColumns(dict(zip((k1, k2), repeats.keys()))).join(changed, [k1, k2], "left")
    size = F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.char_length(text))
    values = {"text": F.coalesce(text, "text"), "n_chars": size.cast(docs.schema["n_chars"].dataType)}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = row_key("doc_id", "text")
    found = containment.contained(docs.select(key.alias("row"), "text"), items, doc_id="row")
    return _without(docs, key, found.select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens, each filled with lexical neighbours: the pieces and their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Not in SQL: packing is a greedy choice. ``tests/llm/test_pipeline.py`` checks all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again."""
    folder = scratch_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
