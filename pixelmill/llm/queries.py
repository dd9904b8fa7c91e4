"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import collocations, containment, cross_parsing, factorisation, jaccard, line_frequency, packing, prefix_trie, repeats, sharding, sql, token_counts, token_files, transcripts
from pixelmill.llm.registry import QUERIES, SQL, query  # noqa: F401
from pixelmill.session import scratch_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _crc(ids: str = "ids"):
    return F.crc32(ids).alias("ids_crc32")


@query(sql.LINE_FREQUENCY)
def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_frequency(documents(spark, sf_dir)).drop("_row", "row_key", "removed")


@query()
def op2_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(documents(spark, sf_dir), path)
    return pieces.select("doc_id", "start", "length", _crc(), "doc_tokens", "sequence_id", "offset")


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = scratch_dir(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), folder, path, end_id=2)
    rows = token_files.read_tokens(spark, folder)
    n = F.expr("octet_length(ids) div 4").cast("long")
    return rows.select("doc_id", "start", n.alias("n_tokens"), _crc())


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts.token_counts(documents(spark, sf_dir), path)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query()
def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), limit=8 << 20)


@query(sql.JACCARD_JOIN)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


@query(sql.REPEATED_PASSAGES)
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = repeats.recurring_passages(docs).withColumn("sha", F.sha2("kept_text", 256)).drop("kept_text")
    decided = repeats.decide(found, docs)
    sha = F.when(F.col("whole"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha"))
    rows = docs.select("doc_id", *repeats.keys()).join(decided, ["k1", "k2"])
    return rows.select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))


@query(sql.CONTAINMENT)
def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return containment.contained(documents(spark, sf_dir), items).drop("_row")


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query()
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = factorisation.train(docs.select("doc_id", "text"), labels.filter(~_held_out()))
    scores = factorisation.score(docs, model)
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return scores.select("doc_id", _held_out().alias("held_out"), "score", predicted)


@query()
def op5_transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = transcripts.as_transcripts(turns)
    model = transcripts.train(lines.filter(F.crc32(F.col("conv_id").cast("string")) % 4 != 2))
    found = transcripts.recover_roles(lines.select("conv_id", "pos", "line"), model)
    return transcripts.render_turns(found)


@query(sql.COLLOCATIONS)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


@query()
def op12_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = cross_parsing.train(docs.filter(~held_out))
    found = cross_parsing.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query(sql.PREFIX_TRIE)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(turns))
