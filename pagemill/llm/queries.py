"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.chat_format import link_tool_calls
from pagemill.llm.collocations import collocations
from pagemill.llm.decontaminate import overlap_report
from pagemill.llm.hyperminhash import link_components
from pagemill.llm.language_id import identify
from pagemill.llm.packing import pack_documents
from pagemill.llm.quality_rules import STATS, score_documents
from pagemill.llm.secret_scan import KINDS, scan_documents, spans_text
from pagemill.llm.sharding import shard_documents
from pagemill.llm.suffix_dedup import remove_repeats
from pagemill.llm.token_alignment import align_documents
from pagemill.llm.token_count import token_count
from pagemill.llm.toxicity import learn_toxicity, toxicity_score

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they exceed 512."""
    counted = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op8_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.coalesce(F.crc32("text"), F.lit(0).cast("long")))
    return shard_documents(docs, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs).select("doc_id", *STATS, "base_failed", "kept")


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    scanned = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *[count(kind.name) for kind in KINDS],
        F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        spans_text(F.col("secret_spans")).alias("spans"),
    )


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of benchmark items."""
    report = overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return link_components(table(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    training = docs.where(~F.col("held_out"))
    found = identify(docs.select("doc_id", "text", "held_out"), training)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses if strings of 200 bytes that start elsewhere too go."""
    removed = remove_repeats(table(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return removed.select("doc_id", "n_bytes", "n_removed", n_spans, "kept_sha256")


@query
def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of ``conversations`` as a call that the next turn of the assistant
    answers; all calls but a conversation's first need the first one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    call_id = lambda turn: F.concat_ws("-", F.lit("call"), "conv_id", turn)
    users = turns.where("role = 'user'")
    opening = users.groupBy("conv_id").agg(F.min("turn").alias("opening"))
    calls = users.join(opening, "conv_id").select(
        "conv_id",
        call_id(F.col("turn")).alias("call_id"),
        "turn",
        F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("prompt"))).alias("arguments"),
        F.when(F.col("turn") > F.col("opening"), F.array(call_id(F.col("opening"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("needs"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
    return link_tool_calls(calls, results, schemas)


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels of two thirds of them."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    network = learn_toxicity(docs.where(~held_out), labels.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity_score(F.col("text"), network).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the tokens of every document in two vocabularies."""
    docs = table(spark, sf_dir, "documents")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(docs, *paths)[0]
