"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, byte_bpe, credentials, decontaminate, hilbert, html_text, licenses, merkle, ngram_join, packing, quality, surrogates,
    toxicity)
from .common import table

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_tokenizer() -> str:
    return tokenizer_file("word_bpe_49k.json")


@query
def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query
def op2_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace(table(spark, folder, "documents"), secret="catalogue key")


@query
def op3_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    trusted = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return quality.select(documents, trusted)


@query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("spans", "items")


@query
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(table(spark, folder, "documents"))


@query
def op6_credentials(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.find_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), word_tokenizer()).drop("ids")


@query
def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a tree: a hundred to a folder, the first of which is its licence file."""
    number = F.col("doc_id") % 100
    files = table(spark, folder, "documents").select("doc_id", "text", F.concat_ws(
        "/", "source", "lang", F.expr("doc_id div 100").cast("string"),
        F.when(number == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("path"))
    return licenses.inherit(files)


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    scores = toxicity.score(documents, toxicity.fit(documents, table(spark, folder, "labels")))
    return scores.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    shards = hilbert.shard_rows(documents, ["lang", "source", "size"], ["doc_id", "text_crc32"])
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's proof, and whether it still leads to the root when a seventh of the rows is tampered with."""
    documents, fields = table(spark, folder, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    claimed = merkle.leaf_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    rows = merkle.manifest(
        documents.withColumn("claimed", F.when(tampered, claimed)), tree="lang", order="doc_id", fields=fields, keep=["claimed"])
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    return rows.select(
        F.col("order_key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


@query
def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and the bytes that they decode to."""
    import public_tokenizers

    vocabulary = {"path": tokenizer_file("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    tokens = byte_bpe.digests(byte_bpe.encode(table(spark, folder, "documents"), **vocabulary, offsets=False))
    rows = byte_bpe.decode(tokens, **vocabulary, keep=["n_tokens", "ids_sha256"])
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of two vocabularies meet in every text and in the corpus."""
    return alignment.report(
        table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
