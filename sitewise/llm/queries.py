"""Registered queries of the operators: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import embeddings, html, merkle, minhash, mixing, oracles, packing, phrases, quality, rules, secrets, shards, tokens, toxicity
from sitewise.llm.common import content_key, n_words, table

OP3 = minhash.NearDup(words=3, percent=85, bands=28, rows=7)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = rules.judge(docs, keep=("doc_id",))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, OP3).drop("fingerprint")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, n_words(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats", "positions")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumns({"size": F.octet_length(text).cast("bigint") + 1, "text_crc32": F.crc32(text.cast("binary"))})
    placed = shards.histogram_shards(sized, content_key(F.col("doc_id"), F.col("text")), F.col("size"), 16, order=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary; TOKENIZER_DIR, where set, names another folder that holds it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, tokens.Unigram.from_sentencepiece(tokenizer_file("piece_bpe_32k.model")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).drop("text")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels"))).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(docs, tampered, F.translate("text", "\n", ""))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest_columns(secrets.find_secrets(docs, tokenizer_file("byte_bpe_50k.tiktoken")))


QUERIES = {
    f.__name__: f for f in (
        op1_html_extraction, op2_quality_rules, op3_minhash_dedup, op4_mixing, op5_sharding, op6_best_fit_packing,
        op7_token_counts, op8_embedding_dedup, op9_toxicity, op10_quality_classifier,
        op11_merkle_manifest, op12_phrase_collocations, op13_secret_scan,
    )
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": oracles.RULES, "op5_sharding": oracles.SHARDS, "op11_merkle_manifest": oracles.MERKLE, "op12_phrase_collocations": oracles.PHRASES,
}
