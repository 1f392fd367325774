"""A training-data pipeline over documents: quality rules, toxicity, near duplicates, mixing, packing.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows, an empty table (no
rows come back) and columns beside those of documents, whatever their names; each docstring states what
comes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import minhash, mixing, packing, rules, toxicity
from sitewise.llm.common import fresh, n_words, settle, table
from sitewise.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a language reference taken from docs themselves.

    Null, empty and short texts fail; repeated rows stay or go together; ties with a limit stay."""
    return rules.passing(docs)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught on the labelled ones among docs, doesn't call toxic.

    Null and empty texts score like any text without a voter's word; rows without an id teach nothing and
    are judged as others are; without labels of both classes all score alike."""
    columns = docs.columns
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8 or more).

    Of a group the row with the least id stays; texts without words, and rows with a null id, stay; of rows
    that repeat an id one stays, the one with the least text by hash."""
    return minhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each time with its training position, sorted by it; documents that it doesn't take go.

    A null source is a source; null and empty texts count 0 words and follow the rule of their place; equal
    rows may swap; a column named position is replaced."""
    (own,) = fresh(docs, "_own")  # carries columns whose names the mix takes for its own
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias(own))
    ordered = mixing.training_order(mixing.mix(rows, n_words(F.col("text"))))
    return ordered.select(*[F.col(own)[c].alias(c) for c in docs.columns if c.lower() != "position"], "position")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 2048, with the training position of each.

    A null or empty text is one piece, its end; repeated rows and null ids are packed like others."""
    out = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), carry=("position",))
    return out.select("doc_id", "position", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules), ("toxicity", clean_of_toxicity), ("minhash_dedup", one_of_each_group),
    ("mixing", mixed_sources), ("packing", packed),
]
# Tokenization, minima and the classifier have no SQL form; tests/llm holds near duplicates, mixing and packed
# positions against plain versions, and only the operators of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each one's documents are a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
