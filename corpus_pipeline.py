"""Corpus preparation in five stages: language, near-duplicates, benchmark, personal data, packing.

Each stage works on all rows that its predecessor kept; ``run`` writes each result as Parquet to the shared folder and
reads it back. All but the last return the columns of documents, whatever other columns there are. Of an empty table every
stage makes an empty one; a text of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document is rejected whose n-grams are out of place by more than those of labelled documents of its length; by more
#: than this share of the largest distance in any case.
FARTHEST = 0.85
VOCABULARY = "byte_bpe_50k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: rejected are those without letters or farther from every profile than labelled ones.

    A row is judged by its text alone: null and empty texts go, rows without an id and repeated rows are judged each. Without any
    labelled document nothing is known, and all go. Equal distances go to the first language.
    """
    from mnemolake.llm import language

    own = docs.select(*COLUMNS)
    profiles = language.learn_limited(own, F.lit(True), FARTHEST)
    got = language.identify(own, profiles, carry=COLUMNS[1:], text_col="text")
    return got.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group (five words, similarity 0.8).

    Of rows with that id the one with the least hash of the text stays, of rows equal in id and text one. Null texts, and texts without
    words, are of no group and stay. A row without an id goes if a row with one, or another without, has its shingles.
    """
    from mnemolake.llm import near_dup

    return near_dup.deduplicate(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the benchmark doesn't contaminate.

    A row is judged by its text alone; null and empty texts, rows without an id and repeated rows stay or go like others. An empty
    benchmark contaminates nothing.
    """
    from mnemolake.llm import decontaminate

    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with personal data in its text replaced; n_chars follows.

    Of spans that overlap the first names the kind. A null text stays null, with n_chars null; rows without an id and repeated rows stay.
    """
    from mnemolake.llm import pii

    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document, packed into sequences of 2048 tokens.

    A null text is an empty one, of one token. Every row has pieces of its own, also where ids are null or repeat; which of equal
    pieces stands where is left open.
    """
    import public_tokenizers

    from mnemolake.llm import packing as p

    return p.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages are iterative or learnt: SQL can't express them. Tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole of documents."""
    from mnemolake.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
