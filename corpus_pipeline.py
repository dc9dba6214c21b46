"""The corpus pipeline: each stage takes documents and returns documents, the last one packed sequences.

Order: quality rules, exact dedup, SimHash near-dedup, surrogates for personal data, packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from confuscope.llm import exact_dedup, packing, pii, quality_rules, simhash
from confuscope.llm.common import discard, scratch, table, written
from confuscope.llm.queries import PII_KEY, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy.

    Null and empty texts have no words and go; a very long text is measured whole; repeated rows, null ids and
    other columns pass as they are, whatever their names; an empty table stays empty.
    """
    return quality_rules.filter_documents(docs, quality_rules.STANDARD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest as written, then the smallest id (null ids last).

    Null texts count as empty, so one of all null and empty texts stays; of rows equal in id and text one stays,
    whichever; texts are compared whole; other columns stay, whatever their names; an empty table stays empty.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (a similarity of 0.8 or more of five-word shingles), the smallest id.

    Null ids come last and ties go by a hash of the text; of rows equal in id and text one stays. Null and empty
    texts are copies of each other; fewer than five words are one shingle; texts are read whole; other columns
    stay, whatever their names; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars, if there is such a column, follows the new text.

    Null texts stay null and empty ones empty; whole texts are read; repeated rows and equal texts become alike; ids and
    other columns stay, whatever their names; an empty table stays empty.
    """
    from pyspark.sql import functions as F

    made = pii.with_surrogates(docs, PII_KEY)
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids.

    Null and empty texts are the end token alone; texts of any length are cut; repeated rows and null ids are packed like
    any other; other columns are left out; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii_surrogates", replace_personal_data),
    ("packing", pack),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's work tables, and the documents before it, go when it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            made = keep(written(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
