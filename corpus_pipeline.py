"""A corpus pipeline: five operators one after the other, each on all that the last one kept.

language ID -> SimHash near-duplicates -> benchmark decontamination -> personal data -> packing.
A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents, further
ones with any name too. Every stage takes an empty table (and gives one) and reads whole texts; what
it does with nulls, empty texts, ties and repeated rows is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.llm import bestfit, decontam, langid, pii, simhash
from rulespark.llm.common import crc_fold, fresh, materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined or ambiguous go; ``lang`` becomes the language found.

    The classifiers learn from the labelled documents outside the held-out fold, as in op5; a null
    id is outside it, a null lang teaches nothing. Null and empty texts and those without a letter
    are undetermined, so they go; equally near languages are ambiguous. Repeated rows are judged
    alike. Without any labelled document every one goes."""
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs, ~held_out)
    names = tuple(fresh(docs, "lang", "score", "ambiguous"))
    found = langid.predict(docs, model, names)
    kept = found.where((F.col(names[0]) != langid.UNDETERMINED) & ~F.col(names[2]))
    return kept.withColumn("lang", F.col(names[0])).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document of the smallest id stays, once if its row is
    repeated. Null, empty and blank texts are near-duplicates of each other; a null id stays only
    if no other document is in its component (see ``simhash.keep_one``)."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of two benchmark items or more go; with null or empty text they
    stay, as they do with an empty benchmark. Repeated rows and null ids are judged by their texts;
    items of equal text are two, rows that repeat an item one."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; n_chars follows the text, null for a
    null one. No row goes, and null ids and repeated rows are treated like any other."""
    cleaned = docs.withColumn("text", pii.redacted(F.col("text"), spark))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens, as in op6. Null and empty
    texts are one piece, the end mark; repeated rows and null ids are packed each for itself."""
    return bestfit.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", packing),
]

#: Byte-pair encoding and the trained models cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
