"""The corpus pipeline: language, near duplicates, benchmark, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner
writes it as Parquet and hands the reread table to the next stage.  All stages
but the last return the columns of ``documents``.

Nulls, empty and very long texts, ties, repeated rows and empty tables have the
results that the operators' modules state; the stages add this:
language ID drops texts without a letter, and no other text for its score; of a near-duplicate group the row of the least doc_id
stays, rows with a null doc_id all stay, and of repeated rows with the least
doc_id each stays; the rewritten text sets ``n_chars`` anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varioflow.llm import common, decontamination, jaccard_join, language_id, packing, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known, learned from all labelled rows of the input."""
    docs = docs.select(*COLUMNS)
    known = language_id.predict(docs.withColumn("body", F.col("text")), language_id.fit(docs), text="body", keep=tuple(COLUMNS))
    return known.where(F.col("lang_pred") != language_id.UNDETERMINED).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group."""
    gone = jaccard_join.link(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its personal data replaced by surrogates."""
    return pii.pseudonymise(docs.select(*COLUMNS), key="varioflow-pipeline").withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Language posteriors, keyed surrogates and tokenisers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
