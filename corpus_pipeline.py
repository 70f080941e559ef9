"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, tokens. Each stage works on all that the
one before it kept, and its decisions take effect; all but the last return the columns of documents.

Defined cases, for every stage: texts are worked on whole, whatever their length; an empty table gives no rows; columns other
than those of documents are left behind, whatever their names; rows are told apart as rows, so those without an id, or with
an id that another row has, stay unless the stage's own decision takes them out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import bpe, language, mixing, near, pii
from quadloom.llm.common import documents, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Passes over a source at most, in the pipeline: the mixture repeats small sources a little and drops no document.
PASSES = 1.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang becomes the language found. Null and empty texts, and texts without a letter,
    go; of repeated rows all stay."""
    known = language.prototypes(docs.where(~language.held_out("doc_id")))
    made = language.identify(docs, known, COLUMNS)
    return made.where(F.col("lang_pred") != language.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8), with the smallest id; rows without an id or
    without words stay."""
    return near.one_of_each(docs, width=5, percent=80).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; a null text stays null, and every row stays."""
    return pii.redacted(docs, [c for c in COLUMNS if c != "text"]).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources wants them, each at least once; a null source is one of its own, and a
    document without words comes once."""
    return mixing.mixed(docs, limit=PASSES).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text has no ids."""
    return bpe.digest(bpe.encode_decode(docs))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Components, a trained tagger and merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
