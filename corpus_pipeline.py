"""A training-corpus pipeline: five stages, each written as Parquet and read again by the next.

quality: rejected documents go. near_duplicates: one document of each group stays. decontamination:
documents that hold a benchmark passage go. personal_data: spans become their kind's name in the text.
pieces: texts become SentencePiece ids. A stage's function takes (spark, docs, sf_dir); other columns
of `docs` pass through the first four, whatever their names.

In all stages an empty table gives an empty one, texts are taken whole whatever their length, and a null
doc_id is a value like others. What each does with null and empty texts, ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, neardup, pieces, pii, quality
from millrace.llm.common import table, write_table


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the whole row, so that no other column's name can clash."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1, with a score of at least 0.5 (a tie stays).

    Null and empty texts score the bias alone. Repeated rows are scored each, and stay or go together.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(_packed(docs), model).where("score >= 0.5").select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group at a similarity of 0.8 of five-word shingles (a pair at exactly 0.8 is linked).

    Texts without words are linked with nothing and stay. Of rows that repeat a doc_id and text one stays; of
    several texts of a group's least doc_id one stays.
    """
    return neardup.first_of_groups(_packed(docs), 5, 80, 100).select("_row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts hold none; rows that repeat a doc_id go together."""
    return decontam.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"), decontam.SHARE).select("_row.*")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars is that of the new text.

    A null text stays null, with a null n_chars. Overlapping spans become one, under the first one's kind. Repeated rows stay.
    """
    changed = pii.redact(_packed(docs))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return changed.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, ids_sha256, decoded_sha256) of all documents.

    A null text counts as empty and has the begin and end ids alone. Repeated rows stay.
    """
    kept = docs.select(*[c for c in ("doc_id", "lang", "source", "text") if c in docs.columns])
    return pieces.encode(kept).drop("text")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("pieces", pieces_stage),
]

#: SQL expresses neither the trained stages nor the tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
