"""From raw documents to training data: stages over the operators of `guestlens.llm`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet and reads again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from guestlens.llm.bpe import encode_documents
from guestlens.llm.common import stored, table
from guestlens.llm.decontaminate import find_leaks
from guestlens.llm.lines import drop_recurring_lines
from guestlens.llm.neardup import near_duplicates
from guestlens.llm.quality import ACCEPTED, score_quality
from guestlens.llm.queries import VOCABULARY, quality_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; one that knows no label accepts all.

    The classifier learns from the labels outside the held-out fold.  Null and empty texts are judged as empty texts.
    """
    model = quality_model(spark, sf_dir, docs)
    if not any(model.weights):
        return docs
    return score_quality(docs, model, score="_score").where(F.col("_score") >= ACCEPTED).select(docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines of recurring templates; ``n_chars`` follows the text."""
    out = drop_recurring_lines(docs, counts=("_lines", "_dropped"))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_dropped") > 0, changed).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document with the least key; documents without a key stay.

    Rows are told apart by key and text, so that a key that is repeated with another text loses no row; of rows that
    repeat both one stays.
    """
    found = stored(near_duplicates(docs, mark="_mark").withColumn("_mark", F.coalesce("_mark", F.lit(""))), "classes")
    marked = docs.withColumn("_mark", F.coalesce(F.md5("text"), F.lit("")))
    left = marked.join(found.where(~F.col("kept")).select("doc_id", "_mark"), ["doc_id", "_mark"], "left_anti")
    repeated = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "_mark").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        again = left.join(repeated, ["doc_id", "_mark"], "left_semi").dropDuplicates(["doc_id", "_mark"])
        left = left.join(repeated, ["doc_id", "_mark"], "left_anti").unionByName(again)
    return left.select(docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), leaks="_leaks")
    return found.where(F.size("_leaks") == 0).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, packed token ids, and the text that they decode to."""
    return encode_documents(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("lines", without_recurring_lines),
    ("neardup", one_of_each_group),
    ("decontaminate", without_leaks),
    ("bpe", encoded),
]

#: The classifier, the similarity of near duplicates and the merges have no SQL; the tests hold a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the rows that are left, encoded."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
