"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guestlens.llm.common import table
from guestlens.llm.lines import lines_sql
from guestlens.llm.oracles import exact_sql, manifest_sql, prefixes_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def register(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@register
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


@register
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.bpe import encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.secrets import find_secrets

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(of))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> "QualityModel":
    """Learned from labels outside the held-out fold, with the texts that ``docs`` has of them."""
    from guestlens.llm.quality import fit_quality

    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    return fit_quality(docs, labels)


@register
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.quality import ACCEPTED, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, quality_model(spark, sf_dir, docs), score="score")
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPTED).cast("int").alias("predicted"),
    )


@register
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.language import fit_language, label_languages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs, remainder("doc_id", 3) != 1)
    return label_languages(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@register
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.suffix import remove_repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@register
def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@register
def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.lines import drop_recurring_lines

    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


SQL["op10_lines"] = lines_sql()


@register
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.decontaminate import find_leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", F.col("leak.item").alias("item_id"), "leak.similarity", "leak.start", "leak.words")


@register
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


@register
def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.prefixes import conversation_turns, prefix_nodes, shared_openings

    return prefix_nodes(shared_openings(conversation_turns(table(spark, sf_dir, "conversations"))))


SQL["op11_prefixes"] = prefixes_sql()


@register
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.merkle import merkle_manifest

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = {"text": lambda c: F.translate(c, upper, upper.lower())}
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered=remainder("doc_id", 3) == 0, changes=lowered)


SQL["op12_manifest"] = manifest_sql()


@register
def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from guestlens.llm.exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"), largest_stays=True)


SQL["op13_exact"] = exact_sql()
