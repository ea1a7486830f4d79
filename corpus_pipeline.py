"""The corpus pipeline: each stage is written as Parquet and read again as the documents of the next.

``run`` applies the stages to ``documents``. All but the last return the columns of documents; the last returns the mix.
SQL cannot express the stages (a trained classifier, edit search, pseudorandom draws), so there is no SQL; the tests compare
each stage with a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikimill.llm import decontaminate, line_dedup, mixture, near_dedup, toxicity
from wikimill.llm.common import free_name, read, stored


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text digest, and the key's name: decisions hold for a text and not for whatever else has its id."""
    name = free_name(docs, "row_")
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumn(name, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), digest.cast("string"))), name


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone(doc_id)``; the key goes again."""
    name = free_name(rows, "gone_")
    return rows.join(gone.select(F.col("doc_id").alias(name)).distinct(), F.col(key) == F.col(name), "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the classifier chain rejects go. Texts without words stay; a null id and a repeated one are judged by their texts."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    rows, key = with_row(docs)
    return without(rows, key, toxicity.classify(rows, model, id_col=key).where("toxic"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are deleted from the texts; no row goes. ``n_chars`` follows the text. Null texts stay null."""
    out = line_dedup.dedup_lines(docs).select(docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays. The stage links at a similarity of 0.8. Rows without words are in no group and stay."""
    return near_dedup.keep_one(docs, near_dedup.Trees(percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of a benchmark item go, those with a null id as well. Null and empty texts hold none."""
    rows, key = with_row(docs)
    return without(rows, key, decontaminate.contaminated(rows, read(spark, sf_dir, "benchmark"), id_col=key))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: blocks of words by shard and slot. Rows without words give none; null sources are one source."""
    return mixture.mix_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
