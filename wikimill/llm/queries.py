"""One query for each operator of this folder, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (centroids, decontaminate, exact_dedup, kneser_ney, license_scan, line_dedup, mixture, near_dedup, piece_spans, spelling, substring_dedup,
               token_counts, toxicity)
from .common import read
from .oracles import ORACLES

MODEL_FILE = "piece_bpe_32k.model"

__all__ = ["ORACLES", "QUERIES"]


def pieces_of(model_path: str | None) -> token_counts.Pieces:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL_FILE)
    return token_counts.Pieces(str(model_path))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_summary(read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: one row per document and item it holds."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_counts(read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), pieces_of(model_path))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the rows, by a hash of the id, is the snapshot, the other the incoming batch; all rows are judged."""
    snapshot, incoming = exact_dedup.halves(read(spark, sf_dir, "documents"))
    return exact_dedup.exact_duplicates(incoming, snapshot).drop("known")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.removed_words(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model = kneser_ney.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    out = kneser_ney.score(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"))


def op12_piece_spans(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    out = piece_spans.encode_documents(read(spark, sf_dir, "documents"), pieces_of(model_path), decode=True)

    def digest(col: str) -> Column:
        return F.sha2(F.array_join(F.col(col).cast("array<string>"), ","), 256)

    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                      digest("borders").alias("borders_sha256"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_benchmark_decontamination, op3_line_dedup, op4_mixture, op5_near_dedup, op6_token_counts,
                            op7_exact_dedup, op8_substring_dedup, op9_lm_score, op10_toxicity, op11_centroids, op12_piece_spans, op13_spelling_groups)
}
