"""The operators of this subpackage as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, counting, decontamination, forest, language, lines, negatives, packing, personal, secrets, sharding, simhash
from . import quality as rules
from .common import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(documents(spark, sf_dir).select("doc_id", "text", "source"), counts=True).drop("source")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir)).drop("text_hash")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(documents(spark, sf_dir), with_prefixes=True)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item, however short, found in a document; documents without a row are clean."""
    found = decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=1)
    return found.select("doc_id", F.explode("items").alias("item")).select("doc_id", "item.item_id", "item.share", F.lit(True).alias("contaminated"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rules.quality(docs, rules.train_crf(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_language, op3_best_fit_packing, op4_sharding, op5_simhash, op6_token_counts, op7_personal_data, op8_decontamination, op9_quality, op10_secrets, op11_hard_negatives, op12_nearest_neighbours, op13_sort_means)}
ORACLES: dict[str, str] = {"op1_line_dedup": lines.DROP_LINES_SQL, "op11_hard_negatives": negatives.HARD_NEGATIVES_SQL, "op13_sort_means": centroids.sort_means_sql()}
