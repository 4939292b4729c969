"""Readers of the tables, feature assembly, and storage of fitted models."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """(id, features, label); with dims only the first so many features."""
    v = F.col("embedding").cast("array<double>")
    v = F.slice(v, 1, dims) if dims else v
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("features"), F.col("label").cast("long").alias("label"))


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """df with numeric columns as one array of doubles."""
    return df.withColumn(out, F.array(*(F.col(c).cast("double") for c in columns)))


def save_model(model, spark: SparkSession, path: str) -> None:
    """Writes a fitted model, pickled, as a one-row table, to any path that Spark writes."""
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    """Reads what save_model() wrote. Unpickling runs code: load only what you wrote yourself."""
    return pickle.loads(bytes(spark.read.parquet(path).first()["model"]))
