"""Averaging vectors by group."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmatch.functions.vectors import l2_normalize


def mean_pool(
    df: DataFrame, key: str, vector: str = "embedding", unit: bool = False
) -> DataFrame:
    """``(key, vector)``: the mean of each group's vectors, optionally of unit length.

    The mean is a running aggregate with a partial result per task: a group that holds
    much of the table sends one vector per task.
    """
    pooled = df.groupBy(key).agg(Summarizer.mean(array_to_vector(vector)).alias("mean"))
    out = pooled.select(key, vector_to_array("mean").alias("vector"))
    return out.withColumn("vector", l2_normalize(F.col("vector"))) if unit else out
