"""Sinks: stored tables with a metadata row, JSON records, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"


def write_meta(df_or_spark, path: str, metadata: dict[str, object] | None = None) -> None:
    """One row of metadata as JSON next to a table."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    pairs = [(str(k), str(v)) for k, v in (metadata or {}).items()]
    row = spark.createDataFrame(
        [(dict(pairs), VERSION)], "metadata map<string,string>, version string"
    ).withColumn("created_at", F.current_timestamp())
    row.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, metadata: dict[str, object] | None = None) -> None:
    """Parquet, with a metadata row in ``<path>_meta``."""
    df.write.mode("overwrite").parquet(path)
    write_meta(df, f"{path}_meta", metadata)


def write_json(df: DataFrame, path: str, metadata: dict[str, object] | None = None) -> None:
    """JSON records, one per line, in as many files as there are tasks."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    write_meta(df, f"{path}_meta", metadata)


def write_envelope(report: DataFrame, path: str, metadata: dict[str, object] | None = None) -> None:
    """A report as one JSON document ``{data: [...], metadata, created_at, version}``.

    The format is one value, so this is for reports of a few rows; tables go to
    :func:`write_table` or :func:`write_json`.
    """
    pairs = [F.lit(str(x)) for pair in (metadata or {}).items() for x in pair]
    document = report.agg(F.collect_list(F.struct(*report.columns)).alias("data")).select(
        "data",
        (F.create_map(*pairs) if pairs else F.expr("map()")).cast("map<string,string>").alias("metadata"),
        F.current_timestamp().alias("created_at"),
        F.lit(VERSION).alias("version"),
    )
    document.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; blanks at the ends of a field stay."""
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


MATCH_BUCKETS = 64


def _bucket(query_id: Column) -> Column:
    return F.pmod(F.xxhash64(query_id.cast("string")), F.lit(MATCH_BUCKETS))


def write_matches(matches: DataFrame, path: str) -> None:
    """Matches of all queries as JSON, the queries dealt to a bounded number of folders."""
    rows = matches.withColumn("bucket", _bucket(F.col("query_id")))
    rows.write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", "false").json(path)


def read_matches(spark: SparkSession, path: str, schema: str, query_id: object = None) -> DataFrame:
    """What :func:`write_matches` wrote; of one query only its folder is read."""
    rows = spark.read.schema(f"{schema}, bucket bigint").json(path)
    if query_id is not None:
        rows = rows.where(
            (F.col("bucket") == _bucket(F.lit(query_id))) & (F.col("query_id") == F.lit(query_id))
        )
    return rows.drop("bucket")


def write_metrics(average: DataFrame, path: str) -> None:
    """The metrics with the time of writing."""
    write_json(average.withColumn("written_at", F.current_timestamp()), path)


def write_threshold(chosen: DataFrame, path: str, k_values) -> None:
    """The chosen threshold with its own F1, precision and recall."""
    write_json(chosen, path, {"k_values": list(k_values)})
