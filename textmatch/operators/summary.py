"""Reports over the matches of many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.functions.text import ellipsis


def _round2(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def scan_summary(matches: DataFrame) -> DataFrame:
    """One row per (document, match) with the first 200 characters of the text."""
    return matches.select(
        F.col("query_id").alias("cv_file"),
        "rank",
        F.col("title").alias("match_title"),
        F.col("similarity_percentage").alias("similarity"),
        F.substring("embedding_text", 1, 200).alias("match_details"),
    )


def overall_summary(matches: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row over all documents; failed ones (``error`` not null) do not count.

    ``documents`` may list documents that returned nothing. Highs never fall below 0 and
    lows never rise above 100. The deviation is that of the population.
    """
    per_doc = matches.groupBy("query_id").agg(
        F.avg("similarity_percentage").alias("mean"),
        F.max("similarity_percentage").alias("high"),
        F.min("similarity_percentage").alias("low"),
    )
    if documents is not None:
        if "error" in documents.columns:
            documents = documents.filter(F.col("error").isNull())
        per_doc = documents.select("query_id").distinct().join(per_doc, "query_id", "left")

    def high(c: str) -> Column:
        return F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0))

    def low(c: str) -> Column:
        return F.least(F.coalesce(F.min(c), F.lit(100.0)), F.lit(100.0))

    return per_doc.agg(
        F.count(F.lit(1)).alias("total_cvs"),
        _round2(F.coalesce(F.avg("mean"), F.lit(0.0))).alias("average_similarity"),
        _round2(high("mean")).alias("highest_avg_similarity"),
        _round2(low("mean")).alias("lowest_avg_similarity"),
        _round2(high("high")).alias("highest_individual_match"),
        _round2(low("low")).alias("lowest_individual_match"),
        _round2(F.coalesce(F.stddev_pop("mean"), F.lit(0.0))).alias("standard_deviation"),
    )


def comparison_series(matches: DataFrame) -> DataFrame:
    """Average per document next to the mean of all averages."""
    per_doc = matches.groupBy(F.col("query_id").alias("document")).agg(
        F.avg("similarity_percentage").alias("avg_similarity")
    )
    overall = per_doc.agg(F.avg("avg_similarity"))
    return per_doc.withColumn("overall_average", overall.scalar())


def result_lines(matches: DataFrame) -> DataFrame:
    """The printed lines of each match: heading, and the text cut to 100 characters."""
    return matches.select(
        "query_id",
        "rank",
        F.concat(
            "title",
            F.lit(" - "),
            F.format_string("%.2f", "similarity_percentage"),
            F.lit("%"),
        ).alias("heading"),
        ellipsis(F.col("embedding_text"), 100).alias("description"),
    )


# The labels of the printed overall summary, in order.
SUMMARY_LABELS = [
    ("average_similarity", "Average similarity score"),
    ("highest_avg_similarity", "Highest average CV similarity"),
    ("lowest_avg_similarity", "Lowest average CV similarity"),
    ("highest_individual_match", "Highest individual match"),
    ("lowest_individual_match", "Lowest individual match"),
    ("standard_deviation", "Standard deviation"),
]


def summary_lines(summary: DataFrame) -> DataFrame:
    """The printed lines of :func:`overall_summary`, ``(line_no, line)``."""
    lines = [F.concat(F.lit("Total CVs processed: "), F.col("total_cvs").cast("string"))]
    lines += [
        F.concat(F.lit(f"{label}: "), F.format_string("%.2f", column), F.lit("%"))
        for column, label in SUMMARY_LABELS
    ]
    return summary.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))
