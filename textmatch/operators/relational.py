"""Table preparation: checks, filters, ordered distinct concatenation, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.functions.text import clean_text


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def filter_max_id(df: DataFrame, max_id: int | None, id_col: str = "person_id") -> DataFrame:
    """Cast the id to int and keep ids up to ``max_id``; other tables pass unchanged."""
    if id_col not in df.columns:
        return df
    df = df.withColumn(id_col, F.col(id_col).cast("int"))
    return df if max_id is None else df.filter(F.col(id_col) <= max_id)


def clean_columns(df: DataFrame, keep: Sequence[str] = ("person_id",)) -> DataFrame:
    """Clean every string column but the ones in ``keep``."""
    return df.select(
        *[
            clean_text(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) and f.name not in keep
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _order(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def group_concat_distinct(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    order_by: Sequence[str | Column],
    sep: str = "; ",
    drop_empty: bool = False,
) -> DataFrame:
    """Per key and column, the distinct values in first-seen order, joined by ``sep``.

    The first aggregation reduces each (key, column, value) to its earliest position and
    combines on the map side, so a key that holds much of the table reaches the second
    one as its distinct values only. With one order column its minimum is a hash aggregate;
    several make a struct, which is sorted. The result holds all distinct values of a key in
    one string, so the second aggregation does as well.
    """
    if not columns:
        return df.select(key).distinct()
    cells = df.select(
        F.col(key).alias("key"),
        (F.struct(*order_by) if len(order_by) > 1 else _order(order_by[0])).alias("seq"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("col"), F.col(c).cast("string").alias("value")
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("cell"),
    )
    firsts = cells.groupBy("key", "cell.col", "cell.value").agg(F.min("seq").alias("seq"))

    def joined(i: int) -> Column:
        wanted = (F.col("col") == i) & F.col("value").isNotNull()
        if drop_empty:
            wanted &= F.col("value") != ""
        picked = F.collect_list(F.when(wanted, F.struct("seq", "value")))
        return F.array_join(F.transform(F.sort_array(picked), lambda x: x["value"]), sep)

    return firsts.groupBy("key").agg(
        *[joined(i).alias(c) for i, c in enumerate(columns)]
    ).withColumnRenamed("key", key)


def content_dedup(df: DataFrame, id_col: str = "person_id") -> DataFrame:
    """One row per distinct content, the one with the lowest id; nulls count as equal.

    Contents are grouped by digest, so that ids and digests are shuffled, combined on the map
    side, and not the texts. ``df`` has one row per id.
    """
    marked = df.withColumn("_digest", content_digest(df, id_col))
    first = marked.groupBy("_digest").agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(first, id_col, "left_semi")


def content_digest(df: DataFrame, id_col: str) -> Column:
    """SHA-256 of all columns but the id; null and every text differ."""
    marked = []
    for c in sorted(c for c in df.columns if c != id_col):
        text = F.col(f"`{c}`").cast("string")
        size = F.octet_length(text).cast("string")
        marked.append(F.coalesce(F.concat(size, F.lit("="), text), F.lit("~")))
    return F.unhex(F.sha2(F.concat_ws("|", *marked), 256))


def dedup_stats(df: DataFrame, id_col: str = "person_id") -> DataFrame:
    """Rows before and after :func:`content_dedup`, and the share it removes."""
    digests = df.select(content_digest(df, id_col).alias("digest"))
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    total = sizes.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("initial_rows"),
        F.count(F.lit(1)).alias("kept_rows"),
    )
    removed = F.col("initial_rows") - F.col("kept_rows")
    share = F.coalesce(F.try_divide(removed * 100.0, F.col("initial_rows")), F.lit(0.0))
    return total.select(
        "initial_rows",
        "kept_rows",
        removed.alias("removed_rows"),
        (F.floor(share * 100 + 0.5) / 100).alias("removed_percent"),
    )


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: distinct values, extremes, and whether a narrow encoding would pay.

    ``exact=False`` estimates the distinct counts in one pass without a shuffle of values.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    plain = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(plain):
        aggs += [
            distinct(F.col(f.name)).alias(f"d{i}"),
            F.min(f.name).cast("string").alias(f"lo{i}"),
            F.max(f.name).cast("string").alias(f"hi{i}"),
        ]

    def suggestion(i: int, f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StringType):
            return F.when(
                F.col(f"d{i}") < 0.5 * F.col("rows"), F.lit("dictionary")
            ).otherwise(F.lit("string"))
        if isinstance(f.dataType, T.IntegralType):
            lo, hi = F.col(f"lo{i}").cast("bigint"), F.col(f"hi{i}").cast("bigint")
            out = F.lit("bigint")
            for bits, name in ((32, "int"), (16, "smallint"), (8, "tinyint")):
                fits = (lo >= -(2 ** (bits - 1))) & (hi < 2 ** (bits - 1))
                out = F.when(fits, F.lit(name)).otherwise(out)
            return out
        if isinstance(f.dataType, T.FractionalType):
            return F.lit("float")
        return F.lit(f.dataType.simpleString())

    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.col("rows").alias("row_count"),
            F.col(f"d{i}").alias("distinct_values"),
            F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"),
            (F.col(f"d{i}") < 0.5 * F.col("rows")).alias("low_cardinality"),
            suggestion(i, f).alias("suggested_type"),
        )
        for i, f in enumerate(plain)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
