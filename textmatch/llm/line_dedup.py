"""Boilerplate lines by distinct-site spread, with HyperLogLog sketches per line.

A line is compared by the digest of its normal form (blanks collapsed, lower case); blank lines
are never removed. A line is boilerplate if it is on at least ``min_sites`` distinct sites, in
at least as many distinct texts, so that one page copied from site to site stays whole.

1. Occurrences per line are counted, combined on the map side; a line with fewer occurrences
   than ``min_sites`` can't be on as many sites and needs no sketch.
2. For the others a sketch of their sites and one of their texts is aggregated per line; the
   sketches of parts merge, so no task sees all rows of a common line.
3. Estimates that lie further from the limit than ``BAND`` standard errors (one at least) are
   decided; the lines near it get exact distinct counts.
4. The lines are removed everywhere but at their first place (smallest id, then position), so
   what is said there is not lost. Only positions are aggregated per document; the text is cut
   in place.

Only DataFrame functions are used.

Defined results: a null text stays null and has no lines; an empty text has one blank line. A
null site is a site of its own. A null id comes first. Rows that repeat id and text are treated
alike. Empty tables give no rows. Other columns pass unchanged; those named as a result are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.config import materialize
from textmatch.llm.common import join_groups, table

MIN_SITES = 10
LG_K = 12  # 4,096 registers: a standard error of 1.6 %
BAND = 5


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _lines(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """(id, content, site, pos, line): one row per line that isn't blank."""
    # What belongs to the document is worked out before its lines multiply the row.
    whole = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("content"),
        F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site"),
        F.split(text_col, "\n", -1).alias("all_lines"),
    )
    # The outer form keeps Spark from splitting the text again for an inferred filter.
    split = whole.select(
        "id", "content", "site", F.posexplode_outer("all_lines").alias("pos", "raw")
    )
    there = split.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    line = normal_line(F.col("raw")).cast("binary")
    return there.select("id", "content", "site", "pos", F.unhex(F.md5(line)).alias("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, first, n) of the lines to remove; ``first`` is the (id, pos) that stays, ``n``
    the number of occurrences."""
    frequent = materialize(
        lines.groupBy("line")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
        .where(F.col("n") >= min_sites),
        "frequent",
    )
    total = lines.count()
    mine = join_groups(lines, frequent.select("line", "n"), ["line"], total).select(
        "line", "site", "content"
    )
    estimated = mine.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
        F.hll_sketch_estimate(F.hll_sketch_agg("content", F.lit(LG_K))).alias("texts"),
    )
    margin = max(1.0, BAND * 1.04 / 2 ** (LG_K / 2) * min_sites)
    least = F.least("sites", "texts")
    estimated = materialize(estimated.where(least >= min_sites - margin), "estimated")
    sure = estimated.where(least > min_sites + margin).select("line")
    near = estimated.where(least <= min_sites + margin).select("line")
    exact = (
        mine.join(near, "line")
        .groupBy("line")
        .agg(F.countDistinct("site").alias("sites"), F.countDistinct("content").alias("texts"))
        .where(least >= min_sites)
        .select("line")
    )
    return frequent.join(sure.union(exact), "line")


def line_dedup(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    site_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, ``n_lines`` and ``n_removed``."""
    lines = materialize(_lines(docs, id_col, site_col, text_col), "lines")
    found = materialize(boilerplate(lines, min_sites), "boilerplate")
    gone = (
        join_groups(lines, found, ["line"], lines.count())
        .where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))))
        .groupBy("id", "content")
        .agg(F.collect_set("pos").alias("gone"))
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(id_col).alias("id"),
        F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("content"),
    )
    same = whole["id"].eqNullSafe(gone["id"]) & (whole["content"] == gone["content"])
    joined = whole.join(gone, same, "left").select(
        "row", "gone", F.split(F.col("row").getField(text_col), "\n", -1).alias("all_lines")
    )
    left = F.filter("all_lines", lambda _, at: ~F.array_contains("gone", at))
    text = F.when(F.col("gone").isNull(), F.col("row").getField(text_col)).otherwise(
        F.array_join(left, "\n")
    )
    out = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept]
    return joined.select(
        *out,
        F.coalesce(F.size("all_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, text, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS raw
  FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents
        WHERE text IS NOT NULL)),
normal AS (
  SELECT *, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM lines),
found AS (
  SELECT line, min((doc_id, pos)) AS first FROM normal WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT coalesce('=' || source, '')) >= {MIN_SITES}
    AND count(DISTINCT text) >= {MIN_SITES}),
marked AS (
  SELECT n.*, f.line IS NOT NULL AND f.first <> (n.doc_id, n.pos) AS gone
  FROM normal n LEFT JOIN found f ON n.line = f.line),
done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_removed, 0)::BIGINT AS n_removed, done.text AS text
FROM documents d LEFT JOIN done USING (doc_id)
"""
