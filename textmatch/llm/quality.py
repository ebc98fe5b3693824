"""Quality rules whose thresholds come from quantile sketches per language and source.

Each document gives counts of its whole text (``text_counts``). From them come four rates,
kept as integers (``RATES``). A sketch of a rate is a table (value, rows): the value rounded
down to seven significant bits, the rows that have it. Such tables merge by adding rows, in any
order, and their size is bounded by the number of such values, whatever the input; so the
sketches are plain grouped counts, combined on the map side, and a source with a third of all
rows costs no more than another. The quantiles of a sketch are exact for the rounded values:
the relative error is under 1/64.

A rate's fences are taken from the documents that pass the base rule:
``median + FENCE * max(median - tenth percentile, floor)`` above and, for word length,
the mirror image below. Only the cleaner side of the distribution sets the width, so junk that
makes up less than half of a source doesn't widen the fence. Where the spread is under the floor,
as it is for most rates of clean sources, the floor decides. A (language, source) with fewer
than ``min_rows`` such rows takes the merged sketch of its language, a language with fewer the
merged sketch of all. The thresholds are joined to the documents by language and source.

Defined results: a null or empty text has no words and fails the base rule. Null languages and
sources are groups of their own. Repeated rows count as often as they occur. An empty table
gives no rows. Other columns pass unchanged; those named as a result are replaced.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize
from textmatch.llm.common import rows_with, table, utf8

MIN_WORDS, REPEAT_PERCENT = 50, 50
FENCE, MIN_ROWS = 5, 50
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: rate: numerator, denominator, scale, floor of the spread, whether low values are bad too
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 1_000_000, 4_000, False),
    "word_length": ("word_chars", "n_words", 1_000, 500, True),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1_000_000, 100_000, False),
    "repeat_rate": ("n_repeat_words", "n_words", 1_000_000, 60_000, False),
}


def counts_of(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The values of ``COUNTS`` for one text."""
    words = text.split()  # bytes.split: the ASCII blanks, \x09-\x0D and \x20
    points = len(text.translate(None, _CONTINUED))
    blanks = len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (
        len(words), points - blanks, symbols, len(lines),
        len(lines) - len(set(lines)), _repeated(words),
    )


# Bytes that go on with a code point; every other byte begins one.
_CONTINUED = bytes(range(0x80, 0xC0))


def _repeated(words: list[bytes]) -> int:
    """Words in runs of three that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    new = count()
    ids = np.array([numbers[w] if w in numbers else numbers.setdefault(w, next(new)) for w in words])
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    runs = pairs[:-1] * len(numbers) + ids[2:]
    _, which, times = np.unique(runs, return_inverse=True, return_counts=True)
    twice = times[which] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : len(words) - 2 + shift] |= twice
    return int(inside.sum())


def text_counts(docs: DataFrame, text_col: str = "text", carry=None) -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` and ``base_failed``."""

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        rows = [counts_of(t) if t else (0,) * len(COUNTS) for t in utf8(columns[0])]
        return [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]

    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    out = rows_with(docs, [text_col], fields, run, carry)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    return out.withColumn("base_failed", failed)


def rate(name: str) -> Column:
    top, bottom, scale, _, _ = RATES[name]
    return F.floor(F.col(top) * scale / F.greatest(F.col(bottom), F.lit(1))).cast("bigint")


def _rounded(value: Column) -> Column:
    """Seven significant bits, the rest zero."""
    low = F.expr("greatest(length(bin(value)) - 7, 0)")
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, rate, value, rows) of the documents that pass the base rule."""
    rates = F.array(*[F.struct(F.lit(r).alias("rate"), rate(r).alias("value")) for r in RATES])
    return (
        counted.where(~F.col("base_failed"))
        .select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.inline(rates))
        .select("lang", "source", "rate", _rounded(F.col("value")).alias("value"))
        .groupBy("lang", "source", "rate", "value")
        .agg(F.count("*").alias("rows"))
    )


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    """The sketches of coarser groups: rows of equal values add up."""
    return parts.groupBy(*keys, "rate", "value").agg(F.sum("rows").alias("rows"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its rows, and a (low, high) pair per rate."""
    group = Window.partitionBy(*keys, "rate")
    upto = group.orderBy("value")
    ranked = sketch.select(
        *keys, "rate", "value",
        F.sum("rows").over(upto).alias("upto"),
        F.sum("rows").over(group).alias("all_rows"),
    )

    def quantile(percent: int) -> Column:
        rank = F.floor((F.col("all_rows") * percent + 99) / 100)
        return F.min(F.when(F.col("upto") >= rank, F.col("value")))

    points = ranked.groupBy(*keys, "rate").agg(
        F.first("all_rows").alias("rows"),
        quantile(10).alias("q10"), quantile(50).alias("q50"), quantile(90).alias("q90"),
    )
    made = []
    for name, (_, _, _, floor, both) in RATES.items():
        mine = F.col("rate") == name
        up = F.col("q50") + FENCE * F.greatest(F.col("q50") - F.col("q10"), F.lit(floor))
        down = F.col("q50") - FENCE * F.greatest(F.col("q90") - F.col("q50"), F.lit(floor))
        made.append(F.max(F.when(mine, up)).cast("bigint").alias(f"{name}_high"))
        if both:
            made.append(F.max(F.when(mine, down)).cast("bigint").alias(f"{name}_low"))
    return points.groupBy(*keys).agg(F.max("rows").alias("rows"), *made)


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The fences of each (lang, source) that has a sketch, from the finest one large enough."""
    own = _fences(sketch, ["lang", "source"]).alias("own")
    by_lang = _fences(merge(sketch, "lang"), ["lang"]).alias("by_lang")
    overall = _fences(merge(sketch.withColumn("all", F.lit(1)), "all"), ["all"]).alias("overall")
    names = [c for c in own.columns if c not in ("lang", "source", "rows")]
    joined = own.join(
        by_lang, F.col("own.lang").eqNullSafe(F.col("by_lang.lang")), "left"
    ).join(F.broadcast(overall), F.lit(True), "left")  # one row

    def pick(c: str) -> Column:
        return (
            F.when(F.col("own.rows") >= min_rows, F.col(f"own.{c}"))
            .when(F.col("by_lang.rows") >= min_rows, F.col(f"by_lang.{c}"))
            .otherwise(F.col(f"overall.{c}"))
            .alias(c)
        )

    return joined.select(
        F.col("own.lang").alias("t_lang"), F.col("own.source").alias("t_source"), *map(pick, names)
    )


def judge(
    counted: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``counted`` with ``kept``. A group all of whose rows fail the base rule has no limits."""
    good = ~F.col("base_failed")
    for name, (_, _, _, _, both) in RATES.items():
        fine = rate(name) <= F.col(f"t.{name}_high")
        good &= fine & (rate(name) >= F.col(f"t.{name}_low")) if both else fine
    return (
        counted.alias("d")
        .join(
            limits.alias("t"),
            F.col(f"d.`{lang_col}`").eqNullSafe(F.col("t.t_lang"))
            & F.col(f"d.`{source_col}`").eqNullSafe(F.col("t.t_source")),
            "left",
        )
        .select("d.*", F.coalesce(good, F.lit(False)).alias("kept"))
    )


def quality_thresholds(
    docs: DataFrame,
    min_rows: int = MIN_ROWS,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The limits learned from ``docs``, written once: a small table."""
    plain = docs.select(
        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("body")
    )
    counted = text_counts(plain, "body", carry=["lang", "source"])
    limits = thresholds(materialize(sketches(counted), "sketches"), min_rows)
    return materialize(limits, "thresholds")


def quality_filter(
    docs: DataFrame,
    min_rows: int = MIN_ROWS,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with its counts, ``base_failed`` and ``kept``; texts are not shuffled."""
    limits = quality_thresholds(docs, min_rows, lang_col, source_col, text_col)
    if "kept" in docs.columns:
        docs = docs.drop("kept")
    return judge(text_counts(docs, text_col), limits, lang_col, source_col)


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = materialize(text_counts(docs, carry=["doc_id", "lang", "source"]), "counts")
    limits = thresholds(materialize(sketches(counted), "sketches"))
    return judge(counted, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def sql(documents: str = "documents") -> str:
    """The same in SQL: exact quantiles of the rounded rates."""
    blank = r"[^\x20\x09-\x0D]"
    rates = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{r}' AS rate, "
        f"({a} * {s}) // greatest({b}, 1) AS raw FROM base WHERE NOT base_failed"
        for r, (a, b, s, _, _) in RATES.items()
    )
    floors = " ".join(f"WHEN '{r}' THEN {v[3]}" for r, v in RATES.items())
    both = ", ".join(f"'{r}'" for r, v in RATES.items() if v[4])

    def level(name: str, lang: str, source: str) -> str:
        return f"""{name} AS (
  SELECT lang, source, rate, any_value(n) AS n,
    min(value) FILTER (upto >= (n * 10 + 99) // 100) AS q10,
    min(value) FILTER (upto >= (n * 50 + 99) // 100) AS q50,
    min(value) FILTER (upto >= (n * 90 + 99) // 100) AS q90
  FROM (SELECT lang, source, rate, value,
      sum(c) OVER (PARTITION BY lang, source, rate ORDER BY value) AS upto,
      sum(c) OVER (PARTITION BY lang, source, rate) AS n
    FROM (SELECT {lang} AS lang, {source} AS source, rate, value, count(*) AS c
      FROM rounded GROUP BY ALL)) GROUP BY lang, source, rate)"""

    return rf"""
WITH words AS (
  SELECT doc_id, w, i FROM (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '{blank}+') AS w FROM {documents}))),
runs AS (
  SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
    SELECT doc_id, i, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d AS g
    FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM runs WHERE times > 1) GROUP BY doc_id),
counted AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars,
    sum(length(w) - length(regexp_replace(w, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols
  FROM words GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM {documents})
  WHERE regexp_matches(l, '{blank}') GROUP BY doc_id),
base AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed
  FROM (SELECT d.doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words,
      coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_symbols, 0)::BIGINT AS n_symbols,
      coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
      coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM {documents} d LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id)
      LEFT JOIN repeats USING (doc_id))),
rates AS ({rates}),
rounded AS (
  SELECT *, (raw >> s) << s AS value
  FROM (SELECT *, greatest(length(bin(raw)) - 7, 0)::BIGINT AS s FROM rates)),
{level("own", "lang", "source")},
{level("by_lang", "lang", "NULL")},
{level("overall", "NULL", "NULL")},
picked AS (
  SELECT own.lang, own.source, own.rate,
    CASE WHEN own.n >= {MIN_ROWS} THEN own.q10 WHEN l.n >= {MIN_ROWS} THEN l.q10 ELSE o.q10 END AS q10,
    CASE WHEN own.n >= {MIN_ROWS} THEN own.q50 WHEN l.n >= {MIN_ROWS} THEN l.q50 ELSE o.q50 END AS q50,
    CASE WHEN own.n >= {MIN_ROWS} THEN own.q90 WHEN l.n >= {MIN_ROWS} THEN l.q90 ELSE o.q90 END AS q90,
    CASE own.rate {floors} END AS floor
  FROM own JOIN by_lang l ON l.rate = own.rate AND l.lang IS NOT DISTINCT FROM own.lang
    JOIN overall o ON o.rate = own.rate),
bad AS (
  SELECT DISTINCT r.doc_id FROM rates r JOIN picked p ON p.rate = r.rate
    AND p.lang IS NOT DISTINCT FROM r.lang AND p.source IS NOT DISTINCT FROM r.source
  WHERE raw > q50 + {FENCE} * greatest(q50 - q10, floor)
    OR (r.rate IN ({both}) AND raw < q50 - {FENCE} * greatest(q90 - q50, floor)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM base
"""


OP6_SQL = sql()
