"""Ranking and clustering metrics against graded truth.

One chain of grouped sums serves every k and threshold. A query may hold any share of the
ranking: rows are grouped by (query, block of ranks), so a long list is spread over tasks
and only its block totals meet.

Inputs: ``ranking (query_id, rank, item_id)``, ranks from 1, and
``truth (query_id, item_id, relevance)``, one row per pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks per block of the running counts, and ranks per predicted cluster.
BLOCK = 8192
CLUSTER = 5
METRICS = ("ndcg", "precision", "recall", "mrr", "map", "ari", "nmi", "purity")


def relevant(threshold: float) -> str:
    """Whether a judged item counts; an unjudged one does not."""
    return f"coalesce(relevance >= {float(threshold)!r}D, false)"


def judge(ranking: DataFrame, truth: DataFrame, distinct_items: bool = False) -> DataFrame:
    """The ranking with each item's relevance, null when unjudged.

    An item listed twice counts twice, unless ``distinct_items`` keeps its best rank.
    """
    ranking = ranking.select("query_id", "rank", "item_id")
    if distinct_items:
        ranking = ranking.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    return ranking.join(
        truth.select("query_id", "item_id", "relevance"), ["query_id", "item_id"], "left"
    )


def _hits(
    judged: DataFrame, k_values: Sequence[int], thresholds: Sequence[float]
) -> DataFrame:
    """Per query: returned and relevant counts, gains, first hits, precision sums."""
    running = (
        "PARTITION BY query_id, block ORDER BY rank, item_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    )
    rows = judged.selectExpr("*", f"floor((rank - 1) / {BLOCK}) AS block").selectExpr(
        "*",
        *[
            f"sum(CAST({relevant(t)} AS bigint)) OVER ({running}) AS run{j}"
            for j, t in enumerate(thresholds)
        ],
    )
    aggs, total, before = [], [], []
    for i, k in enumerate(k_values):
        top = f"FILTER (WHERE rank <= {k})"
        aggs += [
            f"count(*) {top} AS ret{i}",
            f"sum(coalesce(relevance, 0D) / log2(rank + 1D)) {top} AS dcg{i}",
        ]
        total += [f"sum(ret{i}) AS ret{i}", f"sum(dcg{i}) AS dcg{i}"]
        for j, t in enumerate(thresholds):
            hit = f"rank <= {k} AND {relevant(t)}"
            aggs.append(f"count(*) FILTER (WHERE {hit}) AS hit{i}_{j}")
            total.append(f"sum(hit{i}_{j}) AS hit{i}_{j}")
    for j, t in enumerate(thresholds):
        hit = f"FILTER (WHERE {relevant(t)})"
        aggs += [
            f"min(rank) {hit} AS first{j}",
            f"count(*) {hit} AS n{j}",
            f"coalesce(sum(1D / rank) {hit}, 0D) AS inv{j}",
            f"coalesce(sum(run{j} / rank) {hit}, 0D) AS prec{j}",
        ]
        # The blocks before a hit add their hits to its running count.
        earlier = (
            f"coalesce(sum(n{j}) OVER (PARTITION BY query_id ORDER BY block "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        )
        before.append(f"{earlier} * inv{j} + prec{j} AS ap{j}")
        total += [f"min(first{j}) AS first{j}", f"sum(ap{j}) AS ap{j}"]
    blocks = rows.groupBy("query_id", "block").agg(*map(F.expr, aggs))
    return (
        blocks.selectExpr("*", *before).groupBy("query_id").agg(*map(F.expr, total))
    )


def _truth_stats(
    truth: DataFrame, k_values: Sequence[int], thresholds: Sequence[float]
) -> DataFrame:
    """Per query: relevant items by threshold, and the gain of the ideal ranking by k."""
    counts = truth.groupBy("query_id").agg(
        *[
            F.expr(f"count(*) FILTER (WHERE {relevant(t)}) AS rel{j}")
            for j, t in enumerate(thresholds)
        ]
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "item_id")
    ideal = (
        truth.select("query_id", "relevance", F.row_number().over(best).alias("place"))
        .filter(F.col("place") <= max(k_values))
        .groupBy("query_id")
        .agg(
            *[
                F.expr(
                    f"sum(relevance / log2(place + 1D)) FILTER (WHERE place <= {k}) AS idcg{i}"
                )
                for i, k in enumerate(k_values)
            ]
        )
    )
    return counts.join(ideal, "query_id")


def _cells(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Contingency counts of (predicted cluster, truth label) per query and threshold."""
    raw = (
        rows.filter(F.col("relevance").isNotNull())
        .withColumn("pred", F.floor((F.col("rank") - 1) / CLUSTER) + 1)
        .groupBy("query_id", "pred", "relevance")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    label = F.expr("CASE WHEN relevance >= threshold THEN CAST(relevance AS int) ELSE 0 END")
    return (
        raw.select("*", t)
        .withColumn("label", label)
        .groupBy("query_id", "threshold", "pred", "label")
        .agg(F.sum("n").alias("n"))
    )


def _agreement(judged: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Adjusted Rand index and normalised mutual information, in closed form."""
    last = judged.groupBy("query_id", "item_id").agg(
        F.max("rank").alias("rank"), F.max("relevance").alias("relevance")
    )
    keys = [F.col(c) for c in ("query_id", "threshold", "pred", "label")]
    q, t, p, l = keys
    # Counts by cell, by predicted cluster (1) and by truth label (2).
    sides = (
        _cells(last, thresholds)
        .groupingSets([[q, t, p, l], [q, t, p], [q, t, l]], *keys)
        .agg(F.sum("n").cast("double").alias("n"), F.grouping_id().alias("g"))
    )
    sums = sides.groupBy("query_id", "threshold").agg(
        F.expr("sum(n) FILTER (WHERE g = 0) AS n"),
        F.expr("sum(n * n) FILTER (WHERE g = 0) AS s"),
        F.expr("sum(n * n) FILTER (WHERE g = 2) AS a"),
        F.expr("sum(n * n) FILTER (WHERE g = 1) AS b"),
        F.expr("sum(n * ln(n)) FILTER (WHERE g = 0) AS hs"),
        F.expr("sum(n * ln(n)) FILTER (WHERE g = 2) AS ha"),
        F.expr("sum(n * ln(n)) FILTER (WHERE g = 1) AS hb"),
        F.expr("count(*) FILTER (WHERE g = 2) AS labels"),
        F.expr("count(*) FILTER (WHERE g = 1) AS preds"),
    )
    counted = sums.selectExpr(
        "query_id", "threshold", "n", "labels", "preds",
        "s - n AS tp", "a - s AS u", "b - s AS v", "n * n - a - b + s AS tn",
        "(hs - ha - hb) / n + ln(n) AS mutual",
        "ln(n) - ha / n AS h_true", "ln(n) - hb / n AS h_pred",
    )
    return counted.selectExpr(
        "query_id",
        "threshold",
        "CASE WHEN n < 2 THEN 0D WHEN u = 0 AND v = 0 THEN 1D ELSE 2 * (tp * tn - u * v) / "
        "((tp + u) * (u + tn) + (tp + v) * (v + tn)) END AS ari",
        "CASE WHEN n < 2 THEN 0D WHEN labels = 1 AND preds = 1 THEN 1D WHEN mutual <= 1e-12 "
        "THEN 0D ELSE mutual / ((h_true + h_pred) / 2) END AS nmi",
    )


def _purity(judged: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    clusters = (
        _cells(judged, thresholds)
        .groupBy("query_id", "threshold", "pred")
        .agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    )
    return clusters.groupBy("query_id", "threshold").agg(
        (F.sum("top") / F.sum("n")).alias("purity")
    )


def evaluate(
    ranking: DataFrame,
    truth: DataFrame,
    k_values: Sequence[int] = (3, 5, 10),
    thresholds: Sequence[float] = (1.0,),
    metrics: Sequence[str] = METRICS,
    queries: DataFrame | None = None,
    distinct_items: bool = False,
) -> DataFrame:
    """Metrics per query: ``(query_id, metric, k, threshold, value, valid)``.

    Queries without truth are left out. ``queries`` names evaluated queries that may have
    returned nothing; by default those in the ranking. ``valid`` tells whether the query
    counts in the divisor of the average. Only what ``metrics`` needs is computed.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    thresholds = [float(t) for t in thresholds]
    judged = judge(ranking, truth, distinct_items)
    asked = (ranking if queries is None else queries).select("query_id").distinct()
    parts = []
    if set(metrics) & {"ndcg", "precision", "recall", "mrr", "map"}:
        stats = _truth_stats(truth, k_values, thresholds)
        wide = asked.join(stats, "query_id").join(
            _hits(judged, k_values, thresholds), "query_id", "left"
        )
        rows = _list_metrics(metrics, k_values, thresholds)
        parts.append(wide.selectExpr("query_id", f"inline(array({', '.join(rows)}))"))
    clusters = [m for m in ("ari", "nmi", "purity") if m in metrics]
    if clusters:
        grades = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
        keys = ["query_id", "threshold"]
        known = truth.select("query_id").distinct()
        wide = asked.join(known, "query_id", "left_semi").select("query_id", grades)
        if "ari" in clusters or "nmi" in clusters:
            wide = wide.join(_agreement(judged, thresholds), keys, "left")
        if "purity" in clusters:
            wide = wide.join(_purity(judged, thresholds), keys, "left")
        rows = [_row(m, None, "threshold", m) for m in clusters]
        parts.append(wide.selectExpr("query_id", f"inline(array({', '.join(rows)}))"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _row(
    metric: str, k: int | None, threshold: object, value: str, valid: str = "true"
) -> str:
    """SQL for one output row."""
    return (
        f"named_struct('metric', '{metric}', 'k', CAST({'NULL' if k is None else k} AS int), "
        f"'threshold', CAST({threshold} AS double), 'value', coalesce({value}, 0D), "
        f"'valid', {valid})"
    )


def _list_metrics(
    metrics: Sequence[str], k_values: Sequence[int], thresholds: Sequence[float]
) -> list[str]:
    """The per-query rows of the metrics that read the list in order."""
    rows = []
    for i, k in enumerate(k_values):
        gain = f"CASE WHEN idcg{i} > 0 THEN dcg{i} / idcg{i} END"
        rows.append(("ndcg", k, "NULL", gain, f"idcg{i} > 0"))
        returned = f"coalesce(ret{i}, 0) > 0"
        for j, t in enumerate(thresholds):
            share = f"CASE WHEN ret{i} > 0 THEN hit{i}_{j} / ret{i} END"
            found = f"CASE WHEN rel{j} = 0 THEN 1D ELSE hit{i}_{j} / rel{j} END"
            rows.append(("precision", k, t, share, returned))
            rows.append(("recall", k, t, found))
    for j, t in enumerate(thresholds):
        rows.append(("mrr", None, t, f"1D / first{j}"))
        mean = f"CASE WHEN rel{j} = 0 THEN 1D ELSE ap{j} / rel{j} END"
        rows.append(("map", None, t, mean))
    return [_row(*r) for r in rows if r[0] in metrics]


def averages(
    metrics: DataFrame,
    k_values: Sequence[int] = (3, 5, 10),
    thresholds: Sequence[float] = (1.0,),
    names: Sequence[str] = METRICS,
) -> DataFrame:
    """``(metric, k, threshold, value, queries)``; 0 where no query counts."""
    grid = [("ndcg", k, None) for k in k_values]
    for t in thresholds:
        grid += [(m, k, float(t)) for m in ("precision", "recall") for k in k_values]
        grid += [(m, None, float(t)) for m in ("mrr", "map", "ari", "nmi", "purity")]
    grid = [g for g in grid if g[0] in names]
    empty = metrics.sparkSession.createDataFrame(
        grid, "metric string, k int, threshold double"
    ).select("*", F.lit(0.0).alias("value"), F.lit(False).alias("valid"))
    count = F.sum(F.col("valid").cast("bigint"))
    return (
        metrics.drop("query_id")
        .unionByName(empty)
        .groupBy("metric", "k", "threshold")
        .agg(
            F.coalesce(F.try_divide(F.sum("value"), count), F.lit(0.0)).alias("value"),
            count.alias("queries"),
        )
    )


def _label() -> Column:
    return F.when(
        F.col("k").isNotNull(), F.concat(F.col("metric"), F.lit("@"), F.col("k"))
    ).otherwise(F.col("metric"))


def evaluation_report(average: DataFrame) -> DataFrame:
    """The averages as text with four decimals, one line per metric."""
    return average.select(
        _label().alias("name"), F.format_string("%.4f", "value").alias("average"), "queries"
    )


def metric_series(average: DataFrame) -> DataFrame:
    """The curves by k: ``(k, ndcg, precision, recall)``."""
    return (
        average.filter(F.col("k").isNotNull())
        .groupBy("k")
        .pivot("metric", ["ndcg", "precision", "recall"])
        .agg(F.first("value"))
    )


def metric_bars(average: DataFrame) -> DataFrame:
    """The bars of the metrics without a k: ``(metric, value)``."""
    return average.filter(F.col("k").isNull()).select("metric", "value")


def threshold_scores(average: DataFrame, k_values: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """Per threshold: precision, recall and F1 at the middle k."""
    k = k_values[len(k_values) // 2]
    p, r = F.col("precision"), F.col("recall")
    return (
        average.filter((F.col("k") == k) & F.col("metric").isin("precision", "recall"))
        .groupBy("threshold")
        .pivot("metric", ["precision", "recall"])
        .agg(F.first("value"))
        .withColumn("f1", F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(0.0))
    )


def best_threshold(
    average: DataFrame, k_values: Sequence[int] = (3, 5, 10), default: float = 1.0
) -> DataFrame:
    """One row ``(threshold, f1, precision, recall)``: the lowest threshold of best F1,
    the default threshold when every F1 is 0."""
    useless = F.col("f1") <= 0
    return (
        threshold_scores(average, k_values)
        .orderBy(
            F.desc(F.floor(F.col("f1") * 1e12)),
            F.when(useless & (F.col("threshold") == default), 0).otherwise(1),
            "threshold",
        )
        .limit(1)
        .select(
            F.when(useless, F.lit(default)).otherwise(F.col("threshold")).alias("threshold"),
            "f1",
            "precision",
            "recall",
        )
    )
