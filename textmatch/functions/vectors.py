"""Dense vector expressions over ``array<float>`` / ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmatch.functions.text import let


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )


def l2_normalize(v: Column) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    return let(
        norm(v),
        lambda n: F.transform(
            v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))
        ),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
