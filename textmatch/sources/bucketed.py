"""Tables stored by key: a join by that key reads them in place.

The rows of a table are dealt to a fixed number of buckets by the hash of the key when it is
written. A join with it on the key shuffles the other side only, to the buckets; the table itself,
texts and all, is not exchanged. How it is bucketed is kept beside it, so any session can open it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from textmatch.sources.tables import require_files

BUCKETS = 64


def write_by_key(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` to ``path``, a file per bucket, sorted by key, and open it."""
    spark = df.sparkSession
    name = _fresh_name()
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).mode("overwrite")
    writer.option("path", f"{path}/rows").saveAsTable(name)
    kept = json.dumps({"schema": df.schema.jsonValue(), "key": key, "buckets": buckets})
    # Written last: a table without it isn't whole.
    spark.createDataFrame([(kept,)], "layout string").coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    return spark.table(name)


def open_by_key(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, with its buckets known to the planner."""
    require_files(spark, [f"{path}/layout/_SUCCESS"])
    kept = json.loads(spark.read.schema("layout string").json(f"{path}/layout").first().layout)
    schema = T.StructType.fromJson(kept["schema"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    name = _fresh_name()
    spark.sql(
        f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (`{kept['key']}`) "
        f"SORTED BY (`{kept['key']}`) INTO {kept['buckets']} BUCKETS LOCATION '{path}/rows'"
    )
    return spark.table(name)


def _fresh_name() -> str:
    return f"by_key_{uuid.uuid4().hex}"
