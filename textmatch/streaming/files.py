"""Documents that arrive as files: extracted, matched and committed batch by batch.

Structured Streaming lists the folder and hands each file to one micro-batch. A batch is the plan
of a folder scan: files of formats that no extractor takes, and files that can't be read, stay as
rows with their reason; the others are matched. Its rows go to folders of its own, replacing what
an earlier attempt at the batch left there, and its manifest is written last. Readers take the
rows of batches with a manifest only, so a batch that died half-way isn't seen, and one that is
done again gives no second row.

    <out>/documents/batch_id=<n>     query_id, text, error
    <out>/matches/batch_id=<n>       what the matcher gives
    <out>/manifest/batch_id=<n>      files and matches of the batch
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textmatch.plans.scan import process_documents
from textmatch.sources.documents import Extractor
from textmatch.sources.tables import path_exists

DOCUMENTS = "query_id string, text string, error string, batch_id bigint"
FILES = "path string, modificationTime timestamp, length bigint, content binary"
MANIFEST = "files bigint, matches bigint, batch_id bigint"


def scan_stream(
    spark: SparkSession,
    folder: str,
    matcher: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    primary: Extractor,
    fallback: Extractor | None = None,
    name: Callable[[Column], Column] | None = None,
    max_files: int = 1000,
    available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Start a query over the files of ``folder`` and the folders below it.

    ``name`` makes the name of a document, extension included, from the path of its file; by
    default it is the path. A batch has ``max_files`` files at most.
    """
    files = (
        spark.readStream.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .schema(FILES)
        .load(folder)
    )
    path = name(F.col("path")) if name else F.col("path")
    files = files.select(path.alias("path"), "content")

    def run(batch: DataFrame, batch_id: int) -> None:
        documents, matches = process_documents(batch, matcher, primary, fallback)
        place = f"batch_id={batch_id}"
        documents.write.mode("overwrite").parquet(f"{out}/documents/{place}")
        matches.write.mode("overwrite").parquet(f"{out}/matches/{place}")
        written = spark.read.parquet(f"{out}/matches/{place}")
        counts = documents.agg(F.count(F.lit(1)).alias("files")).withColumn("matches", F.lit(written.count()))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/{place}")

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    if not path_exists(spark, f"{out}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest").distinct()


def committed(spark: SparkSession, out: str) -> list[int]:
    """The numbers of the batches that are whole."""
    return [r.batch_id for r in _manifest(spark, out).select("batch_id").collect()]


def scanned_documents(spark: SparkSession, out: str) -> DataFrame:
    """``(query_id, text, error)`` of all files of whole batches."""
    if not path_exists(spark, f"{out}/documents"):
        return spark.createDataFrame([], DOCUMENTS).drop("batch_id")
    rows = spark.read.schema(DOCUMENTS).parquet(f"{out}/documents")
    return rows.join(_manifest(spark, out).select("batch_id"), "batch_id", "left_semi").drop("batch_id")


def scanned_matches(spark: SparkSession, out: str) -> DataFrame:
    """The matches of whole batches; there is nothing to read before the first one."""
    rows = spark.read.parquet(f"{out}/matches")
    done = _manifest(spark, out).select(F.col("batch_id").cast(rows.schema["batch_id"].dataType))
    return rows.join(done, "batch_id", "left_semi").drop("batch_id")
