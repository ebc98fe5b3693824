"""Table sources: the person tables, ground truth, stored corpora, JSON envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.operators.relational import require_columns

PEOPLE = "person_id int, name string, email string, phone string, linkedin string"
ABILITIES = "person_id int, ability string"
EXPERIENCE = (
    "person_id int, title string, firm string, start_date string, end_date string, "
    "location string"
)
SKILLS = "person_id int, skill string"
# The file names of the person tables.
FILES = {
    "people": ("01_people.csv", PEOPLE),
    "abilities": ("02_abilities.csv", ABILITIES),
    "experience": ("04_experience.csv", EXPERIENCE),
    "skills": ("05_person_skills.csv", SKILLS),
}
TRUTH_COLUMNS = ["resume_id", "job_id", "relevance"]
CORPUS_COLUMNS = ["person_id", "embedding_text"]


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def require_files(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raise when a path is missing, before any job runs."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing files: {missing}")


def with_file_order(df: DataFrame, path: str) -> DataFrame:
    """Add ``seq``, the listing order of the rows of the files read from ``path``.

    File, split and position in the split; no row numbering across the table is needed. A file goes
    by its number in the listing, as its path would be most of what is shuffled and compared.
    """
    spark = df.sparkSession
    listed = spark.read.format("binaryFile").load(path).select("_metadata.file_path").distinct()
    paths = sorted(listed.toArrow()["file_path"].to_pylist())
    files = spark.createDataFrame(list(enumerate(paths)), "file int, file_path string")
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    )
    seq = F.struct("file", F.col("_split").alias("split"), F.col("_row").alias("row"))
    numbered = rows.join(F.broadcast(files), rows["_path"] == files["file_path"], "left")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], seq.alias("seq"))


def csv_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The rows of a CSV file as strings; a malformed row fails the job.

    With ``multi_line`` quoted fields may hold line breaks. A file is then read by one task,
    so large tables are better stored in several files.
    """
    return spark.read.csv(path, header=True, multiLine=multi_line, escape='"', mode="FAILFAST")


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = False
) -> DataFrame:
    """A CSV table with a header; the columns are matched by name, not by place."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    found = csv_rows(spark, path, multi_line)
    require_columns(found, [f.name for f in wanted.fields if f.name in ("person_id",)])
    return with_file_order(found, path).select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name)
            for f in wanted.fields
            if f.name in found.columns
        ],
        "seq",
    )


def read_person_tables(
    spark: SparkSession, folder: str, multi_line: bool = False
) -> dict[str, DataFrame]:
    """The four person tables of a folder, each with ``seq``."""
    require_files(spark, [f"{folder}/{name}" for name, _ in FILES.values()])
    tables = {
        key: read_csv(spark, f"{folder}/{name}", schema, multi_line)
        for key, (name, schema) in FILES.items()
    }
    tables["people"] = tables["people"].drop("seq")
    return tables


def load_ground_truth(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``(query_id, item_id, relevance[, item_title], seq)``; of a repeated pair the last
    row wins."""
    found = csv_rows(spark, path, multi_line)
    require_columns(found, TRUTH_COLUMNS)
    rows = with_file_order(found, path)
    keys = [
        F.col("resume_id").cast("string").alias("query_id"),
        F.col("job_id").cast("string").alias("item_id"),
    ]
    aggs = [F.max_by(F.col("relevance").cast("double"), "seq").alias("relevance")]
    if "job_title" in found.columns:
        aggs.append(F.max_by("job_title", "seq").alias("item_title"))
    place = F.concat_ws(
        "|",
        F.lpad(F.col("seq.file").cast("string"), 20, "0"),
        F.lpad(F.col("seq.split").cast("string"), 20, "0"),
        F.lpad(F.col("seq.row").cast("string"), 20, "0"),
    )
    return rows.groupBy(*keys).agg(*aggs, F.min(place).alias("seq"))


def load_processed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A stored corpus, Parquet or CSV by extension, with its required columns checked."""
    df = csv_rows(spark, path, multi_line) if path.endswith(".csv") else spark.read.parquet(path)
    require_columns(df, CORPUS_COLUMNS)
    return df.withColumn("person_id", F.col("person_id").cast("int"))


def read_envelope(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a JSON document ``{data: [...], metadata, created_at, version}``.

    Such a document is one value and is read by one task; it is an exchange format for
    reports. Stored tables are Parquet.
    """
    document = spark.read.schema(f"data array<struct<{schema}>>").json(path, multiLine=True)
    return document.select(F.inline("data"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records written by :func:`textmatch.sources.sinks.write_json`."""
    return spark.read.schema(schema).json(path)
