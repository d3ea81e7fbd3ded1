"""Readers: JSON lines, leaderboards, repository trees, logs and batch files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprint import schemas
from codeprint.operators.jobs import completed_jobs


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a JSON-lines file; a malformed line raises when read."""
    return spark.read.schema(schemas.SAMPLE).option("mode", "FAILFAST").json(path)


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mode", "FAILFAST").json(path)


def load_completed(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Keys of a model's finished jobs; bad lines are skipped, a missing file is empty."""
    try:
        rows = spark.read.schema(f"{schemas.SAMPLE}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException:
        rows = spark.createDataFrame([], f"{schemas.SAMPLE}, _bad string")
    return completed_jobs(rows.where("_bad IS NULL"), model)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def python_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the Python files below a tree; bytes that are no UTF-8 raise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def leaderboard_pages(spark: SparkSession, path: str) -> DataFrame:
    """(year, seq, html): per year the global page, then the days in order."""
    rows = read_files(spark, path).withColumn("year", F.regexp_extract("path", "/(\\d{4})/[^/]*/?[^/]*$", 1))
    day = F.coalesce(F.regexp_extract("path", "day_(\\d+)", 1).try_cast("int"), F.lit(0))
    return rows.select("year", (F.col("year").try_cast("int") * 100 + day).alias("seq"), F.col("text").alias("html"))


def missing_pages(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """Pages (year, day) that still have to be fetched."""
    return wanted.join(landed, ["year", "day"], "left_anti")


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of repository listings (arrays of objects)."""
    return spark.read.schema(schemas.REPOSITORY).option("multiLine", True).json(path)


def tsv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", header).csv(path)


def ablation_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ABLATION_LOG).option("multiLine", True).json(path)


def batch_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, job_id) of a file of sections of ``label: value`` lines."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    values = F.transform(F.filter(F.split("value", "\n"), lambda x: x.contains(":")), lambda x: F.trim(F.regexp_extract(x, ":\\s*(.*)$", 1)))
    return rows.select(F.get(values, F.lit(0)).alias("file_id"), F.get(values, F.lit(1)).alias("job_id")).where("job_id IS NOT NULL")


def batch_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BATCH_REQUEST).json(path)


def batch_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BATCH_RESPONSE).json(path)


def secret(path: str, name: str) -> str | None:
    """The value of a ``name=value`` line of a local file; None without the line or the file."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = [line.strip().removeprefix("export ").partition("=") for line in f if not line.lstrip().startswith("#")]
    except FileNotFoundError:
        return None
    return next((value.strip().strip("'\"") for key, _, value in reversed(lines) if key.strip() == name), None) or None
