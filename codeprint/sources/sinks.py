"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_samples(rows: DataFrame, path: str) -> None:
    """Append samples, in one folder for each kind of prompt where the rows tell it."""
    rows.write.mode("append").partitionBy(*[c for c in ("use_comp_programming",) if c in rows.columns]).json(path)


def write_tsv(users: DataFrame, path: str) -> None:
    users.select("user_id", "github_url").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_ablation_log(runs: DataFrame, path: str, group_mode: str, n_splits: int) -> None:
    """One JSON document; ``runs`` is one row for each configuration."""
    runs.agg(F.collect_list(F.struct("*")).alias("ablation_runs")).select(F.lit(group_mode).alias("group_mode"), F.lit(n_splits).alias("n_splits"), "ablation_runs").coalesce(1).write.mode("overwrite").json(path)


def write_report(reports: DataFrame, path: str) -> None:
    reports.select("report").write.mode("append").text(path)


def land_pages(pages: DataFrame, path: str) -> None:
    """Fetched pages as Parquet by year."""
    pages.write.mode("append").partitionBy("year").parquet(path)


def write_requests(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").json(path)


def write_batch_ids(spark: SparkSession, ids: list[tuple[str, str]], path: str) -> None:
    """Append a section of two lines for each (file id, job id); readers.batch_ids reads them."""
    sections = [(f"Batch file created with ID: {f}\nBatch job created with ID: {j}\n",) for f, j in ids]
    spark.createDataFrame(sections, "value string").coalesce(1).write.mode("append").text(path)
