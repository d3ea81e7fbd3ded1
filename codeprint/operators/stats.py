"""Distributions of a sample corpus, and summaries of ablation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprint.functions.text import normalise_day


def category() -> Column:
    return F.when(F.col("label") == "human", F.lit("human")).otherwise(F.col("model"))


def class_distribution(samples: DataFrame) -> DataFrame:
    return samples.groupBy(category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


def class_per_day(samples: DataFrame) -> DataFrame:
    return samples.groupBy("year", normalise_day(F.col("day")).alias("day"), category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


def competitive_distribution(samples: DataFrame) -> DataFrame:
    return samples.where("label <> 'human'").groupBy("model", "use_comp_programming").agg(F.count(F.lit(1)).alias("n"))


def dense(counts: DataFrame, categories: list[str]) -> DataFrame:
    """One column for each category, missing combinations 0.  Named categories spare a pass over the data."""
    return counts.groupBy("year", "day").pivot("category", categories).agg(F.sum("n")).na.fill(0)


def user_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("_c0").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def ablation_runs(log: DataFrame) -> DataFrame:
    """One row for each run of an ablation log; logs without runs give none."""
    return log.select("group_mode", F.explode("ablation_runs").alias("r")).select(
        "group_mode", F.coalesce("r.ablation", "r.name", "r.tfidf_set").alias("name"), F.coalesce("r.summary.accuracy_mean", "r.accuracy").alias("accuracy"), F.col("r.summary.accuracy_std").alias("accuracy_std"),
        F.coalesce("r.summary.f1_mean", "r.f1_macro").alias("f1_macro"), F.col("r.summary.f1_std").alias("f1_std"), F.coalesce("r.summary.confusion_matrix_sum", "r.confusion_matrix").alias("confusion_matrix"),
    )


def ablation_report(log: DataFrame) -> DataFrame:
    """One text ``report`` of each run of an ablation log."""
    rows = ablation_runs(log)
    form = "  Ablation: %s\n    Accuracy: %.4f ± %.4f\n    F1 Score: %.4f ± %.4f\n    Confusion Matrix Sum: %s"
    std = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("name", F.format_string(form, "name", "accuracy", std("accuracy_std"), "f1_macro", std("f1_std"), F.to_json("confusion_matrix")).alias("report"))
