"""Generation jobs: problems, variants, prompts, resumption, batches and retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprint.functions.text import build_prompt, job_id, order_key
from codeprint.operators.ranks import bucketed, offsets
from codeprint.scratch import materialize

MAX_PAIRS = 25
KEY = ["model", "year", "day", "code_variant", "style_variant", "use_comp_programming"]

#: The instructions that are crossed, for each kind of prompt.
CODE_VARIANTS = {
    "normal": ["Write a highly optimized solution focusing on performance.", "Use a functional programming style where possible.", "Avoid using advanced libraries; rely on basic Python constructs.", "Use concise code, minimizing line count.", "Write readable code."],
    "comp": ["Write a highly optimized solution focusing on performance.", "Use a functional programming style where possible.", "Avoid using advanced libraries; rely on basic Python constructs.", "Use concise code, minimizing line count.", "Write code in the style of an Advent of Code leaderboard submission."],
}
STYLE_VARIANTS = {
    "normal": ["Prefer short variable names.", "Prefer descriptive variable names.", "Use helper functions.", "Avoid helper functions.", "Favor list comprehensions.", "Avoid comprehensions.", "Use recursion where reasonable.", "Prefer iterative solutions."],
    "comp": ["Prefer short variable names.", "Prefer descriptive variable names.", "Use helper functions.", "Avoid helper functions.", "Favor list comprehensions.", "Prefer iterative solutions.", "Use compact control flow.", "Minimize vertical whitespace.", "Favor in-place mutation where practical.", "Use standard library utilities aggressively."],
}


def variant_table(spark, kind: str) -> DataFrame:  # noqa: ANN001
    """(code_variant, style_variant): every pair of a kind's instructions."""
    return spark.createDataFrame([(c, s) for c in CODE_VARIANTS[kind] for s in STYLE_VARIANTS[kind]], "code_variant string, style_variant string")


def assemble_problems(days: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(year, day, problem): the parts joined by an empty line; days without any text are left out."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    both = days.join(first.select("year", "day", F.col("text").alias("_1")), ["year", "day"], "left").join(second.select("year", "day", F.col("text").alias("_2")), ["year", "day"], "left")
    return both.select("year", "day", F.concat_ws("\n\n", blank("_1"), blank("_2")).alias("problem")).where("problem <> ''")


def variant_pairs(problems: DataFrame, pairs: DataFrame, seed: int, most: int = MAX_PAIRS) -> DataFrame:
    """Each problem with its first ``most`` pairs of the seeded order.  ``pairs`` is a small fixed table."""
    every = problems.crossJoin(F.broadcast(pairs))
    order = Window.partitionBy("year", "day").orderBy(order_key(seed, "year", "day", "code_variant", "style_variant"))
    return every.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def build_jobs(problems: DataFrame, pairs: DataFrame, model: str, comp: bool, seed: int, completed: DataFrame | None = None, sample: int | None = None) -> DataFrame:
    """Jobs with prompt and job_id, without completed ones; at most ``sample`` in the seeded order."""
    jobs = variant_pairs(problems, pairs, seed).withColumns({"model": F.lit(model), "use_comp_programming": F.lit(comp)})
    jobs = jobs.withColumn("prompt", build_prompt(F.col("problem"), F.col("code_variant"), F.col("style_variant"))).withColumn("job_id", job_id()).drop("problem")
    if completed is not None:
        jobs = pending(jobs, completed)
    return jobs.orderBy(order_key(seed, "job_id")).limit(sample) if sample else jobs


def pending(jobs: DataFrame, completed: DataFrame) -> DataFrame:
    """Jobs whose key columns no completed sample has."""
    return jobs.join(completed.select(*KEY).distinct(), KEY, "left_anti")


def completed_jobs(samples: DataFrame, model: str) -> DataFrame:
    """Distinct keys of a model's usable samples."""
    have = [F.col(c).isNotNull() for c in ("model", "year", "day", "code_variant", "style_variant")]
    ok = have[0]
    for h in have[1:]:
        ok = ok & h
    return samples.where(ok & (F.col("model") == model)).select(*KEY).distinct()


def create_samples(generated: DataFrame) -> DataFrame:
    """Jobs with ``code`` as machine samples: year and day are text."""
    return generated.select("model", "prompt", "code_variant", "style_variant", "use_comp_programming", "code", F.lit("machine").alias("label"), F.col("year").cast("string").alias("year"), F.col("day").cast("string").alias("day"), F.lit("python").alias("language"))


def length_batches(rows: DataFrame, length: str, key: str, size: int) -> DataFrame:
    """``rows`` with ``batch``: rows in order of length, then key, ``size`` to a batch.

    Rows are counted by length and bucket of the key and ranked only inside these, so a length that
    many rows share is still spread."""
    split = bucketed(rows, key).withColumn("_len", F.coalesce(length, F.lit(-1)))  # null lengths come first
    counts = split.groupBy("_len", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    near = F.sum("_n").over(Window.partitionBy("_len").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    far = offsets(counts.groupBy("_len").agg(F.sum("_n").alias("_n")), "_n", ["_len"], "_far").select("_len", "_far")
    starts = counts.withColumn("_near", F.coalesce(near, F.lit(0))).join(far, "_len").select("_len", "_bucket", (F.col("_near") + F.col("_far")).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_len", "_bucket").orderBy(key)) - 1
    return split.join(starts, ["_len", "_bucket"]).withColumn("batch", F.floor(rank / size).cast("long")).drop("_len", "_bucket", "_before")


def grid(spark, years: list[int], last_day: int = 25, last_days: dict[int, int] | None = None) -> DataFrame:  # noqa: ANN001
    """(year, day): every day of every year; ``last_days`` names years that end on another day."""
    ends = {y: (last_days or {}).get(y, last_day) for y in years}
    return spark.createDataFrame([(y, ends[y]) for y in years], "year int, _n int").select("year", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("day"))


def run_with_retries(jobs: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(valid, failed) after generating the open jobs up to ``retries`` times.

    ``attempt`` gives job_id, code and code_status; only jobs that failed are tried again.  Each
    attempt is written before it is judged, so a generator runs once for each job and attempt."""
    valid, left = None, jobs
    for i in range(retries):
        done = materialize(attempt(left, i), "attempt").where("code_status = 'ok'")
        valid = done if valid is None else valid.unionByName(done)
        left = left.join(done.select("job_id"), "job_id", "left_anti")
        if left.isEmpty():
            break
    return valid, left
