"""Batch requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprint.functions.pycode import code_status_udf
from codeprint.functions.text import extract_code

#: Ids with hyphens of their own, which the older ids' separator hides.
HYPHENATED = ["in-place", "gpt-5-mini-2025-08-07"]


def request_lines(jobs: DataFrame, system_prompt: str, max_tokens: int) -> DataFrame:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(F.col("model"), F.array(message("system", F.lit(system_prompt)), message("user", F.col("prompt"))).alias("input"), F.lit(max_tokens).alias("max_output_tokens"))
    return jobs.select(F.col("job_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body"))


def decode_custom_id(c: Column) -> Column:
    """struct<model, year, day, code_variant, style_variant, use_comp_programming>; null if year or day is no number."""
    for word in HYPHENATED:
        c = F.replace(c, F.lit(word), F.lit(word.replace("-", "_")))
    c = F.replace(c, F.lit("-"), F.lit("@"))
    for word in HYPHENATED:
        c = F.replace(c, F.lit(word.replace("-", "_")), F.lit(word))
    p = F.split(c, "@")
    n = F.size(p)
    part = lambda i: F.get(p, n - i)
    year, day = part(5).try_cast("int"), part(4).try_cast("int")
    out = F.struct(F.array_join(F.slice(p, 1, F.greatest(n - 5, F.lit(0))), "@").alias("model"), year.alias("year"), day.alias("day"), part(3).alias("code_variant"), part(2).alias("style_variant"), (part(1) == "comp").alias("use_comp_programming"))
    return F.when((n >= 6) & year.isNotNull() & day.isNotNull(), out)


def output_text(output: Column) -> Column:
    """The first text of a message; null if there is none."""
    contents = F.flatten(F.transform(F.filter(output, lambda x: x["type"] == "message"), lambda x: F.coalesce(x["content"], F.array())))
    return F.get(F.filter(contents, lambda x: x["type"] == "output_text"), F.lit(0))["text"]


def retrieve(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Answered requests with decoded job columns, code and code_status (``no_output`` where no text came).

    Lines are matched by custom_id, so a missing line never shifts the others."""
    both = requests.join(responses.select("custom_id", "response"), "custom_id")
    rows = both.select("custom_id", decode_custom_id(F.col("custom_id")).alias("job"), F.get("body.input", F.lit(1))["content"].alias("prompt"), output_text(F.col("response.body.output")).alias("text"))
    rows = rows.where("job IS NOT NULL").select("custom_id", "job.*", "prompt", extract_code(F.col("text")).alias("code"))
    return rows.withColumn("code_status", F.when(F.col("code").isNull(), "no_output").otherwise(code_status_udf("code")))


def unanswered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return requests.join(responses, "custom_id", "left_anti")
