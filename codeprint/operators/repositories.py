"""Repositories, leaderboards and solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprint.functions import paths
from codeprint.functions.text import clean_code

YEARS = range(2015, 2025)
#: Fixed values.
TOPICS, KEYWORDS = ["advent-of-code", "aoc"], ["advent of code", "aoc", "adventofcode"]


def repository_score(target_years: list[str]) -> Column:
    """3 for a topic, 1.5 for a keyword, 2 for each target year named; less 0.3 for one other year, 1 for more."""
    if unknown := [y for y in target_years if int(y) not in YEARS]:
        raise KeyError(unknown[0])
    text = F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    named = lambda y: text.rlike(f"(?U)\\b{y}\\b").cast("int")
    total = lambda years: sum((named(y) for y in years), F.lit(0))
    other = total([y for y in YEARS if str(y) not in target_years])
    topic = F.arrays_overlap(F.transform(F.coalesce("topics", F.array().cast("array<string>")), F.lower), F.array(*map(F.lit, TOPICS)))
    keyword = F.lit(False)
    for k in KEYWORDS:
        keyword = keyword | text.contains(k)
    return F.when(topic, 3.0).otherwise(0.0) + F.when(keyword, 1.5).otherwise(0.0) + 2.0 * total(target_years) - F.when(other == 1, 0.3).when(other > 1, 1.0).otherwise(0.0)


def filter_repositories(repos: DataFrame, target_years: list[str], threshold: float = 3.0) -> DataFrame:
    """Python repositories with their score, where it reaches the threshold."""
    return repos.where(F.lower("language") == "python").withColumn("score", repository_score(target_years)).where(F.col("score") >= threshold)


ENTRY = '(?is)<div[^>]*class="[^"]*leaderboard-entry[^"]*".*?(?=<div[^>]*class="[^"]*leaderboard-entry|\\z)'


def leaderboard_entries(pages: DataFrame, html: str = "html", order: str = "seq") -> DataFrame:
    """(user_id, github_url, seq, place): entries with a link, in the order of the page; a missing id reads ``None``."""
    entries = pages.select(F.col(order).alias("seq"), F.posexplode(F.regexp_extract_all(html, F.lit(ENTRY), F.lit(0))).alias("place", "entry"))
    url, user = F.regexp_extract("entry", '(?i)<a[^>]*href="([^"]*github\\.com[^"]*)"', 1), F.regexp_extract("entry", 'data-user-id="([^"]*)"', 1)
    return entries.select(F.when(F.col("entry").rlike('^<div[^>]*data-user-id="'), user).otherwise("None").alias("user_id"), F.regexp_replace(url, "/+$", "").alias("github_url"), "seq", "place").where("github_url <> ''")


def latest_users(entries: DataFrame) -> DataFrame:
    """The last url of each user."""
    return entries.groupBy("user_id").agg(F.max_by("github_url", F.struct("seq", "place")).alias("github_url"))


def user_of_url(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url), "/"), -1)


def solution_files(files: DataFrame, years: list[str], path: str = "path", max_depth: int = 4) -> DataFrame:
    """Files of a repository's first levels that a day names and a target year covers."""
    p = F.col(path)
    depth = F.size(paths.below_repos(p)) - 2
    return files.where((depth >= 1) & (depth <= max_depth) & (paths.is_day_file(p) | (paths.is_python(p) & paths.is_day_folder(p))) & paths.is_valid_solution(p, years))


def human_samples(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Samples of files whose code is not blank and whose year and day can be told."""
    p, below = F.col(path), paths.below_repos(F.col(path))
    rows = files.select(clean_code(F.col(text)).alias("code"), F.lit("human").alias("label"), paths.infer_year(p).alias("year"), paths.infer_day(p).alias("day"), F.lit("python").alias("language"), F.get(below, F.lit(1)).alias("repo"), F.get(below, F.lit(0)).alias("author"), p.alias("path"))
    return rows.where("code <> '' AND year IS NOT NULL AND day IS NOT NULL")


def unique_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths below user and repository."""
    below = paths.below_repos(F.col(path))
    return files.where(paths.is_python(F.col(path)) & (F.size(below) >= 3)).select(F.array_join(F.slice(below, F.lit(3), F.size(below)), "/").alias("file")).distinct()
