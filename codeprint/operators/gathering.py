"""Gathering human samples: leaderboards, their users' repositories, clones, solutions."""

from __future__ import annotations

import json
import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprint import schemas
from codeprint.functions.pycode import code_status_udf
from codeprint.operators import repositories
from codeprint.sources import readers, sinks
from codeprint.sources.web import PagesDataSource

#: Repositories on one page of a listing, and the seconds that a clone may take.
PAGE_SIZE, CLONE_SECONDS = 100, 60
#: (user, page) to a status and the objects of that page.
Fetch = Callable[[str, int], tuple[int, list[dict]]]
#: (url, folder) to whether it has been cloned.
Clone = Callable[[str, str], bool]


def wanted_pages(spark: SparkSession, years: list[str], days: list[int], base_url: str) -> DataFrame:
    """(year, day, url): of each year the overall leaderboard (day 0) and that of each day."""
    rows = [(y, d, f"{base_url}/{y}/leaderboard" + (f"/day/{d}" if d else "")) for y in years for d in (0, *days)]
    return spark.createDataFrame(rows, "year string, day int, url string")


def fetch_pages(pages: DataFrame, **options: str) -> DataFrame:
    """(year, day, html) of the pages that could be fetched; the others are left out, to be asked for again.

    ``pages`` is a plan over years and days.  One partition fetches one page after the other, and waits between them."""
    spark = pages.sparkSession
    spark.dataSource.register(PagesDataSource)
    plan = pages.collect()  # years x days rows
    got = spark.read.format("codeprint_pages").options(urls=json.dumps([r["url"] for r in plan]), **options).load()
    return pages.join(got.where("status = 200"), "url").select("year", "day", F.col("body").alias("html"))


def scrape(spark: SparkSession, years: list[str], days: list[int], base_url: str, path: str, **options: str) -> None:
    """Land the pages of ``years`` and ``days`` below ``path`` that are not there yet."""
    wanted = wanted_pages(spark, years, days, base_url)
    try:
        landed = spark.read.parquet(path).select(F.col("year").cast("string").alias("year"), "day")
    except readers.AnalysisException:
        landed = spark.createDataFrame([], "year string, day int")
    sinks.land_pages(fetch_pages(readers.missing_pages(wanted, landed), **options), path)


def top_users(pages: DataFrame) -> DataFrame:
    """(user_id, github_url) of all landed pages (year, day, html): the last url of each user, in the order of year and day."""
    seq = F.col("year").cast("int") * 100 + F.col("day")
    return repositories.latest_users(repositories.leaderboard_entries(pages.select(seq.alias("seq"), "html")))


def listing(token: str | None = None, api: str = "https://api.github.com") -> Fetch:
    """A Fetch that asks a repository host."""

    def fetch(user: str, page: int) -> tuple[int, list[dict]]:
        request = urllib.request.Request(f"{api}/users/{user}/repos?per_page={PAGE_SIZE}&page={page}", headers={"Authorization": f"token {token}"} if token else {})
        with urllib.request.urlopen(request, timeout=10) as got:  # noqa: S310
            return got.status, json.loads(got.read())

    return fetch


def possible_repositories(users: DataFrame, target_years: list[str], fetch: Fetch, threshold: float = 3.0, interval: float = 0.0) -> DataFrame:
    """(full_name, clone_url) of the users' repositories that reach the threshold.

    Pages are asked for one by one until one is empty; a user whose listing fails has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for user in batch.column(0).to_pylist():
                found, page = [], 1
                try:
                    while True:
                        status, rows = fetch(user, page)
                        if status != 200:
                            found = []
                        if status != 200 or not rows:
                            break
                        found += rows
                        page += 1
                        time.sleep(interval)
                except (OSError, ValueError):
                    found = []
                if found:
                    text = lambda k: pa.array([r.get(k) for r in found], pa.string())  # noqa: B023, E731
                    yield pa.RecordBatch.from_pydict({k: text(k) for k in ("name", "full_name", "ssh_url", "clone_url", "language", "description")} | {"topics": pa.array([r.get("topics") or [] for r in found], pa.list_(pa.string()))})

    listed = users.select(repositories.user_of_url(F.col("github_url")).alias("user")).distinct().mapInArrow(run, schemas.REPOSITORY)
    return repositories.filter_repositories(listed, target_years, threshold).select("full_name", "clone_url")


def git_clone(url: str, folder: str) -> bool:
    """A shallow clone; a folder that exists counts as done."""
    if Path(folder).exists():
        return True
    Path(folder).parent.mkdir(parents=True, exist_ok=True)
    try:
        return subprocess.run(["git", "clone", "--depth", "1", url, folder], capture_output=True, timeout=CLONE_SECONDS, check=False).returncode == 0
    except subprocess.TimeoutExpired:
        return False


def clone_repositories(repos: DataFrame, folder: str, clone: Clone = git_clone) -> DataFrame:
    """(full_name, cloned) of each repository, cloned below ``folder``/repos, which all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clone(url, f"{folder}/repos/{name}") for name, url in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.bool_())], ["full_name", "cloned"])

    return repos.select("full_name", "clone_url").distinct().mapInArrow(run, "full_name string, cloned boolean")


def samples_of_tree(spark: SparkSession, folder: str, target_years: list[str]) -> DataFrame:
    """Samples of the solutions in the clones below ``folder``/repos."""
    return repositories.human_samples(repositories.solution_files(readers.python_files(spark, f"{folder}/repos"), target_years))


def valid_samples(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples whose code is valid, how many of the others have each status)."""
    judged = samples.withColumn("code_status", code_status_udf("code"))
    return judged.where("code_status = 'ok'").drop("code_status"), invalid_counts(judged)


def invalid_counts(judged: DataFrame, status: str = "code_status") -> DataFrame:
    """(status, n) of the rows whose status is not ok."""
    return judged.where(F.col(status) != "ok").groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def gather(spark: SparkSession, years: list[str], days: list[int], base_url: str, folder: str, fetch: Fetch, clone: Clone = git_clone, **options: str) -> DataFrame:
    """The whole way from leaderboards to valid samples, each step's result below ``folder``: pages, users, clones, samples."""
    scrape(spark, years, days, base_url, f"{folder}/pages", **options)
    users = top_users(spark.read.parquet(f"{folder}/pages"))
    sinks.write_tsv(users, f"{folder}/top_users")
    users = readers.tsv(spark, f"{folder}/top_users", header=True)
    clone_repositories(possible_repositories(users, years, fetch), folder, clone).write.mode("overwrite").json(f"{folder}/cloned")
    valid, _ = valid_samples(samples_of_tree(spark, folder, years))
    sinks.write_jsonl(valid, f"{folder}/extracted_solutions")
    return readers.load_samples(spark, f"{folder}/extracted_solutions")
