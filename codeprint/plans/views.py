"""Views that put the test tables into the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLES = """
SELECT d.doc_id AS id, d.text AS code,
  CASE WHEN l.quality = 1 THEN 'human' ELSE 'machine' END AS label,
  CASE WHEN d.doc_id % 2 = 0 THEN '2021' ELSE '2024' END AS year,
  CAST(d.doc_id % 25 + 1 AS VARCHAR(2)) AS day, 'python' AS language,
  CASE WHEN l.quality = 1 THEN NULL ELSE concat('model_', d.lang) END AS model,
  CASE WHEN l.quality = 1 THEN NULL ELSE concat('cv', CAST(d.doc_id % 5 AS VARCHAR(2))) END AS code_variant,
  CASE WHEN l.quality = 1 THEN NULL ELSE concat('sv', CAST(d.doc_id % 8 AS VARCHAR(2))) END AS style_variant,
  CASE WHEN l.quality = 1 THEN NULL ELSE l.toxic = 1 END AS use_comp_programming,
  CASE WHEN l.quality = 1 THEN concat('repo_', d.lang) END AS repo,
  CASE WHEN l.quality = 1 THEN d.source END AS author
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

REPOSITORIES = """
SELECT p_partkey AS id,
  concat(replace(p_name, ' ', '-'), CASE p_size % 3 WHEN 0 THEN '-aoc' WHEN 1 THEN '' ELSE '-2021' END) AS name,
  CASE p_size % 4 WHEN 0 THEN 'Advent of Code 2024' WHEN 1 THEN NULL WHEN 2 THEN 'solutions 2019 and 2020' ELSE 'my 2021 tools' END AS description,
  CASE p_type WHEN 'ECONOMY' THEN 'Python' WHEN 'STANDARD' THEN NULL ELSE 'python' END AS language,
  CASE p_size % 5 WHEN 0 THEN array('AOC') WHEN 1 THEN array('advent-of-code','python') ELSE array('misc') END AS topics
FROM part"""

PATHS = """
SELECT o_orderkey AS id, concat('data_gathering/data/repos/user', CAST(o_custkey % 40 AS VARCHAR(9)), '/',
  CASE o_orderkey % 6 WHEN 0 THEN 'AdventOfCode2021' WHEN 1 THEN 'aoc24' WHEN 2 THEN 'aoc-2021' WHEN 3 THEN 'advent-of-code' WHEN 4 THEN 'AdventOfCode24' ELSE 'puzzles' END, '/',
  CASE o_orderkey % 4 WHEN 0 THEN '2024/' WHEN 1 THEN '' WHEN 2 THEN 'src/' ELSE concat('day', CAST(o_custkey % 30 AS VARCHAR(9)), '/') END,
  CASE o_custkey % 7 WHEN 0 THEN concat('day', CAST(o_orderkey % 30 AS VARCHAR(9)), '.py')
    WHEN 1 THEN concat('day_', CAST(o_orderkey % 30 AS VARCHAR(9)), '_a.py') WHEN 2 THEN concat(CAST(o_orderkey % 30 AS VARCHAR(9)), '.py')
    WHEN 3 THEN 'main.py' WHEN 4 THEN concat('d', CAST(o_orderkey % 30 AS VARCHAR(9)), '.py') WHEN 5 THEN 'README.md'
    ELSE concat(CAST(o_orderkey % 30 AS VARCHAR(9)), '-part2.py') END) AS path
FROM orders"""

BOARD = """
SELECT c_custkey AS seq, concat('<div class="leaderboard-entry" data-user-id="', CAST(c_custkey % 500 AS VARCHAR(9)), '"><span>',
  CAST(c_custkey AS VARCHAR(9)), ')</span>',
  CASE WHEN c_nationkey % 3 = 0 THEN concat('<a href="https://github.com/u', CAST(c_custkey AS VARCHAR(9)), '/">', c_name, '</a>') ELSE c_name END, '</div>') AS html
FROM customer"""

CODE = """
SELECT p_partkey AS id, concat('import math', chr(10), 'def f', CAST(p_partkey AS VARCHAR(9)), '(value):', chr(10),
  '    "size of ', p_brand, '"', chr(10),
  '    total = value + ', CAST(p_size AS VARCHAR(9)), '  # ', p_name, chr(10), '    return total',
  CASE p_partkey % 10 WHEN 0 THEN ' (' WHEN 1 THEN concat(chr(10), 'p = "', chr(92), 'd"') ELSE '' END, chr(10)) AS code,
  CASE p_partkey % 10 WHEN 0 THEN 'syntax' WHEN 1 THEN 'ok_not_strict' ELSE 'ok' END AS expected_status
FROM part"""

MESSY = """
SELECT doc_id AS id, concat('  ', replace(text, '. ', concat(' ', chr(9), chr(13), chr(10))), ' ', chr(10), chr(10)) AS code,
  CASE doc_id % 3 WHEN 0 THEN concat('Here:', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'done') WHEN 1 THEN concat('```', chr(10), text, '```') ELSE concat(' ', text, chr(10)) END AS answer
FROM documents"""

JOBS = """
SELECT c.year, c.day, c.model, c.code_variant, c.style_variant, c.comp AS use_comp_programming
FROM (SELECT CAST(2015 + n_nationkey % 10 AS INT) AS year, CAST(n_nationkey + 1 AS INT) AS day, 'gpt-5-mini-2025-08-07' AS model, r.cv AS code_variant, s.sv AS style_variant, n_nationkey % 2 = 0 AS comp
  FROM nation CROSS JOIN (SELECT DISTINCT p_brand AS cv FROM part) r CROSS JOIN (SELECT DISTINCT p_type AS sv FROM part) s) c"""

VIEWS = {"samples_v": SAMPLES, "repos_v": REPOSITORIES, "paths_v": PATHS, "board_v": BOARD, "code_v": CODE, "messy_v": MESSY, "jobs_v": JOBS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the tables it reads are passed in, no temporary view is left behind."""
    sql = VIEWS[name]
    names = [t for t in ("documents", "labels", "part", "orders", "customer", "nation") if f" {t}" in sql]
    for t in names:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    used = {t: table(spark, sf_dir, t) for t in names if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def cte(*names: str) -> str:
    """The views as common table expressions for the SQL side."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names).replace("array('AOC')", "['AOC']").replace("array('advent-of-code','python')", "['advent-of-code','python']").replace("array('misc')", "['misc']") + " "
