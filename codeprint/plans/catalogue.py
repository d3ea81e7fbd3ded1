"""The queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprint.functions import paths, pycode, text
from codeprint.operators import batch_api, features, gathering, jobs, learning, metrics, repositories, scoring, splits, stats, tfidf
from codeprint.plans.views import cte, table, view
from codeprint.streaming.incremental import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SAMPLES = cte("samples_v")
CATEGORY = "CASE WHEN label = 'human' THEN 'human' ELSE model END"


# ---------------------------------------------------------------- distributions
@query(f"{SAMPLES} SELECT {CATEGORY} AS category, count(*) AS n FROM samples_v GROUP BY 1")
def class_distribution(spark, sf):
    return stats.class_distribution(view(spark, sf, "samples_v"))


@query(f"{SAMPLES} SELECT year, {CATEGORY} AS category, lpad(day, 2, '0') AS day, count(*) AS n FROM samples_v GROUP BY ALL")
def year_distribution(spark, sf):
    return stats.class_per_day(view(spark, sf, "samples_v")).select("year", "category", "day", "n")


@query(f"{SAMPLES} SELECT year, lpad(day, 2, '0') AS day, {CATEGORY} AS category, count(*) AS n FROM samples_v GROUP BY ALL")
def class_per_day(spark, sf):
    return stats.class_per_day(view(spark, sf, "samples_v"))


@query(f"{SAMPLES} SELECT year, lpad(day, 2, '0') AS day, {', '.join(f'''count(CASE WHEN {CATEGORY} = '{c}' THEN 1 END) AS {c}''' for c in ('human', 'model_de', 'model_en', 'model_es', 'model_fr'))} FROM samples_v GROUP BY ALL")
def class_per_day_dense(spark, sf):
    return stats.dense(stats.class_per_day(view(spark, sf, "samples_v")), ["human", "model_de", "model_en", "model_es", "model_fr"])


@query(f"{SAMPLES} SELECT model, use_comp_programming, count(*) AS n FROM samples_v WHERE label <> 'human' GROUP BY ALL")
def comp_distribution(spark, sf):
    return stats.competitive_distribution(view(spark, sf, "samples_v"))


@query("SELECT user_id::VARCHAR AS key, count(*) AS n FROM events GROUP BY 1")
def user_distribution(spark, sf):
    return stats.user_distribution(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("_c0")))


# ---------------------------------------------------------------- code and path columns
WS = r"[\s\x1c-\x1f\x0b\x0c]"


@query(f"{cte('messy_v')} SELECT id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(code, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '{WS}+$', '')), chr(10)), '^{WS}+', ''), '{WS}+$', '') AS code FROM messy_v")
def clean_code(spark, sf):
    return view(spark, sf, "messy_v").select("id", text.clean_code(F.col("code")).alias("code"))


@query(f"{cte('messy_v')} SELECT id, regexp_replace(regexp_replace(CASE WHEN regexp_matches(answer, '(?is)```(?:python|py)\\s*(.*?)```') THEN regexp_extract(answer, '(?is)```(?:python|py)\\s*(.*?)```', 1) ELSE answer END, '^{WS}+', ''), '{WS}+$', '') AS code FROM messy_v")
def extract_code(spark, sf):
    return view(spark, sf, "messy_v").select("id", text.extract_code(F.col("answer")).alias("code"))


_TEXT = "lower(concat(coalesce(name, ''), ' ', coalesce(description, '')))"
_OTHER = " + ".join(f"regexp_matches({_TEXT}, '\\b{y}\\b')::INT" for y in range(2015, 2025) if y not in (2021, 2024))


@query(f"""{cte('repos_v')}, s AS (SELECT id, name, language, topics, regexp_matches({_TEXT}, '\\b2021\\b')::INT + regexp_matches({_TEXT}, '\\b2024\\b')::INT AS hits, {_OTHER} AS other,
  contains({_TEXT}, 'advent of code') OR contains({_TEXT}, 'aoc') OR contains({_TEXT}, 'adventofcode') AS word FROM repos_v WHERE lower(language) = 'python'),
  t AS (SELECT id, name, CASE WHEN list_has_any(list_transform(topics, lambda x: lower(x)), ['advent-of-code', 'aoc']) THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN word THEN 1.5::DOUBLE ELSE 0 END + 2.0::DOUBLE * hits
    - CASE WHEN other = 1 THEN 0.3::DOUBLE WHEN other > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM s) SELECT * FROM t WHERE score >= 3.0""")
def repo_filter_score(spark, sf):
    return repositories.filter_repositories(view(spark, sf, "repos_v"), ["2021", "2024"]).select("id", "name", "score")


_Y = "(?i)(?:20\\d{2}|aoc[\\s_-]?\\d{2}|adventofcode\\d{2,4})"
_YEAR = f"regexp_extract(list_filter(list_transform(string_split(path, '/'), lambda p: regexp_extract(p, '{_Y}')), lambda m: m <> '')[1], '\\d{{2,4}}')"
_YEAR = f"CASE WHEN length({_YEAR}) = 2 THEN '20' || {_YEAR} ELSE {_YEAR} END"
_NAME, _PARENT = "string_split(path, '/')[-1]", "coalesce(string_split(path, '/')[-2], '')"
_STEM = "regexp_replace({}, '^(.+)\\.[^.]+$', '\\1')"
_IN = "CASE WHEN try_cast({0} AS INT) BETWEEN 1 AND 25 THEN lpad(try_cast({0} AS INT)::VARCHAR, 2, '0') END"
_D1 = "list_filter(list_transform(list_reverse(string_split(path, '/')), lambda p: " + _IN.format("regexp_extract(p, '(?i)\\b(?:day|d)[\\s_-]?(\\d{1,2})\\b', 1)") + "), lambda d: d IS NOT NULL)[1]"
_DAY = f"coalesce({_D1}, {_IN.format(f'''regexp_extract({_STEM.format(_NAME)}, '^(\\d{{1,2}})(?:\\D|$)', 1)''')}, {_IN.format(f'''regexp_extract({_STEM.format(_NAME)}, '(?i)^day[_-]?(\\d{{1,2}})(?:[_-][ab])?$', 1)''')}, {_IN.format(f'''regexp_extract({_STEM.format(_PARENT)}, '^(\\d{{1,2}})(?:\\D|$)', 1)''')})"
_DN = "(?i)^(day[\\s_-]?\\d{1,2}|d\\d{1,2}|\\d{1,2})(?:[\\s_-].*)?$"


@query(f"{cte('paths_v')} SELECT id, {_YEAR} AS year, coalesce(ends_with(path, '.py') AND {_YEAR} IN ('2021', '2024'), false) AS valid FROM paths_v")
def detect_year(spark, sf):
    p = F.col("path")
    return view(spark, sf, "paths_v").select("id", paths.infer_year(p).alias("year"), paths.is_valid_solution(p, ["2021", "2024"]).alias("valid"))


@query(f"{cte('paths_v')} SELECT id, {_YEAR} AS year, {_DAY} AS day FROM paths_v")
def infer_year_day(spark, sf):
    return view(spark, sf, "paths_v").select("id", paths.infer_year(F.col("path")).alias("year"), paths.infer_day(F.col("path")).alias("day"))


@query(f"{cte('paths_v')} SELECT id, ends_with({_NAME}, '.py') AND regexp_matches({_STEM.format(_NAME)}, '{_DN}') AS day_file, regexp_matches({_PARENT}, '{_DN}') AS day_folder FROM paths_v")
def day_file_filter(spark, sf):
    p = F.col("path")
    return view(spark, sf, "paths_v").select("id", paths.is_day_file(p).alias("day_file"), paths.is_day_folder(p).alias("day_folder"))


@query(f"{cte('paths_v')} SELECT DISTINCT array_to_string(string_split(path, '/')[6:], '/') AS file FROM paths_v WHERE ends_with(path, '.py') AND len(string_split(path, '/')) >= 6")
def unique_repo_files(spark, sf):
    return repositories.unique_files(view(spark, sf, "paths_v"))


@query(f"""{cte('paths_v')}, c AS (SELECT id, path, {_YEAR} AS year, {_DAY} AS day FROM paths_v WHERE ends_with(path, '.py') AND (regexp_matches({_STEM.format(_NAME)}, '{_DN}') OR regexp_matches({_PARENT}, '{_DN}')))
  SELECT 'x = ' || id::VARCHAR || chr(10) || 'y = x' AS code, 'human' AS label, year, day, 'python' AS language, string_split(path, '/')[5] AS repo, string_split(path, '/')[4] AS author, path FROM c WHERE year IN ('2021', '2024') AND day IS NOT NULL""")
def human_samples(spark, sf):
    files = view(spark, sf, "paths_v").withColumn("text", F.concat(F.lit("\n x = "), F.col("id").cast("string"), F.lit(" \t\r\ny = x\r\n\r\n")))
    return repositories.human_samples(repositories.solution_files(files, ["2021", "2024"]))


@query("""WITH v AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Day ' || (o_custkey % 30)::VARCHAR WHEN 1 THEN ' d' || (o_custkey % 30)::VARCHAR WHEN 2 THEN (o_custkey % 300)::VARCHAR ELSE 'day' || (o_custkey % 30)::VARCHAR END AS d, CASE o_orderkey % 2 WHEN 0 THEN ' 21 ' ELSE '2024' END AS y FROM orders),
  b AS (SELECT id, regexp_replace(lower(trim(d)), '^(day|d)', '') AS d, trim(y) AS y FROM v) SELECT id, CASE WHEN length(d) < 2 THEN lpad(d, 2, '0') ELSE d END AS day, CASE WHEN length(y) = 2 THEN '20' || y ELSE y END AS year FROM b""")
def normalise_day_year(spark, sf):
    n = F.col("o_custkey") % 30
    d = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Day "), n.cast("string"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" d"), n.cast("string"))).when(F.col("o_orderkey") % 4 == 2, (F.col("o_custkey") % 300).cast("string")).otherwise(F.concat(F.lit("day"), n.cast("string")))
    y = F.when(F.col("o_orderkey") % 2 == 0, " 21 ").otherwise("2024")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.normalise_day(d).alias("day"), text.normalise_year(y).alias("year"))


_MACHINE = "concat_ws('_', 'llm', coalesce(model, '{}'), coalesce(code_variant, ''), coalesce(style_variant, ''))"
_GROUPS = {"problem": "concat_ws('_', year, day)", "author_like": f"CASE WHEN repo IS NOT NULL THEN concat_ws('_', 'human', coalesce(author, '')) ELSE {_MACHINE.format('')} END"}
_GROUPS["strict"] = f"concat_ws('_', year, day, CASE WHEN repo IS NOT NULL THEN concat_ws('_', 'human', coalesce(author, '')) ELSE {_MACHINE.format('unknown')} END)"


def _group_queries() -> None:
    for mode, sql in _GROUPS.items():
        name = "group_id_" + mode.removesuffix("_like")
        QUERIES[name] = lambda spark, sf, mode=mode: view(spark, sf, "samples_v").select("id", text.group_id(mode).alias("group_id"), text.y_llm(F.col("repo")).alias("y_llm"), text.y_human(F.col("label")).alias("y_human"))
        ORACLES[name] = f"{SAMPLES} SELECT id, {sql} AS group_id, (repo IS NULL)::INT AS y_llm, (label = 'human')::INT AS y_human FROM samples_v"


_group_queries()

# ---------------------------------------------------------------- jobs and batches
_JOB_ID = "concat_ws('@', model, year::VARCHAR, day::VARCHAR, code_variant, style_variant, CASE WHEN use_comp_programming THEN 'comp' ELSE 'normal' END)"


@query(f"{cte('jobs_v')} SELECT *, {_JOB_ID} AS job_id FROM jobs_v")
def job_grid(spark, sf):
    return view(spark, sf, "jobs_v").withColumn("job_id", text.job_id())


@query("SELECT y::INT AS year, d::INT AS day FROM range(2015, 2025) a(y), range(1, 26) b(d)")
def year_day_grid(spark, sf):
    return jobs.grid(spark, list(range(2015, 2025)))


_NATION = "SELECT (2015 + n_nationkey % 10)::INT AS year, (n_nationkey + 1)::INT AS day, n_name AS problem FROM nation"
_PAIRS = "SELECT DISTINCT p_brand AS code_variant, p_type AS style_variant FROM part"


def _problems(spark, sf):
    n = table(spark, sf, "nation").select((2015 + F.col("n_nationkey") % 10).cast("int").alias("year"), (F.col("n_nationkey") + 1).cast("int").alias("day"), F.col("n_name").alias("problem"))
    return n, table(spark, sf, "part").select(F.col("p_brand").alias("code_variant"), F.col("p_type").alias("style_variant")).distinct()


_TOP25 = f"SELECT *, row_number() OVER (PARTITION BY year, day ORDER BY md5(concat_ws(':', '7', year::VARCHAR, day::VARCHAR, code_variant, style_variant))) AS r FROM ({_NATION}) CROSS JOIN ({_PAIRS})"


@query(f"SELECT year, day, problem, code_variant, style_variant FROM ({_TOP25}) WHERE r <= 25")
def job_top25(spark, sf):
    return jobs.variant_pairs(*_problems(spark, sf), seed=7)


@query(f"""WITH j AS (SELECT year, day, problem, 'm' AS model, code_variant, style_variant, false AS use_comp_programming FROM ({_TOP25}) WHERE r <= 25)
  SELECT year, day, code_variant, style_variant, model, use_comp_programming, md5('You are solving a programming problem.

    OUTPUT FORMAT:
    - Output ONLY Python code
    - No markdown
    - No explanations

    BEGIN PROBLEM
    ' || problem || '
    END PROBLEM

    BEGIN INSTRUCTIONS
    ' || code_variant || '
    ' || style_variant || '
    END INSTRUCTIONS

    Now write the solution.') AS prompt_md5, {_JOB_ID} AS job_id FROM j WHERE day % 3 <> 0""")
def pending_jobs(spark, sf):
    problems, pairs = _problems(spark, sf)
    done = jobs.variant_pairs(problems.where("day % 3 = 0"), pairs, seed=7).withColumns({"model": F.lit("m"), "use_comp_programming": F.lit(False)})
    out = jobs.build_jobs(problems, pairs, "m", False, 7, completed=jobs.completed_jobs(done, "m"))
    return out.withColumn("prompt_md5", F.md5("prompt")).drop("prompt")


@query("SELECT 'm@2021@' || conv_id::VARCHAR || '@a@' || turn::VARCHAR || '@normal' AS custom_id, to_json({'custom_id': 'm@2021@' || conv_id::VARCHAR || '@a@' || turn::VARCHAR || '@normal', 'method': 'POST', 'url': '/v1/responses', 'body': {'model': 'm', 'input': [{'role': 'system', 'content': 'sys'}, {'role': 'user', 'content': text}], 'max_output_tokens': 64}})::VARCHAR AS line FROM conversations WHERE role = 'user'")
def batch_request(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'")
    rows = turns.select(F.lit("m").alias("model"), F.col("text").alias("prompt"), F.concat_ws("@", F.lit("m"), F.lit("2021"), "conv_id", F.lit("a"), "turn", F.lit("normal")).alias("job_id"))
    lines = batch_api.request_lines(rows, "sys", 64)
    return lines.select("custom_id", F.to_json(F.struct(*lines.columns)).alias("line"))


def _turns(spark, sf):
    """The user's turns as requests and the assistant's as responses to the turn before."""
    c = table(spark, sf, "conversations")
    day = (F.col("conv_id") % 25 + 1).cast("string")
    custom = lambda turn: F.concat_ws("-", F.lit("gpt-5-mini-2025-08-07"), F.lit("2021"), day, F.lit("Favor in-place mutation"), F.concat_ws(" ", "conv_id", turn), F.lit("comp"))
    message = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))
    texts = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), F.col("text").alias("text")))
    asked = c.where("role = 'user'").select(F.lit("m").alias("model"), F.col("text").alias("prompt"), custom(F.col("turn")).alias("job_id"))
    output = F.struct(F.struct(F.array(message("reasoning", texts("summary")), message("message", texts("output_text"))).alias("output")).alias("body"))
    return batch_api.request_lines(asked, "sys", 64), c.where("role = 'assistant'").select(custom(F.col("turn") - 1).alias("custom_id"), output.alias("response"))


@query("""WITH i AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), o AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
  SELECT 'gpt-5-mini-2025-08-07' AS model, 2021 AS year, (i.conv_id % 25 + 1)::INT AS day, 'Favor in-place mutation' AS code_variant, i.conv_id::VARCHAR || ' ' || i.turn::VARCHAR AS style_variant, true AS use_comp_programming, i.text AS prompt, md5(regexp_replace(regexp_replace(o.text, '^\\s+', ''), '\\s+$', '')) AS code_md5
  FROM i JOIN o ON i.conv_id = o.conv_id AND o.turn = i.turn + 1""")
def batch_join(spark, sf):
    out = batch_api.retrieve(*_turns(spark, sf))
    return out.select("model", "year", "day", "code_variant", "style_variant", "use_comp_programming", "prompt", F.md5("code").alias("code_md5"))


@query("""SELECT i.text AS prompt FROM conversations i LEFT JOIN conversations o ON i.conv_id = o.conv_id AND o.turn = i.turn + 1 AND o.role = 'assistant' WHERE i.role = 'user' AND o.conv_id IS NULL""")
def batch_unanswered(spark, sf):
    return batch_api.unanswered(*_turns(spark, sf)).select(F.get("body.input", F.lit(1))["content"].alias("prompt"))


@query(f"{cte('jobs_v')} SELECT model, year, day, code_variant, style_variant, use_comp_programming FROM jobs_v")
def custom_id_decode(spark, sf):
    return view(spark, sf, "jobs_v").select(batch_api.decode_custom_id(text.job_id()).alias("j")).select("j.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS text FROM events")
def output_text_extract(spark, sf):
    part = F.struct(F.when(F.col("event_id") % 3 == 0, "refusal").otherwise("output_text").alias("type"), F.col("event_type").alias("text"))
    output = F.array(F.struct(F.lit("reasoning").alias("type"), F.array(part).alias("content")), F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("x").alias("type"), F.lit("no").alias("text")), part).alias("content")))
    return table(spark, sf, "events").select("event_id", batch_api.output_text(output).alias("text"))


@query("SELECT conv_id, turn, length(text) AS len, (row_number() OVER (ORDER BY length(text), conv_id * 1000 + turn) - 1) // 8 AS batch FROM conversations")
def length_batches(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    return jobs.length_batches(rows, "len", "k", 8).drop("k")


@query("""WITH d AS (SELECT DISTINCT conv_id FROM conversations), a AS (SELECT conv_id, text FROM conversations WHERE turn = 0), b AS (SELECT conv_id, text FROM conversations WHERE turn = 1)
  SELECT 2021 AS year, conv_id AS day, concat_ws(chr(10) || chr(10), nullif(a.text, ''), nullif(b.text, '')) AS problem FROM d LEFT JOIN a USING (conv_id) LEFT JOIN b USING (conv_id) WHERE concat_ws('', nullif(a.text, ''), nullif(b.text, '')) <> ''""")
def problem_text_join(spark, sf):
    c = table(spark, sf, "conversations").select(F.lit(2021).alias("year"), F.col("conv_id").alias("day"), "turn", "text")
    return jobs.assemble_problems(c.select("year", "day").distinct(), c.where("turn = 0"), c.where("turn = 1"))


@query(f"{cte('board_v')} SELECT regexp_extract(html, 'data-user-id=\"([^\"]*)\"', 1) AS user_id, arg_max(regexp_replace(regexp_extract(html, '<a href=\"([^\"]*)\"', 1), '/+$', ''), seq) AS github_url FROM board_v WHERE contains(html, 'github.com') GROUP BY 1")
def leaderboard_users(spark, sf):
    return repositories.latest_users(repositories.leaderboard_entries(view(spark, sf, "board_v")))


@query("SELECT page_id, i - 1 AS place, links[i] AS link FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS links FROM pages), range(1, 100000) t(i) WHERE i <= len(links)")
def page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "link")).withColumn("place", F.col("place").cast("long"))


# ---------------------------------------------------------------- thresholds and metrics
_MED = "(SELECT median(value) FROM events)"
_LIMITS = {"percentile": "SELECT quantile_cont(value, 0.95) AS t FROM events", "mean_std": "SELECT avg(value) + 2 * stddev_pop(value) AS t FROM events", "mad": f"SELECT {_MED} + 3 * 1.4826::DOUBLE * median(abs(value - {_MED})) AS t FROM events", "iqr": "SELECT quantile_cont(value, 0.75) + 1.5::DOUBLE * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS t FROM events"}


def _threshold_queries() -> None:
    for k, sql in _LIMITS.items():
        QUERIES[f"threshold_{k}"] = lambda spark, sf, k=k: metrics.thresholds(table(spark, sf, "events"), "value").where(F.col("strategy") == k).select("strategy", F.round("threshold", 6).alias("threshold"))
        ORACLES[f"threshold_{k}"] = f"SELECT '{k}' AS strategy, round(t, 6) AS threshold FROM ({sql})"


_threshold_queries()


@query("SELECT strategy, count(*) AS n, count(CASE WHEN value > t THEN 1 END) AS positive FROM events, (" + " UNION ALL ".join(f"SELECT '{k}' AS strategy, t FROM ({s})" for k, s in _LIMITS.items()) + ") GROUP BY 1")
def classify_by_threshold(spark, sf):
    e = table(spark, sf, "events").select("value")
    return metrics.classify(e, metrics.thresholds(e, "value"), "value").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("positive"))


_CM = "WITH r AS (SELECT l.quality AS y, (d.n_chars > 1500)::INT AS p FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT count(CASE WHEN y = 0 AND p = 0 THEN 1 END) AS tn, count(CASE WHEN y = 0 AND p = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND p = 0 THEN 1 END) AS fn, count(CASE WHEN y = 1 AND p = 1 THEN 1 END) AS tp FROM r)"


def _judged(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"), "n_chars")


@query(_CM + " SELECT tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def binary_metrics(spark, sf):
    r = metrics.binary_report(metrics.confusion(_judged(spark, sf), "y", "p"))
    return r.select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")], F.round("f1_1", 6).alias("f1"))


@query(_CM + " SELECT round(2 * tn / (2 * tn + fp + fn), 6) AS f1_0, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_1, round((2 * tn / (2 * tn + fp + fn) + 2 * tp / (2 * tp + fp + fn)) / 2, 6) AS f1_macro FROM c")
def macro_f1(spark, sf):
    return metrics.binary_report(metrics.confusion(_judged(spark, sf), "y", "p")).select(*[F.round(c, 6).alias(c) for c in ("f1_0", "f1_1", "f1_macro")])


@query("WITH r AS (SELECT l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id)), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM r) SELECT round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auroc FROM k")
def auroc(spark, sf):
    return metrics.auroc(_judged(spark, sf), "y", "n_chars").select(F.round("auroc", 6).alias("auroc"))


@query(f"{SAMPLES} SELECT id, row_number() OVER (ORDER BY md5(concat_ws(':', '227', id::VARCHAR)), id) <= 300 AS is_calibration FROM samples_v WHERE label = 'human'")
def calibration_split(spark, sf):
    return splits.calibration_split(view(spark, sf, "samples_v").where("label = 'human'").select("id"), "id")


@query(f"{SAMPLES}, g AS (SELECT DISTINCT concat_ws('_', year, day) AS g FROM samples_v), r AS (SELECT g, row_number() OVER (ORDER BY md5(concat_ws(':', '74339', g)), g) <= ceil(0.2::DOUBLE * (SELECT count(*) FROM g)) AS is_test FROM g) SELECT id, g, is_test FROM samples_v JOIN r ON g = concat_ws('_', year, day)")
def group_shuffle_split(spark, sf):
    return splits.group_shuffle_split(view(spark, sf, "samples_v").select("id", text.group_id("problem").alias("g")), "g")


@query(f"""{SAMPLES.replace('WITH ', 'WITH RECURSIVE ', 1)}, g AS (SELECT concat_ws('_', year, day) AS g, count(*) AS n FROM samples_v GROUP BY 1), o AS (SELECT list(n ORDER BY n DESC, md5(g), g) AS ns FROM g),
  run(i, load, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0::BIGINT UNION ALL
    SELECT i + 1, [load[j] + CASE WHEN j = list_position(load, list_min(load)) THEN ns[i + 1] ELSE 0 END FOR j IN range(1, 6)], list_position(load, list_min(load)) FROM run, o WHERE i < len(ns))
  SELECT (fold - 1)::INT AS fold, sum(ns[i])::BIGINT AS n, count(*) AS groups FROM run, o WHERE i > 0 GROUP BY 1""")
def group_kfold_sizes(spark, sf):
    rows = view(spark, sf, "samples_v").select("id", text.group_id("problem").alias("g"))
    return rows.join(splits.group_kfold(rows, "g"), "g").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("groups"))


_FOLD = "WITH f AS (SELECT doc_id % 5 AS fold, l.toxic AS s, l.quality AS y, (d.n_chars > 1500)::INT AS p FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT fold, count(CASE WHEN y = 0 AND p = 0 THEN 1 END) AS tn, count(CASE WHEN y = 0 AND p = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND p = 0 THEN 1 END) AS fn, count(CASE WHEN y = 1 AND p = 1 THEN 1 END) AS tp FROM f GROUP BY 1), m AS (SELECT *, (tn + tp) / (tn + fp + fn + tp) AS a, (coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2 AS f FROM c)"


@query(_FOLD + " SELECT 'all' AS name, round(avg(a), 6) AS accuracy_mean, round(stddev_pop(a), 6) AS accuracy_std, round(avg(f), 6) AS f1_mean, round(stddev_pop(f), 6) AS f1_std, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::BIGINT AS tp FROM m")
def fold_summary(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("doc_id") % 5).alias("fold"), F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"))
    folds = metrics.binary_report(metrics.confusion(rows, "y", "p", ["fold"])).withColumn("name", F.lit("all"))
    s = metrics.fold_summary(folds, ["name"])
    return s.select("name", *[F.round(c, 6).alias(c) for c in ("accuracy_mean", "accuracy_std", "f1_mean", "f1_std")], "tn", "fp", "fn", "tp")


# ---------------------------------------------------------------- features
def _tfidf_sql(s: tfidf.TfidfSpec) -> str:
    if s.analyzer == "word":
        counts = "SELECT id, t AS term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+')) AS t FROM documents) GROUP BY ALL"
    else:
        sizes = " UNION ALL ".join(f"SELECT {n} AS n" for n in range(s.n_min, s.n_max + 1))
        counts = f"""SELECT id, term, sum(k)::BIGINT AS tf FROM (SELECT id, k, unnest(list_transform(range(1, greatest(length(w) + 2 - n, 0) + 2), lambda i: substring(' ' || w || ' ', i, n))) AS term
          FROM (SELECT id, w, count(*) AS k FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL) CROSS JOIN ({sizes}) WHERE n = {s.n_min} OR n <= length(w) + 2) GROUP BY ALL"""
    tf, idf = ("1 + ln(tf::DOUBLE)" if s.sublinear else "tf::DOUBLE"), ("ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1" if s.use_idf else "1.0::DOUBLE")
    return f"WITH c AS MATERIALIZED ({counts}), v AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*) AS df FROM c GROUP BY 1) WHERE df >= {s.min_df}) SELECT id, count(*) AS terms, round(sqrt(sum(w * w)), 6) AS norm, round(max(w) / sqrt(sum(w * w)), 6) AS max_weight FROM (SELECT id, ({tf}) * idf AS w FROM c JOIN v USING (term)) GROUP BY 1"


def _tfidf_queries() -> None:
    names = {"char_3_5_standard": "tfidf_char_3_5", "char_high_min_df": "tfidf_char_min_df5"}
    for s in tfidf.TFIDF_SETS:
        name = names.get(s.name, f"tfidf_{s.name}")
        QUERIES[name] = lambda spark, sf, s=s: tfidf.tfidf_profile(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), s)
        ORACLES[name] = _tfidf_sql(s)


_tfidf_queries()


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS z_{c}" for c in ("l_quantity", "l_extendedprice")) + " FROM lineitem")
def standard_scale(spark, sf):
    z = features.standard_scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return z.select("l_orderkey", "l_linenumber", F.round("z_l_quantity", 5).alias("z_l_quantity"), F.round("z_l_extendedprice", 5).alias("z_l_extendedprice"))


@query("SELECT event_id, round(CASE WHEN hi - lo <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(lo) THEN 0.5::DOUBLE ELSE (value - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT event_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id))")
def min_max_normalise(spark, sf):
    return features.min_max(table(spark, sf, "events").select("event_id", "user_id", "value"), "value", ["user_id"]).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("WITH t AS (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS w FROM documents), n AS (SELECT id, w, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM n) SELECT id, round(-sum(p * log2(p + 1e-12::DOUBLE)), 6) AS entropy FROM p GROUP BY 1")
def token_entropy(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return scoring.text_entropy(docs, "id", "text").select("id", F.round("entropy", 6).alias("entropy"))


@query("WITH t AS (SELECT doc_id AS id, length(unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10)))) AS s FROM documents) SELECT id, round(avg(s) + 0.5::DOUBLE * stddev_pop(s) + 0.25::DOUBLE * max(s) / (avg(s) + 1e-8::DOUBLE), 6) AS score FROM t GROUP BY 1")
def line_stats_score(spark, sf):
    lines = scoring.split_lines(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), "text", "id").select("id", F.length("line").cast("double").alias("loss"))
    return scoring.line_score(lines, "id").select("id", F.round("score", 6).alias("score"))


@query("WITH p AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type), c AS (SELECT *, sum(p) OVER w AS c, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY user_id ORDER BY p DESC, event_type ROWS UNBOUNDED PRECEDING)), k AS (SELECT * FROM c WHERE c <= 0.55 OR r = 1) SELECT user_id, event_type, round(p, 6) AS p, round(p / sum(p) OVER (PARTITION BY user_id), 6) AS share FROM k")
def nucleus_keep(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = n.join(n.groupBy("user_id").agg(F.sum("n").alias("t")), "user_id").select("user_id", "event_type", (F.col("n") / F.col("t")).alias("p"))
    return scoring.nucleus(p, ["user_id"], "p", "event_type", 0.55).select("user_id", "event_type", F.round("p", 6).alias("p"), F.round("share", 6).alias("share"))


CODE = cte("code_v")


def _sources(spark, sf):
    return pycode.dealt(view(spark, sf, "code_v").select("id", "code"), "id")


@query(f"{CODE} SELECT id, CASE expected_status WHEN 'syntax' THEN 'syntax' ELSE 'ok' END AS status, expected_status = 'ok' AS strict FROM code_v")
def validate_status(spark, sf):
    return _sources(spark, sf).select("id", pycode.code_facts("status", "strict")("code").alias("f")).select("id", "f.status", "f.strict")


#: How often each kind of node and each token occurs in a program of code_v, counted by hand: a plain one, and one that ends in ``p = "\\d"``.
_KINDS = "CASE expected_status WHEN 'ok' THEN [1, 1, 1, 1, 1, 1, 1, 2, 1, 3, 1, 1, 2, 1, 1] ELSE [1, 1, 1, 1, 1, 1, 1, 3, 2, 4, 2, 1, 2, 1, 1] END"
_ENTROPY = "-list_sum(list_transform({0}, lambda x: x / list_sum({0}) * log2(x / list_sum({0}) + 1e-12::DOUBLE)))"
_ONE = ("FunctionDef", "Import", "declarations")


@query(f"""{CODE}, c AS (SELECT id, expected_status, {_KINDS} AS k FROM code_v WHERE expected_status <> 'syntax')
  SELECT id, {', '.join(f"round({'1 / list_sum(k)' if n.removeprefix('ratio_') in _ONE else '0.0::DOUBLE'}, 6) AS {n}" for n in pycode.AST_FEATURES[:-2])},
    round({_ENTROPY.format('k')}, 6) AS node_entropy, CASE expected_status WHEN 'ok' THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS depth_per_child FROM c""")
def ast_features(spark, sf):
    f = _sources(spark, sf).select("id", pycode.code_facts("ast")("code").alias("f"))
    return f.where("f.ast IS NOT NULL").select("id", *[F.round(F.get("f.ast", F.lit(i)), 6).alias(n) for i, n in enumerate(pycode.AST_FEATURES)])


# names: math, f<id>, value, total, value, total (p); tokens: 4 or 5 operators, 1 or 2 strings, import, def, return, line ends, indent, comment, dedent and end
_IDS = "[4, 1 + length(id::VARCHAR), 5, 5, 5, 5] || CASE expected_status WHEN 'ok' THEN []::BIGINT[] ELSE [1] END"
_NAMES = "[1, 1, 2, 2] || CASE expected_status WHEN 'ok' THEN []::INT[] ELSE [1] END"


@query(f"""{CODE}, c AS (SELECT id, {_IDS} AS s, {_NAMES} AS k, expected_status <> 'ok' AS more FROM code_v WHERE expected_status <> 'syntax'),
  t AS (SELECT *, CASE WHEN more THEN 29 ELSE 25 END AS n, CASE WHEN more THEN [6, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1] ELSE [5, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1] END AS w FROM c)
  SELECT id, round(len(s) / n, 6) AS identifier_ratio, round(3 / n, 6) AS keyword_ratio, round((5 + more::INT) / n, 6) AS op_ratio, round((1 + more::INT) / n, 6) AS string_ratio, round(1 / n, 6) AS number_ratio,
    round({_ENTROPY.format('k')}, 6) AS identifier_entropy, round(list_avg(s), 6) AS identifier_mean, list_max(s)::DOUBLE AS identifier_max, round(list_var_pop(s), 6) AS identifier_variance,
    round({_ENTROPY.format('w')}, 6) AS token_entropy, round(n / (len(s) + 1), 6) AS density FROM t""")
def token_features(spark, sf):
    f = _sources(spark, sf).select("id", pycode.code_facts("token")("code").alias("f"))
    return f.where("f.token IS NOT NULL").select("id", *[F.round(F.get("f.token", F.lit(i)), 6).alias(n) for i, n in enumerate(pycode.TOKEN_FEATURES)])


_UNCOMMENTED = "CASE WHEN expected_status <> 'syntax' THEN replace(code, '# ' || p_name, repeat(' ', length(p_name) + 2)) END"


@query(f"{CODE} SELECT id, {_UNCOMMENTED} AS code FROM code_v JOIN part ON id = p_partkey")
def strip_comments(spark, sf):
    return _sources(spark, sf).select("id", pycode.preprocess_udf(True, False, False)("code").alias("code"))


def _rendered(doc: bool, names: bool) -> str:
    """What unparsing gives, without the docstring or with other names; null for a source that has no tree."""
    f, v, t, p = ("'v0'", "v1", "v2", "v3") if names else ("('f' || id::VARCHAR)", "value", "total", "p")
    body = "" if doc else " || '    \"\"\"size of ' || p_brand || '\"\"\"' || chr(10)"
    return f"CASE WHEN expected_status <> 'syntax' THEN 'import math' || chr(10) || chr(10) || 'def ' || {f} || '({v}):' || chr(10){body} || '    {t} = {v} + ' || p_size::VARCHAR || chr(10) || '    return {t}' || CASE WHEN expected_status = 'ok' THEN '' ELSE chr(10) || '{p} = ' || chr(39) || chr(92) || chr(92) || 'd' || chr(39) END END"


@query(f"{CODE} SELECT id, {_rendered(True, False)} AS code FROM code_v JOIN part ON id = p_partkey")
def strip_docstrings(spark, sf):
    return _sources(spark, sf).select("id", pycode.preprocess_udf(False, True, False)("code").alias("code"))


@query(f"{CODE} SELECT id, {_rendered(False, True)} AS code FROM code_v JOIN part ON id = p_partkey")
def rename_identifiers(spark, sf):
    return _sources(spark, sf).select("id", pycode.preprocess_udf(False, False, True)("code").alias("code"))


_MATRIX = {"baseline": "code", "no_comments": _UNCOMMENTED, "no_docstrings": _rendered(True, False), "normalized_identifiers": _rendered(False, True), "fully_normalized": _rendered(True, True)}


@query(f"{CODE} SELECT id, {', '.join(f'md5({v}) AS {k}' for k, v in _MATRIX.items())} FROM code_v JOIN part ON id = p_partkey")
def preprocess_matrix(spark, sf):
    rows = _sources(spark, sf).select("id", pycode.preprocess_each(features.FEATURE_SETS)("code").alias("p"))
    return rows.select("id", *[F.md5(f"p.{name}").alias(name) for name, *_ in features.FEATURE_SETS])


@query(f"{CODE} SELECT expected_status AS status, count(*) AS n FROM code_v WHERE expected_status = 'syntax' GROUP BY 1")
def invalid_statuses(spark, sf):
    return gathering.invalid_counts(_sources(spark, sf).select(pycode.code_status_udf("code").alias("code_status")))


# ---------------------------------------------------------------- learning and scoring
def _code_samples(spark, sf):
    """Programs of two kinds: half of them keep their comments and names, half are fully normalised where they can be."""
    rows = _sources(spark, sf)
    human = F.col("id") % 2 == 0
    return rows.select("id", F.when(human, F.col("code")).otherwise(F.coalesce(pycode.preprocess_udf(True, True, True)("code"), "code")).alias("code"), F.when(human, "human").otherwise("machine").alias("label"), F.when(F.col("id") % 4 < 2, "2021").otherwise("2024").alias("year"), (F.col("id") % 25 + 1).cast("string").alias("day"), F.when(~human, "m").alias("model"), F.when(~human, "a").alias("code_variant"), F.when(~human, F.concat(F.lit("s"), (F.col("id") % 8).cast("string"))).alias("style_variant"), F.when(human, "r").alias("repo"), F.when(human, F.concat(F.lit("u"), (F.col("id") % 20).cast("string"))).alias("author"))


@query()
def svm_ablation(spark, sf):
    return learning.feature_ablation_cv(_code_samples(spark, sf), "problem")


@query()
def preprocess_ablation(spark, sf):
    return learning.preprocess_ablation(_code_samples(spark, sf), "problem")


@query()
def tfidf_ablation(spark, sf):
    return learning.tfidf_ablation(_code_samples(spark, sf), "problem")


#: A character-trigram model over lines in SQL: each line's perplexity, then each document's score.
_TRIGRAM = """WITH l AS (SELECT id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id AS id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM documents)),
  d AS (SELECT chr(2) || chr(2) || text AS t FROM documents WHERE text <> ''),
  tri AS (SELECT substring(t, i, 2) AS c, substring(t, i + 2, 1) AS x, count(*) AS n FROM (SELECT t, unnest(range(1, length(t) - 1)) AS i FROM d) GROUP BY ALL),
  m AS (SELECT c, x, n, sum(n) OVER (PARTITION BY c) AS m FROM tri), ctx AS (SELECT c, sum(n) AS m FROM tri GROUP BY 1),
  u AS (SELECT id, i, substring(t, k, 2) AS c, substring(t, k + 2, 1) AS x FROM (SELECT id, i, chr(2) || chr(2) || line AS t, unnest(range(1, length(line) + 1)) AS k FROM l WHERE trim(line) <> '')),
  loss AS (SELECT u.id, u.i, exp(-avg(ln((coalesce(m.n, 0) + 0.1::DOUBLE) / (coalesce(ctx.m, 0) + 25.6::DOUBLE)))) AS loss FROM u LEFT JOIN m USING (c, x) LEFT JOIN ctx ON u.c = ctx.c GROUP BY ALL),
  losses AS (SELECT l.id, coalesce(loss, 0) AS loss FROM l LEFT JOIN loss USING (id, i)),
  scores AS (SELECT id, avg(loss) + 0.5::DOUBLE * stddev_pop(loss) + 0.25::DOUBLE * max(loss) / (avg(loss) + 1e-8::DOUBLE) AS score FROM losses GROUP BY 1)"""


@query(_TRIGRAM + " SELECT id, round(score, 6) AS score FROM scores")
def perplexity_ngram(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    scored = scoring.code_scores(docs, scoring.TrigramScorer(docs), "text", "id")
    return scored.select("id", F.round("score", 6).alias("score"))


_RUN_LIMITS = {"percentile": "quantile_cont(score, 0.95)", "mean_std": "avg(score) + 2 * stddev_pop(score)", "mad": "median(score) + 3 * 1.4826::DOUBLE * (SELECT median(abs(score - (SELECT median(score) FROM k))) FROM k)", "iqr": "quantile_cont(score, 0.75) + 1.5::DOUBLE * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25))"}


@query(f"""{_TRIGRAM}, samples_v AS ({SAMPLES.partition('(')[2].rpartition(')')[0]}),
  h AS (SELECT score, row_number() OVER (ORDER BY md5(concat_ws(':', '227', id::VARCHAR)), id) <= 100 AS known FROM samples_v JOIN scores USING (id) WHERE label = 'human'), k AS (SELECT score FROM h WHERE known),
  lim AS ({' UNION ALL '.join(f"SELECT '{n}' AS strategy, {t} AS t FROM k" for n, t in _RUN_LIMITS.items())}),
  mine AS (SELECT CASE WHEN use_comp_programming THEN 'comp' ELSE 'normal' END AS dataset, score FROM samples_v JOIN scores USING (id) WHERE label <> 'human'),
  r AS (SELECT dataset, score, 1 AS y FROM mine UNION ALL SELECT dataset, score, 0 FROM h, (SELECT DISTINCT dataset FROM mine) WHERE NOT known),
  ranks AS (SELECT dataset, y, rank() OVER (PARTITION BY dataset ORDER BY score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2 AS k FROM r),
  areas AS (SELECT dataset, (sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auroc FROM ranks GROUP BY 1),
  c AS (SELECT dataset, strategy, t, count(*) FILTER (y = 0 AND score <= t) AS tn, count(*) FILTER (y = 0 AND score > t) AS fp, count(*) FILTER (y = 1 AND score <= t) AS fn, count(*) FILTER (y = 1 AND score > t) AS tp FROM r, lim GROUP BY ALL)
  SELECT dataset, strategy, round(t, 6) AS threshold, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_1, round(auroc, 6) AS auroc FROM c JOIN areas USING (dataset)""")
def perplexity_run(spark, sf):
    samples = view(spark, sf, "samples_v")
    machine = samples.where("label <> 'human'").withColumn("dataset", F.when(F.col("use_comp_programming"), "comp").otherwise("normal"))
    scorer = scoring.TrigramScorer(table(spark, sf, "documents"))
    run = scoring.perplexity_run(samples.where("label = 'human'"), machine, scorer, "trigram", n=100)
    return run.select("dataset", "strategy", *[F.round(c, 6).alias(c) for c in ("threshold", "accuracy", "f1_1", "auroc")], "tn", "fp", "fn", "tp")


@query(_TRIGRAM + """, u2 AS (SELECT doc_id AS id, chr(2) || chr(2) || text AS t, unnest(range(1, length(text) + 1)) AS k FROM documents WHERE trim(text, chr(32) || chr(10) || chr(9) || chr(13)) <> ''),
  nll AS (SELECT id, -avg(ln((coalesce(m.n, 0) + 0.1::DOUBLE) / (coalesce(ctx.m, 0) + 25.6::DOUBLE))) AS nll FROM (SELECT id, substring(t, k, 2) AS c, substring(t, k + 2, 1) AS x FROM u2) u LEFT JOIN m USING (c, x) LEFT JOIN ctx ON u.c = ctx.c GROUP BY 1)
  SELECT doc_id AS id, round(coalesce(nll, 0), 6) AS nll FROM documents LEFT JOIN nll ON doc_id = id""")
def text_nll(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return scoring.code_nll(docs, scoring.TrigramScorer(docs), "text", "id").select("id", F.round("nll", 6).alias("nll"))


@query()
def perturb_detect(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    lines = docs.select(F.explode(F.split("text", text.LINE_ENDS)).alias("line"))
    tokens = lines.select(F.explode(F.split("line", " ")).alias("token")).where(text.informative(F.col("token")))
    likely = scoring.corpus_nucleus(tokens)
    return scoring.detect(docs, scoring.TrigramScorer(docs), likely)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    return windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))
