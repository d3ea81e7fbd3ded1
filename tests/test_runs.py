"""The composed runs: gathering, generation, batches, ablation logs and the perplexity run."""

from __future__ import annotations

import http.server
import json
import subprocess
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codeprint import cli, schemas
from codeprint.operators import batch_api, gathering, generation, jobs, learning, scoring
from codeprint.plans import catalogue
from codeprint.scratch import clear_scratch, materialize
from codeprint.sources import readers, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


@pytest.fixture
def server():
    pages = {"/2021/leaderboard": '<div class="leaderboard-entry" data-user-id="7"><a href="https://github.com/ann/">a</a></div><div class="leaderboard-entry" data-user-id="8">b</div>', "/2021/leaderboard/day/1": '<div class="leaderboard-entry" data-user-id="7"><a href="https://github.com/ann2">a</a></div>'}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = pages.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as httpd:
        threading.Thread(target=httpd.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{httpd.server_port}", pages
        httpd.shutdown()


def listing(url):
    def fetch(user, page):
        if user == "gone":
            return 404, []
        return 200, [{"name": "aoc-2021", "full_name": f"{user}/solutions", "clone_url": url, "language": "Python", "topics": ["aoc"]}, {"name": "x", "full_name": f"{user}/x", "clone_url": url, "language": "Go"}] if page == 1 else []

    return fetch


def test_gathering_from_pages_to_samples(spark, server, tmp_path):
    url, pages = server
    source = tmp_path / "source"
    (source / "2021" / "day1").mkdir(parents=True)
    (source / "2021" / "day1" / "main.py").write_text("x = 1  \r\nprint(x)\n")
    (source / "2021" / "day_2.py").write_text("x = (\n")
    (source / "2021" / "notes.txt").write_text("no")
    for command in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        subprocess.run(["git", *command], cwd=source, check=True)
    folder = str(tmp_path / "out")
    got = gathering.gather(spark, ["2021"], [1, 2], url, folder, listing(str(source))).collect()
    assert [(r["code"], r["year"], r["day"], r["author"], r["repo"]) for r in got] == [("x = 1\nprint(x)", "2021", "01", "ann2", "solutions")]
    assert [tuple(r) for r in readers.tsv(spark, f"{folder}/top_users", header=True).collect()] == [("7", "https://github.com/ann2")]
    assert [r["cloned"] for r in spark.read.json(f"{folder}/cloned").collect()] == [True]
    pages["/2021/leaderboard/day/2"] = "late"
    gathering.scrape(spark, ["2021"], [1, 2], url, f"{folder}/pages")  # only what is not there yet
    assert sorted(r["day"] for r in spark.read.parquet(f"{folder}/pages").collect()) == [0, 1, 2]
    _, faults = gathering.valid_samples(gathering.samples_of_tree(spark, folder, ["2021"]))
    assert [tuple(r) for r in faults.collect()] == [("syntax", 1)]


def test_users_without_a_listing_have_no_repositories(spark):
    users = spark.createDataFrame([("1", "https://github.com/gone"), ("2", "https://github.com/bob")], "user_id string, github_url string")
    assert [tuple(r) for r in gathering.possible_repositories(users, ["2021"], listing("u")).collect()] == [("bob/solutions", "u")]
    assert gathering.clone_repositories(spark.createDataFrame([("a/b", "/nowhere/at/all")], "full_name string, clone_url string"), "/tmp/none").first()["cloned"] is False


class Echo:
    """Answers with a program; every third attempt is broken."""

    def chat(self, system, prompt):
        return f"<s>{system}</s><u>{prompt}</u>"

    def tokens(self, text):
        return len(text.split())

    def generate(self, prompts, max_new_tokens, seed):
        return ["```python\nx = 1\n```" if (len(p) + seed) % 3 else "x = (" for p in prompts]


def test_local_generation_appends_valid_samples_and_resumes(spark, tmp_path):
    problems = spark.createDataFrame([(2021, d, "p" * d) for d in (1, 2, 3)], "year int, day int, problem string")
    out = str(tmp_path / "samples")
    failed = generation.run_local(spark, problems, "m", Echo, out, retries=0)
    first, bad = readers.load_samples(spark, out).count(), failed.count()
    assert first + bad == 75 and first and bad
    assert generation.run_local(spark, problems, "m", Echo, out, retries=3).isEmpty()
    assert readers.load_samples(spark, out).count() == 75 and {r["code"] for r in readers.load_samples(spark, out).collect()} == {"x = 1"}
    prompts = generation.chat_prompts(problems.select(F.col("day").alias("job_id"), F.col("problem").alias("prompt")).withColumn("job_id", F.col("job_id").cast("string")), Echo, "sys")
    assert {(r["job_id"], r["rendered"], r["length"]) for r in prompts.collect()} == {(str(d), f"<s>sys</s><u>{'p' * d}</u>", 1) for d in (1, 2, 3)}


def test_attempts_run_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def attempt(left, i):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                for j in b.column(0).to_pylist():
                    n = len(list(log.glob(f"{j}-{i}-*")))
                    (log / f"{j}-{i}-{n}").touch()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["ok" if hash((j, i, n)) % 2 else "syntax" for j in b.column(0).to_pylist()])], ["job_id", "code_status"])

        return left.select("job_id").mapInArrow(run, "job_id string, code_status string")

    valid, failed = jobs.run_with_retries(spark.createDataFrame([(f"j{i}",) for i in range(20)], "job_id string"), attempt, 3)
    both = [r["job_id"] for r in valid.collect()], [r["job_id"] for r in failed.collect()]
    assert sorted(both[0] + both[1]) == sorted(f"j{i}" for i in range(20))
    assert all(p.name.endswith("-0") for p in log.iterdir())


class Service:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def upload(self, path):
        self.path = path
        return "file-1"

    def create(self, file_id):
        return "batch-1"

    def output(self, job_id):
        answers = []
        for i, r in enumerate(readers.batch_requests(self.spark, self.path).orderBy("custom_id").collect()):
            content = [{"type": "output_text", "text": "```py\ny = 2\n```" if i % 5 else "y = ("}] if i % 7 else []
            answers.append({"custom_id": r["custom_id"], "response": {"body": {"output": [{"type": "message", "content": content}]}}})
        path = self.folder / "answers.jsonl"
        path.write_text("\n".join(map(json.dumps, answers[1:])))  # one answer is missing
        return str(path)


def test_batches_from_jobs_to_samples(spark, tmp_path):
    problems = spark.createDataFrame([(2021, 4, "a / b")], "year int, day int, problem string")
    service, folder = Service(spark, tmp_path), str(tmp_path / "run")
    assert generation.run_batch(spark, problems, "m", service, folder, comp=True) == ("file-1", "batch-1")
    lines = readers.batch_requests(spark, f"{folder}/batch_requests")
    assert lines.count() == 25 and lines.first()["body"]["input"][0]["content"] == generation.system_prompt("comp")
    failed = generation.retrieve_all(spark, service, folder)
    want_bad = [i for i in range(1, 25) if i % 5 == 0 or i % 7 == 0]
    assert failed.count() == len(want_bad) and {r["code_status"] for r in failed.collect()} == {"syntax", "no_output"}
    assert readers.load_samples(spark, f"{folder}/samples").count() == 24 - len(want_bad)
    assert batch_api.unanswered(lines, readers.batch_responses(spark, str(tmp_path / "answers.jsonl"))).count() == 1


def test_system_prompts():
    assert generation.system_prompt("normal").startswith("\nYou are a code synthesis engine.\n\nOutput") and generation.system_prompt("normal").endswith("- test =\n")
    assert generation.system_prompt("comp").startswith("You are a code synthesis engine specialized") and generation.system_prompt("comp").endswith("- test =")


def test_grid(spark):
    assert jobs.grid(spark, [2021, 2025], last_days={2025: 12}).groupBy("year").count().orderBy("year").collect() == [(2021, 25), (2025, 12)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\ntwo")
    assert [r["text"] for r in readers.read_files(spark, str(tmp_path / "a")).collect()] == ["one\ntwo"]
    (tmp_path / "a" / "bad.py").write_bytes(b"x = '\xff'")
    with pytest.raises(Exception, match="(?i)malformed|utf-8"):
        readers.python_files(spark, str(tmp_path / "a")).collect()
    (tmp_path / "bad.jsonl").write_text('{"code": 1}\n{"code"')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.load_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    report = spark.createDataFrame([("Model: a\nDone",)], "report string")
    for _ in range(2):
        sinks.write_report(report, str(tmp_path / "reports"))
    assert spark.read.text(str(tmp_path / "reports"), wholetext=True).count() == 2
    (tmp_path / "users.tsv").write_text("7\thttps://github.com/a\n8\tb\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "users.tsv")).collect()] == [("7", "https://github.com/a"), ("8", "b")]
    pages = tmp_path / "2021" / "html"
    pages.mkdir(parents=True)
    (pages / "global_leaderboard.html").write_text("g")
    (pages / "day_3_leaderboard.html").write_text("d")
    assert sorted((r["seq"], r["html"]) for r in readers.leaderboard_pages(spark, str(tmp_path / "2021")).collect()) == [(202100, "g"), (202103, "d")]
    repos = [{"name": "n", "full_name": "a/n", "clone_url": "u", "language": None, "description": None, "topics": ["t"]}]
    (tmp_path / "repos.json").write_text(json.dumps(repos))
    assert readers.repositories(spark, str(tmp_path / "repos.json")).select("full_name", "topics").first() == ("a/n", ["t"])


def test_scratch_can_be_cleared(spark):
    rows = materialize(spark.range(3), "test")
    assert rows.count() == 3 and clear_scratch(spark) >= 1
    with pytest.raises(Exception, match="(?i)not exist|PATH_NOT_FOUND|FAILED_READ_FILE"):
        rows.count()


def test_ablation_logs(spark, tmp_path, monkeypatch, capsys):
    def one_row(rows, spec, tfidf):
        return spark.createDataFrame([(1, 2, 3, 4, 0.5, 0.25)], "tn long, fp long, fn long, tp long, accuracy double, f1_macro double")

    monkeypatch.setattr(learning, "evaluate_split", one_row)
    samples = [{"code": c, "label": "human", "year": "2021", "day": str(d), "repo": "r", "author": "a"} for d in range(1, 8) for c in ("x = 1", "y = 2")] + [{"code": "x = (", "label": "machine"}]
    (tmp_path / "normal_samples.jsonl").write_text("\n".join(map(json.dumps, samples)))
    path = str(tmp_path / "normal_samples.jsonl")
    assert learning.run_feature_ablations(spark, [path], str(tmp_path / "out"), ("problem",), 3) == {path: {"syntax": 1}}
    log = readers.ablation_log(spark, str(tmp_path / "out" / "normal_samples_ablation_problem")).first()
    assert (log["group_mode"], log["n_splits"], len(log["ablation_runs"])) == ("problem", 3, 7)
    run = log["ablation_runs"][0]
    assert [f["fold"] for f in run["folds"]] == [0, 1, 2] and run["summary"]["confusion_matrix_sum"] == [[3, 6], [9, 12]]
    capsys.readouterr()
    cli.main(["analyse", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert said.startswith("Results for normal_samples - problem:\n  Ablation: ast_only\n    Accuracy: 0.5000 ± 0.0000\n    F1 Score: 0.2500 ± 0.0000\n    Confusion Matrix Sum: [[3,6],[9,12]]") and said.count("Ablation:") == 7


def test_perplexity_reports(spark, tmp_path):
    rows = [{"code": f"x = {i}\nprint(x)", "label": "human", "repo": "r"} for i in range(310)]
    (tmp_path / "human.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "normal.jsonl").write_text("\n".join(json.dumps({"code": f"zzz{i} " * 9, "label": "machine"}) for i in range(8)))
    cli.main(["perplexity", str(tmp_path / "human.jsonl"), str(tmp_path / "normal.jsonl"), "--out", str(tmp_path / "reports")])
    reports = [r["value"] for r in spark.read.text(str(tmp_path / "reports"), lineSep="\n\n").collect()]
    assert sum(r.strip().startswith("Model: trigram\nDataset: normal.jsonl\nThreshold: ") for r in reports) == 4
    assert all("Confusion Matrix: [[" in r for r in reports if r.strip())


def test_secrets(tmp_path):
    (tmp_path / ".env").write_text("# A=0\nA=1\nexport GITHUB_TOKEN='t=1'\nA = 2\n")
    path = str(tmp_path / ".env")
    assert [readers.secret(path, n) for n in ("A", "GITHUB_TOKEN", "B")] == ["2", "t=1", None] and readers.secret(str(tmp_path / "no"), "A") is None


def test_nll_is_the_mean_over_the_text(spark):
    rows = spark.createDataFrame([(1, "aab"), (2, " \n"), (3, None)], "id int, text string")
    got = {r["id"]: r["nll"] for r in scoring.code_nll(rows, scoring.TrigramScorer(rows.where("id = 1")), "text", "id").collect()}
    assert got[2] == got[3] == 0 and got[1] > 0
    lines = scoring.TrigramScorer(rows.where("id = 1")).line_losses(spark.createDataFrame([(1, "  "), (2, "aab")], "k int, line string"))
    assert {r["k"]: r["loss"] > 0 for r in lines.collect()} == {1: False, 2: True}


def test_samples_have_one_schema():
    assert schemas.SAMPLE.startswith("code string") and "perplexity_run" in catalogue.QUERIES
