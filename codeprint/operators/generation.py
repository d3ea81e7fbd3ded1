"""Generating machine samples, by a model on the executors or by a batch service."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprint.functions.pycode import code_status_udf
from codeprint.functions.text import extract_code
from codeprint.operators import batch_api, jobs
from codeprint.sources import readers, sinks

#: What both kinds of system prompt say, and their first lines.
OPENING = {"normal": "You are a code synthesis engine.", "comp": "You are a code synthesis engine specialized in competitive programming problems."}
CONSTRAINTS = """

Output constraints:
- Output ONLY Python source code.
- The output must define functions/classes required to solve the problem.
- Do not include any executable code that demonstrates usage.
- Do not include sample inputs, sample outputs, or test data.
- Do not include a main function or __main__ guard.
- Do not include hardcoded example arrays or placeholder datasets.
- Do not include comments of any kind.

Violation examples (forbidden):
- input =
- example =
- sample =
- test ="""


def system_prompt(kind: str) -> str:
    """Fixed texts; the normal one stands between line ends."""
    text = OPENING[kind] + CONSTRAINTS
    return f"\n{text}\n" if kind == "normal" else text


class Generator(Protocol):
    """A model.  It is made once for each task, by the factory that is sent to the executors."""

    def chat(self, system: str, prompt: str) -> str:
        """The rendered chat prompt."""

    def tokens(self, text: str) -> int:
        """The length of a rendered prompt."""

    def generate(self, prompts: list[str], max_new_tokens: int, seed: int | None) -> list[str]:
        """One answer for each prompt."""


Factory = Callable[[], Generator]


def chat_prompts(rows: DataFrame, make: Factory, system: str) -> DataFrame:
    """(job_id, rendered, length) of each job's prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            said = [model.chat(system, p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array([model.tokens(s) for s in said], pa.int64())], ["job_id", "rendered", "length"])

    return rows.select("job_id", "prompt").mapInArrow(run, "job_id string, rendered string, length long")


def generate(rows: DataFrame, make: Factory, system: str, batch_size: int = 8, max_new_tokens: int = 512, seed: int | None = None) -> DataFrame:
    """``rows`` with code and code_status: prompts of like length are answered together, ``batch_size`` at a time."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = table.sort_by([("length", "ascending"), ("job_id", "ascending")])
        said = make().generate(own.column("rendered").to_pylist(), max_new_tokens, seed)
        return pa.table({"job_id": own.column("job_id"), "answer": pa.array(said, pa.string())})

    batches = jobs.length_batches(chat_prompts(rows, make, system), "length", "job_id", batch_size)
    answers = batches.groupBy("batch").applyInArrow(run, "job_id string, answer string")
    return rows.join(answers, "job_id").withColumn("code", extract_code(F.col("answer"))).withColumn("code_status", code_status_udf("code")).drop("answer")


def run_local(spark: SparkSession, problems: DataFrame, model: str, make: Factory, path: str, comp: bool = False, sample: int | None = None, seed: int = 42, retries: int = 3, **options: int) -> DataFrame:
    """Build the jobs that ``path`` does not have yet, answer them, append what is valid to ``path``; the failed jobs."""
    kind = "comp" if comp else "normal"
    completed = readers.load_completed(spark, path, model)
    todo = jobs.build_jobs(problems, jobs.variant_table(spark, kind), model, comp, seed, completed, sample)
    valid, failed = jobs.run_with_retries(todo, lambda left, i: generate(left, make, system_prompt(kind), seed=seed + i, **options), retries + 1)
    sinks.append_samples(jobs.create_samples(valid), path)
    return failed


class BatchService(Protocol):
    """A service that takes files of requests."""

    def upload(self, path: str) -> str:
        """The id of the file."""

    def create(self, file_id: str) -> str:
        """The id of the batch job over that file."""

    def output(self, job_id: str) -> str:
        """The path of the finished job's responses."""


def submit(todo: DataFrame, service: BatchService, folder: str, system: str, max_tokens: int) -> tuple[str, str]:
    """Write the request lines and the file of ids below ``folder`` and start the batch: (file id, job id)."""
    sinks.write_requests(batch_api.request_lines(todo, system, max_tokens), f"{folder}/batch_requests")
    file_id = service.upload(f"{folder}/batch_requests")
    job_id = service.create(file_id)
    sinks.write_batch_ids(todo.sparkSession, [(file_id, job_id)], f"{folder}/batch_ids")
    return file_id, job_id


def run_batch(spark: SparkSession, problems: DataFrame, model: str, service: BatchService, folder: str, comp: bool = False, sample: int | None = None, seed: int = 42, max_tokens: int = 512) -> tuple[str, str]:
    """Build the open jobs of ``folder``/samples and submit them."""
    kind = "comp" if comp else "normal"
    completed = readers.load_completed(spark, f"{folder}/samples", model)
    return submit(jobs.build_jobs(problems, jobs.variant_table(spark, kind), model, comp, seed, completed, sample), service, folder, system_prompt(kind), max_tokens)


def retrieve_all(spark: SparkSession, service: BatchService, folder: str) -> DataFrame:
    """Append the valid answers of every batch in the id file to ``folder``/samples; the answers that failed."""
    failed = None
    for r in readers.batch_ids(spark, f"{folder}/batch_ids").collect():  # one row a batch
        done = batch_api.retrieve(readers.batch_requests(spark, f"{folder}/batch_requests"), readers.batch_responses(spark, service.output(r["job_id"])))
        sinks.append_samples(jobs.create_samples(done.where("code_status = 'ok'")), f"{folder}/samples")
        bad = done.where("code_status <> 'ok'")
        failed = bad if failed is None else failed.unionByName(bad)
    return failed

