from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from codeprint.operators import batch_api, jobs, metrics, splits, stats, tfidf
from codeprint.sources import readers, sinks
from codeprint.streaming.incremental import ingest_available, windowed_counts


def test_report_golden(spark):
    cm = spark.createDataFrame([(365, 0, 1, 701)], "tn long, fp long, fn long, tp long")
    assert metrics.binary_report(cm).first()["accuracy"] == pytest.approx(0.99906, abs=5e-6)


def test_folds_are_disjoint(spark):
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 17).cast("string").alias("g"))
    folds = splits.group_kfold(rows, "g")
    assert folds.count() == 17 and rows.join(folds, "g").groupBy("fold").count().count() == 5
    split = splits.group_shuffle_split(rows, "g")
    assert split.where("is_test").select("g").distinct().count() == 4
    assert split.groupBy("g").agg(F.count_distinct("is_test").alias("n")).where("n > 1").isEmpty()


def test_tfidf_has_unit_rows(spark):
    docs = spark.createDataFrame([(1, "a cat sat"), (2, "the cat ran"), (3, "")], "id int, text string")
    rows = tfidf.tfidf(docs, tfidf.TfidfSpec("t", min_df=1))
    assert {round(r[0], 9) for r in rows.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).select("s").collect()} == {1.0}


def test_fold_vocabulary_is_the_rest(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(12)], "id int, text string")
    spec = tfidf.TfidfSpec("w", analyzer="word", n_min=1, n_max=1, min_df=1)
    counts, folds = tfidf.term_counts(docs, spec), docs.select("id", (F.col("id") % 2).alias("fold"))
    got = {(r["term"], round(r["idf"], 9)) for r in tfidf.fold_vocabularies(counts, folds, spec).where("fold = 0").collect()}
    rest = folds.where("fold = 1")
    want = {(r["term"], round(r["idf"], 9)) for r in tfidf.fit_vocabulary(counts.join(rest, "id", "left_semi"), rest.count(), spec).collect()}
    assert got == want


def test_custom_ids(spark):
    ids = ["gpt-5-mini-2025-08-07-2021-3-Favor in-place x-s-comp", "a@b@2021@3@c@s@normal", "m@x@3@c@s@comp", "short"]
    rows = spark.createDataFrame([(i,) for i in ids], "c string").select(batch_api.decode_custom_id(F.col("c")).alias("j")).collect()
    assert [r["j"] and tuple(r["j"]) for r in rows] == [("gpt-5-mini-2025-08-07", 2021, 3, "Favor in-place x", "s", True), ("a@b", 2021, 3, "c", "s", False), None, None]


def test_retries(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    valid, failed = jobs.run_with_retries(left, lambda d, i: d.withColumn("code_status", F.when(F.col("job_id") == "abc"[i], "ok").otherwise("empty")), 2)
    assert sorted(r[0] for r in valid.select("job_id").collect()) == ["a", "b"] and [r[0] for r in failed.collect()] == ["c"]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("m", 2021, 1, "c", "s", True, "x = 1", "p")], "model string, year int, day int, code_variant string, style_variant string, use_comp_programming boolean, code string, prompt string")
    sinks.write_jsonl(jobs.create_samples(rows), str(tmp_path / "s"))
    assert readers.load_samples(spark, str(tmp_path / "s")).first()["year"] == "2021"
    assert readers.load_completed(spark, str(tmp_path / "s"), "m").count() == 1
    assert readers.load_completed(spark, str(tmp_path / "none"), "m").count() == 0
    (tmp_path / "ids.txt").write_text("file: f1\njob: b1\n\nfile: f2\njob: b2\n")
    assert [tuple(r) for r in readers.batch_ids(spark, str(tmp_path / "ids.txt")).collect()] == [("f1", "b1"), ("f2", "b2")]
    (tmp_path / "log.json").write_text(json.dumps({"group_mode": "problem", "n_splits": 1, "ablation_runs": [{"tfidf_set": "w", "accuracy": 0.5, "f1_macro": 0.4, "confusion_matrix": [[1, 2], [3, 4]]}]}))
    assert stats.ablation_runs(readers.ablation_log(spark, str(tmp_path / "log.json"))).first()["name"] == "w"


def test_stream_takes_each_file_once(spark, tmp_path):
    land, out, state = (str(tmp_path / x) for x in ("land", "out", "state"))
    spark.createDataFrame([("x = 1", "human"), ("x = (", "human")], "code string, label string").write.json(land)
    for _ in range(2):
        ingest_available(spark, land, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_windows_on_a_stream_leave_out_late_rows(spark, tmp_path):
    files = [[("2024-01-01T00:10:00Z", 1.0), ("2024-01-01T00:20:00Z", 2.0)], [("2024-01-01T05:30:00Z", 4.0)], [("2024-01-01T05:40:00Z", 0.5)], [("2024-01-01T00:40:00Z", 8.0)], [("2024-01-01T09:00:00Z", 16.0)], [("2024-01-01T09:10:00Z", 32.0)]]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(files):
        path = tmp_path / "in" / f"{i}.json"
        path.write_text("\n".join(json.dumps({"ts": t, "event_type": "a", "value": v}) for t, v in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = sorted((str(r["start"]), r["event_type"], r["n"], r["total"]) for r in spark.table("windows").collect())
    assert got == [("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 05:00:00", "a", 2, 4.5)]
