"""Ranks in two levels against plain ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeprint.operators import jobs, metrics, splits
from codeprint.operators.ranks import bucketed, percentiles


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_auroc_of_many_distinct_scores_on_many_partitions(spark, adaptive):
    rows = spark.range(0, 1_000_000, numPartitions=16).select(F.hash("id").cast("double").alias("s"), (F.pmod(F.hash(F.col("id") + 1), F.lit(5)) == 0).alias("b"))
    rows = rows.select((F.col("s") / 2**31 + F.col("b").cast("double")).alias("s"), F.col("b").cast("int").alias("y"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = metrics.auroc(rows, "y", "s").first()["auroc"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    local = rows.toPandas()
    ranks = local["s"].rank().to_numpy()
    p, n = int(local["y"].sum()), len(local)
    assert got == pytest.approx((ranks[local["y"] == 1].sum() - p * (p + 1) / 2) / (p * (n - p)), abs=1e-12)


def test_auroc_with_ties_and_without_a_class(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 1.0), (0, 0.5), (1, 2.0), (1, None), (None, 3.0), (0, float("-inf"))], "y int, s double")
    assert metrics.auroc(rows, "y", "s").first()["auroc"] == pytest.approx(5.5 / 6)
    assert metrics.auroc(rows.where("y = 1"), "y", "s").first()["auroc"] is None
    assert metrics.auroc(rows.limit(0), "y", "s").first()["auroc"] is None


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_percentiles_interpolate(spark, n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.3, 1.5, rng.normal(size=n) ** 3)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    assert percentiles(rows, "v", shares) == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    limits = {r["strategy"]: r["threshold"] for r in metrics.thresholds(rows, "v").collect()}
    med = np.median(values)
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert limits == pytest.approx({"percentile": np.quantile(values, 0.95), "mean_std": values.mean() + 2 * values.std(), "mad": med + 3 * 1.4826 * np.median(abs(values - med)), "iqr": q3 + 1.5 * (q3 - q1)}, abs=1e-9)


def test_thresholds_of_nothing(spark):
    assert {r["threshold"] for r in metrics.thresholds(spark.createDataFrame([], "score double")).collect()} == {None}


def test_buckets_rise_with_texts_too(spark):
    rows = spark.createDataFrame([(w,) for w in ["", "a", "aa", "ab", "b", "é", "zz", "日本", None] * 20], "w string")
    got = {}
    for r in bucketed(rows, "w", buckets=4).collect():
        got.setdefault(r["w"], set()).add(r["_bucket"])
    assert all(len(b) == 1 for b in got.values()) and None in got
    order = [min(got[w]) for w in sorted(w for w in got if w is not None)]
    assert order == sorted(order)


def test_length_batches_with_one_length_for_most_rows(spark):
    rng = random.Random(4)
    rows = [(i, 7 if rng.random() < 0.9 else rng.randrange(20)) for i in range(3000)] + [(4000, None)]
    got = {r["k"]: r["batch"] for r in jobs.length_batches(spark.createDataFrame(rows, "k long, len long"), "len", "k", 8).collect()}
    assert got == {k: at // 8 for at, (k, _) in enumerate(sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0])))}


@pytest.mark.parametrize("k", [2, 3, 5])
def test_fold_phases_are_the_greedy_walk(k):
    rng = random.Random(k)
    for _ in range(40):
        sizes = sorted(((s, rng.randrange(1, 60)) for s in rng.sample(range(1, 90), rng.randrange(1, 7))), reverse=True)
        load, want = [0] * k, []
        for size, n in sizes:
            for r in range(n):
                fold = load.index(min(load))
                load[fold] += size
                want.append((size, r, fold))
        phases, got = splits.fold_phases(sizes, k), []
        for size, n in sizes:
            own = [p for p in phases if p[0] == size]
            for r in range(n):
                _, first, folds = [p for p in own if p[1] <= r][-1]
                got.append((size, r, folds[(r - first) % len(folds)]))
        assert got == want


def test_group_splits_keep_groups_whole(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("g"), F.floor(F.sqrt("id")).cast("string")).alias("g"))
    sizes = dict(rows.groupBy("g").count().collect())
    load = [0] * 5
    for r in splits.group_kfold(rows, "g").collect():
        load[r["fold"]] += sizes.pop(r["g"])
    assert not sizes and max(load) - min(load) <= 110
    with pytest.raises(ValueError):
        splits.group_kfold(rows.limit(3), "g")
    test = splits.group_shuffle_split(rows, "g")
    assert test.count() == 3000 and test.where("is_test").select("g").distinct().count() == 11  # of 55
