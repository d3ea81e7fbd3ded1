"""Ranks and percentiles in two levels: counts of value buckets, then order inside a bucket."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of values: their bounds are literals, so every use of them agrees.
BUCKETS = 1024


def order_number(column: str, kind: str) -> Column:
    """A number that rises with the column, though not strictly: of a text the first two characters count."""
    if kind == "string":
        return F.ascii(column).cast("double") * (1 << 21) + F.ascii(F.substring(column, 2, 1))
    return F.col(column).cast("double")


def bucketed(rows: DataFrame, value: str, out: str = "_bucket", buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with an int column ``out`` that rises with ``value``; about as many rows in each as values differ.

    The bounds are approximate quantiles, taken at once; a single value is never split.  Nulls count as lowest."""
    number = F.coalesce(order_number(value, dict(rows.dtypes)[value]), F.lit(-1.7976931348623157e308))
    named = rows.withColumn("_number", number)
    shares = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    bounds = named.agg(F.percentile_approx("_number", shares, 8 * buckets).alias("b")).first()["b"] or []
    inner = sorted({b for b in bounds if math.isfinite(b)})
    cut = Bucketizer(splits=[-math.inf, *inner, math.inf] if inner else [-math.inf, 0.0, math.inf], inputCol="_number", outputCol="_at", handleInvalid="keep")
    return cut.transform(named).withColumn(out, F.col("_at").cast("int")).drop("_number", "_at")


def offsets(counts: DataFrame, n: str, order: list[str], out: str) -> DataFrame:
    """``counts`` (one row a bucket) with the sum ``out`` of all ``n`` before it."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(before), F.lit(0)))


def percentiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """The exact percentiles with linear interpolation; None without values.

    Values are counted; bucket totals tell in which buckets the wanted ranks lie, and only those
    buckets are sorted."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    per = bucketed(counts, "v")
    totals = sorted((r["_bucket"], r["n"]) for r in per.groupBy("_bucket").agg(F.sum("n").alias("n")).collect())  # BUCKETS + 1 rows at most
    n = sum(t for _, t in totals)
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    wanted = sorted({int(f(p)) for p in places for f in (math.floor, math.ceil)})
    at, before, i = [], 0, 0
    for bucket, size in totals:
        while i < len(wanted) and wanted[i] < before + size:
            at.append((bucket, wanted[i], wanted[i] - before))
            i += 1
        before += size
    ranks = rows.sparkSession.createDataFrame(at, "_bucket int, rank long, inside long")
    upto = F.sum("n").over(Window.partitionBy("_bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    sums = per.where(F.col("_bucket").isin(sorted({b for b, _, _ in at}))).withColumn("_to", upto)
    hits = sums.join(F.broadcast(ranks), "_bucket").where((F.col("inside") < F.col("_to")) & (F.col("inside") >= F.col("_to") - F.col("n")))
    found = {r["rank"]: r["v"] for r in hits.select("rank", "v").collect()}  # two rows a percentile
    low = [found[math.floor(p)] for p in places]
    return [a + (found[math.ceil(p)] - a) * (p - math.floor(p)) if math.ceil(p) > math.floor(p) else a for a, p in zip(low, places, strict=True)]
