"""Uniform global shuffle into shards of exact size through a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeprint.llm.common import materialize, ranked

#: Rows that a source block holds at least, and the most blocks: the matrix never exceeds MAX_BLOCKS x shards.
BLOCK_ROWS, MAX_BLOCKS = 8192, 4096
#: Items from which numpy's sampler draws.
SMALL_POPULATION = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` items drawn without replacement are among the ``good`` ones.

    numpy draws up to 10^9 items.  Beyond, the distribution function is inverted: weights follow from
    the ratios of neighbouring ones, outwards from the mode over nine standard deviations and more,
    outside of which less than 10^-18 lies."""
    if good + bad < SMALL_POPULATION:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 64 + int(9 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))))
    first, last = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    x = np.arange(first, last, dtype=np.float64)
    weights = np.concatenate(([0.0], np.cumsum(np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1))))
    sums = np.cumsum(np.exp(weights - weights.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def communication_matrix(block_counts: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """How many rows each block sends to each shard: rows sum to block_counts, columns to shard_sizes.

    Each block's row is a multivariate hypergeometric draw from what the shards still lack, which is
    the law of a uniform permutation of all rows."""
    rng, left = np.random.default_rng(seed), list(shard_sizes)
    out = np.zeros((len(block_counts), len(shard_sizes)), dtype=np.int64)
    for i, n in enumerate(block_counts):
        rest = sum(left)
        for j, own in enumerate(left):
            rest -= own
            out[i, j] = drawn = hypergeometric(rng, own, rest, n) if n else 0
            left[j] -= drawn
            n -= drawn
    return out


def shuffle_into_shards(rows: DataFrame, id_col: str, n_shards: int, seed: int = 20240517) -> DataFrame:
    """``rows`` with long columns ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one at most.  Blocks are made from a hash of the id, so the result does
    not depend on how the input is split, and a recomputed task gives the same rows.  Only counts of
    at most MAX_BLOCKS blocks reach the driver.  Rows that share an id, or have none, are dealt by
    their other columns; rows equal in all columns may swap places, which cannot be seen.  An empty
    table gives an empty result."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != id_col]
    n = rows.count()
    blocks = max(1, min(MAX_BLOCKS, math.ceil(n / BLOCK_ROWS)))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), id_col, *names), F.lit(blocks)).cast("int"))
    counts = {r["_block"]: r["count"] for r in dealt.groupBy("_block").count().collect()}
    sizes = [n // n_shards + (j < n % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts.get(i, 0) for i in range(blocks)], sizes, seed).cumsum(axis=1)
    ends = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "_block int, _ends array<bigint>")
    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), id_col, *names), id_col, *names)
    sent = (
        dealt.withColumn("_at", F.row_number().over(local) - 1)
        .join(F.broadcast(ends), "_block")
        .withColumn("shard", F.size(F.filter("_ends", lambda x: x <= F.col("_at"))))
        .withColumn("_r", F.xxhash64(F.lit(seed + 2), id_col, *names))
        .withColumn("_part", F.pmod("_r", F.lit(blocks)).cast("int"))
        .drop("_block", "_at", "_ends")
    )
    return ranked(materialize(sent, "shards"), "shard", "_part", [F.col("_r"), F.col(id_col), *map(F.col, names)], "slot").drop("_r", "_part")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, seed: int = 20240517) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of each document, under the law ``rows``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shuffle_into_shards(rows, id_col, n_shards, seed)
    return out.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", n_shards: int = 24, seed: int = 20240517) -> None:
    """Write ``docs`` in folders shard=0, shard=1, ..., each file in the order of the column ``slot``, which is added.

    ``docs`` has unique ids and no column called shard or slot; rows without an id are not placed."""
    placed = shuffle_into_shards(docs.select(id_col), id_col, n_shards, seed)
    docs.join(placed, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
