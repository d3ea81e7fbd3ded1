"""Embedding near-dedup by a subspace pigeonhole join.

Vectors of length one with cosine >= t lie within R = sqrt(2 - 2t).  After a fixed rotation they are
cut into low-dimensional blocks.  If all blocks were further apart than their proportional share of
R^2, so would be the vectors; hence each pair is found in the block where its distance is smallest
against that share.  Each block is a range join: pivots split the block's space, a vector is at home
with its nearest pivot and visits the later cells that its radius reaches.  A pair is verified on
the whole vectors, in double precision, and counted only in its smallest block, so once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprint.llm.common import materialize
from codeprint.llm.graph import components

#: Dimensions of a block; vectors at home in one tile, and partners that meet them there.
BLOCK_DIMS, HOME_ROWS, PARTNER_ROWS = 16, 4096, 16384
#: Pivots of a block grow with the root of the number of vectors, within these bounds.
PIVOTS = (4, 2048)
#: What rounding may add to a distance, in double and in single precision.
_SLACK, _COARSE = 1e-9, 1e-5


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_starts(dim: int) -> np.ndarray:
    n = max(1, dim // BLOCK_DIMS)
    return np.arange(n) * dim // n


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors after the rotation.  Sums run in one order, so a row's bits don't depend on its neighbours."""
    x = np.ascontiguousarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    q, out = rotation(x.shape[1]), np.zeros_like(x)
    for i in range(x.shape[1]):
        out += x[:, i : i + 1] * q[i]
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def cells(x: np.ndarray, pivots: np.ndarray, between: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row, and (row, cell) of its visits: the later cells that its ball reaches.

    ``between`` holds the distances between the pivots."""
    d = _squares(x, pivots)
    home = d.argmin(axis=1)
    near = d - d[np.arange(len(x)), home][:, None] <= 2 * (radius + _SLACK) * between[home] + _SLACK
    near &= np.arange(len(pivots)) > home[:, None]
    return home, *np.nonzero(near)


def _half_squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1, keepdims=True) / 2


def tile_links(left: np.ndarray, right: np.ndarray | None, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the linked pairs that count in ``block``; without ``right``, pairs within ``left``.

    One product in single precision, with room for its rounding, gives all distances in the block;
    the pairs within the budget are then verified in double precision."""
    dim, budget = left.shape[1], 2 - 2 * threshold
    starts = block_starts(dim)
    sizes = np.diff(np.append(starts, dim))
    cut = slice(starts[block], starts[block] + sizes[block])
    other = left if right is None else right
    limit = np.float32(-(budget * sizes[block] / dim * (1 + 1e-6) + _COARSE) / 2)
    x, y = left[:, cut], other[:, cut]
    x = np.hstack([x, -_half_squares(x), np.ones((len(x), 1))]).astype(np.float32)
    y = np.hstack([y, np.ones((len(y), 1)), -_half_squares(y)]).astype(np.float32).T.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(left), 256):
        i, j = np.divmod(np.flatnonzero(x[a : a + 256] @ y >= limit), len(other))  # minus half the squared distance
        i = i + a
        if right is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 50_000):
            p, q = left[i[s : s + 50_000]], other[j[s : s + 50_000]]
            gap = p - q
            share = np.add.reduceat(gap * gap, starts, axis=1) / sizes
            ok = ((p * q).sum(axis=1) >= threshold) & (share.argmin(axis=1) == block)
            found.append((i[s : s + 50_000][ok], j[s : s + 50_000][ok]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def local_roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component under the pairs (i, j)."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of each row.

    Ids are whole numbers, or texts of such.  All rows are compared; those whose vector is null, empty, zero, or holds a null or non-finite
    component, and those with a null id, link with nothing.  Vectors of different lengths don't link.
    Equal vectors are one node with a count; rows that repeat an id count each and share a component.
    Pairs are never emitted: a tile returns each vector's number of links and one edge to the
    smallest vector that it reaches there."""
    v = F.col("_v")
    good = v.isNotNull() & (F.size(v) > 0) & F.col("_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).withColumn("_ok", F.coalesce(good, F.lit(False)))
    nodes = rows.where("_ok").groupBy("_v").agg(F.min("_id").alias("g"), F.count(F.lit(1)).alias("c"))
    nodes = materialize(nodes.withColumn("h", F.xxhash64("_v")).withColumn("dim", F.size("_v")), "vectors")

    pivots: dict[int, list[np.ndarray]] = {}
    for dim, n in sorted((r["dim"], r["count"]) for r in nodes.groupBy("dim").count().collect()):
        k = max(PIVOTS[0], min(PIVOTS[1], math.ceil(math.sqrt(n) / 8)))
        sample = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("h"), "g").limit(k).select("_v").collect()  # k rows
        x = rotated(np.array([r["_v"] for r in sample], dtype=np.float64))
        pivots[dim] = np.split(x, block_starts(dim)[1:], axis=1)
    budget = 2 - 2 * threshold

    def assign(batches):  # noqa: ANN001, ANN202
        between = {dim: [np.sqrt(_squares(p, p)) for p in parts] for dim, parts in pivots.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(own)
                x = np.split(rotated(part.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)), block_starts(dim)[1:], axis=1)
                for b, (sub, piv, apart) in enumerate(zip(x, pivots[dim], between[dim], strict=True)):
                    home, row, cell = cells(sub, piv, apart, math.sqrt(budget * sub.shape[1] / dim))
                    who = pa.array(np.concatenate([np.arange(len(home)), row]))
                    n = len(who)
                    got = part.take(who)
                    yield pa.RecordBatch.from_arrays(
                        [got.column("dim"), pa.array(np.full(n, b, np.int32)), pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.arange(n) < len(home)), got.column("g"), got.column("h"), got.column("c"), got.column("_v")],
                        ["dim", "block", "cell", "home", "g", "h", "c", "_v"],
                    )

    element = nodes.schema["_v"].dataType.simpleString()
    sent = nodes.select("dim", "g", "h", "c", "_v").mapInArrow(assign, f"dim int, block int, cell int, home boolean, g long, h long, c long, _v {element}")
    per_cell = materialize(sent.groupBy("dim", "block", "cell").agg(F.sum(F.col("home").cast("long")).alias("nh"), F.count(F.lit(1)).alias("na")), "cells")
    tiles = per_cell.select("dim", "block", "cell", F.ceil(F.col("nh") / HOME_ROWS).cast("int").alias("hs"), F.ceil(F.col("na") / PARTNER_ROWS).cast("int").alias("ps")).where("hs > 0")
    sent = sent.join(F.broadcast(tiles), ["dim", "block", "cell"])  # blocks x pivots rows at most
    hs, ps = F.pmod("h", "hs").cast("int"), F.pmod(F.xxhash64("h"), F.col("ps")).cast("int")
    homes = sent.where("home").withColumn("ti", hs).withColumn("tj", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)))
    # a home row is a partner of the later slabs of its cell, a visitor of all of them
    first = F.when(F.col("home"), hs + 1).otherwise(F.lit(0))
    partners = sent.where(first < F.col("hs")).withColumn("home", F.lit(False)).withColumn("ti", F.explode(F.sequence(first, F.col("hs") - 1))).withColumn("tj", ps)
    names = ["dim", "block", "cell", "ti", "tj", "home", "g", "h", "c", "_v"]

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, tj = int(key[1]), int(key[4])
        x = rotated(np.stack(pdf["_v"].to_numpy()))
        at_home = pdf["home"].to_numpy()
        h, p = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        i, j = (np.empty(0, np.int64),) * 2
        if len(h) and len(p):
            i, j = tile_links(x[h], x[p], block, threshold)
            i, j = h[i], p[j]
        if len(h) and tj == 0:
            a, b = tile_links(x[h], None, block, threshold)
            i, j = np.concatenate([i, h[a]]), np.concatenate([j, h[b]])
        g, c = pdf["g"].to_numpy(), pdf["c"].to_numpy()
        links = np.bincount(i, c[j], len(g)) + np.bincount(j, c[i], len(g))
        own = np.flatnonzero(links)
        return pd.DataFrame({"g": g[own], "h": pdf["h"].to_numpy()[own], "links": links[own].astype(np.int64), "root": local_roots(g, i, j)[own]})

    found = materialize(homes.select(*names).unionByName(partners.select(*names)).groupBy("dim", "block", "cell", "ti", "tj").applyInPandas(join, "g long, h long, links long, root long"), "links")
    totals = nodes.select("g", "h", "c", "_v").join(found.groupBy("g", "h").agg(F.sum("links").alias("links")), ["g", "h"], "left")
    members = rows.where("_ok").select("_id", "_v").join(totals, "_v").select("_id", "g", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    members = materialize(members, "members")
    edges = found.select(F.col("g").alias("a"), F.col("root").alias("b")).unionByName(members.select(F.col("_id").alias("a"), F.col("g").alias("b"))).where("a <> b")
    part = components(edges)
    out = members.select("_id", "n").unionByName(rows.where("NOT _ok").select("_id", F.lit(0).cast("long").alias("n")))
    out = out.join(part.select(F.col("node").alias("_id"), "component"), "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("_id").eqNullSafe(F.col("component")).alias("kept"))
