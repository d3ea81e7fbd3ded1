"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprint.llm.common import materialize, maybe_broadcast, ranked

#: The pool of all sources that have no weight of their own (null included).
OTHER = "*"
#: The columns that mix_sources adds.
ADDED = ("pool", "block", "release", "deadline", "slot", "position")
#: Cycles whose starts are summed in one task; across chunks only their totals are.
CHUNK_CYCLES = 4096


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def pfair_cycle(parts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each pool's blocks in one cycle of sum(parts) slots.

    Block k of a pool with p parts of Q is released at floor(kQ/p) and due at ceil((k+1)Q/p); each
    slot goes to the released block that is due first, ties by name.  The parts fill all slots, so
    every block meets its deadline and a pool is never a whole block away from its share.  The plan
    depends on the weights alone, never on the data."""
    if not parts or any(int(p) != p or p < 1 for p in parts.values()):
        raise ValueError("weights are positive whole parts")
    q, slots = sum(parts.values()), {k: [] for k in parts}
    for t in range(q):
        due = [(-(-(len(s) + 1) * q // parts[k]), k) for k, s in slots.items() if len(s) * q // parts[k] <= t and len(s) < parts[k]]
        slots[min(due)[1]].append(t)
    return slots


def _placed(docs: DataFrame, weights: dict[str, int], other: int, block_rows: int, id_col: str, source_col: str) -> DataFrame:
    """(_row, pool, block, release, deadline, slot, position): every row of ``docs`` as a struct, with its place."""
    if OTHER in weights:
        raise ValueError(f"the pool of other sources is called {OTHER}; its parts are given as other")
    parts = dict(weights) | {OTHER: other}
    q, plan = sum(parts.values()), pfair_cycle(parts)
    pool = F.when(F.col(source_col).isin(*weights), F.col(source_col)).otherwise(F.lit(OTHER)) if weights else F.lit(OTHER)
    table = docs.sparkSession.createDataFrame([(k, parts[k], s) for k, s in plan.items()], "pool string, _p int, _slots array<int>")
    tie = F.xxhash64(*[_named(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = docs.select(F.struct(*map(_named, docs.columns)).alias("_row"), pool.alias("pool"), F.col(id_col).alias("_id"), F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("~")).alias("_md5"), tie.alias("_tie"))
    rows = ranked(rows.withColumn("_part", F.substring("_md5", 1, 3)), "pool", "_part", [F.col("_md5"), F.col("_id"), F.col("_tie")], "_rank")
    k, cycle = F.col("block") % F.col("_p"), F.floor(F.col("block") / F.col("_p"))
    rows = (
        rows.withColumn("block", F.expr(f"_rank div {block_rows}"))
        .join(F.broadcast(table), "pool")
        .withColumn("_cycle", cycle.cast("long"))
        .withColumn("release", F.col("_cycle") * q + F.floor(k * q / F.col("_p")))
        .withColumn("deadline", F.col("_cycle") * q + F.ceil((k + 1) * q / F.col("_p")))
        .withColumn("slot", (F.col("_cycle") * q + F.element_at("_slots", (k + 1).cast("int"))).cast("long"))
    )
    filled = rows.groupBy("_cycle", "slot").agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cycles = filled.groupBy("_cycle").agg(F.sum("_n").alias("_n")).withColumn("_chunk", F.expr(f"_cycle div {CHUNK_CYCLES}"))
    far = cycles.groupBy("_chunk").agg(F.sum("_n").alias("_n")).select("_chunk", before(Window.orderBy("_chunk")).alias("_far"))
    near = cycles.select("_cycle", "_chunk", before(Window.partitionBy("_chunk").orderBy("_cycle")).alias("_near")).join(far, "_chunk")
    starts = filled.select("_cycle", "slot", before(Window.partitionBy("_cycle").orderBy("slot")).alias("_before")).join(near, "_cycle")
    # written, as their number decides whether the rows have to be shuffled for them: 16 bytes for each block
    starts = materialize(starts.select("slot", (F.col("_before") + F.col("_near") + F.col("_far")).alias("_start")), "slots")
    rows = rows.join(maybe_broadcast(starts, starts.count()), "slot").withColumn("position", F.col("_start") + F.col("_rank") % block_rows)
    return rows.select("_row", "pool", *(F.col(c).cast("long").alias(c) for c in ADDED[1:]))


def mix_sources(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with columns pool, block, release, deadline, slot and position (gapless from 0).

    ``weights`` gives each source its parts; all further sources share the pool ``*`` with ``other``
    parts.  A pool's rows are put in the order of md5(id) and cut into blocks of ``block_rows``;
    blocks take the slots of the Pfair plan, repeated cycle after cycle.  Up to the slot where the
    first pool runs out, each pool has its share of the blocks to within less than one block; later
    its idle slots are closed up and the others keep their ratios.  Every row comes out once: null
    and unknown sources are in ``*``, null ids are ranked last, rows that repeat an id stay.  A column
    of ``docs`` that has the name of an added one gives way to it; an empty table gives an empty one."""
    own = [c for c in docs.columns if c.lower() not in ADDED]
    return _placed(docs, weights, other, block_rows, id_col, source_col).select(*(F.col("_row")[c].alias(c) for c in own), *ADDED)


def in_mixed_order(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` with all their columns and no others, range-partitioned and sorted by position.

    Columns named like those of mix_sources are kept as they are; nulls, ties and empty tables as there."""
    placed = _placed(docs, weights, other, block_rows, id_col, source_col)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*(F.col("_row")[c].alias(c) for c in docs.columns))
