"""Exact dedup: group by a 128-bit content hash, then compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprint.llm.common import BROADCAST_ROWS, materialize, maybe_broadcast, repeats_ids


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal; null counts as the empty text.  Of equal texts the
    row with the smallest id stays (``keep="max"``: the largest).  The hash only proposes groups:
    texts of groups of two or more are compared as bytes by grouping on (hash, text), where copies
    collapse before the shuffle.  The hashes (16 bytes each) of such groups are broadcast up to
    BROADCAST_ROWS; beyond that, rows are picked by a shuffle join and written, so that a hash that
    many rows share can be split.  A hash that turns out to hold two texts is resolved by text.
    Rows that repeat an id are counted each, and all of them are kept when that id stays; a null id
    is never preferred to another.  Other columns are not read."""
    best = F.min if keep == "min" else F.max
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_h", content_hash(F.col("_text")))
    many = materialize(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "hashes")
    if many.count() <= broadcast_rows:
        copies = rows.join(F.broadcast(many), "_h", "left_semi")
    else:
        copies = materialize(rows.join(many, "_h", "left_semi"), "copies")
    groups = copies.groupBy("_h", "_text").agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written, so that it is computed once and that the join below can split a hash that many rows share
    sides = materialize(groups.groupBy("_h").agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts")), "groups")
    out = rows.select("_id", "_h", F.sha2("_text", 256).alias("text_sha256")).join(sides, "_h", "left")
    if clashing := sides.where("_texts > 1").count():
        bad = maybe_broadcast(sides.where("_texts > 1").select("_h"), clashing)
        split = rows.join(bad, "_h", "left_semi").join(groups, ["_h", "_text"]).select("_id", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
        out = out.where("coalesce(_texts, 1) = 1").select("_id", "text_sha256", "keep_id", "group_size").unionByName(split)
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("keep_id", "_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep_id", "_id").eqNullSafe(F.col("_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of ``docs`` with equal texts one, that with the smallest id, with all its columns.

    A null id gives way to any other.  Of rows that repeat both id and text any one stays; rows that
    share an id but not a text are judged each by its own text."""
    lost = exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("_lost"), F.col("text_sha256").alias("_lost_text"))
    if not repeats_ids(docs, id_col):
        return docs.join(lost.select("_lost"), docs[id_col] == lost["_lost"], "left_anti")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha"))
    left = rows.join(lost.distinct(), (F.col("_sha") == F.col("_lost_text")) & F.col("_id").eqNullSafe(F.col("_lost")), "left_anti")
    return left.dropDuplicates(["_id", "_sha"]).select(*(F.col("_row")[c].alias(c) for c in docs.columns))
