"""Jaccard self-join of word n-gram sets by grouped prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprint.llm.common import bounded, materialize, repeats_ids
from codeprint.llm.graph import components
from codeprint.llm.hashing import MULTIPLIERS, mix, ngrams, signed, word_hashes
from codeprint.scratch import discard

#: Counters of the frequency sketch, how many of them one row of its partial sums holds, and the
#: tasks whose sums are added first.
COUNTERS, CHUNK, TASKS = 1 << 20, 1 << 13, 512
#: 64-bit words of a set's parity bitmap, and of the smallest wide one, which grows with the set.
PARITY, WIDE = 8, 4


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a shorter text is one shingle, no words none."""
    hashes, first = word_hashes(column, lower=True)
    grams = {words: mix(ngrams(hashes, words, MULTIPLIERS[1]))}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        k = min(words, b - a)
        if k and k not in grams:
            grams[k] = mix(ngrams(hashes, k, MULTIPLIERS[1]) + np.uint64(k))
        x = np.sort(grams[k][a : b - k + 1]) if k else np.empty(0, np.uint64)
        out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
    return out


def word_list(text: bytes | None) -> list[bytes]:
    """The words of a text; bytes.lower lowers A-Z alone, bytes.split cuts at 0x20 and 0x09-0x0D."""
    return (text or b"").lower().split()


def exact_shingles(text: bytes | None, words: int) -> set:
    """The set of shingles itself, without hashes."""
    own = word_list(text)
    return set(zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else {tuple(own)} if own else set()


def frequency_sketch(docs: DataFrame, words: int, text_col: str) -> np.ndarray:
    """How often shingles fall on each of COUNTERS counters, over all texts.

    Its size is fixed.  It only orders shingles, so that frequent ones stay out of the prefixes; any
    order gives the same result, and counters that many shingles share cost time only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = np.zeros(COUNTERS, dtype=np.int64), TaskContext.get().partitionId() // TASKS
        for batch in bounded(batches, 0):
            if sets := [x for x in shingle_sets(batch.column(0), words) if len(x)]:
                total += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        for i in np.flatnonzero(total.reshape(-1, CHUNK).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([i], pa.int32()), pa.array([total[i * CHUNK : (i + 1) * CHUNK]], pa.list_(pa.int32()))], ["task", "chunk", "n"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n").combine_chunks().flatten().to_numpy().reshape(-1, CHUNK).sum(axis=0, dtype=np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.list_(pa.int64()))})

    parts = docs.select(text_col).mapInArrow(count, "task int, chunk int, n array<int>").groupBy("chunk", "task").applyInArrow(add, "chunk int, n array<long>")
    parts = parts.groupBy("chunk").applyInArrow(add, "chunk int, n array<long>")
    out = np.zeros(COUNTERS, dtype=np.int64)
    for r in parts.collect():  # COUNTERS / CHUNK rows at most
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = r["n"]
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def parity_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of 64 * words bits (a power of two): bit i tells whether an odd number of hashes fall on it.

    It folds: the halves of a bitmap, one xor the other, are the bitmap of half as many words."""
    bits = np.bincount((hashes >> np.uint64(30)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_words(n: int) -> int:
    """Words of the wide bitmap of a set of n: at least one bit a member, so that it is not full."""
    return max(WIDE, 1 << max(-(-n // 64) - 1, 0).bit_length())


def _described(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: _id, m (digest of its words in order), n, s1, s2 (hash of the set), prefix and its digest
    ph (with n), parity, wide (the parity bitmap that grows with n).

    A set too small to link with any other than itself has no prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, words, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            m = [md5(b" ".join(word_list(t))).digest() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n, s1, s2, ph, prefix, parity, wide = [], [], [], [], [], [], []
            for x in shingle_sets(batch.column(1), words):
                n.append(len(x))
                y = mix(x + np.uint64(1))
                s1.append(y.sum(dtype=np.uint64))
                s2.append(mix(y).sum(dtype=np.uint64))
                size = len(x) - -(-len(x) * percent // 100) + 1 if 100 * len(x) >= percent * (len(x) + 1) else 0
                order = np.lexsort((x, shared.value[(x & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:size]
                prefix.append(x[order].view(np.int64))
                ph.append(md5(len(x).to_bytes(8) + x[order].tobytes()).digest())
                parity.append(parity_words(y, PARITY))
                wide.append(parity_words(y, wide_words(len(x))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m, pa.binary()), pa.array(n, pa.int64()), signed(np.array(s1, np.uint64)), signed(np.array(s2, np.uint64)), pa.array(ph, pa.binary()), *(pa.array(c, pa.list_(pa.int64())) for c in (prefix, parity, wide))], ["_id", "m", "n", "s1", "s2", "ph", "prefix", "parity", "wide"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, m binary, n long, s1 long, s2 long, ph binary, prefix array<long>, parity array<long>, wide array<long>")
    out = materialize(rows, "sets")
    shared.destroy()
    return out


def _may_link(percent: int) -> Column:
    """No set pair that links fails this: sizes, and the parity bitmaps' distance as a lower bound of the symmetric difference."""
    sizes = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    apart = sum((F.bit_count(F.get("a_parity", F.lit(i)).bitwiseXOR(F.get("b_parity", F.lit(i)))) for i in range(PARITY)), F.lit(0))
    return sizes & (apart * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent))


def _close(pairs: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes left by the wide bitmaps, whose distance is a lower bound of the symmetric difference;
    written, in place of ``pairs``.

    Bitmaps that differ in length by a factor of two are compared after the longer is folded; those
    that differ by more (possible below 50 percent) decide nothing."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wide = every.where("n > 0").select(F.struct("_id", "m").alias("node"), "n", "wide").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("wide").alias("w"))
    wide = materialize(wide, "bitmaps")
    a, b = (wide.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), F.col("w").alias(f"{p}_w")) for p in "ab")
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda x, y: F.when(F.size(x) == 2 * F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), xor)).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(folded("a_w", "b_w"), folded("b_w", "a_w"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, k: s + k)
    comparable = F.greatest(F.size("a_w"), F.size("b_w")) <= 2 * F.least(F.size("a_w"), F.size("b_w"))
    near = ~comparable | (apart * F.lit(100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent))
    out = materialize(pairs.join(a, "a").join(b, "b").where(near).select("a", "b"), "pairs")
    discard(wide, pairs)
    return out


def _linked(pairs: DataFrame, every: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets link; the shingles themselves are compared, not their hashes."""
    pairs = _close(materialize(pairs, "tried"), every, percent)
    nodes = pairs.select(F.col("a._id").alias("_id")).unionByName(pairs.select(F.col("b._id").alias("_id"))).distinct()
    nodes = materialize(nodes, "asked")
    asked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(nodes, "_id", "left_semi")
    kind = asked.schema["_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [md5(b" ".join(word_list(t))).digest() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m, pa.binary()), batch.column(1)], ["_id", "m", "t"])

    texts = asked.mapInArrow(name, f"_id {kind}, m binary, t string").select(F.struct("_id", "m").alias("node"), "t").dropDuplicates(["node"])
    texts = materialize(texts, "texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, set()
        for batch in bounded(bounded(batches, 2), 3):
            keep = []
            for ta, tb in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)), strict=True):
                if tb != last:  # rows come sorted by b
                    last, y = tb, exact_shingles(tb, words)
                x = exact_shingles(ta, words)
                shared = len(x & y)
                keep.append(bool(x) and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    node = f"struct<_id:{kind},m:binary>"
    out = materialize(both.select("a", "b", "ta", "tb").mapInArrow(compare, f"a {node}, b {node}"), "links")
    discard(pairs, nodes, texts)
    return out


def near_duplicate_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of each row.

    A-Z is lowered; words are the runs of bytes outside 0x20 and 0x09-0x0D; two texts link when
    100 * intersection >= percent * union of their sets of distinct shingles.  component_id is the
    smallest id reachable by links, the row's own included.  Null, empty and blank texts have no
    shingles and link with nothing; rows that repeat an id share a component; a row with a null id
    links with nothing.  Other columns are not read.

    Equal sets are one node; texts of one node whose words differ in order are compared like any
    other pair.  Nodes with the same prefix and size form a group; groups that share a prefix shingle
    are tried first against one leader each, expanded to their members and verified.  Pairs that
    these links leave in different components are then all tried, by prefix shingle and class of
    size, so no link between different components is lost, and the pairs inside a component are
    never listed.  Every link is verified on the shingles themselves."""
    every = _described(docs, words, percent, id_col, text_col)
    sets = every.where("n > 0 AND _id IS NOT NULL")
    nodes = sets.groupBy("s1", "s2", "n").agg(F.min(F.struct("_id", "m")).alias("node"), F.first("ph").alias("ph"), F.first("parity").alias("parity"))
    nodes = materialize(nodes, "nodes")
    # texts of the same words in the same order are linked outright, through the smallest id that has them
    orders = materialize(sets.groupBy("s1", "s2", "n", "m").agg(F.min("_id").alias("first")), "orders")
    same = sets.select("_id", "m").join(orders.select("m", "first"), "m").select(F.col("_id").alias("a"), F.col("first").alias("b")).where("a <> b")
    reordered = orders.join(nodes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"]).where("m <> node.m").select(F.struct(F.col("first").alias("_id"), "m").alias("a"), F.col("node").alias("b"))

    groups = sets.where("size(prefix) > 0").groupBy("ph").agg(F.first("prefix").alias("prefix"), (F.min("s1") < F.max("s1")).alias("several"))
    listed = groups.select("ph", "several", F.explode("prefix").alias("shingle")).repartition("shingle")
    common = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.max("several").alias("several")).where("k > 1 OR several").select("shingle")
    tokens = materialize(listed.select("ph", "shingle").join(common, "shingle", "left_semi"), "shingles")

    # sizes of linked sets are at most one class apart
    step = float(-np.log(percent / 100)) * (1 + 1e-9) if percent < 100 else 1e-3
    member = nodes.select("node", "n", "ph", "parity", F.floor(F.log("n") / step).alias("size"))
    leading = nodes.groupBy("ph").agg(F.min("node").alias("group"), F.first("n").alias("n"))
    sized = materialize(tokens.join(leading, "ph").select("shingle", "ph", "group", F.floor(F.log("n") / step).alias("size"), F.floor(F.log("n") / step / 2).alias("wide")), "sized")
    discard(tokens)
    leaders = materialize(sized.groupBy("shingle", "wide").agg(F.min("group").alias("leader")), "leaders")
    first = materialize(sized.join(leaders, ["shingle", "wide"]).select("ph", "leader").distinct(), "leading")
    discard(leaders)
    side = lambda p: [F.col("node").alias(p), F.col("n").alias(f"{p}_n"), F.col("parity").alias(f"{p}_parity")]
    tried = first.join(member.select("ph", *side("a")), "ph").join(nodes.select(*side("b")), F.col("leader") == F.col("b"))
    tried = tried.where("a <> b").where(_may_link(percent)).select("a", "b").distinct()
    links = _linked(tried.unionByName(reordered).distinct(), every, docs, words, percent, id_col, text_col)
    edges = links.select(F.col("a._id").alias("a"), F.col("b._id").alias("b")).unionByName(same)
    part = materialize(components(edges), "components")
    discard(first, links, orders)

    own = part.select(F.col("node").alias("_node"), F.col("component").alias("c"))
    known = materialize(member.join(own, F.col("node._id") == F.col("_node"), "left").select("node", "n", "ph", "parity", "size", F.coalesce("c", "node._id").alias("c")), "known")
    discard(nodes)
    # a cell: the sets of one shingle of one size and of the size below; all of a ph are of one size
    cells = sized.select("ph", "shingle", "size", F.explode(F.array("size", F.col("size") + 1)).alias("cell"))
    reach = known.groupBy("ph").agg(F.min("c").alias("x"), F.max("c").alias("y"))
    spread = cells.join(reach, "ph").groupBy("shingle", "cell").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("size").alias("size"))
    open_ = materialize(spread.where("x < y AND size = cell").select("shingle", "cell"), "open")
    left = cells.join(open_, ["shingle", "cell"], "left_semi").select("ph", "shingle", "cell").join(known, "ph")
    left = materialize(left.select("shingle", "cell", "size", "node", "n", "parity", "c"), "left")
    discard(sized, open_, known)
    a = left.where("cell = size").select(F.col("shingle").alias("a_shingle"), F.col("size").alias("a_size"), *side("a"), F.col("c").alias("a_c"))
    b = left.select(F.col("shingle").alias("b_shingle"), F.col("size").alias("_size"), F.col("cell").alias("b_size"), *side("b"), F.col("c").alias("b_c"))
    met = (F.col("a_shingle") == F.col("b_shingle")) & (F.col("a_size") == F.col("b_size"))
    once = (F.col("_size") != F.col("a_size")) | (F.col("a") < F.col("b"))
    rest = a.join(b, met & once & (F.col("a_c") != F.col("b_c")) & _may_link(percent)).select("a", "b").distinct()
    more = _linked(rest, every, docs, words, percent, id_col, text_col)
    discard(left)
    whole = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a._id", "b._id").toDF("a", "b")))
    out = every.select("_id", "n").join(whole.select(F.col("node").alias("_id"), "component"), "_id", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of ``docs`` in one component one, that with the smallest id, with all its columns.

    Where ids repeat or are null, a row goes by its id (null first) and the digest of its text; of rows
    that repeat both any one stays."""
    if not repeats_ids(docs, id_col):
        lost = near_duplicate_documents(docs, words, percent, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_lost"))
        return docs.join(lost, docs[id_col] == lost["_lost"], "left_anti")
    key = F.struct(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), key.alias("_key"), F.col(text_col).alias("_text"))
    lost = near_duplicate_documents(rows, words, percent, "_key", "_text").where("_key <> component_id").select(F.col("_key").alias("_lost")).distinct()
    left = rows.join(lost, F.col("_key") == F.col("_lost"), "left_anti").dropDuplicates(["_key"])
    return left.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
