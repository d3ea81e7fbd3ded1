"""Substring dedup over the compacted de Bruijn graph of the corpus.

A window of ``window`` words is an edge of the graph; the words it shares with the next window are
the node between them.  Neighbouring edges of a document that have the same minimizer (the smallest
hash of a short n-gram in the window) are one path.  Equal edges have equal minimizers, so paths can
share edges within a minimizer only.  Where all paths of a minimizer are equal, none of their nodes
branches and they compact into one path, which keeps its smallest source document.  Where they
differ, some node has two ways in or out; there the first source of each path is cut into its edges
again.  Paths are joined on their words, and an edge found by its hashes counts only after its words
have been compared at the coordinates of both documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprint.llm.common import bounded, materialize
from codeprint.llm.hashing import MULTIPLIERS, mix, ngrams, signed, word_hashes

#: Words of the n-grams among which minimizers are chosen.
SEED_WORDS = 16
#: Repeated minimizers that a bitmap may stand for, bits for each of them, and bits at least.
BITMAP_KEYS, BITS_A_KEY, LEAST_BITS = 1 << 22, 16, 1 << 16
_PLACE = np.uint64((1 << 30) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def paths(column: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one minimizer: text number, first word, number of windows, minimizer."""
    words, first = word_hashes(column)
    n = len(words) - window + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.empty(0, np.uint64)
    seed = max(1, min(SEED_WORDS, window))
    seeds = mix(ngrams(words, seed, MULTIPLIERS[0]))
    low = sliding_min((seeds & ~_PLACE) | np.arange(len(seeds), dtype=np.uint64), window - seed + 1)[:n] & _PLACE
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    valid = np.arange(n) + window <= first[text + 1]
    change = np.ones(n, dtype=bool)
    change[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(valid & change)
    edge = np.flatnonzero(np.append(change | ~valid, True))
    count = edge[np.searchsorted(edge, starts, side="right")] - starts
    return text[starts], starts - first[text[starts]], count, seeds[low[starts].astype(np.int64)]


def split_words(text: bytes | None) -> list[bytes]:
    """The words of a text: bytes.split cuts at 0x20 and 0x09-0x0D."""
    return (text or b"").split()


def path_hash(words: Column) -> Column:
    return F.xxhash64(words)


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits (a power of two), those set on which a key of the column ``low`` falls."""
    at = F.col("low").bitwiseAND(F.lit(bits - 1))
    cells = keys.select(F.shiftright(at, 6).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast((low & {bits - 1}) & 63 AS int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    got = cells.toArrow()  # bits / 64 rows at most
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _path_words(rows: DataFrame, window: int, shared: DataFrame, bitmap_keys: int) -> DataFrame:
    """(low, _id, _th, pos, n, words, h): the paths of the minimizers in ``shared``, and perhaps others, with their words and a hash of these.

    Up to ``bitmap_keys`` minimizers are sent to the workers as a bitmap; it lets some others through.
    Beyond that, paths and minimizers are joined by a shuffle, then texts and paths."""
    kind = rows.schema["_id"].dataType.simpleString()
    fields = f"low long, _id {kind}, _th long, pos int, n int"
    names = ["low", "_id", "_th", "pos", "n", "words"]
    many = shared.count()
    if many <= bitmap_keys:
        bits = max(LEAST_BITS, 1 << (BITS_A_KEY * many).bit_length())
        known = rows.sparkSession.sparkContext.broadcast(_bitmap(shared, bits))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = np.uint64(bits - 1)
            for batch in bounded(batches, 2):
                text, pos, n, low = paths(batch.column(2), window)
                at = low & last
                hit = np.flatnonzero((known.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                text, pos, n, low = text[hit], pos[hit], n[hit], low[hit]
                texts, said, before, own = batch.column(2).cast(pa.binary()), [], -1, []
                for t, p, k in zip(text.tolist(), pos.tolist(), n.tolist(), strict=True):
                    if t != before:
                        before, own = t, split_words(texts[t].as_py())
                    said.append(b" ".join(own[p : p + k + window - 1]))
                who = pa.array(text)
                yield pa.RecordBatch.from_arrays([signed(low), batch.column(0).take(who), batch.column(1).take(who), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(said, pa.binary())], names)

        out = materialize(rows.mapInArrow(cut, f"{fields}, words binary").withColumn("h", path_hash(F.col("words"))), "paths")
        known.destroy()
        return out

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            text, pos, n, low = paths(batch.column(2), window)
            who = pa.array(text)
            yield pa.RecordBatch.from_arrays([signed(low), batch.column(0).take(who), batch.column(1).take(who), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], names[:5])

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            for i, (text, spans) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = split_words(text)
                said = [b" ".join(own[s["pos"] : s["pos"] + s["n"] + window - 1]) for s in spans]
                columns = [pa.array([s[c] for s in spans], t) for c, t in (("low", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()))]
                who = pa.array([i] * len(spans))
                yield pa.RecordBatch.from_arrays([columns[0], batch.column(0).take(who), batch.column(1).take(who), *columns[1:], pa.array(said, pa.binary())], names)

    found = rows.mapInArrow(place, fields).join(shared, "low", "left_semi")
    spans = materialize(found.groupBy("_id", "_th").agg(F.collect_list(F.struct("low", "pos", "n")).alias("spans")), "asked")  # a text's own
    texts = rows.dropDuplicates(["_id", "_th"]).join(spans, ["_id", "_th"]).select("_id", "_th", "_text", "spans")
    return materialize(texts.mapInArrow(say, f"{fields}, words binary").withColumn("h", path_hash(F.col("words"))), "paths")


def _edge_spans(firsts: DataFrame, window: int, kind: str) -> DataFrame:
    """(_id, _th, pos, n): the windows of these paths (_id, _th, pos, n, words) that start in one of them with a smaller id.

    Two independent pairs of hashes propose an edge's first source; its words are then compared."""
    key = f"_id {kind}, _th long, pos int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4):
            n = batch.column(3).to_numpy().astype(np.int64)
            who = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            hashed = []
            for seed, base in enumerate(MULTIPLIERS, 1):
                words, first = word_hashes(batch.column(4), seed=seed)
                hashed.append(signed(mix(ngrams(words, window, base))[first[who] + off]))
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *hashed, pa.array(off.astype(np.int32))], ["_id", "_th", "pos", "a", "b", "off"])

    edges = materialize(firsts.select("_id", "_th", "pos", "n", "words").mapInArrow(cut, f"{key}, a long, b long, off int"), "edges")
    source = edges.groupBy("a", "b").agg(F.min(F.struct("_id", "_th", "pos", "off")).alias("s"), F.max("_id").alias("last")).where("s._id < last").drop("last")
    claims = edges.join(materialize(source, "sources"), ["a", "b"]).where("s._id < _id")
    claims = claims.groupBy("_id", "_th", "pos", F.col("s._id").alias("_sid"), F.col("s._th").alias("_sth"), F.col("s.pos").alias("_spos")).agg(F.collect_list(F.struct("off", F.col("s.off").alias("soff"))).alias("offs"))  # a path's own
    claims = materialize(claims, "claims")
    own = firsts.select("_id", "_th", "pos", "words")
    theirs = firsts.select(F.col("_id").alias("_sid"), F.col("_th").alias("_sth"), F.col("pos").alias("_spos"), F.col("words").alias("said"))
    both = claims.join(own, ["_id", "_th", "pos"]).join(theirs, ["_sid", "_sth", "_spos"]).select("_id", "_th", "pos", "offs", "words", "said")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(bounded(batches, 4), 5):
            who, at = [], []
            for i, (pos, offs, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)):
                x, y = split_words(x), split_words(y)
                same = [pos + o["off"] for o in offs if x[o["off"] : o["off"] + window] == y[o["soff"] : o["soff"] + window]]
                who += [i] * len(same)
                at += same
            rows = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32())], ["_id", "_th", "pos"])

    return both.mapInArrow(compare, key).withColumn("n", F.lit(1))


def repeated_spans(docs: DataFrame, window: int, id_col: str, text_col: str, bitmap_keys: int = BITMAP_KEYS) -> DataFrame:
    """(_id, _th, spans): for each text with removable windows, their first words and lengths in windows."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            text, _, _, low = paths(batch.column(2), window)
            yield pa.RecordBatch.from_arrays([signed(low), batch.column(0).take(pa.array(text))], ["low", "_id"])

    shared = rows.mapInArrow(lows, f"low long, _id {kind}").groupBy("low").agg(F.min("_id").alias("x"), F.max("_id").alias("y")).where("x < y").select("low")
    found = _path_words(rows, window, materialize(shared, "minimizers"), bitmap_keys)

    # written, as are the sides of the joins below, so that AQE can split a key that many rows share
    compact = materialize(found.groupBy("low", "h", "words").agg(F.min("_id").alias("source"), F.max("_id").alias("last")), "compact")
    # paths are equal by their words; where no two of a minimizer share a hash, it says the same without sending the words again
    clash = not compact.groupBy("low", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()
    key = ["low", "h", "words"] if clash else ["low", "h"]
    branching = compact.groupBy("low").agg(F.count(F.lit(1)).alias("k"), F.min("source").alias("x"), F.max("last").alias("y")).where("k > 1 AND x < y").select("low")
    placed = found.select(*key, "_id", "_th", "pos", "n")
    whole = placed.join(compact.where("source < last").select(*key, "source"), key).where("source < _id").select("_id", "_th", "pos", "n")
    unlike = materialize(compact.join(materialize(branching, "branching"), "low", "left_semi").select("low", "h", "words", F.col("source").alias("_id")), "unlike")
    firsts = materialize(placed.join(unlike, [*key, "_id"]).select("_id", "_th", "pos", "n", "words").dropDuplicates(["_id", "_th", "pos"]), "firsts")
    spans = whole.unionByName(_edge_spans(firsts, window, kind))
    return materialize(spans.distinct().groupBy("_id", "_th").agg(F.collect_list(F.struct("pos", "n")).alias("spans")), "spans")


def remove_repeated_spans(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, bitmap_keys: int = BITMAP_KEYS) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of each row (``with_text``: also kept_text).

    Words are the runs of bytes outside 0x20 and 0x09-0x0D.  A word goes if a window of ``window``
    words covers it whose words also start in a text with a smaller id; kept words are joined by one
    blank.  Windows are equal when their words are; hashes only propose them.  Null and empty texts
    have no words; rows with a null id neither lose words nor take any from others; rows that repeat
    an id are no source for each other.  Other columns are not read."""
    spans = repeated_spans(docs, window, id_col, text_col, bitmap_keys)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text")).join(spans, ["_id", "_th"], "left").select("_id", "_text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            size, lost, kept = [], [], []
            for text, own in zip(pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = split_words(text)
                size.append(len(words))
                if own:
                    gone = np.zeros(len(words), dtype=bool)
                    for s in own:
                        gone[s["pos"] : s["pos"] + s["n"] + window - 1] = True
                    words = [words[i] for i in np.flatnonzero(~gone)]
                lost.append(size[-1] - len(words))
                kept.append(b" ".join(words))
            out = [batch.column(0), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array([sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept, pa.binary()).cast(pa.string())] if with_text else [])], names)

    names = [id_col, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    return rows.mapInArrow(cut, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
