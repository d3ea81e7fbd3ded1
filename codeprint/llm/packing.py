"""Token-id sequences of fixed length by best-fit-decreasing packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeprint.llm.bpe import LibraryBpe, codec
from codeprint.llm.common import ARROW_BYTES, bounded

#: Pieces that are packed together at most, so that a task's memory is bounded.
PACK_TOKENS = 2_000_000


class CapacityTree:
    """A segment tree over free capacities 1 to n: which capacities have an open row."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._count(capacity, 1)

    def take(self, capacity: int) -> int:
        self._count(capacity, -1)
        return self.rows[capacity].pop()

    def _count(self, capacity: int, change: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += change
            i >>= 1

    def best_fit(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that has an open row; 0 if there is none."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return 0


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; every item is at most ``capacity`` long and positive.

    Items go longest first (ties in input order) into the fullest row that still takes them."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        if free := tree.best_fit(need):
            row = tree.take(free)
        else:
            row, free = len(rows), capacity
            rows.append([])
        rows[row].append(i)
        if free > need:
            tree.add(free - need, row)
    return rows


def packed_rows(items: list[tuple[object, np.ndarray]], length: int, pad: int) -> Iterator[tuple]:
    """Packed rows of (id, token ids) items: doc_ids, offsets, cu_seqlens, ids, position_ids.

    An item longer than a row is split into pieces of ``length`` and a rest, so that no token is
    lost: offsets tell where in its document each piece begins."""
    pieces = [(doc, at, ids[at : at + length]) for doc, ids in items for at in range(0, len(ids), length)]
    for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
        own = [pieces[i] for i in row]
        ends = np.cumsum([len(p[2]) for p in own])
        ids, positions = np.full(length, pad, np.int32), np.zeros(length, np.int32)
        ids[: ends[-1]] = np.concatenate([p[2] for p in own])
        positions[: ends[-1]] = np.concatenate([np.arange(len(p[2]), dtype=np.int32) for p in own])
        yield [p[0] for p in own], [p[1] for p in own], [0, *ends.tolist()], ids, positions


def pack_documents(docs: DataFrame, path: str, length: int = 2048, pad: int | None = None, id_col: str = "doc_id", text_col: str = "text", pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """Packed rows of the tokens of ``docs``, each document ended by the end token.

    A row: doc_ids and offsets (of the pieces in it), cu_seqlens (from 0 to the tokens used), ids and
    position_ids (``length`` each; positions restart at 0 with each piece; the tail is padded).
    Packing runs within an input partition over buffers of ``pack_tokens`` tokens, without a shuffle:
    which documents share a row follows the input's split, and only a buffer's last rows are less full.
    Null and empty texts are the end token alone; an empty table gives no rows; repeated rows are
    packed as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = codec(path, LibraryBpe)
        [end] = tokenizer.id_arrays(["<|endoftext|>"])
        held: list[tuple[object, np.ndarray]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(packed_rows(held, length, int(end[0]) if pad is None else pad))
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                matrix = lambda k: pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * length), pa.array(np.concatenate([r[k] for r in part])))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.list_(id_type)), pa.array([r[1] for r in part], pa.list_(pa.int64())), pa.array([r[2] for r in part], pa.list_(pa.int32())), matrix(3), matrix(4)], ["doc_ids", "offsets", "cu_seqlens", "ids", "position_ids"])
            held.clear()

        id_type = None
        for batch in bounded(batches, 1, ARROW_BYTES):
            id_type = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.id_arrays(batch.column(1).to_pylist()), strict=True):
                held.append((doc, np.concatenate((ids, end))))
                n += len(held[-1][1])
                if n > pack_tokens:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_ids array<{kind}>, offsets array<long>, cu_seqlens array<int>, ids array<int>, position_ids array<int>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the packed rows as Parquet: id matrix, segment lengths and positions side by side."""
    packed.write.parquet(path)
