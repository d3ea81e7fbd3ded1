"""Perturbed copies scored inside Arrow batches, for a trigram model of bounded size.

A line's loss is a sum over its tokens, each with the blank behind it, and of one trigram between two
tokens.  So a copy costs its drawn numbers and the tokens that change; no copy is written or shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeprint.functions.chargrams import slices
from codeprint.functions.text import LOW_INFORMATION, OPERATOR_CHARACTERS

#: Tokens that are worked on together, in whole documents.
CHUNK = 1 << 15
#: Trigrams that a task holds before it gives them on.
HELD_TRIGRAMS = 1 << 20
#: Scores that differ by less are equal: sums of the same numbers in another order.
TIE = 1e-12
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _word(x: np.ndarray | int) -> np.ndarray:
    return _turn(np.atleast_1d(np.asarray(x, dtype=np.uint64)) * _P2, 31) * _P1


def _mixed(seed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one more long after ``seed``, the hash so far; ``word`` is _word of the long."""
    h = _turn((seed + _P5 + np.uint64(8)) ^ word, 27) * _P1 + _P4
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ h >> np.uint64(32)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def informative(token: str) -> bool:
    if token.isalnum():
        return True
    t = token.strip()
    return any(c not in OPERATOR_CHARACTERS for c in t) and t not in LOW_INFORMATION


class TrigramTable:
    """Log probabilities of trigrams, with add-k smoothing, as sorted codes of 21 bits a character."""

    def __init__(self, context: list[str], after: list[str], n: np.ndarray, k: float, vocabulary: float) -> None:
        two = np.array([ord(c[0]) | ord(c[1]) << 21 for c in context], dtype=np.int64)
        codes = two | np.array([ord(c) for c in after], dtype=np.int64) << 42
        contexts, of = np.unique(two, return_inverse=True)
        m = np.bincount(of, weights=n, minlength=len(contexts))
        order = np.argsort(codes)
        self.grams, self.known = codes[order], np.log((n + k) / (m[of] + k * vocabulary))[order]
        self.contexts, self.unseen, self.nothing = contexts, np.log(k / (m + k * vocabulary)), float(np.log(1 / vocabulary))
        self.between = self.grams >> 21 & (1 << 21) - 1 == 32  # with a blank in the middle
        self.blank_grams, self.blank_known = self.grams[self.between], self.known[self.between]

    def __call__(self, codes: np.ndarray, blank: bool = False) -> np.ndarray:
        grams, known = (self.blank_grams, self.blank_known) if blank else (self.grams, self.known)
        out, miss = self._found(codes, grams, known)
        if len(miss):
            out[miss], none = self._found(codes[miss] & (1 << 42) - 1, self.contexts, self.unseen)
            out[miss[none]] = self.nothing
        return out

    @staticmethod
    def _found(codes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(codes)), np.arange(len(codes))
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return values[at], np.flatnonzero(keys[at] != codes)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code of each trigram inside a text, and the number of its text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(chars) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.arange(2, len(chars)) < np.repeat(np.cumsum(sizes), sizes)[:-2])
    return chars[at] | chars[at + 1] << 21 | chars[at + 2] << 42, np.repeat(np.arange(len(texts)), sizes)[at]


def _spelled(codes: np.ndarray, n: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    """Columns context, next, uses of trigram codes."""
    at = [[chr(c >> s & (1 << 21) - 1) for c in codes.tolist()] for s in (0, 21, 42)]
    return [pa.array([a + b for a, b in zip(at[0], at[1], strict=True)], pa.string()), pa.array(at[2], pa.string()), pa.array(n)], ["context", "next", "uses"]


def counted_trigrams(rows: DataFrame, text: str) -> DataFrame:
    """(context, next, uses) of all texts, two marks before each; a task gives a trigram once while it holds few, so texts are never exploded."""

    def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        return codes, np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 0):
            codes = _grams(["\x02\x02" + t for t in batch.column(0).to_pylist() if t])[0]
            codes.sort()
            first = np.flatnonzero(np.concatenate((np.ones(min(len(codes), 1), bool), codes[1:] != codes[:-1])))
            held.append((codes[first], np.diff(np.append(first, len(codes)))))
            size += len(first)
            if size > HELD_TRIGRAMS:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD_TRIGRAMS // 2:
                    yield pa.RecordBatch.from_arrays(*_spelled(*held[0]))
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays(*_spelled(*merged(held)))

    return rows.select(text).mapInArrow(run, "context string, next string, uses long")


def trigrams_of_lines(lines: DataFrame, line: str) -> DataFrame:
    """(the other columns, context, next, uses) of each line that is not blank: its trigrams, counted, in bounded slices."""
    keys = [c for c in lines.columns if c != line]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            codes, of = _grams([_padded(t) for t in batch.column(0).to_pylist()])
            order = np.lexsort((codes, of))
            codes, of = codes[order], of[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(len(codes), 1), bool), (codes[1:] != codes[:-1]) | (of[1:] != of[:-1]))))
            columns, names = _spelled(codes[first], np.diff(np.append(first, len(codes))))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of[first])) for c in batch.columns[1:]), *columns], [*keys, *names])

    return lines.select(line, *keys).mapInArrow(run, T.StructType([*lines.select(*keys).schema.fields, *(T.StructField(n, k) for n, k in (("context", T.StringType()), ("next", T.StringType()), ("uses", T.LongType())))]))


def _padded(line: str | None) -> str:
    """The line as it is scored: a blank one has no trigram."""
    return "\x02\x02" + line if line and not line.isspace() else ""


def line_losses(lines: DataFrame, table: TrigramTable, line: str) -> DataFrame:
    """``lines`` with ``loss``, where they are: perplexity of each line, 0 for a blank one.  Nothing is shuffled."""
    shared = lines.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            codes, of = _grams([_padded(t) for t in batch.column(at).to_pylist()])
            n = np.bincount(of, minlength=len(batch))
            total = np.bincount(of, weights=shared.value(codes), minlength=len(batch))
            loss = np.where(n > 0, np.exp(-total / np.maximum(n, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(loss)], [*batch.schema.names, "loss"])

    at = lines.columns.index(line)
    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("loss", T.DoubleType())]))


def _forms(tokens: list[str], codes: np.ndarray, table: TrigramTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code, 4 * token + 2 * (opens the line) + (ends it): log probability inside, characters, and the code of the first and the last one (-1: none)."""
    texts = [(" ", " ", "\x02\x02", "\x02\x02")[c & 3] + tokens[c >> 2] + (" ", "", " ", "")[c & 3] for c in codes.tolist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum(sizes)
    grams, of = _grams(texts)
    inside = np.bincount(of, weights=table(grams), minlength=len(texts))
    ending = codes % 2 == 1
    n = sizes - np.where(codes % 4 > 1, 2, 1)
    first = np.where(n > 0, chars[np.minimum(ends - np.maximum(n, 1), len(chars) - 1)], -1)
    return inside, n, first, chars[ends - np.where(ending, 1, 2)]


def _by_document(losses: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean + 0.5 std + 0.25 max / mean."""
    mean = np.add.reduceat(losses, starts) / sizes
    std = np.sqrt(np.add.reduceat((losses - np.repeat(mean, sizes)) ** 2, starts) / sizes)
    return mean + 0.5 * std + 0.25 * np.maximum.reduceat(losses, starts) / (mean + 1e-8)


def _shares(lines: list[list[list[str]]], seeds: np.ndarray, table: TrigramTable, fills: tuple, cumulative: np.ndarray, copies: int, rate: float, mask: str) -> np.ndarray:
    """How many of the copies of each document score above it, as a share; ``seeds``: of each document, for masks and for fills."""
    per_doc = np.array([len(x) for x in lines])
    starts = np.cumsum(per_doc) - per_doc
    flat = [x for doc in lines for x in doc]
    sizes = np.array([len(x) for x in flat])
    blank = np.array([not any(map(str.strip, x)) for x in flat])  # no copy changes these, as no token of theirs is masked
    head = np.cumsum(sizes) - sizes
    ids: dict[str, int] = {}
    token = np.fromiter((ids.setdefault(t, len(ids)) for x in flat for t in x), np.int64, int(sizes.sum()))
    line_of = np.repeat(np.arange(len(flat)), sizes)
    flags = np.zeros(len(token), dtype=np.int64)
    flags[head] += 2
    flags[head + sizes - 1] += 1
    codes, form = np.unique(4 * token + flags, return_inverse=True)
    inside, n, first, last = (np.concatenate(x) for x in zip(fills, _forms(list(ids), codes, table), strict=True))
    form = len(fills[0]) + form

    def cost(at: np.ndarray, forms: np.ndarray) -> np.ndarray:
        own, before = forms[at], last[forms[at - 1]]
        out = inside[own]
        joint = np.flatnonzero((flags[at] < 2) & (first[own] >= 0))
        out[joint] += table(before[joint] | 32 << 21 | first[own[joint]] << 42, blank=True)
        return out

    def loss(total: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return np.where((chars > 0) & ~blank, np.exp(-total / np.maximum(chars, 1)), 0.0)

    base = cost(np.arange(len(form)), form)
    total, chars = np.add.reduceat(base, head), np.add.reduceat(n[form], head)
    losses = loss(total, chars)
    own = _by_document(losses, starts, per_doc)
    low, high = (np.repeat(f.reduceat(losses, starts), per_doc) for f in (np.minimum, np.maximum))
    even = high - low <= 1e-8 + 1e-5 * low
    weight = np.where(even, 0.5, (losses - low) / np.where(even, 1.0, high - low))
    chance = np.array([2.0 if t == mask else float(informative(t)) for t in ids])[token]
    chance = np.where(chance > 1, chance, chance * (rate * (1 + 2 * weight))[line_of])
    place, line_no = _word(np.arange(len(token)) - head[line_of]), _word(np.arange(len(flat)) - np.repeat(starts, per_doc))
    by_line = [_mixed(np.repeat(s, per_doc), line_no) for s in seeds]
    above = np.zeros(len(lines))
    for replica in range(copies):
        which, what = (_mixed(h, _word(replica)) for h in by_line)
        masked = _unit(_mixed(which[line_of], place)) < chance
        at = np.flatnonzero(masked)
        drawn = np.searchsorted(cumulative, _unit(_mixed(what[line_of[at]], place[at])), side="right")
        new = form.copy()
        new[at] = 4 * np.minimum(drawn, len(cumulative) - 1) + flags[at]
        masked[1:] |= masked[:-1].copy()
        changed = np.flatnonzero(masked)
        more = np.bincount(line_of[changed], weights=cost(changed, new) - base[changed], minlength=len(flat))
        longer = np.bincount(line_of[at], weights=n[new[at]] - n[form[at]], minlength=len(flat))
        above += _by_document(loss(total + more, chars + longer), starts, per_doc) > own * (1 + TIE)
    return above / copies


def probabilities(rows: DataFrame, table: TrigramTable, words: list[str], cumulative: list[float], text: str, key: str, copies: int, rate: float, seed: int, mask: str = "<mask>") -> DataFrame:
    """(key, probability): the share of ``copies`` that score above the original; 0 for null.  Draws are those of scoring.uniform."""

    shared = rows.sparkSession.sparkContext.broadcast((table, words or [""], np.array(cumulative or [1.0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, ends = shared.value
        fills = _forms(words, np.arange(4 * len(words)), table)
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            seeds = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]).astype(np.int64).view(np.uint64)
            out, held, taken, size = np.zeros(len(texts)), [], [], 0
            for i, t in enumerate(texts):
                if t is not None:
                    held.append([x.split(" ") for x in t.splitlines() or [""]])
                    taken.append(i)
                    size += sum(map(len, held[-1]))
                if taken and (size >= CHUNK or i == len(texts) - 1):
                    out[taken] = _shares(held, seeds[:, taken], table, fills, ends, copies, rate, mask)
                    held, taken, size = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [key, "probability"])

    hashed = rows.select(key, text, *[F.xxhash64(F.lit(s).cast("long"), key).alias(f"_h{s}") for s in (seed, seed + 1)])
    return hashed.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, probability double")
