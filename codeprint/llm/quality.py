"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprint.llm.common import bounded, maybe_broadcast
from codeprint.llm.hashing import word_hashes

PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
#: Features of a text's surface, and buckets of its lower-cased words' hashes.
SURFACE, BUCKETS = len(PUNCTUATION) + 17, 128
N_FEATURES = SURFACE + BUCKETS
#: What a word's bucket weighs against a feature of the surface: there are many, each of little use.
BUCKET_SCALE = 0.1
#: The confidence that best bin estimation of the prior uses.
DELTA, GAMMA = 0.1, 0.01


def text_features(text: str | None) -> np.ndarray:
    """Counts and ratios over the whole text; null is the empty text, whose features are all zero."""
    out = np.zeros(SURFACE, dtype=np.float64)
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    hist, n = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256), len(data)
    out[: len(PUNCTUATION)] = np.sqrt(hist[PUNCTUATION] / n)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    k = max(len(words), 1)
    counts = Counter(words)
    caps = sum(map(str.isupper, text.split()))
    out[len(PUNCTUATION) :] = (
        hist[65:91].sum() / n, hist[97:123].sum() / n, hist[48:58].sum() / n, hist[128:].sum() / n, hist[32] / n, hist[10] / n,
        np.log1p(n) / 10, np.log1p(len(words)) / 10, len(data) / k / 10, caps / k,
        len(counts) / k, max(counts.values(), default=0) / k, sum(map(eq, words, words[1:])) / k,
        sum(v for v in counts.values() if v > 3) / k, len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)) / 10, sum(v for w, v in counts.items() if not w[-1:].isalnum()) / k,
    )
    return out


def features(column: pa.Array) -> np.ndarray:
    """A row of N_FEATURES for each text: its surface, and the roots of its words' shares of the buckets."""
    hashes, first = word_hashes(column, lower=True, seed=3)
    size = np.diff(first)
    at = np.repeat(np.arange(len(size)), size) * BUCKETS + (hashes >> np.uint64(32)).astype(np.int64) % BUCKETS
    words = np.bincount(at, minlength=len(size) * BUCKETS).reshape(-1, BUCKETS)
    surface = [text_features(t) for t in column.to_pylist()]
    return np.hstack([np.array(surface).reshape(-1, SURFACE), np.sqrt(words / np.maximum(size, 1)[:, None])])


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of both that no row had a part in fitting.

    At each threshold the unlabelled rows above it are at least the prior's share of the positives
    above it, so the ratio bounds the prior from above; it is read where the ratio and its sampling
    error are smallest together (best bin estimation, Garg et al., 2021)."""
    cuts = np.unique(np.concatenate([pos, unl]))
    share = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    p, u = share(pos), share(unl)
    cuts, p, u = cuts[p > 0], p[p > 0], u[p > 0]
    error = np.sqrt(np.log(4 / DELTA) / 2) * (len(pos) ** -0.5 + len(unl) ** -0.5)
    best = int(np.argmin((u + (1 + GAMMA) * error) / p))
    return float(u[best] / p[best])


class NonNegativePU:
    """A network of one hidden layer, fitted to positives and unlabelled rows by the non-negative risk.

    Risk: prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)]), logistic loss;
    where the second term is negative, its gradient is reversed (Kiryo et al., 2017).  Without a
    prior the rows are told apart by the plain logistic loss, as the prior's estimate needs."""

    def __init__(self, prior: float | None, hidden: int = 16, steps: int = 600, rate: float = 0.02, seed: int = 7) -> None:
        self.prior, self.hidden, self.steps, self.rate, self.seed = prior, hidden, steps, rate, seed

    def objective(self, x: np.ndarray, is_pos: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """What one step lessens, without the weights' penalty, and its gradient by the weights."""
        n_p, n_u = is_pos.sum(), (~is_pos).sum()
        h = np.tanh(x @ self.w[0] + self.w[1])
        g = h @ self.w[2] + self.w[3][0]
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        as_pos, as_neg = np.logaddexp(0, -g), np.logaddexp(0, g)
        if self.prior is None:
            value, dg = as_pos[is_pos].mean() + as_neg[~is_pos].mean(), np.where(is_pos, (p - 1) / n_p, p / n_u)
        else:
            rest = as_neg[~is_pos].mean() - self.prior * as_neg[is_pos].mean()
            against = np.where(is_pos, -self.prior * p / n_p, p / n_u)
            if rest >= 0:
                value, dg = self.prior * as_pos[is_pos].mean() + rest, np.where(is_pos, self.prior * (p - 1) / n_p, 0.0) + against
            else:
                value, dg = -rest, -against
        dg = dg.astype(x.dtype)
        dh = np.outer(dg, self.w[2]) * (1 - h * h)
        return float(value), [x.T @ dh, dh.sum(axis=0), h.T @ dg, np.array([dg.sum()])]

    def start(self, both: np.ndarray) -> None:
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0)
        self.scale[self.scale < 1e-9] = 1
        rng, d = np.random.default_rng(self.seed), both.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]

    def fit(self, pos: np.ndarray, unl: np.ndarray) -> NonNegativePU:
        both = np.concatenate([pos, unl])
        self.start(both)
        self.w = [w.astype(np.float32) for w in self.w]
        m, v = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w]
        x, is_pos = self._scaled(both).astype(np.float32), np.arange(len(both)) < len(pos)
        for step in range(1, self.steps + 1):
            grads = self.objective(x, is_pos)[1]
            for i, grad in enumerate(grads):
                if i % 2 == 0:
                    grad = grad + 1e-4 * self.w[i]
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                self.w[i] = (self.w[i] - self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        out = np.clip((x - self.mean) / self.scale, -8, 8)
        out[:, SURFACE:] *= BUCKET_SCALE
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _sampled(texts: DataFrame, seed: int) -> np.ndarray:
    """The features of all texts (a bounded sample), in an order that follows from them alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(list(features(batch.column(0)).astype(np.float32)), pa.list_(pa.float32()))], ["x"])

    rows = texts.mapInArrow(run, "x array<float>").toArrow().column(0).combine_chunks()
    x = rows.flatten().to_numpy().reshape(-1, N_FEATURES) if len(rows) else np.empty((0, N_FEATURES), np.float32)
    return np.random.default_rng(seed).permutation(x[np.lexsort(x.T[::-1])])


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The class prior by two-fold cross-fitting: each half is scored by a network that told the others apart."""
    found = []
    for fold in (0, 1):
        p, u = (np.arange(len(x)) % 2 == fold for x in (pos, unl))
        if not (p.any() and u.any() and (~p).any() and (~u).any()):
            continue
        judge = NonNegativePU(None, steps=150).fit(pos[~p], unl[~u])
        found.append(class_prior(judge.score(pos[p]), judge.score(unl[u])))
    return float(np.clip(np.mean(found), 0.01, 0.99)) if found else 0.5


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000) -> NonNegativePU | None:
    """Fit on at most ``sample`` trusted positives and at most ``sample`` unlabelled documents.

    Both are bounded samples of the rows where ``train`` holds, those with the smallest hash of the
    id.  The positives are the rows labelled 1; the unlabelled ones come from all documents, their
    labels unseen; rows labelled otherwise are not used as such.  The class prior is estimated from
    the two samples alone, and kept 0.01 away from 0 and 1.  Null labels are no labels; without a
    positive or a document there is no model (None).  Rows that repeat an id are all taken; ties of
    the hash go by id."""
    marks = labels.where(train & (F.col(label_col) == 1)).select(F.col(id_col).alias("_id"))
    least = lambda ids, salt: ids.orderBy(F.xxhash64(F.lit(salt), "_id"), "_id").limit(sample)
    wanted = {"pos": least(marks.distinct(), 1), "unl": least(docs.where(train).select(F.col(id_col).alias("_id")), 2)}
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    x = {k: _sampled(texts.join(maybe_broadcast(ids, sample), "_id", "left_semi").select("_text"), i) for i, (k, ids) in enumerate(wanted.items())}
    if not len(x["pos"]) or not len(x["unl"]):
        return None
    return NonNegativePU(estimated_prior(x["pos"], x["unl"])).fit(x["pos"], x["unl"])


def score_quality(docs: DataFrame, model: NonNegativePU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every row; 0.5 without a model.  Nulls are scored as empty texts, equal texts alike.

    The whole text counts, however long; other columns are not read; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            scores = model.score(features(batch.column(1))) if model and len(batch) else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(np.float64), pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double")
