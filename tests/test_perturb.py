"""The perturbation detector against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeprint.operators import perturbed, scoring
from codeprint.plans import catalogue

TEXTS = ["def f(x):\n    return x + 1\n", "a b c d e f g h", "the cat sat on the mat\r\nthe dog ran  off\n\n", "", None, "x", "  = ( )\n### ::", "un café brûlé\tpour la fête 😀 et la mer\nla mer la mer", "the the the the\nthe the the the", "\n", " ", "<mask> of the mat"]


def brute(rows, drawn, words, ends, copies):
    """``drawn``: (seed, id, line, replica, place) -> number."""
    three, two = Counter(), Counter()
    for _, text in rows:
        padded = "\x02\x02" + (text or "")
        for g in zip(padded, padded[1:], padded[2:], strict=False):
            three[g] += 1
            two[g[:2]] += 1

    def loss(line):
        if not line.strip():
            return 0.0
        padded = "\x02\x02" + line
        logs = [math.log((three[g] + 0.1) / (two[g[:2]] + 25.6)) for g in zip(padded, padded[1:], padded[2:], strict=False)]
        return math.exp(-math.fsum(logs) / len(logs)) if logs else 0.0

    def score(losses):
        mean = math.fsum(losses) / len(losses)
        return mean + 0.5 * math.sqrt(math.fsum((x - mean) ** 2 for x in losses) / len(losses)) + 0.25 * max(losses) / (mean + 1e-8)

    def informative(token):
        t = token.strip()
        return not (re.fullmatch(r"[_\-=+*/<>!&|]*", t) or t in {*"{}()[]:;,.#"})

    out = {}
    for key, text in rows:
        if text is None:
            out[key] = 0.0
            continue
        lines = text.splitlines() or [""]
        losses = [loss(x) for x in lines]
        lo, hi, own, above = min(losses), max(losses), score(losses), 0
        for r in range(copies):
            copy = []
            for j, line in enumerate(lines):
                w = 0.5 if math.isclose(lo, hi, rel_tol=1e-5, abs_tol=1e-8) else (losses[j] - lo) / (hi - lo)
                tokens = line.split(" ")
                for i, t in enumerate(tokens):
                    if t == "<mask>" or informative(t) and drawn[42, key, j, r, i] < 0.05 * (1 + 2 * w):
                        tokens[i] = next((x for x, e in zip(words, ends, strict=True) if drawn[43, key, j, r, i] < e), words[-1])
                copy.append(" ".join(tokens))
            above += score([loss(x) for x in copy]) > own * (1 + 1e-10)
        out[key] = above / copies
    return out


def draws(spark, rows, copies):
    places = [(k, j, i) for k, t in rows if t is not None for j, x in enumerate(t.splitlines() or [""]) for i in range(len(x.split(" ")))]
    at = spark.createDataFrame(places, "id long, line_no int, place int").crossJoin(spark.range(copies).select(F.col("id").cast("int").alias("replica")))
    got = at.select("*", *[scoring._draw(s, ("id",), F.col("place")).alias(f"d{s}") for s in (42, 43)]).collect()
    return {(s, r["id"], r["line_no"], r["replica"], r["place"]): r[f"d{s}"] for r in got for s in (42, 43)}


@pytest.mark.parametrize("sent", [scoring.SENT_ROWS, 0], ids=["sent", "joins"])
def test_detect_is_brute_force(spark, sent):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "id long, text string")
    likely = spark.createDataFrame([("mat", 1 / 3), ("z9", 1 / 3), ("the", 1 / 3)], "token string, share double")
    got = scoring.detect(docs, scoring.TrigramScorer(docs), likely, sent=sent).collect()
    want = brute(rows, draws(spark, rows, 30), ["mat", "the", "z9"], [1 / 3, 2 / 3, 1.0], 30)
    assert {r["id"]: round(r["probability"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert all(r["is_machine"] == (r["probability"] > 0.97) for r in got) and 0 < max(want.values())


def test_query_perturbs_every_document_30_times(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["perturb_detect"](spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in got) == [k for k, _ in rows]
    assert all(round(r["probability"] * 30, 6).is_integer() for r in got) and any(not round(r["probability"] * 5, 6).is_integer() for r in got)


@pytest.mark.parametrize("sent", [scoring.SENT_ROWS, 0], ids=["sent", "joins"])
def test_fills_are_drawn_by_share(spark, sent):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "id long, text string")
    likely = spark.createDataFrame([("mat", 0.125), ("z9", 0.125), ("the", 0.75)], "token string, share double")
    got = scoring.detect(docs, scoring.TrigramScorer(docs), likely, sent=sent).collect()
    want = brute(rows, draws(spark, rows, 30), ["the", "mat", "z9"], [0.75, 0.875, 1.0], 30)
    assert {r["id"]: round(r["probability"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize("words", [[f"w{i:03}" for i in range(400)], ["a"] * 50 + [f"w{i}" for i in range(50)], ["a"] * 3 + ["b"] * 3 + [f"c{i}" for i in range(54)]])
def test_nucleus_has_no_row_limit(spark, words):
    got = scoring.corpus_nucleus(spark.createDataFrame([(w,) for w in words], "token string")).collect()
    order = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))
    kept, passed = [], 0
    for i, (w, n) in enumerate(order):
        passed += n
        if not i or passed <= len(words) / 10:
            kept.append((w, n))
    total = sum(n for _, n in kept)
    assert {r["token"]: round(r["share"], 9) for r in got} == {w: round(n / total, 9) for w, n in kept}


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_lines_are_scored_where_they_are(spark):
    """A model that is sent needs no shuffle; a larger one gives the same losses."""
    rows = [(None if i == 9 else i, j, line) for i, t in enumerate(TEXTS) for j, line in enumerate((t or "").splitlines() or [None])]
    lines = spark.createDataFrame(rows, "id long, line_no int, line string")
    scorer = scoring.TrigramScorer(spark.createDataFrame([(t,) for t in TEXTS[:6]], "text string"))
    sent, joined = scorer.line_losses(lines), scorer.line_losses(lines, sent=0)
    assert "Exchange" not in _plan(sent) and sent.columns == ["id", "line_no", "line", "loss"]
    got, want = ({(r["id"], r["line_no"]): round(r["loss"], 9) for r in x.collect()} for x in (sent, joined))
    assert got.keys() == want.keys() and {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None} and max(got.values()) > 0


def test_trigrams_of_long_texts_come_in_slices(spark):
    """One Arrow batch of 8 MB is counted 512 KB at a time, so that no worker holds the trigrams of all its texts."""
    lines = spark.createDataFrame([(i, f"{i} ab " * 50_000) for i in range(40)], "id int, line string").coalesce(1)
    held = perturbed.trigrams_of_lines(lines, "line").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"texts": [len(b.column(0).unique())]}) for b in batches), "texts long")
    counts = perturbed.trigrams_of_lines(lines, "line").groupBy("id").agg(F.sum("uses").alias("n"))
    assert held.agg(F.sum("texts")).first()[0] == 40 and {r["n"] for r in counts.collect()} == {len(f"{i} ab ") * 50_000 for i in range(40)}


def test_entropy_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b a "), (2, ""), (3, None), (4, "x x")], "id int, text string")
    rows = scoring.text_entropy(docs, "id", "text")
    words = docs.select("id", F.explode(F.split("text", " ")).alias("w"))
    want = {r["id"]: r["entropy"] for r in scoring.token_entropy(words, "id", "w").collect()}
    assert {r["id"]: r["entropy"] for r in rows.collect()} == pytest.approx(want) and "Exchange" not in _plan(rows)
    assert "Exchange" not in _plan(catalogue.QUERIES["token_entropy"](spark, "/root/testdata/sf0.001"))


def test_the_model_is_sent_by_broadcast(spark, monkeypatch):
    """Pickled into the function, each task would unpack a model of its own."""
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    likely = spark.createDataFrame([("mat", 1.0)], "token string, share double")
    scoring.detect(docs, scoring.TrigramScorer(docs), likely)
    assert any(isinstance(x, tuple) and isinstance(x[0], perturbed.TrigramTable) for x in sent)
