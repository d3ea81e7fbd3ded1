"""Every stage of the pipeline, and its result, against brute force on a small table with clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
from codeprint.llm.queries import vocabulary
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, position string, _lost int, `a.b` string, _id string"


def documents():
    rng = random.Random(11)
    pools = {"en": ["the", "of", "and", "thing", "with", "wash"], "fr": ["le", "de", "est", "une", "quelle", "eaux"]}
    say = lambda lang, k: " ".join(rng.choice(pools[lang]) + str(rng.randrange(30)) * (rng.random() < 0.5) for _ in range(k))
    base = say("en", 200)
    near = [" ".join(w if rng.random() > 0.006 else "edit%d" % rng.randrange(99) for w in base.split()) for _ in range(20)]
    texts = [None, "", " \t ", "12 !?", "a", "A", "a b", *near, base, base, *(say(lang, rng.randrange(1, 120)) for lang in ("en", "fr") * 40), say("fr", 4000)]
    texts += texts[30:60]
    rng.shuffle(texts)
    langs, sources = ["en", "fr", None], ["src0", "src0", "src1", "src19", "other", None]
    return [(i, t, rng.choice(langs[:2]) if t and "le" in t else langs[i % 3], rng.choice(sources), None, "x", 1, "dot", "y") for i, t in enumerate(texts)]


def shingles(text):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_force(rows):
    lettered = {r[0]: r[1] for r in rows if r[1] and any(map(str.isalpha, r[1]))}
    first: dict[str, int] = {}
    for i in sorted(lettered):
        first.setdefault(lettered[i], i)
    distinct = {i: t for t, i in first.items()}
    sets, root = {i: shingles(t) for i, t in distinct.items()}, {i: i for i in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return lettered, distinct, {i: t for i, t in distinct.items() if find(i) == i}


def test_pipeline(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lettered, distinct, kept = brute_force(rows)
    assert len(rows) > len(lettered) > len(distinct) > len(kept) + 10
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    by_id = {r[0]: r for r in rows}
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (lettered, distinct, kept, kept), strict=True):
        out = stage(spark, step, str(tmp_path))
        assert out.columns == docs.columns, name
        step = corpus_pipeline.materialize(out, "test")
        got = step.collect()
        assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(want), name
        assert all((r[0], r[1], *r[3:]) == (by_id[r[0]][0], by_id[r[0]][1], *by_id[r[0]][3:]) and r["lang"] in ("en", "fr") for r in got), name
    library = Tokenizer.from_file(vocabulary())
    want = set()
    for i, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))))
    result = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in result} == want and len(result) == len(want)


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
