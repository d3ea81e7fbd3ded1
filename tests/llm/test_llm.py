"""The training-data operators against brute force, on rows with nulls, blanks, long texts, copies and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeprint.llm import bpe, embedding_join, exact, langid, mixing, ngram_join, packing, quality, sharding, substring
from codeprint.llm.common import prepare
from codeprint.llm.graph import components
from codeprint.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, _text string, n int, shard int"


def rows_of(texts, start=0):
    return [(i + start, t, "en" if i % 2 else "fr", None if i % 7 == 0 else f"src{i % 3}", "x", 1, 9) for i, t in enumerate(texts)]


def corpus():
    rng = random.Random(3)
    say = lambda k: " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "théta"]) + str(rng.randrange(40)) for _ in range(k))
    shared, base = say(60), say(120)
    near = [" ".join(w if rng.random() > 0.004 else "edit%d" % rng.randrange(999) for w in base.split()) for _ in range(25)]
    texts = [None, "", " \t\n", "a", "a b", "A B", *near, base, base, base + " ", say(40) + " " + shared, shared + "\n" + say(30), say(20) + " " + shared + " " + shared, shared, say(3000), *(say(rng.randrange(1, 90)) for _ in range(30))]
    return texts + texts[8:12]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(rows_of(corpus()), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def merged(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = merged({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}


def test_exact(docs, empty):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    got = {r["doc_id"]: r for r in exact.exact_duplicates(docs, keep="max").collect()}
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in got.items()} == {i: (max(groups[t]), len(groups[t]), max(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    assert exact.drop_exact_duplicates(docs).count() == len(groups) and exact.exact_duplicates(empty).isEmpty()
    assert {i: (r["keep_id"], r["group_size"]) for i, r in ((r["doc_id"], r) for r in exact.exact_duplicates(docs, keep="max", broadcast_rows=0).collect())} == {i: (max(groups[t]), len(groups[t])) for i, t in texts.items()}


def test_exact_compares_bytes_where_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(exact, "content_hash", lambda t: F.unhex(F.md5(F.substring(t, 1, 1))))
    rows = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab"), (4, None), (5, ""), (6, "b"), (None, "ac"), (7, "ad")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(rows).collect()}
    assert got == {(1, 1, 2, True), (3, 1, 2, False), (2, 2, 2, True), (None, 2, 2, False), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 1, True), (7, 7, 1, True)}


REPEATED = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "p q r s t u", "x"), (2, "a b c d e f", "z"), (None, "a b c d e f", "n"), (None, "k l m n o p", "n"), (None, "k l m n o p", "n"), (3, None, "x"), (3, None, "x"), (4, "A b c d e f", "w")]


def test_rows_that_repeat_an_id_or_have_none(spark):
    rows = spark.createDataFrame(REPEATED, "doc_id long, text string, `a.b` string")
    left = exact.drop_exact_duplicates(rows)
    assert left.columns == rows.columns
    assert sorted((str(r[0]), str(r[1])) for r in left.collect()) == sorted([("1", "a b c d e f"), ("1", "p q r s t u"), ("None", "k l m n o p"), ("3", "None"), ("4", "A b c d e f")])
    one = ngram_join.keep_one_of_each(rows)
    assert one.columns == rows.columns
    got = sorted((str(r[0]), str(r[1]).lower()) for r in one.collect())
    # a null id comes first, so it stays for the six words that are equal but for case
    assert got == sorted([("None", "a b c d e f"), ("1", "p q r s t u"), ("None", "k l m n o p"), ("3", "none")])


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_words_of_thue_morse_form_do_not_collide(spark):
    import pyarrow as pa

    from codeprint.llm.hashing import word_hashes

    x, y = ("".join("ab"[b ^ flip] for b in thue_morse(2048)) for flip in (0, 1))
    hashes, _ = word_hashes(pa.array([f"{x} {y} {x}", "a\0 a", y]))
    assert len(set(hashes.tolist())) == 4 and hashes[0] == hashes[2] and hashes[1] == hashes[5]
    texts = [f"{x}-pattern", f"{y}-pattern", " ".join(f"{x}{i}" for i in range(60)), " ".join(f"{y}{i}" for i in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicate_documents(rows, 3, 90).collect()} == {i: i for i in range(4)}
    assert {r["n_removed"] for r in substring.remove_repeated_spans(rows, 50).collect()} == {0}


def test_hash_collisions_make_no_link_and_remove_nothing(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(120)), " ".join(f"v{i}" for i in range(120)), " ".join(f"w{i}" for i in range(120))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blind = lambda column, lower=False, seed=1: (np.concatenate([np.arange(len((t or "").split()), dtype=np.uint64) for t in column.to_pylist()]), np.cumsum([0, *(len((t if isinstance(t, str) else (t or b"").decode()).split()) for t in column.to_pylist())]))
    monkeypatch.setattr(substring, "word_hashes", blind)
    monkeypatch.setattr(ngram_join, "word_hashes", blind)
    links = ngram_join._linked(spark.createDataFrame([((0, ngram_join.md5(texts[0].encode()).digest()), (1, ngram_join.md5(texts[1].encode()).digest()))], "a struct<_id:long,m:binary>, b struct<_id:long,m:binary>"), ngram_join._described(rows, 3, 90, "doc_id", "text"), rows, 3, 90, "doc_id", "text")
    assert links.isEmpty()


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, empty, words, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").translate(low))
        sets[r["doc_id"]] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_documents(docs, words, percent).collect()} == {i: (len(sets[i]), c) for i, c in merged(sets, links).items()}
    assert ngram_join.near_duplicate_documents(empty).isEmpty()


@pytest.mark.parametrize(("bitmap_keys", "bits"), [(1 << 22, 64), (0, 64), (1 << 22, 1)])
def test_substring(docs, empty, bitmap_keys, bits, monkeypatch):
    """By the bitmap, by shuffles, and where paths of a minimizer share a hash."""
    monkeypatch.setattr(substring, "path_hash", lambda words: F.xxhash64(words).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1)))
    texts = {r["doc_id"]: WORD.findall(r["text"] or "") for r in docs.collect()}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][k : k + 50]), i)
    want = {}
    for i, w in texts.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = substring.remove_repeated_spans(docs, 50, with_text=True, bitmap_keys=bitmap_keys).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in got} == want
    assert sum(w[1] for w in want.values()) > 100 and substring.remove_repeated_spans(empty).isEmpty()


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 64))
    x = np.concatenate([x, x[:20] * 3, x[0] + 0.15 * rng.normal(size=(60, 64)), x[5:6], x[5:6]])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] + [1.0] * 63, 1), (904, [], 1), (905, x[0][:32].tolist(), 1)]
    got = {r["vec_id"]: r for r in embedding_join.near_duplicate_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int"), 0.95).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    part = merged(range(len(x)), [(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True)])
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(len(x))] == [(int(linked[i].sum()) - 1, part[i], part[i] == i) for i in range(len(x))]
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(900, 906))


def test_embeddings_of_an_empty_table_and_odd_ids(spark):
    kind = "vec_id long, embedding array<float>, n_links string"
    assert embedding_join.near_duplicate_vectors(spark.createDataFrame([], kind)).isEmpty()
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = spark.createDataFrame([(5, a, "x"), (5, b, "x"), (None, a, "x"), (7, a, "x"), (9, b, "x"), (11, None, None)], kind)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embedding_join.near_duplicate_vectors(rows).collect())
    assert got == sorted([("5", 1, "5", True), ("5", 1, "5", True), ("None", 0, "None", True), ("7", 1, "5", False), ("9", 1, "5", False), ("11", 0, "11", True)])


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(700, 64))
    x = np.concatenate([rng.normal(size=(4000, 64)), np.repeat(centres, 5, axis=0) + 0.13 * rng.normal(size=(3500, 64)), centres[0] + 0.1 * rng.normal(size=(800, 64))]).astype(np.float32)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    part = merged(range(len(x)), zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True))
    assert linked.sum() > 100_000 and got == {i: (int(linked[i].sum()), part[i]) for i in range(len(x))}


def test_pigeonhole_tiles_find_each_pair_once():
    rng = np.random.default_rng(4)
    x = embedding_join.rotated(np.repeat(rng.normal(size=(30, 64)), 5, axis=0) + 0.1 * rng.normal(size=(150, 64)))
    found = Counter()
    for b in range(len(embedding_join.block_starts(64))):
        found.update(zip(*map(np.ndarray.tolist, embedding_join.tile_links(x, None, b, 0.95)), strict=True))
    assert found == Counter((i, j) for i in range(150) for j in range(i + 1, 150) if x[i] @ x[j] >= 0.95)


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    mine = bpe.codec(vocabulary())
    rng = random.Random(5)
    odd = ["", " <|endoftext|>a<|startoftext|>", "ΑΣ İstanbul", "it's WE'LL don't", "a\x1cb \x85c", "日本 ½²é ǆ ﬁ", "a\0b", "é", *("".join(rng.choice("aeinrst  '.!01éÈßΣ́日\n\xa0") for _ in range(50)) for _ in range(200))]
    for text, (ids, decoded, n) in zip(odd, mine.encode_batch(odd), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == library.decode(want, skip_special_tokens=False) == mine.decode(want)
    small = bpe.TrieBpe(vocabulary(), limit=1000)
    assert [small.encode(t) for t in odd[:20]] == [mine.encode(t) for t in odd[:20]]
    got = {r["doc_id"]: r for r in bpe.digest_documents(docs, vocabulary()).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.digest_documents(empty, vocabulary()).isEmpty()


def test_packing(docs, empty):
    rng = random.Random(6)
    sizes = [rng.randrange(1, 65) for _ in range(300)]
    rows, free, naive = packing.best_fit_decreasing(sizes, 64), [], []
    assert sorted(i for r in rows for i in r) == list(range(300))
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        fits = [k for k, f in enumerate(free) if f >= sizes[i]]
        if fits:
            k = min(fits, key=lambda k: free[k])
            free[k] -= sizes[i]
            naive[k].append(i)
        else:
            free.append(64 - sizes[i])
            naive.append([i])
    assert len(rows) == len(naive) and all(sum(sizes[i] for i in r) <= 64 for r in rows)
    shape = lambda packed: sorted(sorted(sizes[i] for i in r) for r in packed)
    assert sorted(map(sum, shape(rows))) == sorted(map(sum, shape(naive))) and max(len(r) for r in rows) == max(len(r) for r in naive)
    back = defaultdict(dict)
    for r in packing.pack_documents(docs, vocabulary(), length=128).collect():
        assert len(r["ids"]) == len(r["position_ids"]) == 128
        for doc, at, a, b in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            back[doc][at] = r["ids"][a:b]
            assert r["position_ids"][a:b] == list(range(b - a))
    mine = bpe.codec(vocabulary())
    assert {d: [x for _, p in sorted(v.items()) for x in p] for d, v in back.items()} == {r["doc_id"]: [*mine.encode(r["text"]), 49407] for r in docs.collect()}
    assert packing.pack_documents(empty, vocabulary()).isEmpty()


def test_sharding(docs, empty, tmp_path):
    rows = sharding.shard_documents(docs, n_shards=5).collect()
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert rows and all(r["law"] == "rows" and r["grown_shard"] is None for r in rows) and sharding.shard_documents(empty).isEmpty()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    again = sharding.shard_documents(docs.repartition(7, "text"), n_shards=5).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in again} == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    plain = docs.select("doc_id", "text")
    sharding.write_shards(plain, str(tmp_path / "shards"), n_shards=5)
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(r["doc_id"], r["text"]) for r in plain.collect()} and back.count() == plain.count()
    assert {n for (n,) in back.groupBy("shard").count().select("count").collect()} <= {len(texts) // 5, len(texts) // 5 + 1}


def test_sharding_of_rows_without_ids(spark):
    rows = spark.createDataFrame([(None, str(i % 40)) for i in range(200)] + [(7, "x")] * 20, "doc_id long, text string")
    got = sharding.shard_documents(rows, n_shards=3).collect()
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert {k: sorted(v) for k, v in per.items()} == {0: list(range(74)), 1: list(range(73)), 2: list(range(73))}


def test_communication_matrix_of_any_size():
    matrix = sharding.communication_matrix([7, 0, 20, 13], [14, 13, 13], 1)
    assert matrix.sum(axis=1).tolist() == [7, 0, 20, 13] and matrix.sum(axis=0).tolist() == [14, 13, 13]
    blocks, shards = [10**10 + i for i in range(12)], [0] * 24
    for i in range(24):
        shards[i] = sum(blocks) // 24 + (i < sum(blocks) % 24)
    big = sharding.communication_matrix(blocks, shards, 1)
    assert big.sum(axis=1).tolist() == blocks and big.sum(axis=0).tolist() == shards
    mean = np.outer(np.array(blocks, float), np.array(shards, float)) / sum(blocks)
    z = (big - mean) / np.sqrt(mean * (1 - 1 / 24) * (1 - 1 / 12))
    assert 0.9 < z.std() < 1.1 and abs(z).max() < 5


def test_own_hypergeometric_draws_have_numpys_law(monkeypatch):
    monkeypatch.setattr(sharding, "SMALL_POPULATION", 0)
    rng = np.random.default_rng(2)
    for good, bad, n in ((30, 50, 20), (5, 400, 60), (1000, 3, 500), (4, 4, 8), (9, 0, 3)):
        own = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)])
        ref = rng.hypergeometric(good, bad, n, 4000)
        assert own.min() >= max(0, n - bad) and own.max() <= min(n, good)
        assert abs(own.mean() - ref.mean()) <= 5 * (ref.std() + 1e-9) / 4000**0.5 * 2 and abs(own.std() - ref.std()) <= 0.1 * ref.std() + 1e-9


def test_every_place_is_as_likely(spark):
    rows = spark.range(24).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    found = np.zeros((24, 4))
    for seed in range(12):
        for r in sharding.shuffle_into_shards(rows, "doc_id", 4, seed).select("doc_id", "shard").toArrow().to_pylist():
            found[r["doc_id"], r["shard"]] += 1
    assert ((found - 3) ** 2 / 3).sum() < 24 * 3 + 4 * (2 * 72) ** 0.5


@pytest.mark.parametrize("parts", [{"a": 1}, {"a": 8, "b": 3, "c": 2, "d": 4}, {f"s{i}": 1 + i % 5 for i in range(13)}])
def test_pfair_keeps_within_one_block(parts):
    plan, q = mixing.pfair_cycle(parts), sum(parts.values())
    assert sorted(t for s in plan.values() for t in s) == list(range(q))
    for name, slots in plan.items():
        assert all(abs(sum(s < t for s in slots) - parts[name] * t / q) < 1 for t in range(q + 1))


def test_mixing(docs, empty):
    rows = sorted(mixing.mix_sources(docs, {"src0": 3, "src1": 1}, 2, 4).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(docs.count())) and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"*": 3}).count()
    assert [r["slot"] for r in rows] == sorted(r["slot"] for r in rows) and mixing.mix_sources(empty, {"src0": 1}).isEmpty()


def test_language(spark, empty):
    rng = random.Random(7)
    words = {"en": ["the", "of", "thing", "wash", "and", "with"], "fr": ["le", "de", "est", "une", "quelle", "eaux"]}
    texts = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    rows = spark.createDataFrame([*texts, (900, None, "en"), (901, "12 !?", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict_language(rows, langid.fit_profiles(rows, ~langid.held_out())).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in texts) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert langid.keep_identified(rows).count() == 80
    assert langid.predict_language(empty, langid.fit_profiles(empty, F.lit(True))).isEmpty()


def out_of_place(text, profiles, size):
    """Brute force: n-grams as strings, ranks as dictionaries."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    grams = Counter(g for w in words for p in [f" {w} "] for n in (1, 2, 3) for g in (p[i : i + n] for i in range(len(p) - n + 1)) if g != " ")
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    own = [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][:size]
    if not own:
        return "und", 0.0
    far = {k: sum(abs(p.index(code(g)) - i) if code(g) in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (size * len(own))


def test_language_against_brute_force(spark):
    rng = random.Random(13)
    say = lambda a, k: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 9))) for _ in range(k))
    texts = [say("abcdeé", 40), say("xyzß日", 60), say("abxy", 3), "A", "!?", None, say("abcdexyz", 9000), "é" * 3000]
    rows = spark.createDataFrame([(i, t, l, "c") for i, (t, l) in enumerate(zip([*texts, *texts], ["one", "two", None, None] * 4, strict=True))], "doc_id long, text string, lang string, lang_pred string")
    profiles = langid.fit_profiles(rows, F.lit(True), size=50)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_language(rows, profiles, size=50).collect()}
    for i, t in enumerate([*texts, *texts]):
        want = out_of_place(t, profiles, 50)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1]), t
    twins = {"b": profiles["one"], "a": profiles["one"]}  # ties go by name
    assert {r["lang_pred"] for r in langid.predict_language(rows.where("text = 'A'"), twins, size=50).collect()} == {"a"}


def test_without_profiles_only_texts_without_letters_go(spark):
    rows = spark.createDataFrame([(1, "hello", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.keep_identified(rows).collect()] == [(1, "hello", None)]


def test_risk_gradient_against_finite_differences():
    rng = np.random.default_rng(1)
    x, is_pos = rng.normal(size=(60, 7)), np.arange(60) < 25
    for prior in (None, 0.3, 0.99):
        net = quality.NonNegativePU(prior, hidden=4)
        net.start(x)
        for shift in (0.0, -3.0):  # with and without a negative second term
            net.w[3] = np.array([shift])
            _, grads = net.objective(x, is_pos)
            for w, grad in zip(net.w, grads, strict=True):
                for at in np.ndindex(w.shape):
                    kept = w[at]
                    w[at] = kept + 1e-6
                    up = net.objective(x, is_pos)[0]
                    w[at] = kept - 1e-6
                    down = net.objective(x, is_pos)[0]
                    w[at] = kept
                    assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.9])
def test_prior_is_estimated_from_unlabelled_rows(prior):
    rng = np.random.default_rng(int(prior * 100))
    pos = rng.normal(1, 0.7, (1500, 5))
    unl = np.where(rng.random(3000)[:, None] < prior, rng.normal(1, 0.7, (3000, 5)), rng.normal(-1, 0.7, (3000, 5)))
    assert abs(quality.estimated_prior(pos, unl) - prior) < 0.08


def test_quality(spark, empty):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["we", "went", "home", "again", "quietly"]) for _ in range(40)) + "."
    rows = [(i, good() if i % 4 else good().upper().replace(" ", "!! ")) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 3)] + [(901, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels, ~quality.held_out())).collect()}
    assert len(got) == 402 and np.mean([(got[i] >= 0.5) == (i % 4 > 0) for i in range(400)]) > 0.95
    assert quality.fit_quality(empty.select("doc_id", "text"), labels.limit(0), F.lit(True)) is None


def test_wide_parity_bitmaps_fold_and_bound_the_distance():
    rng = np.random.default_rng(3)
    x = rng.integers(1, 2**63, 900, dtype=np.uint64)
    for n in (1, 64, 300, 900):
        assert 64 * ngram_join.wide_words(n) >= n
    long, short = ngram_join.parity_words(x, 16), ngram_join.parity_words(x, 8)
    assert (long[:8] ^ long[8:] == short).all()
    apart = np.bitwise_count(ngram_join.parity_words(x[:-20], 16).view(np.uint64) ^ long.view(np.uint64)).sum()
    assert 0 < apart <= 20


def test_library_words_have_the_trie_ids():
    texts = ["it's a <|endoftext|> test", "ÉCOLE Σας 日本 x12!?", "", None, "unbelievably " * 3]
    path = vocabulary()
    assert list(bpe.LibraryBpe(path).id_strings(texts)) == list(bpe.TrieBpe(path).id_strings(texts))


def test_words_are_cut_like_the_library_whatever_the_age_of_unicode_tables():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(vocabulary()), random.Random(9)
    chars = [*map(chr, range(0x900)), *"aeinrst '.!"] + [*"\u1e01\u3000\u1e9e\u0323\u0325\u058b"] * 40 + ["<|endoftext|>"] * 20
    texts = ["s\u058c", "\u073b\u058b", "c\u0323s\u058c", "\u07fd\u081b", "'tis ''s !'t 'LL", *("".join(rng.choices(chars, k=30)) for _ in range(2000))]
    want = [" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]
    for kind in (bpe.TrieBpe, bpe.LibraryBpe):
        assert list(kind(vocabulary()).id_strings(texts)) == want


@pytest.mark.parametrize("kind", [bpe.TrieBpe, bpe.LibraryBpe])
def test_words_that_come_back_are_encoded_once(kind, monkeypatch):
    """Ever new words between them must not drive words in use out of a full table, nor let it grow."""
    codec, asked = kind(vocabulary(), limit=200_000), Counter()
    plain = codec.encode_words

    def counted(words):
        asked.update(words)
        return plain(words)

    monkeypatch.setattr(codec, "encode_words", counted)
    letters = "abcdefghij"
    for i in range(120):
        fresh = ["".join(letters[int(d)] for d in str(1000 * i + k)) + "x" for k in range(300)]
        list(codec.id_strings([" ".join([*fresh, "often"] if i % 2 else [*fresh, "seldom"])]))
    assert asked["often"] <= 2 and asked["seldom"] <= 2 and len(codec.words) < 2500


def test_a_batch_looks_up_each_word_once():
    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    codec = bpe.LibraryBpe(vocabulary())
    codec.words = Counted(codec.words)
    got = list(codec.id_strings(["it's a plain tést", None, "a"] * 500))
    assert Counted.asked <= 5 and got == list(bpe.TrieBpe(vocabulary()).id_strings(["it's a plain tést", None, "a"])) * 500


def test_words_begin_where_the_pattern_finds_them():
    codec, rng = bpe.LibraryBpe(vocabulary()), random.Random(12)
    texts = ["", "'", "'r", "'re", "a've", "'s's''ll", "'d1'mé", "!'s 's! 're're", "\0'\0a\0", *("".join(rng.choices("aelrstvmd'''1 !é\0\u00bd\xa0\n\u0301", k=25)) for _ in range(3000))]
    for text in texts:
        raw = np.frombuffer(text.encode() + b"\n\n\n", np.uint8)
        starts, inside = bpe.word_starts(raw, codec.classes)
        want = [(len(text[: m.start()].encode()), m[0].encode()) for m in codec.pattern.finditer(text)]
        assert np.flatnonzero(starts).tolist() == [at for at, _ in want] and raw[inside].tobytes() == b"".join(w for _, w in want)


def test_ids_of_mixed_batches_keep_their_order():
    texts = ["a b", "x <|endoftext|> y", None, "日本 a", "", "it's", "<| no", "s\u058c", "a b", " \n"]
    each = bpe.LibraryBpe(vocabulary())
    for batch in (texts, texts[2:3], [], texts[1:2], texts[::-1]):
        assert [x.tolist() for x in bpe.LibraryBpe(vocabulary()).id_arrays(batch)] == [next(each.id_arrays([t])).tolist() for t in batch]
        assert [" ".join(map(str, x.tolist())) for x in each.id_arrays(batch)] == list(bpe.TrieBpe(vocabulary()).id_strings(batch))


def test_words_merged_in_arrays_have_the_library_ids():
    """Words of every length, of few and of many kinds of bytes, long ones too; each pair of the table is found, others are not."""
    codec, rng = bpe.LibraryBpe(vocabulary()), random.Random(14)
    kinds = ["ab", "aaab", "thein", "0123456789", "!?.", "\0'", "éßçñü", "abcdefghijklmnopqrstuvwxyz"]
    words = sorted({"".join(rng.choices(rng.choice(kinds), k=rng.randrange(1, 45))) for _ in range(6000)} | {t.removesuffix("</w>") for t in codec.names.values() if t.isascii() and t.isprintable() and "<" not in t})
    rng.shuffle(words)
    alone = [x for w in words[:300] for x in codec.by_library([w])]
    assert codec.by_arrays(words) == codec.by_library(words) and codec.by_arrays(words[:300]) == alone
    assert [w for w, _ in codec.encode_words(words)] == words and codec.by_arrays(["a"]) == codec.by_library(["a"])
    ranks = {(rng.randrange(500), rng.randrange(500)): r for r in range(3000)}
    left, right = map(np.ravel, np.meshgrid(np.arange(500), np.arange(500)))
    for known in (ranks, dict(list(ranks.items())[:1]), {}):
        assert bpe.PairTable(known).of(left, right).tolist() == [known.get(x, bpe.NONE) for x in zip(left.tolist(), right.tolist(), strict=True)]


def test_digests_follow_the_library_where_unicode_tables_differ(spark):
    from tokenizers import Tokenizer

    texts, library = ["s\u058c", "\u073b\u058b a", "\u07fd\u081b", "plain"], Tokenizer.from_file(vocabulary())
    got = {r["doc_id"]: r for r in bpe.digest_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary()).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ngram_join_removes_what_it_wrote_on_its_way(docs):
    from codeprint import scratch

    before = set(scratch._written)
    got = ngram_join.near_duplicate_documents(docs, words=3, percent=60)
    left = Counter(path.rsplit("/", 1)[1].split("-")[1] for path in set(scratch._written) - before)
    assert got.count() == docs.count() and set(left) <= {"sets", "components", "edges", "links"} and left["sets"] == left["components"] == 1
