"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprint.llm import bpe, embedding_join, exact, langid, mixing, ngram_join, packing, quality, sharding, substring
from codeprint.llm.common import dataset

VOCABULARY = "word_bpe_49k.json"
#: Target weights of the sources, in parts.
WEIGHTS = {"src0": 8} | {f"src{i}": 2 + i % 3 for i in range(1, 20)}
BLOCK_ROWS = 64
SEQUENCE = 2048


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicate_vectors(dataset(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(dataset(spark, sf_dir, "documents"), vocabulary(), length=SEQUENCE)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(dataset(spark, sf_dir, "documents"), vocabulary())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(dataset(spark, sf_dir, "documents"), n_shards=24)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = dataset(spark, sf_dir, "documents"), dataset(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels, ~quality.held_out())
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dataset(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, WEIGHTS, other=2, block_rows=BLOCK_ROWS)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dataset(spark, sf_dir, "documents")
    profiles = langid.fit_profiles(docs, ~langid.held_out())
    return langid.predict_language(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated_spans(dataset(spark, sf_dir, "documents"), window=50)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(dataset(spark, sf_dir, "documents"), keep="max")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_documents(dataset(spark, sf_dir, "documents"), words=3, percent=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_sequence_packing, op3_bpe, op4_sharding, op5_quality, op6_mixing, op7_language, op8_substring_dedup, op9_exact_dedup, op10_ngram_jaccard)}

ORACLES = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op6_mixing": f"""
        WITH RECURSIVE w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in sorted((WEIGHTS | {"*": 2}).items()))}) AS t(pool, p)),
        q AS (SELECT sum(p)::BIGINT AS q, list(p ORDER BY pool) AS ps, list(pool ORDER BY pool) AS names FROM w),
        run(t, done, pick) AS (
          SELECT 0::BIGINT, [0::BIGINT FOR x IN ps], 0::BIGINT FROM q
          UNION ALL
          SELECT t + 1, [done[i] + CASE WHEN i = chosen THEN 1 ELSE 0 END FOR i IN range(1, len(ps) + 1)], chosen
          FROM (SELECT t, done, ps, list_min([{{'d': ((done[i] + 1) * q + ps[i] - 1) // ps[i], 'i': i}} FOR i IN range(1, len(ps) + 1)
                 IF done[i] * q // ps[i] <= t AND done[i] < ps[i]]).i AS chosen FROM run, q WHERE t < q)),
        plan AS (SELECT names[pick] AS pool, t - 1 AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM run, q WHERE pick > 0),
        ranked AS (SELECT d.doc_id, d.source, coalesce(w.pool, '*') AS pool,
            row_number() OVER (PARTITION BY coalesce(w.pool, '*') ORDER BY coalesce(md5(d.doc_id::VARCHAR), '~'), d.doc_id) - 1 AS r
          FROM documents d LEFT JOIN w ON d.source = w.pool AND w.pool <> '*'),
        placed AS (SELECT doc_id, source, pool, r, r // {BLOCK_ROWS} AS block, (r // {BLOCK_ROWS}) // p AS cycle, (r // {BLOCK_ROWS}) % p AS k, p FROM ranked JOIN w USING (pool))
        SELECT doc_id, source, pool, block::BIGINT AS block, (cycle * q + k * q // p)::BIGINT AS release, (cycle * q + ((k + 1) * q + p - 1) // p)::BIGINT AS deadline,
          (cycle * q + place)::BIGINT AS slot, row_number() OVER (ORDER BY cycle * q + place, r) - 1 AS position
        FROM placed JOIN plan USING (pool, k), q""",
}
