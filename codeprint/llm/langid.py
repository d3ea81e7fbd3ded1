"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprint.llm.common import bounded, maybe_broadcast

UND = "und"
#: Leading bits of the id's hash by which training documents are counted before they are ranked.
LEADING_BITS = 12
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngram_codes(text: str | None) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 characters of the lower-cased words, a blank on both sides of each.

    A code packs up to three code points of 21 bits, so different n-grams have different codes.
    Null and texts without a letter give none."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    points = np.concatenate(([32], np.where(_is_letter()[points], points, 32), [32]))
    blank = points == 32
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(points) < 3:
        return np.empty(0, np.int64)
    two = points[:-1] | points[1:] << 21
    three = two[:-1] | points[2:] << 42
    inner = points[1:-1] != 32  # an n-gram does not run over a blank between words
    return np.concatenate((points[points != 32], two, three[inner]))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def top_ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    grams, n = counted(codes)
    if len(grams) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keep = n >= least
        grams, n = grams[keep], n[keep]
    return grams[np.argsort(-n, kind="stable")][:size]


def fit_profiles(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 300, docs_per_lang: int = 1000) -> dict[str, list[int]]:
    """Each language's ``size`` most frequent n-grams, most frequent first.

    Learnt from at most ``docs_per_lang`` documents of each language (a bounded sample, those with the
    smallest hash of the id) among the rows where ``train`` holds and the language is not null.  Counts
    of the hashes' leading bits show up to which of them the sample reaches, so only rows up to there
    are ranked."""
    ids = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.shiftright(F.xxhash64(id_col), 64 - LEADING_BITS).alias("_lead"))
    sums = ids.groupBy("_lang", "_lead").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_lang").orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = sums.withColumn("_b", earlier).where(F.col("_b") < docs_per_lang).groupBy("_lang").agg(F.max("_lead").alias("_reach"))
    ids = ids.join(maybe_broadcast(reach, reach.count()), "_lang").where("_lead <= _reach").select("_id", "_lang")
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = ids.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= docs_per_lang).drop("_rn").distinct()
    chosen = maybe_broadcast(chosen, chosen.count())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).join(chosen, ["_id", "_lang"], "left_semi").select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(lang, []).append(ngram_codes(text))
            for lang, codes in by.items():
                if len(all_codes := np.concatenate(codes)):
                    grams, n = counted(all_codes)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    totals = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):  # size rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """Profiles as one sorted array of n-grams and their ranks in each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.langs, self.size = sorted(profiles), size
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.int64)), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the smallest out-of-place distance (ties by name) and 1 - distance / largest distance."""
        codes = ngram_codes(text)
        if not len(codes) or not self.langs:
            return UND, 0.0
        own = top_ranked(codes, self.size)
        at = np.searchsorted(self.grams, own)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == own[at < len(self.grams)], at[at < len(self.grams)], len(self.grams))
        ranks = self.ranks[at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = 300) -> DataFrame:
    """id, lang_pred, score (0 to 1) of each row.

    Null texts and texts without a letter give ``und`` and 0, as does an empty set of profiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for batch in bounded(batches, 1):
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those that have no letter, with the language set to the predicted one.

    Where no profile can be learnt, documents with a letter keep the language they have.  Equal rows
    get equal answers; null texts have no letter; other columns pass as they are."""
    profiles = fit_profiles(docs, F.lit(True), id_col, text_col, lang_col)
    at = {c: docs.columns.index(c) for c in (text_col, lang_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, 300)
        for batch in bounded(batches, at[text_col]):
            texts = batch.column(at[text_col]).to_pylist()
            columns = list(batch.columns)
            if model.langs:
                lang = [model.predict(t)[0] for t in texts]
                keep = [x != UND for x in lang]
                columns[at[lang_col]] = pa.array(lang, batch.schema.field(at[lang_col]).type)
            else:
                keep = [len(ngram_codes(t)) > 0 for t in texts]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow resolves names, which may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
