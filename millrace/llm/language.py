"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held_out

#: n-gram lengths, and bits of their hash.
ORDERS, BITS = (1, 2, 3), 15
#: Characters of text that are hashed at once.
BLOCK = 1 << 20
#: Languages that are learned at most, the most frequent first: a bound on the model, whatever stands in lang.
LANGUAGES = 128
#: Documents under this posterior of their best language are rejected by filter_languages.
LEAST_SCORE = 0.5
#: A row belies its own language if another explains its n-grams better by so many nats each: foreign, not mixed, text.
BELIED = 0.75
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, lower-cased, each run of other characters as one space; and each text's end in them.

    A text without a letter has none. The n-grams of each order follow one another within a text's own part.
    """
    cps = np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    # A line end in a text is a space; the ends of the texts are counted from the lower-cased lengths.
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    letter = letters()[cps]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    keep[ends] = True
    c = np.where(letter, cps, 32)[keep].astype(np.uint32)
    place = np.cumsum(keep) - 1
    bounds = place[np.concatenate([[0], ends])]
    mixed = c * np.uint32(0x9E3779B1)
    out = []
    rolling = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        rolling = (rolling ^ (mixed >> np.uint32(3))) * np.uint32(0x85EBCA6B) + np.uint32(n)
        if n in ORDERS:
            out.append(((rolling ^ (rolling >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
        rolling = rolling[: max(0, len(rolling) - 1)]
        mixed = mixed[1:]
    return out, bounds


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > BLOCK:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def _spans(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its first n-gram and the one after its last; a text's n-grams do not reach past its bounds."""
    lo = bounds[:-1]
    return lo, np.maximum(lo, bounds[1:] + 2 - n)


def counts(texts: list[str]) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for some in _blocks(texts):
        grams, bounds = ngrams(some)
        for n, g in zip(ORDERS, grams):
            lo, hi = _spans(bounds, n)
            # A space between two texts counts for both.
            starts = np.bincount(lo[lo < hi], minlength=len(g) + 1) - np.bincount(hi[lo < hi], minlength=len(g) + 1)
            total += np.bincount(g, np.cumsum(starts)[: len(g)], 1 << BITS).astype(np.int64)
    return total


def log_scores(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """For each text and language the sum of its n-grams' log-probabilities; logp: [bucket, language].

    A block's texts are rows of a sparse matrix of n-gram counts, one sorted key for each text and bucket that occurs.
    """
    rows = []
    for some in _blocks(texts):
        grams, bounds = ngrams(some)
        keys = []
        for n, g in zip(ORDERS, grams):
            lo, hi = _spans(bounds, n)
            of = np.repeat(np.arange(len(some)), hi - lo)
            at = np.arange(len(of)) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
            keys.append(of << BITS | g[at])
        keys = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.concatenate([keys[:1] >= 0, keys[1:] != keys[:-1]]))
        times = np.diff(first, append=len(keys))
        of, bucket = keys[first] >> BITS, keys[first] & ((1 << BITS) - 1)
        rows.append(np.stack([np.bincount(of, times * logp[bucket, k], len(some)) for k in range(logp.shape[1])], 1) if logp.shape[1] else np.zeros((len(some), 0)))
    return np.concatenate(rows) if rows else np.zeros((0, logp.shape[1]))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-priors and [bucket, language] log-probabilities from docs (text, lang), add-one smoothed.

    Every partition tallies its own documents; what is shuffled is one row for each language, bucket and partition at
    most, and what comes to the driver is LANGUAGES times 2**BITS counts at most: if lang has more values, those of the
    most rows are learned. Rows with a null text or lang teach nothing.
    """
    docs = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    most = [r.lang for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    docs = docs.where(F.col("lang").isin(most))

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        sizes: dict[str, int] = {}
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                totals[lang] = totals.get(lang, 0) + counts(part.text.tolist())
                sizes[lang] = sizes.get(lang, 0) + len(part)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(total[at], sizes[lang])})

    found = docs.mapInPandas(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found.lang.unique())
    if not langs:
        return [], np.zeros(0), np.zeros((1 << BITS, 0), np.float32)
    n = np.zeros((1 << BITS, len(langs)))
    prior = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = found[found.lang == lang]
        n[own.bucket[own.bucket >= 0], k] = own.n[own.bucket >= 0]
        prior[k] = own.n[own.bucket == -1].sum()
    logp = np.log(n + 1) - np.log(n.sum(0) + len(n))
    return langs, np.log(prior / prior.sum()), logp.astype(np.float32)


def posteriors(texts: list[str], langs: list[str], prior: np.ndarray, logp: np.ndarray) -> tuple[list[str], list[float]]:
    if not langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    return _best(texts, langs, log_scores(texts, logp) + prior)


def _best(texts: list[str], langs: list[str], s: np.ndarray) -> tuple[list[str], list[float]]:
    has_letter = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    best = s.argmax(1)
    score = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)], [float(x) if ok else 0.0 for x, ok in zip(score, has_letter)]


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text): a learned language and its posterior.

    A null text, one without a letter, or a model without languages gives und with score 0. Ties go to the language
    that sorts first. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = posteriors([t or "" for t in batch.column("text").to_pylist()], *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows of docs (doc_id, text, lang) that are not held out."""
    model = train(docs.where(~held_out("doc_id", modulus)))
    return predict(docs, model).select("doc_id", held_out("doc_id", modulus).alias("held_out"), "lang_pred", "score")


def filter_languages(docs: DataFrame, least_score: float = LEAST_SCORE, languages: Collection[str] | None = None) -> DataFrame:
    """docs whose language is recognised, with all columns; learned from docs' own lang.

    A row is rejected if its text is null or has no letter, if the best language's posterior is under least_score, if
    that language is not among `languages` (where given), or if its own lang belies it: the best language's mean
    log-probability of an n-gram is BELIED higher than the own one's. A null lang says nothing, and one that is not
    learned (see train) belies every text. Rows that repeat a doc_id or have none are judged each.
    """
    model = train(docs)
    if not model[0]:
        return docs.where(F.lit(False))
    at, own = docs.columns.index("text"), docs.columns.index("lang")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = shared.value
        number = {x: k for k, x in enumerate(langs)}
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            # The last column counts the n-grams.
            sums = log_scores(texts, np.hstack([logp, np.ones((len(logp), 1), logp.dtype)]))
            preds, scores = _best(texts, langs, sums[:, :-1] + prior)
            kept = []
            for p, score, said, row in zip(preds, scores, batch.column(own).to_pylist(), sums):
                good = p != UNKNOWN and score >= least_score and (languages is None or p in languages)
                if good and said is not None:
                    good = said in number and row[number[p]] - row[number[said]] < BELIED * row[-1]
                kept.append(good)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
