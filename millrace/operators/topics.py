"""Latent Dirichlet allocation over tokens (doc_id, pos, word, topic).

Counts are aggregates. A sweep resamples each token from its document's counts and the sweep's word and topic counts
(stale within the sweep): blocks of documents pull the word-topic counts of their words by a join on the word, and each
block's documents are sampled side by side in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import log_gamma
from ..sources.shared import bucketed, discard, written

#: Tokens of the documents that a task samples side by side.
BLOCK = 1 << 21
#: Rows of blocks' tallies that a task adds up.
SHARD = 1 << 20


def initial_topics(tokens: DataFrame, topics: int, seed: int) -> DataFrame:
    """tokens (doc_id, pos, word) with a uniform topic, a function of the token's place and seed alone."""
    return tokens.withColumn("topic", F.pmod(F.xxhash64("doc_id", "pos", F.lit(seed)), F.lit(topics)).cast("int"))


def word_topics(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word", "topic").agg(F.count("*").alias("n"))


def document_topics(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "topic").agg(F.count("*").alias("n"))


def topic_totals(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("topic").agg(F.count("*").alias("n"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """word, topic, n: the non-zero differences of word-topic counts between two states of the tokens."""
    both = word_topics(after).unionByName(word_topics(before).withColumn("n", -F.col("n")))
    return both.groupBy("word", "topic").agg(F.sum("n").alias("n")).where("n != 0")


def document_likelihood(tokens: DataFrame, topics: int, alpha: float) -> DataFrame:
    """One row: the log-likelihood of the topics given the documents' Dirichlet(alpha)."""
    cells = document_topics(tokens)
    per_doc = cells.groupBy("doc_id").agg(F.sum(log_gamma(F.col("n") + F.lit(alpha)) - log_gamma(F.lit(alpha))).alias("s"), F.sum("n").alias("n"))
    return per_doc.agg(F.sum(F.col("s") + log_gamma(F.lit(topics * alpha)) - log_gamma(F.col("n") + F.lit(topics * alpha))).alias("llh"))


def word_likelihood(tokens: DataFrame, vocabulary: int, beta: float) -> DataFrame:
    """One row: the log-likelihood of the words given the topics' Dirichlet(beta)."""
    per_topic = word_topics(tokens).groupBy("topic").agg(F.sum(log_gamma(F.col("n") + F.lit(beta)) - log_gamma(F.lit(beta))).alias("s"), F.sum("n").alias("n"))
    return per_topic.agg(F.sum(F.col("s") + log_gamma(F.lit(vocabulary * beta)) - log_gamma(F.col("n") + F.lit(vocabulary * beta))).alias("llh"))


def resampled(first: np.ndarray, code: np.ndarray, z: np.ndarray, counts: np.ndarray, totals: np.ndarray, draws: np.ndarray, alpha: float, beta: float, vocabulary: int) -> np.ndarray:
    """New topics of the tokens of documents first[d] to first[d + 1]; z: topics so far, counts: [code, topic] of the sweep.

    Documents are lanes that take a token each at a time: a document's counts change with each of its tokens, and no
    document's depend on another.
    """
    sizes, topics, z = np.diff(first), len(totals), z.copy()
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[:-1][order], sizes[order]
    lane = np.repeat(np.argsort(order), np.sort(sizes)[::-1][np.argsort(order)])
    own = np.bincount(z * len(sizes) + lane, minlength=topics * len(sizes)).reshape(topics, -1).astype(float)
    smooth, whole, less = counts + beta, (totals + vocabulary * beta)[:, None], (totals - 1) + vocabulary * beta
    counted = (counts[code, z] - 1) + beta
    live, lanes = len(sizes), np.arange(len(sizes))
    for t in range(sizes[0] if len(sizes) else 0):
        while sizes[live - 1] <= t:
            live -= 1
        at, ks = first[:live] + t, lanes[:live]
        old, mine = z[at], own[:, :live]
        mine[old, ks] -= 1
        p = smooth[code[at]].T.copy()
        p *= mine + alpha
        p /= whole
        p[old, ks] = (mine[old, ks] + alpha) * counted[at] / less[old]
        for k in range(1, topics):
            p[k] += p[k - 1]
        new = np.minimum((p <= draws[at] * p[-1]).sum(0), topics - 1)
        mine[new, ks] += 1
        z[at] = new
    return z


def runs(tokens: DataFrame) -> DataFrame:
    """Tokens of one document that follow each other, as a row: doc_id, at (the first's pos), and arrays word and topic."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("doc_id")
                same = pc.or_kleene(pc.equal(ids[1:], ids[:-1]).fill_null(False), pc.and_(ids[1:].is_null(), ids[:-1].is_null()))
                follows = same.to_numpy(zero_copy_only=False) & (np.diff(batch.column("pos").to_numpy()) == 1)
                starts = np.concatenate([[0], np.flatnonzero(~follows) + 1])
                offsets, starts = pa.array([*starts, batch.num_rows], pa.int32()), pa.array(starts)
                yield pa.RecordBatch.from_arrays([ids.take(starts), batch.column("pos").take(starts), *(pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("word", "topic"))], ["doc_id", "at", "word", "topic"])

    kind = tokens.schema["word"].dataType.simpleString()
    tokens = tokens.select(F.col("doc_id").cast("long"), F.col("pos").cast("int"), "word", F.col("topic").cast("int"))
    return tokens.mapInArrow(pack, f"doc_id long, at int, word array<{kind}>, topic array<int>")


def documents(words: DataFrame, topics: int, seed: int) -> DataFrame:
    """words (doc_id, word: array) as runs, with the topics of initial_topics()."""
    draw = F.transform("word", lambda w, k: F.pmod(F.xxhash64("doc_id", k, F.lit(seed)), F.lit(topics)).cast("int"))
    return words.where(F.size("word") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("at"), "word", draw.alias("topic"))


def sweep(tokens: DataFrame, topics: int, alpha: float, beta: float, vocabulary: int, seed: int) -> DataFrame:
    """tokens after one sweep of collapsed Gibbs sampling; the draws depend on document, seed and counts alone."""
    done = sweep_documents(runs(tokens), tokens.count(), topics, alpha, beta, vocabulary, seed)
    return done.select("doc_id", "at", F.posexplode(F.arrays_zip("word", "topic"))).select("doc_id", (F.col("at") + F.col("pos")).alias("pos"), "col.word", "col.topic")


def sweep_documents(docs: DataFrame, tokens: int, topics: int, alpha: float, beta: float, vocabulary: int, seed: int) -> DataFrame:
    """As sweep(), of and to runs (doc_id, at, word, topic) with so many tokens in all.

    Documents are dealt to blocks of about BLOCK tokens. A block tallies its distinct words, shards of words add the
    tallies up and answer each block with its words' counts: a frequent word moves once a block, a token with its
    document only.
    """
    kind = docs.schema["word"].dataType.elementType.simpleString()
    blocks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-tokens // BLOCK))
    docs = bucketed(docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")), "documents", ["block"], blocks)

    def tally(block: pa.Table) -> pa.Table:
        coded = pc.list_flatten(block["word"]).combine_chunks().dictionary_encode()
        known = coded.is_valid().to_numpy(zero_copy_only=False)
        cells = coded.indices.filter(coded.is_valid()).to_numpy().astype(np.int64) * topics + pc.list_flatten(block["topic"]).to_numpy()[known]
        n = np.bincount(cells, minlength=len(coded.dictionary) * topics)
        some = np.flatnonzero(n)
        offsets = pa.array(np.searchsorted(some // topics, np.arange(len(coded.dictionary) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((some % topics).astype(np.int32), n[some])]
        return pa.table([pa.array(np.full(len(coded.dictionary), block["block"][0].as_py(), np.int32)), coded.dictionary, *lists], ["block", "word", "topic", "n"])

    found = written(docs.groupBy("block").applyInArrow(tally, f"block int, word {kind}, topic array<int>, n array<long>"), "tallies")
    totals = np.zeros(topics)
    for r in found.select(F.inline(F.arrays_zip("topic", "n"))).groupBy("topic").agg(F.sum("n").alias("n")).collect():
        totals[r.topic] = r.n

    def answer(shard: pa.Table) -> pa.Table:
        coded = shard["word"].combine_chunks().dictionary_encode()
        words = np.repeat(coded.indices.to_numpy().astype(np.int64), pc.list_value_length(shard["topic"]).to_numpy())
        cells, of = np.unique(words * topics + pc.list_flatten(shard["topic"]).to_numpy(), return_inverse=True)
        n = np.zeros(len(cells), np.int64)
        np.add.at(n, of, pc.list_flatten(shard["n"]).to_numpy())
        offsets = pa.array(np.searchsorted(cells // topics, np.arange(len(coded.dictionary) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)).take(coded.indices) for x in ((cells % topics).astype(np.int32), n)]
        return pa.table([shard["block"], shard["word"], *lists], ["block", "word", "topic", "n"])

    shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-found.count() // SHARD))
    shard = F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")
    pulled = found.withColumn("shard", shard).repartition(shards, "shard").groupBy("shard").applyInArrow(answer, f"block int, word {kind}, topic array<int>, n array<long>")

    def sample(block: pa.Table, pulled: pa.Table) -> pa.Table:
        counts = np.zeros((pulled.num_rows, topics))
        counts[np.repeat(np.arange(pulled.num_rows), pc.list_value_length(pulled["topic"]).to_numpy()), pc.list_flatten(pulled["topic"]).to_numpy()] = pc.list_flatten(pulled["n"]).to_numpy()
        block = block.sort_by([("doc_id", "ascending"), ("at", "ascending")])
        ids = block["doc_id"].combine_chunks()
        distinct = ids.dictionary_encode("encode")
        code = pc.index_in(pc.list_flatten(block["word"]), pulled["word"].combine_chunks())
        known = code.is_valid().to_numpy()  # others are null
        code = code.fill_null(0).to_numpy()[known]
        sizes = pc.list_value_length(block["word"]).to_numpy()
        doc = np.repeat(distinct.indices.to_numpy(), sizes)[known]
        pos = (np.arange(sizes.sum()) + np.repeat(block["at"].to_numpy() - np.cumsum(sizes) + sizes, sizes))[known]
        z = pc.list_flatten(block["topic"]).to_numpy()[known]
        if ((np.diff(doc) == 0) & (np.diff(pos) <= 0)).any():
            order = np.lexsort((z, pc.rank(pulled["word"].combine_chunks()).to_numpy()[code], pos, doc))
            code, doc, pos, z = code[order], doc[order], pos[order], z[order]
        first = np.searchsorted(doc, np.arange(len(distinct.dictionary) + 1))
        seeds = ([seed] if i is None else [seed, abs(i)] for i in distinct.dictionary.to_pylist())
        draws = np.concatenate([np.zeros(0), *(np.random.default_rng(s).random(n) for s, n in zip(seeds, np.diff(first)))])
        z = resampled(first, code, z, counts, totals, draws, alpha, beta, vocabulary)
        words = pulled["word"].combine_chunks().take(pa.array(code))
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(pos) != 1)])[: len(doc)])
        offsets = pa.array([*starts, len(doc)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (words, pa.array(z.astype(np.int32)))]
        return pa.table([distinct.dictionary.take(pa.array(doc[starts])), pa.array(pos[starts].astype(np.int32)), *lists], ["doc_id", "at", "word", "topic"])

    return docs.groupBy("block").cogroup(pulled.groupBy("block")).applyInArrow(sample, f"doc_id long, at int, word array<{kind}>, topic array<int>")


def fit(tokens: DataFrame, topics: int, sweeps: int, alpha: float, beta: float, vocabulary: int, seed: int = 0) -> DataFrame:
    state = written(initial_topics(tokens, topics, seed), "topics")
    for k in range(sweeps):
        before, state = state, written(sweep(state, topics, alpha, beta, vocabulary, seed + k + 1), "topics")
        discard(before)
    return state
