"""SimHash near-duplicates through an inverted index over positional bytes of the fingerprint.

Fingerprints that differ in at most 3 of 64 bits share at least 5 of their 8 positional bytes. The index's postings
are sets of four (position, byte) entries: the 14 blocks of the Steiner system S(3,4,8) are such that any 3 differing
positions leave the 4 positions of some block untouched, so every link meets in a posting, and a posting holds
2**-32 of random fingerprints where a single byte's would hold 2**-8. Within a posting the positions' equal bytes are
tallied for each pair, pairs below 5 are dropped, and only the rest are compared by their differing bits; a spanning
forest of the links leaves the task. A posting beyond `posting_limit` is split by a fifth byte, which loses no link,
and one that is still too large is searched by enumerating the fingerprints within 3 bits and joining on equality.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ROW, first_rows, join_groups, numbered, written
from .components import components

MAX_BITS = 3
BYTES = 8
LEAST_SHARED = BYTES - MAX_BITS
#: Largest posting whose pairs one task tallies.
POSTING_LIMIT = 2048
#: Blocks of S(3,4,8): the 4-subsets of 0..7 whose elements' exclusive or is 0.
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit integer."""
    n = len(hashes)
    if not n:
        return 0
    rows = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(n, BYTES)
    ones = np.concatenate([np.bincount(rows[:, j], minlength=256) @ BITS for j in range(BYTES)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(shingle_hashes(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def _byte(j: int) -> F.Column:
    return F.shiftrightunsigned("fp", 8 * j).bitwiseAND(F.lit(255))


def _mask(positions) -> int:
    m = sum(255 << (8 * j) for j in positions)
    return m - (1 << 64) if m >> 63 else m


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each posting's fingerprints the edges of a spanning forest of their links."""
    for batch in batches:
        us, vs = [], []
        for fps in batch.column("fps").to_pylist():
            for i, j in forest(np.array(fps, np.int64).view(np.uint64)):
                us.append(fps[i])
                vs.append(fps[j])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def counted(a: np.ndarray, least: int = LEAST_SHARED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of fingerprints that share at least `least` positional bytes, by a tally over the positions."""
    m = len(a)
    at = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(m, BYTES).T
    step = max(1, (1 << 20) // m)
    for lo in range(0, m - 1, step):
        tally = np.zeros((min(step, m - lo), m), np.uint8)
        for column in at:
            tally += column[lo : lo + step, None] == column
        i, j = np.nonzero(tally >= least)
        later = j > i + lo
        yield i[later] + lo, j[later]


def forest(a: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, first member) for each set of fingerprints that links join; only counted pairs are verified."""
    label = np.arange(len(a))
    for i, j in counted(a):
        near = np.bitwise_count(a[i] ^ a[j]) <= MAX_BITS
        i, j = i[near], j[near]
        while (label[i] != label[j]).any():
            least = np.minimum(label[i], label[j])
            # The labels' own labels fall too, so that a set joined earlier moves as one.
            for k in (label[i], label[j]):
                np.minimum.at(label, k, least)
            while (label != label[label]).any():
                label = label[label]
    return [(k, r) for k, r in enumerate(label.tolist()) if r != k]


def links(fps: DataFrame, posting_limit: int = POSTING_LIMIT) -> DataFrame:
    """Edges (u, v) of fingerprints that connect what links of at most MAX_BITS connect; fps: distinct fp."""
    block = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("key")) for k, b in enumerate(BLOCKS)]))
    entries = fps.select("fp", block.alias("b")).select("fp", "b.part", "b.key")
    edges, large = _tallied(entries, posting_limit)
    if large is None:
        return edges
    # A fifth shared byte: the positions outside the block.
    rest = [[j for j in range(BYTES) if j not in b] for b in BLOCKS]
    fifth = F.explode(F.element_at(F.array(*[F.array(*[F.struct(F.lit(k * BYTES + j).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask([*BLOCKS[k], j]))).alias("key")) for j in rest[k]]) for k in range(len(BLOCKS))]), F.col("part") + 1))
    finer = written(large.select("fp", fifth.alias("b")).select("fp", "b.part", "b.key"), "postings")
    more, still = _tallied(finer, posting_limit)
    edges = edges.unionByName(more)
    if still is None:
        return edges
    # Fingerprints within 3 bits, by enumeration over the three bytes left: a bounded number for each, joined on equality.
    free = {k * BYTES + j: [x for x in range(BYTES) if x not in BLOCKS[k] and x != j] for k in range(len(BLOCKS)) for j in rest[k]}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {}
        for batch in batches:
            for fp, part in zip(*(batch.column(c).to_pylist() for c in ("fp", "part"))):
                if part not in flips:
                    bits = [1 << (8 * x + b) for x in free[part] for b in range(8)]
                    flips[part] = np.array([sum(c) for n in range(1, MAX_BITS + 1) for c in combinations(bits, n)], np.uint64)
                around = (flips[part] ^ np.uint64(fp % (1 << 64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(around[around < fp]), pa.array(np.full((around < fp).sum(), fp))], ["fp", "u"])

    around = still.select("fp", "part").mapInArrow(near, "fp long, u long").distinct()
    return edges.unionByName(around.join(fps.select("fp"), "fp").select("u", F.col("fp").alias("v")))


def _tallied(entries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges found in postings of up to limit entries, and the entries of larger ones, if any."""
    sizes = written(entries.groupBy("part", "key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    small = entries.join(sizes.where(F.col("size") <= limit), ["part", "key"])
    small = small.groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    edges = small.mapInArrow(_local_forest, "u long, v long")
    over = sizes.where(F.col("size") > limit)
    if over.isEmpty():
        return edges, None
    large = entries.join(over, ["part", "key"], "left_semi")
    return edges, written(large, "postings")


def near_duplicates(docs: DataFrame, posting_limit: int = POSTING_LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs (doc_id, text); other columns are ignored.

    A null or empty text, or one of white space only, has fingerprint zero and links like any other. Rows with a null
    doc_id take part by their fingerprint, and link others, but are never a component_id; it is null if no row of the
    component has an id. Rows that repeat a doc_id are rows of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = written(docs.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    # Links and components are of fingerprints; a component then takes the least id of its fingerprints' rows.
    linked = components(links(classes.select("fp"), posting_limit))
    linked = written(linked.select(F.col("node").alias("fp"), "component").join(classes.select("fp", "rep"), "fp"), "linked")
    ids = linked.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    least = join_groups(linked, ids, "component", "members", linked.count()).select("fp", "component_id", F.lit(True).alias("joined"))
    named = classes.join(least, "fp", "left").select("fp", "size", F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    out = join_groups(own, written(named, "components"), "fp", "size", own.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id, nulls last; all columns stay."""
    rows = numbered(docs)
    return first_rows(rows, near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("_group")))
