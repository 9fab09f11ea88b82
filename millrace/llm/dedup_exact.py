"""Exact deduplication by content-defined chunk recipes.

Each normalised text is cut where a rolling hash of its last 32 bytes has its top bits zero, so equal passages are cut
alike wherever they stand. A document becomes its recipe: the ordered list of (chunk hash, chunk length). The chunks'
bytes move once, deduplicated before the shuffle, to verify that a hash and length name one content only; contents
that share a hash get different ordinals. Documents are then compared by their lists of verified identifiers, and no
whole document is moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ROW, first_rows, join_groups, numbered, written

MIN_CHUNK, MEAN_BITS, MAX_CHUNK, WINDOW = 512, 11, 16384, 32
#: Bytes of text that are hashed at once.
BLOCK = 4 << 20
GEAR = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
SPACES = b" \t\n\r\x0b\x0c"


def normalised(text: str | None) -> bytes:
    """UTF-8 with each run of ASCII white space as one space; null is empty."""
    if not text:
        return b""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" "
    return (b" " if raw[0] in SPACES else b"") + b" ".join(words) + (b" " if raw[-1] in SPACES else b"")


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions i where a chunk may end before i: the gear hash of the WINDOW bytes before i has its top bits zero."""
    h, shift = GEAR[data], 1
    while shift < WINDOW:
        h[shift:] += h[:-shift] << np.uint64(shift)
        shift *= 2
    return np.flatnonzero(h >> np.uint64(64 - MEAN_BITS) == 0) + 1


def recipes(texts: list[bytes]) -> Iterator[list[tuple[int, int]]]:
    """For each text the (start, end) of its chunks. Chunk bounds depend on the text alone: MIN_CHUNK exceeds WINDOW."""
    at, n = 0, len(texts)
    while at < n:
        upto, size = at, 0
        while upto < n and (upto == at or size + len(texts[upto]) <= BLOCK):
            size += len(texts[upto])
            upto += 1
        ends = cut_points(np.frombuffer(b"".join(texts[at:upto]), np.uint8)).tolist() if size else []
        k, base = 0, 0
        for text in texts[at:upto]:
            out, start, stop = [], base, base + len(text)
            while k < len(ends) and ends[k] < stop:
                e = ends[k]
                k += 1
                while e - start > MAX_CHUNK:
                    out.append((start - base, start + MAX_CHUNK - base))
                    start += MAX_CHUNK
                if e - start >= MIN_CHUNK:
                    out.append((start - base, e - base))
                    start = e
            while stop - start > MAX_CHUNK:
                out.append((start - base, start + MAX_CHUNK - base))
                start += MAX_CHUNK
            out.append((start - base, stop - base))
            while k < len(ends) and ends[k] <= stop:
                k += 1
            base = stop
            yield out
        at = upto


def chunk_hash(chunk: bytes, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(chunk) >> (64 - bits)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


RECIPE = "doc_id long, text_sha256 string, hashes array<bigint>, lengths array<int>"
CHUNK = "doc_id long, pos int, h long, length int, chunk binary"


def _recipe_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t) for t in batch.column("text").to_pylist()]
            hashes, lengths = [], []
            for text, cuts in zip(texts, recipes(texts)):
                hashes.append([_signed(chunk_hash(text[a:b], bits)) for a, b in cuts])
                lengths.append([b - a for a, b in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(hashes, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32()))],
                ["doc_id", "text_sha256", "hashes", "lengths"],
            )

    return run


def _chunk_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [normalised(t) for t in batch.column("text").to_pylist()]
            rows, size = [], 0
            for doc_id, text, cuts in zip(ids, texts, recipes(texts)):
                for pos, (a, b) in enumerate(cuts):
                    rows.append((doc_id, pos, _signed(chunk_hash(text[a:b], bits)), b - a, text[a:b]))
                    size += b - a
                    if size > BLOCK:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "pos", "h", "length", "chunk"])


def exact_groups(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (doc_id, text).

    Texts are equal when identical after each run of ASCII white space became one space; null is the empty text. Of
    equal texts the smallest doc_id stays. Rows that repeat a doc_id with equal text carry the same decision and count
    in group_size; a null doc_id never stays unless all of its group are null (kept is false then, keep_id null).
    Other columns of docs are ignored. hash_bits: fewer bits make collisions, which are resolved; for tests.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = written(docs.mapInArrow(_recipe_rows(hash_bits), RECIPE), "recipes").withColumn("ordinals", F.lit(None).cast("array<bigint>"))
    contents = docs.mapInArrow(_chunk_rows(hash_bits), CHUNK).select("h", "length", "chunk").distinct()
    shared = written(contents.groupBy("h", "length").agg(F.count("*").alias("contents")).where("contents > 1"), "collisions")
    if not shared.isEmpty():
        own = _with_ordinals(own, docs, shared, hash_bits)
    own = own.withColumn("recipe", F.struct("lengths", "hashes", "ordinals")).drop("hashes", "lengths", "ordinals")
    groups = written(own.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    out = join_groups(own, groups, "recipe", "group_size", own.count())
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def _with_ordinals(own: DataFrame, docs: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """Recipes in which chunks whose hash names several contents carry the content's rank under that hash.

    Rows are told apart by doc_id and text_sha256, which equal rows share, and equal rows have equal ordinals.
    """
    full = docs.mapInArrow(_chunk_rows(bits), CHUNK).join(shared.select("h", "length"), ["h", "length"], "left_semi")
    digest = F.sha2("chunk", 256)
    named = full.select("h", "length", digest.alias("d"), "chunk").distinct()
    earlier = named.select("h", "length", F.col("d").alias("d2"), F.col("chunk").alias("c2"))
    rank = written(named.join(earlier, ["h", "length"]).groupBy("h", "length", "chunk").agg(F.sum((F.col("c2") < F.col("chunk")).cast("int")).cast("int").alias("ordinal")), "ordinals")
    per_chunk = own.select("doc_id", "text_sha256", F.posexplode(F.arrays_zip("hashes", "lengths")).alias("pos", "c")).select("doc_id", "text_sha256", "pos", F.col("c.hashes").alias("h"), F.col("c.lengths").alias("length")).distinct()
    # A document's chunk is found again by its place; documents that share an id are told apart by their text's digest.
    at = docs.mapInArrow(_chunk_rows_with_digest(bits), CHUNK + ", text_sha256 string").join(rank, ["h", "length", "chunk"]).select("doc_id", "text_sha256", "pos", "ordinal").distinct()
    lists = per_chunk.join(at, ["doc_id", "text_sha256", "pos"]).groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "ordinal"))).alias("o"))
    lists = lists.select("doc_id", "text_sha256", F.transform("o", lambda x: x["pos"].cast("bigint") * (1 << 31) + x["ordinal"]).alias("ordinals"))
    return written(own.drop("ordinals").join(lists, ["doc_id", "text_sha256"], "left"), "recipes")


def _chunk_rows_with_digest(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                digest = hashlib.sha256(normalised(batch.column("text")[k].as_py())).hexdigest()
                for b in _chunk_rows(bits)(iter([batch.slice(k, 1)])):
                    yield b.append_column("text_sha256", pa.array([digest] * b.num_rows))

    return run


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of those whose texts are equal: of the smallest doc_id, nulls last; all columns stay."""
    rows = numbered(docs)
    return first_rows(rows, exact_groups(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("_group")))
