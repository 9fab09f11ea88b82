"""Best-fit packing of tokenised documents into sequences, hierarchically.

Pieces are dealt by row number into parts of about PART_ITEMS; each part packs its own best-fit decreasing. Full bins
are emitted; of the others each part hands its HANDED_ON lightest to the next round, where they are the items of FAN_IN
parts' best-fit, and so on up the tree. A round is a written table of (child, bin, offset); a piece's sequence is found
by following the few bins that were merged.

Handing on more would merge no more. Two bins of one part never fit together: the first item of the later one did not
fit into the earlier. So a part has at most one bin that is half full or less, and each merge of a round takes one of
these, of which FAN_IN meet. Each needs one other bin with room for it, and of a part's bins the FAN_IN lightest serve
as well as any. After the round the FAN_IN parts together are again a part of which no two bins fit together.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written

CAPACITY = 2048
PART_ITEMS = 20_000
FAN_IN = 8
#: Bins that a part hands on in a round: FAN_IN at least, more for a closer fit; the rest are emitted as they are.
HANDED_ON = 64
#: Words whose ids a task remembers.
CACHE = 300_000


class ByteBpe:
    """Ids of the byte-level vocabulary, as the tokenizers library gives them without added special tokens.

    A text is cut at single spaces between other characters, which are always token bounds, and the ids of the words
    with their leading space are remembered. Texts with other white space around a space are encoded whole.
    """

    def __init__(self, tokenizer_json: str, cache: int = CACHE):
        import json

        spec = json.load(open(tokenizer_json, encoding="utf-8"))
        chars = byte_chars()
        ranks = {bytes(chars[c] for c in word): k for word, k in spec["model"]["vocab"].items() if all(c in chars for c in word)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {w: k for w, k in ranks.items() if k not in special.values()}
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, bytes] = {}
        self.most = cache

    def _ids(self, text: str) -> bytes:
        return array("I", self.enc.encode(text, allowed_special="all", disallowed_special=())).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if UNEVEN.search(text) or self.special and self.special.search(text):
            return self._ids(text)
        first, *words = text.split(" ")
        known, out = self.known, [self._ids(first)]
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._ids(" " + w)
                if len(known) < self.most and len(w) < 40:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(2)
def loaded(tokenizer_json: str) -> ByteBpe:
    """One for each worker process, so that its remembered words outlast a task."""
    return ByteBpe(tokenizer_json)


#: A space that does not stand between two other characters that are not white space.
UNEVEN = re.compile(r"\s | (?=\s|$)")
# Fixed value: the pattern by which byte-level vocabularies of this kind cut words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row a piece: each document's ids and end_id, in pieces of capacity of which the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = loaded(tokenizer_json), array("I", [end_id]).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = bpe.encode(text or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rows.append((doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and the bins' fills. Bit r of `open_` says that a bin has room r."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fitting = open_ >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                open_ &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += size
        with_room[room - size].append(b)
        open_ |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def pack(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """items (any columns, with length: 1 to capacity) with sequence_id and offset; items must be a written table.

    Rows are dealt by their number in that table, so equal rows spread evenly. No items give no rows. Sequences are filled from offset 0 without gaps and never beyond capacity.
    """
    keys = items.columns
    n = items.count()
    parts = max(1, -(-n // part_items))
    spark = items.sparkSession
    ready = items.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("long"))

    def first(rows: pa.Table) -> pa.Table:
        b, o, fills = best_fit(rows.column("length").to_numpy(), capacity)
        # Bins are numbered by round (from bit 54), part (from bit 24) and place, so that numbers never meet.
        part = rows.column("part")[0].as_py() << 24
        out = rows.drop_columns("part")
        for name, values in (("bin", part + b), ("offset", o), ("fill", fills[b])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    placed = written(ready.groupBy("part").applyInArrow(first, f"{kinds}, bin long, offset long, fill long"), "packed")
    bins = placed.groupBy("bin").agg(F.max("fill").alias("fill"))
    moves: DataFrame | None = None
    level = 0
    while parts > 1:
        # Of each part's bins with room, the lightest go on; F.shiftright(bin, 24) is the part.
        part = F.shiftright("bin", 24) if level == 0 else F.pmod(F.shiftright("bin", 24), F.lit(1 << 30))
        open_ = bins.where(F.col("fill") < capacity).withColumn("part", part)
        light = open_.groupBy("part").agg(F.slice(F.array_sort(F.collect_list(F.struct("fill", "bin"))), 1, HANDED_ON).alias("b"))
        level += 1
        parts = -(-parts // FAN_IN)

        items_ = light.select((F.col("part") / FAN_IN).cast("long").alias("part"), F.explode("b").alias("x")).select("part", "x.bin", "x.fill")
        moved = written(items_.groupBy("part").applyInPandas(_merging(level, capacity), "child long, bin long, offset long, fill long"), "merged")
        bins = moved.groupBy("bin").agg(F.max("fill").alias("fill"))
        if moves is None:
            moves = moved.select("child", "bin", "offset")
        else:
            up = moved.select(F.col("child").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("more"))
            moves = written(moves.join(up, "bin", "left").select("child", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")), "moves")
    out = placed.drop("fill")
    if moves is not None:
        up = moves.select(F.col("child").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("more"))
        out = out.join(up, "bin", "left").withColumn("bin", F.coalesce("to", "bin")).withColumn("offset", F.col("offset") + F.coalesce("more", F.lit(0)))
    return out.select(*keys, F.col("bin").alias("sequence_id"), "offset")


def _merging(level: int, capacity: int):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        b, o, fills = best_fit(frame.fill.to_numpy(), capacity)
        at = int(frame.part.iloc[0])
        return pd.DataFrame({"child": frame.bin, "bin": (level << 54) + (at << 24) + b, "offset": o, "fill": fills[b]})

    return merge


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of docs (doc_id, text).

    A null text is empty and packs its end id alone; rows that repeat a doc_id are packed each. Other columns are ignored.
    """
    return pack(written(pieces(docs, tokenizer_json, capacity), "pieces"), capacity, part_items)
