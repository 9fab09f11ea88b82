"""Byte-pair encoding and decoding of a word-end vocabulary.

A word's symbols are a doubly linked list; a heap holds the adjacent pairs by merge rank and place. The least pair is
merged in place and its new neighbours are pushed; entries whose symbols have changed since are stale and skipped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import byte_chars

#: Words that a task remembers, and the length from which none is.
CACHE, LONG = 250_000, 40
#: White space as the vocabulary's normaliser has it: Unicode's property, without the four separators that str.split takes.
SPACE = regex.compile(r"\p{White_Space}+")
ODD = re.compile("[\x1c-\x1f]")
# Fixed value: the pattern by which this vocabulary cuts words.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordBpe:
    def __init__(self, tokenizer_json: str, cache: int = CACHE):
        spec = json.load(open(tokenizer_json, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # A pair of ids as one number leads to (rank, id of the merged symbol).
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: (k, self.vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.text = {i: w for w, i in [*self.vocab.items(), *self.special.items()]}
        self.inner = {b: self.vocab[c] for c, b in byte_chars().items()}
        self.final = {b: self.vocab[c + self.end] for c, b in byte_chars().items()}
        self.words: dict[str, tuple[str, str, int]] = {}
        self.most = cache
        self.remembered = lru_cache(cache)(self._merge)

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece; those of short pieces are remembered."""
        return self.remembered(piece) if len(piece) < LONG else self._merge(piece)

    def _merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, by rank order of merges over a linked list of symbols."""
        raw = piece.encode("utf-8", "replace")
        ids = [*map(self.inner.__getitem__, raw)]
        n = len(ids)
        ids[-1] = self.final[raw[-1]]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        get, pop, push, heap = self.ranks.get, heapq.heappop, heapq.heappush, []
        for k in range(n - 1):
            if r := get(ids[k] << 32 | ids[k + 1]):
                heap.append((r[0], k, ids[k], ids[k + 1], r[1]))
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = pop(heap)
            j = right[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue  # stale: one of its symbols was merged meanwhile
            ids[k], ids[j] = new, -2
            right[k] = after = right[j]
            if after < n:
                left[after] = k
                if r := get(new << 32 | ids[after]):
                    push(heap, (r[0], k, new, ids[after], r[1]))
            before = left[k]
            if before >= 0 and (r := get(ids[before] << 32 | new)):
                push(heap, (r[0], before, ids[before], new, r[1]))
        return tuple([i for i in ids if i >= 0])

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch without white space; a special token's string in it is that token."""
        if word.isascii() and word.isalpha():
            return list(self.merge(word.lower()))
        out: list[int] = []
        for part in self.special_at.split(word) if self.special_at and "<" in word else (word,):
            if part in self.special:
                out.append(self.special[part])
            else:
                low = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
                for piece in PIECE.findall(low):
                    out += self.merge(piece)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split(text) for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by one space: the file names no decoder, so word ends and byte letters stay."""
        return " ".join(self.text[i] for i in ids)

    def split(self, text: str) -> list[str]:
        return [w for w in SPACE.split(text) if w] if ODD.search(text) else text.split()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids in decimal, digest of the decoded text. Words' strings are remembered."""
        known, ids, texts, n = self.words, [], [], 0
        for w in self.split(text):
            found = known.get(w)
            if found is None:
                own = self.encode_word(w)
                found = (" ".join(map(str, own)), self.decode(own), len(own))
                if len(known) < self.most and len(w) < LONG:
                    known[w] = found
            if found[2]:
                ids.append(found[0])
                texts.append(found[1])
                n += found[2]
        return n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(texts).encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(2)
def loaded(tokenizer_json: str) -> WordBpe:
    """One for each worker process, so that its remembered words outlast a task."""
    return WordBpe(tokenizer_json)


def encode_documents(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id, ids array<int>, decoded: each row's ids and the text that they decode to; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_json)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return _plain(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of docs (doc_id, text); a null text is empty.

    An empty text has no ids, and both digests are of the empty string. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_json)
        for batch in batches:
            rows = [bpe.digest(t or "") for t in batch.column("text").to_pylist()]
            n, ids, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
