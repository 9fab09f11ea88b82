import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe as B
from millrace.llm import packing as P

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "'", "1", "23", "!", "<|endoftext|>", "<|", "　", "\x1c", "中", " x", " don't", "Σ", "İ", "é", "ß", "<|startoftext|>", "\x85", "​", "½", "therefore"]


def texts(n, seed=0):
    r = random.Random(seed)
    return [None, "", " ", "x" * 5000, "word " * 3000] + ["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("file,make", [(WORD, B.WordBpe), (BYTE, P.ByteBpe)])
def test_ids_are_the_library_s(file, make):
    known, own = Tokenizer.from_file(file), make(file)
    for t in texts(3000):
        ids = known.encode(t or "", add_special_tokens=False).ids
        if make is B.WordBpe:
            assert own.encode(t or "") == ids and own.decode(ids) == known.decode(ids, skip_special_tokens=False)
        else:
            assert np.frombuffer(own.encode(t or ""), "<u4").tolist() == ids


def frame(spark, some):
    return spark.createDataFrame([(k if k != 2 else None, t, 5, 6, 7, "c") for k, t in enumerate(some)], "doc_id long, text string, length int, bin int, part int, ids string")


def test_digests_and_round_trip(spark):
    some = texts(60, 1)
    known = Tokenizer.from_file(WORD)
    want = set()
    for k, t in enumerate(some):
        ids = known.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((k if k != 2 else None, len(ids), sha(" ".join(map(str, ids))), sha(known.decode(ids, skip_special_tokens=False))))
    assert set(map(tuple, B.digest_documents(frame(spark, some), WORD).collect())) == want
    r = B.encode_documents(frame(spark, ["Hello there"]), WORD).first()
    assert r.decoded == "hello</w> there</w>" and len(r.ids) == 2
    assert B.digest_documents(frame(spark, some).where("false"), WORD).count() == 0


@pytest.mark.parametrize("items", [20_000, 16])
def test_pieces_and_sequences(spark, items):
    some = texts(80, 2) + ["long text " * 5000, "same", "same"]
    known = Tokenizer.from_file(BYTE)
    out = P.pack_documents(frame(spark, some), BYTE, part_items=items).toPandas()
    assert list(out.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for k, t in enumerate(some):
        ids = known.encode(t or "", add_special_tokens=False).ids + [0]
        own = out[out.doc_id.isna() if k == 2 else out.doc_id == k].sort_values("piece")
        assert list(own.piece) == list(range(len(own))) and own.length.sum() == len(ids)
        assert all(own.length.iloc[1:] == 2048) and own.length.max() <= 2048 and (len(ids) > 2048 or len(own) == 1)
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    check_layout(out)
    large = spark.createDataFrame([(2**62 + 1, "a"), (None, "b")], "doc_id long, text string")
    assert {r.doc_id for r in P.pack_documents(large, BYTE).collect()} == {2**62 + 1, None}
    assert P.pack_documents(frame(spark, some).where("false"), BYTE).count() == 0


def check_layout(out, capacity=2048):
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == (s.offset + s.length).shift(1).fillna(0)).all() and s.length.sum() <= capacity


def test_packing_is_near_the_bound(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(k, min(2048, int(r.expovariate(1 / 400)) + 1)) for k in range(5000)], "k long, length long")
    for items, slack in ((20_000, 1.01), (500, 1.02)):
        from millrace.llm.base import written

        out = P.pack(written(rows, "items"), part_items=items).toPandas()
        check_layout(out)
        assert out.sequence_id.nunique() <= slack * out.length.sum() / 2048 + 1


def test_large_items_are_not_gathered(spark):
    """Nothing fits together: each part hands on a bounded number of bins, and none is lost."""
    from millrace.llm.base import written

    rows = spark.range(3000).selectExpr("id AS k", "CAST(1500 AS LONG) AS length")
    out = P.pack(written(rows, "items"), part_items=100).toPandas()
    assert len(out) == 3000 and out.sequence_id.nunique() == 3000


def test_equal_rows_spread_over_parts(spark):
    """20,000 equal pieces in parts of about 1,000: each part packs its share, and the tree joins what is left over."""
    from millrace.llm.base import written

    rows = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(3 AS LONG) AS length")
    out = P.pack(written(rows, "items"), part_items=1000).toPandas()
    check_layout(out)
    assert len(out) == 20_000 and out.sequence_id.nunique() == -(-20_000 // 682)
    first = out[out.sequence_id < 1 << 54]
    assert (first.groupby(first.sequence_id.to_numpy() >> 24).size() <= 1100).all()


def test_handing_on_more_bins_merges_no_more(spark, monkeypatch):
    from millrace.llm.base import written

    r = random.Random(8)
    rows = written(spark.createDataFrame([(k, r.choice((r.randint(900, 2048), r.randint(1, 300), 700))) for k in range(4000)], "k long, length long"), "items")
    some = P.pack(rows, part_items=100).toPandas().sequence_id.nunique()
    monkeypatch.setattr(P, "HANDED_ON", P.FAN_IN)
    fewer = P.pack(rows, part_items=100).toPandas().sequence_id.nunique()
    monkeypatch.setattr(P, "HANDED_ON", 10_000)
    assert abs(some - P.pack(rows, part_items=100).toPandas().sequence_id.nunique()) <= 1 and abs(some - fewer) <= 1
