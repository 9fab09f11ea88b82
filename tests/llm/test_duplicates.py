import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components as CC
from millrace.llm import dedup_exact as X
from millrace.llm import simhash as S

DOCS = "doc_id long, text string, fp string, kept int, h int, part int"


def docs(spark, texts):
    rows = [(i, t, "clash", 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def plain_exact(texts):
    norm = {}
    for i, t in texts:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in norm.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def corpus():
    r = random.Random(4)
    long = " ".join(str(r.random()) for _ in range(4000))
    texts = [(0, None), (1, ""), (2, " "), (3, "\n\t"), (4, "a b"), (5, "a\n b"), (6, " a b"), (7, "a b"), (8, long), (9, long.replace(" ", "\n", 1)), (10, long + "x"), (11, "x" + long), (12, long[:-1] + "y"), (4, "a b"), (None, "a b"), (None, "alone"), (13, "é" * 3000), (14, "é" * 3000), (15, "é" * 2999)]
    return texts + [(20 + k, r.choice(["same text", "other text", long])) for k in range(40)]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups_against_plain(spark, bits):
    got = X.exact_groups(docs(spark, corpus()), hash_bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_exact(corpus())


def test_chunks_cover_the_text_and_do_not_depend_on_neighbours():
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 123, n, dtype=np.uint8)) for n in (0, 1, 511, 512, 5000, 200_000)] + [b"a" * 50_000]
    together = list(X.recipes(texts))
    for t, cuts in zip(texts, together):
        assert cuts[0][0] == 0 and cuts[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        assert all(b - a <= X.MAX_CHUNK for a, b in cuts)
        assert list(X.recipes([t]))[0] == cuts
    # An insertion changes the chunks around it only.
    changed = texts[5][:100_000] + b"!" + texts[5][100_000:]
    pieces = lambda t: {t[a:b] for a, b in list(X.recipes([t]))[0]}
    assert len(pieces(texts[5]) - pieces(changed)) <= 2


def test_keep_first_keeps_columns_and_handles_empty(spark):
    rows = docs(spark, [(3, "a"), (1, "a "), (2, "a"), (5, None), (6, "")])
    out = X.keep_first(rows)
    assert out.columns == rows.columns and {r.doc_id for r in out.collect()} == {1, 2, 5}
    assert X.exact_groups(rows.where("false")).count() == 0 and X.keep_first(rows.where("false")).count() == 0


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(pairs, fps):
    ids = [i for i, _ in pairs]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if (x ^ y).bit_count() <= 3:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}


def test_near_duplicates_against_plain(spark):
    r = random.Random(2)
    base = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    texts = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "two words"), (5, " TWO\twords "), (6, "É é E e")]
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[r.randrange(200)] = "changed" + str(k)
        texts.append((10 + k, " ".join(words)))
    got = S.near_duplicates(docs(spark, texts))
    fps = [plain_fingerprint(t) for _, t in texts]
    want = plain_components(texts, fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == {(i, f"{x:016x}", want[i]) for (i, _), x in zip(texts, fps)}
    assert S.near_duplicates(docs(spark, texts).where("false")).count() == 0
    kept = S.one_each(docs(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == docs(spark, texts).columns


@pytest.mark.parametrize("limit", [2048, 8, 2])
def test_links_lose_none_however_small_the_postings(spark, limit):
    """Clusters of fingerprints around a few centres, in which postings are large."""
    r = random.Random(9)
    fps = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.component for r in CC.components(S.links(frame, limit)).collect()}
    want = plain_components([(k, None) for k in signed], fps)
    assert {k: got.get(k, k) for k in want} == want


def test_postings_meet_every_link():
    blocks = [set(b) for b in S.BLOCKS]
    assert len(blocks) == 14
    from itertools import combinations

    assert all(any(not (b & set(c)) for b in blocks) for c in combinations(range(8), 3))


def test_null_ids_are_no_components(spark):
    out = S.near_duplicates(docs(spark, [(None, "a b c d"), (7, "a b c d"), (None, "other words of this")]))
    assert sorted((r.component_id is None, r.component_id) for r in out.collect()) == [(False, 7), (False, 7), (True, None)]


def test_rows_without_an_id_link_others(spark):
    r = random.Random(6)
    base = ["".join(r.choices("abcdefgh", k=5)) for _ in range(150)]
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(r.randint(1, 3)):
            words[r.randrange(150)] = f"changed{r.randrange(10**6)}"
        texts.append(" ".join(words))
    fps = [plain_fingerprint(t) for t in texts]
    far = lambda a, b: (fps[a] ^ fps[b]).bit_count()
    a, b, c = next((a, b, c) for a in range(60) for b in range(60) for c in range(60) if 0 < far(a, b) <= 3 and 0 < far(b, c) <= 3 < far(a, c))
    out = S.near_duplicates(docs(spark, [(9, texts[a]), (None, texts[b]), (5, texts[c]), (None, "quite other words")])).collect()
    assert sorted(((str(x.doc_id), x.component_id) for x in out), key=str) == sorted([("9", 5), ("None", 5), ("5", 5), ("None", None)], key=str)


def test_only_counted_pairs_are_verified():
    """Within a posting the tally keeps every link and few other pairs, and the forest joins what links join."""
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**64, dtype=np.uint64)
    high = np.uint64(0xFFFFFFFF00000000)
    a = np.unique((centre & high) | r.integers(0, 2**32, 1200, dtype=np.uint64))
    some = a[:300] ^ (np.uint64(1) << r.integers(0, 32, 300, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 32, 300, dtype=np.uint64))
    a = np.unique(np.concatenate([a, some]))
    pairs = [(int(x), int(y)) for i, j in S.counted(a) for x, y in zip(i, j)]
    links = {(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 3).tolist() if j > i}
    assert links <= set(pairs) and len(links) >= 250 and len(pairs) < 0.03 * len(a) * (len(a) - 1) / 2
    root = list(range(len(a)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    assert S.forest(a) == [(k, find(k)) for k in range(len(a)) if find(k) != k]


def test_components_of_paths_and_stars(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in CC.components(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(200)}
    assert CC.components(edges.where("false")).count() == 0


@pytest.mark.parametrize("stage", [X.keep_first, S.one_each])
def test_stages_drop_rows_not_ids(spark, stage):
    a, b, c, d = ("".join(f"{x}{k} " for k in range(60)) for x in "abcd")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (7, c), (None, c), (None, d), (None, d)]
    assert sorted(((r.doc_id, r.text) for r in stage(docs(spark, rows)).collect()), key=str) == sorted([(3, b), (5, a), (7, c), (None, d)], key=str)
