import os

import pytest
from compare import DATA
from test_models import docs, sample

import corpus_pipeline as C
from millrace.llm import language, pii
from millrace.llm.base import written

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages_on_planted_cases(spark):
    texts = sample(60)
    plain = next(t for i, t, lang in texts if lang == "xx" and i)
    rows = texts + [(900, texts[0][1].replace(" ", "\t ", 1), texts[0][2]), (901, plain.upper(), "xx"), (902, None, "xx"), (903, "12345", "yy"), (904, "the and ing of er mail a@b.co or +1 (415) 555-0132", "xx"), (905, f"{plain} {plain}", "yy")]  # 905's own language is another
    frame = docs(spark, rows)
    at = frame
    for name, stage in C.STAGES[:-1]:
        at = written(stage(spark, at, None), name)
        assert at.columns == frame.columns
        ids = {r.doc_id for r in at.collect()}
        if name == "language_id":
            assert ids == {i for i, _, _ in rows} - {902, 903, 905}
        if name == "exact_dedup":
            assert 900 not in ids and 901 in ids
        if name == "near_dedup":
            assert 901 not in ids and 904 in ids
    assert [r.text for r in at.where("doc_id = 904").collect()] == ["the and ing of er mail [EMAIL] or [PHONE]"]
    packed = C.STAGES[-1][1](spark, at, None)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in at.collect()}


def test_run_on_the_tables(spark):
    out = C.run(spark, DATA)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "personal_data", "packing"]
    assert language.LEAST_SCORE <= 1 and pii.KINDS == ("email", "ip", "card", "phone")


def test_empty_table(spark):
    at = docs(spark, []).where("false")
    for name, stage in C.STAGES:
        at = written(stage(spark, at, None), name)
    assert at.count() == 0
