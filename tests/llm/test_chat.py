import hashlib
import os
import random

import pytest
from compare import DATA, same

from millrace.llm import chat as C
from millrace.llm import queries as Q

PARTS = ["\\", "###", " ", "### Assistant: ", "</turn>", " </turn>\n", "<", ":", ": ", "\n", "é", "x", "</", "#", "\U0001f600"]


def random_text(r, n=8):
    return "".join(r.choices(PARTS, k=r.randint(0, n)))


def test_escaping_is_reversible():
    r = random.Random(3)
    for _ in range(5000):
        roles, texts = [random_text(r, 3) for _ in range(3)], [random_text(r) for _ in range(3)]
        buffer, ends, lo, hi = C.assemble(roles, texts)
        assert C.read_turns(buffer.tobytes().decode()) == list(zip(roles, texts))
        assert [C.unescape(buffer[a:b].tobytes().decode()) for a, b in zip(lo, hi)] == texts
    with pytest.raises(ValueError):
        C.read_turns("### user: x")


def test_digests_against_plain(spark, monkeypatch):
    monkeypatch.setattr(C, "BUFFER", 50)
    r = random.Random(5)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(r.randint(1, 6)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", None]), r.choice([None, "", random_text(r), "long " * 50]), "clash", 1))
    rows += [rows[0], rows[0]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, loss int")
    want = set()
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        turns = [(x[2] or "", x[3] or "") for x in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((conv, len(own), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss)))
    got = C.chat_digests(frame).collect()
    assert {tuple(x)[:5] for x in got} == want
    parts = C.format_chat(frame).collect()
    assert sum(len(p.text) for p in parts) == sum(x.formatted_chars for x in got)
    assert C.chat_digests(frame.where("false")).count() == 0 and C.format_chat(frame.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_rows_as_duckdb(spark, name):
    same(spark, Q.QUERIES[name], Q.ORACLE[name])
