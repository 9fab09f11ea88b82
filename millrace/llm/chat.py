r"""Chat formatting by columnar byte assembly.

A turn is `### role: text </turn>` and a line end. In texts and roles a backslash stands before each backslash, `###`
and `</turn>` (and before `: ` in roles), so a template's own signs never carry one and reading back is exact. Rows
arrive sorted by conversation and turn; for each batch the lengths of headers, texts and footers give cumulative
offsets, numpy scatter indices copy all bytes into one preallocated buffer, and the buffer becomes an Arrow column of
segments without another copy. A conversation longer than a batch goes on in further segments, so memory is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
FOOTER = b" </turn>\n"
UNESCAPE = re.compile(r"\\(\\|###|</turn>|: )")
#: A turn; the body ends with the footer's space.
TURN = re.compile(r"### ((?:[^\\:]++|\\(?:\\|###|</turn>|: )|:(?! ))*+): ((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")
#: Bytes of text that a buffer holds at most, but for one longer turn.
BUFFER = 16 << 20


def escape(s: str) -> str:
    if "\\" in s:
        s = s.replace("\\", "\\\\")
    if "###" in s:
        s = s.replace("###", "\\###")
    return s.replace("</turn>", "\\</turn>") if "</turn>" in s else s


def unescape(s: str) -> str:
    return UNESCAPE.sub(lambda m: m[1], s) if "\\" in s else s


def header(role: str) -> bytes:
    return f"### {escape(role).replace(': ', chr(92) + ': ')}: ".encode("utf-8", "surrogatepass")


def assemble(roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns, each turn's end in it, and the start and end of each turn's text."""
    kinds = {r: k for k, r in enumerate(dict.fromkeys(roles))}
    heads = [header(r) for r in kinds]
    which = np.fromiter((kinds[r] for r in roles), np.int64, len(roles))
    bodies = [escape(t).encode("utf-8", "surrogatepass") for t in texts]
    head_len = np.array([len(h) for h in heads])[which] if roles else np.empty(0, np.int64)
    body_len = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.cumsum(head_len + body_len + len(FOOTER))
    starts = ends - head_len - body_len - len(FOOTER)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    head_at = np.cumsum([0, *map(len, heads)])[:-1]
    all_heads = np.frombuffer(b"".join(heads), np.uint8)
    out[_spread(starts, head_len)] = all_heads[_spread(head_at[which], head_len)]
    out[_spread(starts + head_len, body_len)] = np.frombuffer(b"".join(bodies), np.uint8)
    foot = np.full(len(bodies), len(FOOTER))
    out[_spread(ends - len(FOOTER), foot)] = np.tile(np.frombuffer(FOOTER, np.uint8), len(bodies))
    return out, ends, starts + head_len, starts + head_len + body_len


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of lengths[k] each, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(total)


SEGMENT = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turns", pa.int64()), ("text", pa.large_string()), ("loss", pa.list_(pa.int64()))])


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) that are sorted by conversation become (conv_id, segment, turns, text, loss).

    loss lists the byte start and end, within the segment, of each text that is trained on.
    """
    last: tuple = ()
    segment = 0
    for batch in batches:
        roles = [r or "" for r in batch.column("role").to_pylist()]
        texts = [t or "" for t in batch.column("text").to_pylist()]
        convs = batch.column("conv_id").to_pylist()
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BUFFER):
                size += len(texts[upto])
                upto += 1
            buffer, ends, lo, hi = assemble(roles[at:upto], texts[at:upto])
            ids = convs[at:upto]
            firsts = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
            numbers, losses = [], []
            for a, b in zip(firsts, [*firsts[1:], len(ids)]):
                segment = segment + 1 if last == (ids[a],) else 0
                last = (ids[a],)
                numbers.append(segment)
                base = int(ends[a - 1]) if a else 0
                losses.append([int(x) - base for k in range(a, b) if roles[at + k] == LOSS_ROLE for x in (lo[k], hi[k])])
            bounds = np.concatenate([[0], ends[np.array([*firsts[1:], len(ids)]) - 1]]).astype(np.int64)
            column = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(bounds), pa.py_buffer(buffer))
            turns = np.diff([*firsts, len(ids)])
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in firsts], pa.int64()), pa.array(numbers, pa.int64()), pa.array(turns, pa.int64()), column, pa.array(losses, pa.list_(pa.int64()))], schema=SEGMENT)
            at = upto


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted segment; raises ValueError if it is not one."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return out


def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What reading the segments back gives for each conversation; a conversation may span segments and batches."""
    state: list | None = None

    def row(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    for part in parts:
        rows = []
        for conv, segment, text, loss in zip(*(part.column(c).to_pylist() for c in ("conv_id", "segment", "text", "loss"))):
            if segment == 0:
                if state:
                    rows.append(row(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in read_turns(text):
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            raw = text.encode("utf-8", "surrogatepass")
            for a, b in zip(loss[::2], loss[1::2]):
                body = unescape(raw[a:b].decode("utf-8", "surrogatepass"))
                state[3] += len(body)
                state[4].update(body.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
        if rows:
            yield _rows(rows)
    if state:
        yield _rows([row(state)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def ordered(conversations: DataFrame) -> DataFrame:
    """Each conversation's rows in one partition, by turn; ties and null turns (first) by role and text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, turns, text, loss: the formatted conversations of (conv_id, turn, role, text).

    A null role or text is empty; rows with a null conv_id are one conversation; repeated rows are turns of their own.
    Nearly every conversation is one segment; those beyond a batch go on in segments 1, 2, ... Other columns are ignored.
    """
    return ordered(conversations).mapInArrow(_narrow, "conv_id long, segment long, turns long, text string, loss array<bigint>")


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in segments(batches):
        yield b.set_column(3, "text", b.column(3).cast(pa.string()))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered(conversations).mapInArrow(lambda batches: digests(segments(batches)), out)
