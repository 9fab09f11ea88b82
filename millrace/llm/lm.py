"""Language model scoring: a gated recurrent network with a class-factored output.

Word counts cover all training documents. The HEAD most frequent words are symbols of their own; all other words are
symbols by their ending, within which words are predicted by smoothed counts, with one place for unknown words. Symbols
are cut into classes of CLASS_WORDS by rank, and the output is P(class) P(symbol | class). So the network's input and
output are bounded however many words there are, and every probability sums to one over known words and one unknown
word for each ending.

The network's weights are fitted over all training documents in ROUNDS rounds. In each, every task starts from the
broadcast weights, runs truncated backpropagation in numpy over its own documents' symbols and gives how far its
weights moved; the moves are averaged by tokens. Each document is read in one round. No text comes to the driver. Documents are scored in lanes of like
length, window by window, with the state carried on, so a document's log-likelihood is complete. Counts of words beyond
the BROADCAST most frequent are joined in by a shuffle.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard
from .base import held_out, written

END = "\n"
HEAD, CLASS_WORDS, ENDINGS, BROADCAST = 1024, 32, 96, 60_000
HIDDEN, ROUNDS = 24, 4
#: Without effect: every corpus, whatever its size, is read once, each document in one round. Tests set it to show that.
SMALL_CORPUS = 1 << 21
#: Tokens that a task trains on in a round, and those of a set of documents (a longer document is a set of its own); a
#: task holds two sets at once.
TASK_TOKENS, HELD_TOKENS = 1 << 19, 1 << 18
#: Tasks of a round at most, so that what they give stays bounded: under 1 MB each.
TASKS = 4096
#: Weights move in whole multiples of 1/STEPS_A_UNIT, so their sum is exact in any order.
STEPS_A_UNIT = 1 << 22
LANES, WINDOW = 512, 64
#: Words and their counts in one hash table of the join that gives rare words their counts.
JOINED = 1 << 18
#: Bytes of text whose words a task handles at once.
SLICE = 4 << 20
PUNCTUATION = b".,;:!?%*&$#|\"')]}-"


def ending(word: bytes) -> str:
    """The last two bytes before trailing punctuation, and whether there is any."""
    bare = word.rstrip(PUNCTUATION)
    return bare[-2:].decode("latin-1") + ("+" if len(bare) < len(word) else "")


def endings_of(words: pa.Array) -> pa.Array:
    """ending() for an Arrow column of large strings, as bytes."""
    bare = pc.ascii_rtrim(words, characters=PUNCTUATION.decode())
    more = pc.not_equal(pc.binary_length(bare), pc.binary_length(words))
    last = pc.binary_slice(bare.cast(pa.large_binary()), -2, None)
    mark, none = (pa.scalar(b, pa.large_binary()) for b in (b"+", b""))
    return pc.binary_join_element_wise(last, pc.if_else(more, mark, none), none)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each token its text's number and its word's number, texts in order, each text's words and then its end; and the words.

    A-Z are lower-cased, words are cut at ASCII white space, a null text is empty.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat, of = cut.flatten(), np.repeat(np.arange(len(cut), dtype=np.int32), np.diff(cut.offsets.to_numpy()))
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    of, code = of[real.to_numpy(zero_copy_only=False)], coded.indices.to_numpy()
    # Each text before puts its end before a word.
    all_of = np.repeat(np.arange(len(cut), dtype=np.int32), np.bincount(of, minlength=len(cut)) + 1)
    all_code = np.full(len(all_of), len(coded.dictionary), np.int32)
    all_code[np.arange(len(of)) + of] = code
    return all_of, all_code, pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_string())])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches with a text, parts of SLICE bytes of it; a longer text is a part of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(ends):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            # Copied, not sliced: of a slice of long strings pyarrow's ascii_lower reads other bytes.
            yield batch.take(pa.array(np.arange(at, upto)))
            at = upto


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over the rows of docs (text, held_out) that are not held out, m over all, ends included.

    A slice's words are tallied before the shuffle.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            of, code, words = words_of(batch.column("text"))
            learned = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            n, m = np.bincount(code[learned[of]], minlength=len(words)), np.bincount(code, minlength=len(words))
            for k in range(0, len(words), 1 << 18):
                part = slice(k, k + (1 << 18))
                yield pa.RecordBatch.from_arrays([words[part].cast(pa.string()), pa.array(n[part]), pa.array(m[part])], ["word", "n", "m"])

    return docs.select("text", "held_out").mapInArrow(tally, "word string, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Vocabulary:
    """What scoring needs of the counts: bounded in size whatever the corpus."""

    def __init__(self, top: list[tuple[str, int]], endings: list[tuple[str, int, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.top = {w.encode(): n for w, n in top}
        known = [(w, n) for w, n in top[:HEAD] if n]
        self.head = {w.encode(): k for k, (w, _) in enumerate(known)}
        self.head_counts = np.array([n for _, n in known], float)
        self.ending = {e: k for k, (e, _, _) in enumerate(endings)}
        # The last ending class has all other endings.
        rest_n = total - self.head_counts.sum() - sum(n for _, n, _ in endings)
        rest_v = distinct - len(self.head) - sum(v for _, _, v in endings)
        self.ending_counts = np.array([*(n for _, n, _ in endings), rest_n], float)
        self.ending_words = np.array([*(v for _, _, v in endings), rest_v], float)
        self.symbols = len(self.head) + len(self.ending_counts)
        self.symbol_counts = np.concatenate([self.head_counts, self.ending_counts])
        self.norm = np.log10(self.ending_counts + self.ending_words + 1)

    def symbol(self, word: bytes) -> int:
        """A head word's rank, or len(head) and the number of the word's ending class."""
        found = self.head.get(word)
        if found is not None:
            return found
        return len(self.head) + self.ending.get(ending(word), len(self.ending_counts) - 1)

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its count among the top words, or -1, and its symbol: count and symbol() for an Arrow column."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = pc.index_in(words, pa.array(list(self.top), pa.large_binary()).cast(pa.large_string())).fill_null(-1).to_numpy()
        counts = np.array([*self.top.values(), -1], np.int64)[at]
        symbols = at.astype(np.int64)
        other = (at < 0) | (at >= len(self.head))
        known = pa.array([e.encode("latin-1") for e in self.ending], pa.large_binary())
        found = pc.index_in(endings_of(words.filter(pa.array(other))), known)
        symbols[other] = len(self.head) + found.fill_null(len(self.ending_counts) - 1).to_numpy()
        return counts, symbols


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From written counts (word, n, m). What comes to the driver is bounded by BROADCAST and ENDINGS.

    The most frequent words of all documents, held out or not, are those from a count on that at most BROADCAST words
    reach: any other word is under 1/BROADCAST of all tokens. The count is found from a histogram over 64 steps a
    doubling, so that only these words are collected, not each partition's candidates. If more words than that share
    the top step, none is collected, and all are told by their endings.
    """
    step = F.floor(F.log2("m") * 64)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("known")).collect()
    least, reached = None, 0
    for r in sorted(steps, key=lambda r: -r.step):
        reached += r.words
        if reached > BROADCAST:
            break
        least = r.step
    top = [] if least is None else sorted(((r.word, r.n) for r in counts.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))
    head = [w for w, n in top[:HEAD] if n]

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word").cast(pa.large_string())
            told = pa.table({"e": endings_of(word), "n": batch.column("n")}).filter(pc.invert(pc.is_in(word, pa.array(head, pa.large_string()))))
            for part in told.group_by("e").aggregate([("n", "sum"), ("n", "count")]).to_batches():
                yield pa.RecordBatch.from_arrays([part.column("e").cast(pa.binary()), part.column("n_sum"), part.column("n_count")], ["e", "n", "v"])

    found = counts.where("n > 0").select("word", "n").mapInArrow(tail, "e binary, n long, v long").groupBy("e").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    endings = [(bytes(r.e).decode("latin-1"), r.n, r.v) for r in found.orderBy(F.desc("n"), "e").limit(ENDINGS - 1).collect()]
    return Vocabulary(top, endings, sum(r.n for r in steps), sum(r.known for r in steps))


class Gru:
    """symbols + 1 inputs (the last is the start), HIDDEN states, classes of CLASS_WORDS symbols and their symbols."""

    def __init__(self, v: Vocabulary, seed: int = 11):
        r = np.random.default_rng(seed)
        h, f = HIDDEN, np.float32
        self.x = r.normal(0, 0.2, (v.symbols + 1, 3 * h)).astype(f)
        self.x[:, :h] += 1.0  # states last at first
        self.u = (r.normal(0, 1, (h, 3 * h)) / math.sqrt(h)).astype(f)
        self.class_words = CLASS_WORDS
        self.classes = -(-v.symbols // CLASS_WORDS)
        self.w = r.normal(0, 0.1, (h, self.classes)).astype(f)
        # A symbol that nothing counts is as likely as one token; a place without a symbol is impossible.
        counts = np.zeros(self.classes * CLASS_WORDS)
        counts[: v.symbols] = np.maximum(v.symbol_counts, 1)
        self.b = np.log(counts.reshape(-1, CLASS_WORDS).sum(1)).astype(f)
        self.ww = r.normal(0, 0.05, (self.classes, h, CLASS_WORDS)).astype(f)
        self.wb = np.where(counts > 0, np.log(np.maximum(counts, 1)), -1e9).reshape(-1, CLASS_WORDS).astype(f)

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.w, self.b, self.ww, self.wb]

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states after inputs x [lane, 3 * HIDDEN] from states h [lane, HIDDEN]."""
        x = np.ascontiguousarray(x.T)
        return self._step(x, np.ascontiguousarray(self.u.T) @ h.T, h.T).T

    @staticmethod
    def _step(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Units by rows, lanes by columns; x becomes the gates and the candidate."""
        n = HIDDEN
        gates, c = x[: 2 * n], x[2 * n :]
        gates += u[: 2 * n]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        c += gates[n:] * u[2 * n :]
        np.tanh(c, out=c)
        out = h - c
        out *= gates[:n]
        out += c
        return out

    def _inputs(self, symbols: np.ndarray) -> np.ndarray:
        """[time, 3 * HIDDEN, lane] of symbols [time, lane]."""
        return np.ascontiguousarray(self.x[symbols].transpose(0, 2, 1))

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The order of tokens by class, their classes in it, and (class, first, end) of each class that occurs."""
        cls = (y // self.class_words).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        bounds = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        return order, cls, [(c, a, b) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]

    def log_probs(self, hs: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of P(class) P(symbol | class); hs: [token, HIDDEN]."""
        return self._log_probs(np.ascontiguousarray(hs.T), np.arange(len(y)), y)

    def _log_probs(self, states: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of symbols y after the states in columns `at`."""
        order, cls, runs = self._by_class(y)
        states, word = states.take(at[order], 1), y[order] % self.class_words
        found = _log_softmax(self.w.T @ states + self.b[:, None], cls)
        for c, a, b in runs:
            found[a:b] += _log_softmax(self.ww[c].T @ states[:, a:b] + self.wb[c][:, None], word[a:b])
        out = np.empty_like(found)
        out[order] = found
        return out

    def fit(self, docs: Iterable[np.ndarray], lanes: int = 128, window: int = 32, rate: float = 0.01) -> int:
        """Adam over windows of lanes, once over all docs; the number of tokens read.

        A lane is documents one after another, and the state starts anew with each; it also does where a lane begins.
        """
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()]
        done = read = 0
        for some in _held(docs):
            outs = np.concatenate(some)
            ins = np.concatenate([np.concatenate([[len(self.x) - 1], d[:-1]]) for d in some])
            starts = np.zeros(len(outs), bool)
            starts[np.cumsum([0, *map(len, some)])[:-1]] = True
            read += len(outs)
            wide = max(1, min(lanes, len(outs) // (64 * window)))  # so that few documents give 64 steps too
            steps = -(-len(outs) // wide)
            real = np.ones(len(outs), bool)
            ins, outs, starts, real = (np.pad(a, (0, steps * wide - len(a))).reshape(wide, steps).T for a in (ins, outs, starts, real))
            h = np.zeros((wide, HIDDEN), np.float32)
            for t in range(0, steps, window):
                part = slice(t, t + window)
                grads, h = self._gradients(ins[part], outs[part], starts[part], h, real[part])
                done += 1
                norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads))
                scale = min(1.0, 1.0 / (norm + 1e-8))
                of_s = math.sqrt(1 - 0.99**done)
                for p, g, (m, s) in zip(self.params(), grads, moments):
                    m *= 0.9
                    s *= 0.99
                    m += np.multiply(g, 0.1 * scale)
                    np.multiply(g, g, out=g)
                    g *= 0.01 * scale * scale
                    s += g
                    np.sqrt(s, out=g)
                    g += 1e-6 * of_s
                    np.divide(m, g, out=g)
                    g *= rate * of_s / (1 - 0.9**done)
                    p -= g
        return read

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()]).astype(float)

    def move(self, by: np.ndarray) -> None:
        at = 0
        for p in self.params():
            p += by[at : at + p.size].reshape(p.shape).astype(p.dtype)
            at += p.size

    def _gradients(self, ins, outs, starts, h, real=None):
        """Of the mean loss over the real tokens, and the last states [lane, HIDDEN]; other tokens only pad the lanes."""
        n, (steps, lanes) = HIDDEN, ins.shape
        x, ut, h = self._inputs(ins), np.ascontiguousarray(self.u.T), h.T
        u, before, states = np.empty_like(x), np.empty((n, steps, lanes), x.dtype), np.empty((n, steps, lanes), x.dtype)
        anew = starts.any(1).tolist()
        for t in range(steps):
            before[:, t] = h
            if anew[t]:
                before[:, t][:, starts[t]] = 0
            np.matmul(ut, before[:, t], out=u[t])
            states[:, t] = h = self._step(x[t], u[t], before[:, t])
        y = outs.ravel()
        share = np.full(len(y), 1 / len(y), x.dtype) if real is None else (real.ravel() / real.sum()).astype(x.dtype)
        gx, gu, gw, gb, gww, gwb = (np.zeros_like(p) for p in self.params())
        order, cls, runs = self._by_class(y)
        word, share = y[order] % self.class_words, share[order]
        flat = states.reshape(n, -1).take(order, 1)
        s = _loss_gradient(self.w.T @ flat + self.b[:, None], cls, share)
        gw[:], gb[:] = flat @ s.T, s.sum(1)
        dflat = self.w @ s
        for c, a, b in runs:
            part = flat[:, a:b]
            s = _loss_gradient(self.ww[c].T @ part + self.wb[c][:, None], word[a:b], share[a:b])
            gww[c], gwb[c] = part @ s.T, s.sum(1)
            dflat[:, a:b] += self.ww[c] @ s
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        dh = dflat.take(back, 1).reshape(n, steps, lanes)
        z, r, c = x[:, :n], x[:, n : 2 * n], x[:, 2 * n :]
        rest = 1 - z
        of_c = rest * (1 - c * c)
        of_z = (before.transpose(1, 0, 2) - c) * z * rest
        of_r = u[:, 2 * n :] * r * (1 - r)
        carry = np.zeros((n, lanes), x.dtype)
        # Of the gates, of the candidate's part of u, and of the candidate.
        g = np.empty((4 * n, steps, lanes), x.dtype)
        for t in range(steps - 1, -1, -1):
            d = dh[:, t] + carry
            gt = g[:, t]
            np.multiply(d, of_z[t], out=gt[:n])
            dc = np.multiply(d, of_c[t], out=gt[3 * n :])
            np.multiply(dc, of_r[t], out=gt[n : 2 * n])
            np.multiply(dc, r[t], out=gt[2 * n : 3 * n])
            carry = self.u @ gt[: 3 * n]
            d *= z[t]
            carry += d
            if anew[t]:
                carry[:, starts[t]] = 0
        g = g.reshape(4 * n, -1)
        np.matmul(before.reshape(n, -1), g[: 3 * n].T, out=gu)
        ins = ins.ravel().astype(np.int16)
        order = np.argsort(ins, kind="stable")
        ins = ins[order]
        first = np.flatnonzero(np.concatenate([[True], ins[1:] != ins[:-1]]))
        rows = np.concatenate([g[: 2 * n], g[3 * n :]]).T.take(order, 0)
        gx[ins[first]] = np.add.reduceat(rows, first, axis=0)
        return [gx, gu, gw, gb, gww, gwb], h.T

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Each document's natural log-likelihood of its symbols; lanes hold documents of like length."""
        out, ut = np.zeros(len(docs)), np.ascontiguousarray(self.u.T)
        flat = np.concatenate([*docs, np.zeros(WINDOW, np.int64)])
        first = np.cumsum([0, *map(len, docs)])
        order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
        for k in range(0, len(order), LANES):
            some = order[k : k + LANES]
            sizes = np.array([len(docs[i]) for i in some])
            h = np.zeros((HIDDEN, len(some)), np.float32)
            last = np.full(len(some), len(self.x) - 1)
            for t in range(0, sizes[0], WINDOW):
                live = int(np.searchsorted(-sizes, -t, "left"))
                n = min(WINDOW, sizes[0] - t)
                # Past a document's end are other symbols, whose states and probabilities nothing uses.
                y = flat[np.arange(t, t + n)[:, None] + first[some[:live]]]
                x = np.vstack([last[:live], y[:-1]])
                h, hs, inputs = h[:, :live], np.empty((HIDDEN, n, live), np.float32), self._inputs(x)
                for s in range(n):
                    hs[:, s] = h = self._step(inputs[s], ut @ h, h)
                last = y[-1]
                at = np.flatnonzero(np.arange(t, t + n)[:, None] < sizes[None, :live])
                lp = self._log_probs(hs.reshape(HIDDEN, -1), at, y.ravel()[at])
                out[some[:live]] += np.bincount(at % live, lp, minlength=live)
        return out


def _loss_gradient(s: np.ndarray, of: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of -share log softmax(s)[of] in each column, in the place of s."""
    s -= s.max(0)
    np.exp(s, out=s)
    s *= share / s.sum(0)
    s[of, np.arange(len(of))] -= share
    return s


def _log_softmax(s: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of the row `of` in each column; s is used up."""
    s -= s.max(0)
    out = s[of, np.arange(s.shape[1])]
    np.exp(s, out=s)
    return out - np.log(s.sum(0))


def _held(docs: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sets of HELD_TOKENS or more; what is left over joins the last, for a small set has as many windows as a full one."""
    some, size, last = [], 0, []
    for d in docs:
        some.append(d)
        size += len(d)
        if size >= HELD_TOKENS:
            if last:
                yield last
            some, size, last = [], 0, some
    if last or some:
        yield last + some


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2").astype(np.int64) for b in batch.column("symbols").to_pylist()]


def _plus(a: tuple, b: tuple) -> tuple:
    return b if a[1] is None else a if b[1] is None else (a[0] + b[0], a[1] + b[1])


def train(coded: DataFrame, v: Vocabulary) -> tuple[Gru, int]:
    """Fitted on all rows of coded (row, held_out, symbols), a written table, that are not held out.

    Also gives the number of tokens read. Each row is read in one of the rounds, whatever the corpus's size, and both its
    round and its task come from the hash of its number, so no task has more than its share whatever the ids. A task gives one row of the weights' size, and these are added up
    in a tree: the driver gets the sum. Beyond TASKS tasks each reads more, a part at a time.
    """
    gru = Gru(v)
    context = coded.sparkSession.sparkContext
    tasks = min(TASKS, max(1, -(-v.total // (ROUNDS * TASK_TOKENS))))
    read = 0
    for k in range(ROUNDS if v.total else 0):
        rate = 0.01 * (1 - 0.9 * k / ROUNDS)
        shared = context.broadcast(gru)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            own = copy.deepcopy(shared.value)
            before = own.flat()
            n = own.fit((d for batch in batches for d in _sequences(batch)), rate=rate)
            if n:
                moved = np.rint((own.flat() - before) * STEPS_A_UNIT).astype(np.int64) * n
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([moved.tobytes()], pa.binary())], ["n", "moved"])

        order = F.xxhash64("row", F.lit(k))
        rows = coded.where(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == k)).select("row", "symbols")
        moves = rows.repartition(tasks, "row").sortWithinPartitions(order, "row").mapInArrow(run, "n long, moved binary")
        n, moved = moves.rdd.map(lambda r: (r.n, np.frombuffer(r.moved, np.int64))).treeAggregate((0, None), _plus, _plus)
        if n:
            gru.move(moved / (n * STEPS_A_UNIT))
        read += n
        shared.destroy()
    return gru, read


OWN = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, logs double, ending_logs double"
CODED, SCORED = f"{OWN}, rare array<string>, symbols binary", f"{OWN}, model double"


def score_documents(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, fitted_tokens: one row for each row of docs (doc_id, text).

    Learned from the rows that are not held out; a null text is empty and consists of its end. Scores are log10: the
    base's by add-one counts, the model's by the network. Without training rows all words are unknown. fitted_tokens
    is the number of training tokens that the network's weights were fitted on, each counted once. Other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id", modulus).alias("held_out"))
    counts = written(word_counts(docs), "counts")
    v = vocabulary(counts)
    vocabularies = docs.sparkSession.sparkContext.broadcast(v)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies.value
        for batch in _slices(batches):
            of, word, words = words_of(batch.column("text"))
            n, symbols = v.codes(words)
            logs, rest = np.log10(np.maximum(n, 0) + 1), symbols - len(v.head)
            of_ending = np.where(rest >= 0, logs - v.norm[np.maximum(rest, 0)], 0)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))])
            # Of what each word gives, the sum over a text's tokens, of which each text has one at least.
            total = lambda given: pa.array(np.add.reduceat(given[word], bounds[:-1]))
            rare = np.flatnonzero((n < 0)[word])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, bounds), pa.int32()), words.take(pa.array(word[rare])).cast(pa.string()))
            packed = symbols.astype("<u2")[word]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("row"), pa.array(np.diff(bounds)), total((n > 0).astype(np.int64)), total(logs), total(of_ending), lists,
                 pa.array([packed[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "logs", "ending_logs", "rare", "symbols"],
            )

    ready = docs.withColumn("row", F.monotonically_increasing_id())
    coded = written(ready.mapInArrow(code, CODED), "coded")
    # Words beyond the broadcast ones, known or not: none is over 1/BROADCAST of all tokens, so no key is hot. Each word
    # is counted once, so a part's hash table has about JOINED rows, whatever the corpus, and nothing need be sorted.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-v.distinct // JOINED))
    rare = coded.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word")).repartition(parts, "word")
    rare = rare.join(counts.where("n > 0").select("word", "n").repartition(parts, "word").hint("shuffle_hash"), "word")
    rare = written(rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs")), "rare")
    discard(counts)
    network, fitted = train(coded, v)
    networks = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = pa.array(networks.value.score(_sequences(batch)) / math.log(10), pa.float64())
            yield batch.drop_columns(["symbols"]).append_column("model", model)

    own = written(coded.drop("rare").mapInArrow(run, SCORED), "scored")
    discard(coded)
    zero = F.lit(0)
    base = F.col("logs") + F.coalesce("more_logs", zero) - F.col("n_tokens") * math.log10(v.total + v.distinct + 1)
    return own.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", zero)).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("model") + F.col("ending_logs") + F.coalesce("more_logs", zero)).alias("score"),
        F.lit(fitted).cast("long").alias("fitted_tokens"),
    )
