"""Language-model scoring: a gated recurrent network with a class-factored softmax, trained where the documents lie.

A text's tokens are its words and one end. The `listed` most frequent ones have outputs of their own, in classes of equal
size by rank; all others fall into classes by their form, inside which their smoothed share of the training tokens counts.
So every token has a probability, words never seen included, and these sum to one. P(token) is P(class | state) times
P(token | class, state) for listed tokens, or P(class | state) times that share for others.

1. Tasks tokenise portions of whole texts to rows of word ids with the portion's own list of words (`blocks`).
2. Training counts of all words are summed over all blocks; words meet them by word, with frequent words as hot keys.
3. Each block meets its words' counts and codes again and gives a row a document: codes, base score, the others' shares.
4. In each round every task trains on its own documents of that round, by backpropagation truncated to windows with the
   state carried over from one to the next; the tasks' weights are averaged, by their tokens, in two steps of bounded groups.
5. Documents are scored whole, many at once, window by window, each with its own state from the first token to the end.

What the corpus gives grows with it: counts, shares, distinct words, and the documents trained on, each in one of the
rounds. Only totals, the listed words and the averaged weights (all bounded by parameters) reach the driver.
A document is never split between tasks, so the longest one bounds the longest task.

Defined cases: a null or empty text is one end token; a null doc_id counts as trained on; repeated rows count and are
scored once each; without training documents all counts are 0, the base score is 0 and the network keeps its first
weights; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import words
from vellum.llm.common import drop, join_with_hot_keys, stash

#: A token that no word can be: words hold no blank.
END = " "
SMOOTHING = 0.1
#: Bytes of text in a block, and tokens that a task holds at a time in training and scoring.
BLOCK, HELD = 1 << 24, 1 << 21


@dataclass(frozen=True)
class Settings:
    listed: int = 1024
    per_class: int = 32
    width: int = 16
    window: int = 32
    streams: int = 256
    rounds: int = 3
    rate: float = 0.03
    seed: int = 13


#: Forms of words that aren't listed: how they end, whether they are long, whether they hold other than ASCII.
FORMS = 12


def form(word: Column) -> Column:
    ends = F.when(word.rlike(r"[.!?]$"), 2).when(word.rlike(r"[,;:]$"), 1).otherwise(0)
    size = F.octet_length(word)
    return ends * 4 + (size > 8).cast("int") * 2 + (size > F.char_length(word)).cast("int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


# ---- tokens and counts ----------------------------------------------------------------------------------------------

BLOCKS = "block long, doc_ids array<long>, held array<boolean>, counts array<int>, ids binary, words array<binary>, n array<int>"


def _pressed(ids: np.ndarray) -> bytes:
    """Ids as their first bytes, then their second ones and so on, compressed."""
    return zstandard.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpressed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int32())), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int32()))])
    for i, portion in enumerate(words.portions(batches, "text", BLOCK)):
        each, counts = words.split(portion["text"].combine_chunks(), words.SPACED)
        coded = each.dictionary_encode()
        ends = np.cumsum(counts + 1) - 1
        ids = np.zeros(len(each) + len(counts), np.uint32)
        is_word = np.ones(len(ids), bool)
        is_word[ends] = False
        ids[is_word] = coded.indices.to_numpy().astype(np.uint32) + 1
        held = portion["held"].to_numpy()
        trained = ids[np.repeat(~held, counts + 1)]
        known = pa.concat_arrays([pa.array([END.encode()], pa.binary()), coded.dictionary.cast(pa.binary())])
        n = np.bincount(trained, minlength=len(known)).astype(np.int32)
        columns = [[(TaskContext.get().partitionId() << 24) + i], [portion["doc_ids"].to_pylist()], [held], [(counts + 1).astype(np.int32)], [_pressed(ids)]]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)]
        arrays += [pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), x) for x in (known, pa.array(n))]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


@dataclass(frozen=True)
class Totals:
    """Training tokens and distinct ones, of all words and of each form's words that aren't listed."""

    tokens: int
    distinct: int
    form_tokens: np.ndarray
    form_distinct: np.ndarray


def count_words(blocks: DataFrame, st: Settings) -> tuple[DataFrame, Totals, list[int]]:
    """((word, c, in_blocks, code) of every word, stashed; totals; counts of the listed words)."""
    each = blocks.select(F.explode(F.arrays_zip("words", "n")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.n").alias("n"))
    counts = stash(each.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("in_blocks")), "counts")
    is_end = F.col("word") == F.lit(END.encode())
    top = counts.filter(~is_end & (F.col("c") > 0)).orderBy(F.col("c").desc(), "word").limit(st.listed - 1).select("word", "c").collect()
    end = counts.filter(is_end).select("c").first()
    listed = [(END.encode(), end["c"] if end else 0), *((bytes(r["word"]), r["c"]) for r in top)]
    known = blocks.sparkSession.createDataFrame([(w, i) for i, (w, _) in enumerate(listed)], "word binary, code int")
    text = F.col("word").cast("string")
    coded = counts.join(F.broadcast(known), "word", "left").withColumn("code", F.coalesce("code", st.listed + form(text)))
    coded = stash(coded.select("word", "c", "in_blocks", F.col("code").cast("int").alias("code")), "codes")
    drop(counts)
    tokens, distinct = np.zeros(FORMS + 1, np.int64), np.zeros(FORMS + 1, np.int64)
    kind = F.greatest(F.col("code") - st.listed + 1, F.lit(0))
    for r in coded.filter("c > 0").groupBy(kind.alias("k")).agg(F.sum("c").alias("t"), F.count("*").alias("d")).collect():
        tokens[r["k"]], distinct[r["k"]] = r["t"], r["d"]
    return coded, Totals(int(tokens.sum()), int(distinct.sum()), tokens[1:], distinct[1:]), [c for _, c in listed]


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rest_score double, codes binary"


def _meet(totals: Totals, listed: int):
    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        size = block["size"][0].as_py()
        c, code = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = known["pos"].to_numpy()
        c[at], code[at] = known["c"].to_numpy(), known["code"].to_numpy()
        log = lambda n, d: np.log10((c + SMOOTHING) / (n + SMOOTHING * (d + 1)))
        own = np.maximum(code - listed, 0)
        rest = np.where(code >= listed, log(totals.form_tokens[own], totals.form_distinct[own]), 0.0)
        ids = _unpressed(block["ids"][0].as_py())
        counts = block["counts"][0].values.to_numpy()
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sums = [np.add.reduceat(x[ids], starts) for x in ((c > 0).astype(np.int64), log(totals.tokens, totals.distinct), rest)]
        places = np.append(starts, len(ids)).astype(np.int32) * 2
        codes = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(places), pa.py_buffer(code.astype(np.uint16)[ids])])
        columns = [block["doc_ids"][0].values, block["held"][0].values, pa.array(counts.astype(np.int64)), *map(pa.array, sums), codes]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "rest_score", "codes"])

    return run


# ---- the network -----------------------------------------------------------------------------------------------------


class Network:
    """Weights as views of one vector: inputs by code, recurrence, class outputs, word outputs by class."""

    def __init__(self, st: Settings, flat: np.ndarray | None = None):
        h, self.st = st.width, st
        self.n_classes, self.codes = st.listed // st.per_class, st.listed + FORMS
        shapes = {"win": (self.codes, 3 * h), "u": (3 * h, h), "bn": (h,), "wc": (h, self.n_classes + FORMS), "bc": (self.n_classes + FORMS,), "wo": (self.n_classes, h, st.per_class), "bo": (self.n_classes, st.per_class)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        if flat is None:
            draw = np.random.default_rng(st.seed)
            flat = (draw.standard_normal(size) * 0.1).astype(np.float32)
        self.flat, at = flat, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    def start_from(self, listed: list[int], form_tokens: np.ndarray) -> None:
        """Output biases as the counts have it, so that training starts from them."""
        n = np.full(self.st.listed, SMOOTHING)
        n[: len(listed)] += listed
        by_class = n.reshape(self.n_classes, -1)
        self.bo[:] = np.log(by_class / by_class.sum(1, keepdims=True))
        total = np.concatenate([by_class.sum(1), form_tokens + SMOOTHING])
        self.bc[:] = np.log(total / total.sum())

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What codes x[time, document] add to the gates and the candidate: [time, 3 * width, document]."""
        return np.ascontiguousarray(self.win[x].transpose(0, 2, 1))

    def step(self, xp: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One token further, a document a column: (state, both gates, candidate, its recurrent part)."""
        w = self.st.width
        a = self.u @ h
        gates, inner = a[: 2 * w], a[2 * w :]
        gates += xp[: 2 * w]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        inner += self.bn[:, None]
        new = gates[w:] * inner
        new += xp[2 * w :]
        np.tanh(new, out=new)
        out = h - new
        out *= gates[:w]
        out += new
        return out, gates, new, inner

    def by_class(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(class, places of its listed codes, their numbers in it)."""
        cls = (codes // self.st.per_class).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.n_classes + 1))
        for c in range(self.n_classes):
            if bounds[c] < bounds[c + 1]:
                at = order[bounds[c] : bounds[c + 1]]
                yield c, at, codes[at] % self.st.per_class

    def classes(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < self.st.listed, codes // self.st.per_class, codes - self.st.listed + self.n_classes)

    def log_p(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of each code after its state; states[place, width]."""
        out = _log_softmax(self.wc.T @ states.T + self.bc[:, None])[self.classes(codes), np.arange(len(codes))]
        for c, at, k in self.by_class(codes):
            out[at] += _log_softmax(self.wo[c].T @ states[at].T + self.bo[c][:, None])[k, np.arange(len(at))]
        return out

    def window(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, h: np.ndarray, grad: Network) -> tuple[np.ndarray, float]:
        """Backpropagation over one window x, y, weight[time, stream]; (state after it, sum of log probabilities)."""
        (t_max, b), w = x.shape, self.st.width
        xp, keep = self.inputs(x), (x != 0).astype(np.float32)
        before, gates, new, inner, after = ([None] * t_max for _ in range(5))
        for t in range(t_max):
            before[t] = h * keep[t]
            h, gates[t], new[t], inner[t] = self.step(xp[t], before[t])
            after[t] = h
        states = np.stack(after).transpose(0, 2, 1).reshape(-1, w)
        d_states, told = self.outputs(states, y.ravel(), weight.ravel(), grad)
        d_states = np.ascontiguousarray(d_states.reshape(t_max, b, w).transpose(0, 2, 1))
        d_in, d_rec, d_h = np.empty((t_max, 3 * w, b), np.float32), np.empty((t_max, 3 * w, b), np.float32), np.zeros((w, b), np.float32)
        back = np.ascontiguousarray(self.u.T)
        for t in reversed(range(t_max)):
            d_h += d_states[t]
            z, r, n = gates[t][:w], gates[t][w:], new[t]
            di, dr = d_in[t], d_rec[t]
            dn = di[2 * w :]
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= d_h
            rest = 1 - z
            dn *= rest
            np.multiply(dn, r, out=dr[2 * w :])
            rest *= z
            rest *= d_h
            np.multiply(before[t] - n, rest, out=di[:w])
            np.multiply(dr[2 * w :], inner[t], out=di[w : 2 * w])
            di[w : 2 * w] *= 1 - r
            dr[: 2 * w] = di[: 2 * w]
            d_h *= z
            d_h += back @ dr
            d_h *= keep[t]
        flat = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], -1)
        d_rec = flat(d_rec)
        grad.u[:], grad.bn[:] = d_rec @ flat(np.stack(before)).T, d_rec[2 * w :].sum(1)
        order = np.argsort(x.ravel().astype(np.int16), kind="stable")
        ids = x.ravel()[order]
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        grad.win[:] = 0
        grad.win[ids[heads]] = np.add.reduceat(d_in.transpose(0, 2, 1).reshape(-1, 3 * w)[order], heads, axis=0)
        return h, told

    def outputs(self, states: np.ndarray, codes: np.ndarray, weight: np.ndarray, grad: Network) -> tuple[np.ndarray, float]:
        """(gradient of the states, sum of log probabilities) of codes after states; sets the outputs' gradients."""
        rows, scale = np.arange(len(codes)), weight / max(1.0, float(weight.sum()))
        p = _softmax(self.wc.T @ states.T + self.bc[:, None])
        cls = self.classes(codes)
        told = np.log(p[cls, rows])
        p[cls, rows] -= 1
        p *= scale
        grad.wc[:], grad.bc[:] = (p @ states).T, p.sum(1)
        d_states = np.ascontiguousarray((self.wc @ p).T)
        grad.wo[:], grad.bo[:] = 0, 0
        for c, at, k in self.by_class(codes):
            own, each = states[at], np.arange(len(at))
            q = _softmax(self.wo[c].T @ own.T + self.bo[c][:, None])
            told[at] += np.log(q[k, each])
            q[k, each] -= 1
            q *= scale[at]
            grad.wo[c], grad.bo[c] = (q @ own).T, q.sum(1)
            d_states[at] += (self.wo[c] @ q).T
        return d_states, float((told * weight).sum())


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the columns, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(0)
    return x - np.log(np.exp(x).sum(0))


class Adam:
    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.t = flat, rate, 0
        self.mean, self.square = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, grad: np.ndarray) -> None:
        self.t += 1
        self.mean += 0.1 * (grad - self.mean)
        self.square += 0.01 * (grad * grad - self.square)
        size = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        self.flat -= np.float32(size) * self.mean / (np.sqrt(self.square) + 1e-6)


def train(net: Network, codes: np.ndarray, adam: Adam) -> float:
    """Go once through the tokens of whole documents (each ends with code 0), as parallel streams; sum of log probabilities."""
    st, n = net.st, len(codes)
    streams = max(1, min(st.streams, n // st.window))
    length = -(-n // (streams * st.window)) * st.window
    y, weight = np.zeros(streams * length, np.int64), np.zeros(streams * length, np.float32)
    y[:n], weight[:n] = codes, 1
    y, weight = y.reshape(streams, length), weight.reshape(streams, length)
    x = np.concatenate([np.zeros((streams, 1), np.int64), y[:, :-1]], axis=1)
    h, grad, told = np.zeros((st.width, streams), np.float32), Network(st, np.zeros_like(net.flat)), 0.0
    for lo in range(0, length, st.window):
        cut = slice(lo, lo + st.window)
        h, sums = net.window(np.ascontiguousarray(x[:, cut].T), np.ascontiguousarray(y[:, cut].T), np.ascontiguousarray(weight[:, cut].T), h, grad)
        adam.step(grad.flat)
        told += sums
    return told


def log10_p(net: Network, codes: list[np.ndarray], at_once: int = 512, window: int = 32) -> np.ndarray:
    """log10 probability of whole documents, the longest first; each keeps its state from window to window."""
    sizes = np.array([len(c) for c in codes])
    out, order = np.zeros(len(codes)), np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), at_once):
        group = order[lo : lo + at_once]
        long = sizes[group]
        h = np.zeros((net.st.width, len(group)), np.float32)
        previous = np.zeros(len(group), np.int64)
        for start in range(0, int(long[0]), window):
            some = int(np.searchsorted(-long, -start, side="left"))  # documents that go on here
            steps = min(window, int(long[0]) - start)
            y = np.zeros((steps, some), np.int64)
            for i in range(some):
                part = codes[group[i]][start : start + steps]
                y[: len(part), i] = part
            x = np.concatenate([previous[None, :some], y[:-1]])
            h, previous = np.ascontiguousarray(h[:, :some]), y[-1]
            xp, states = net.inputs(x), []
            for t in range(steps):
                h = net.step(xp[t], h)[0]
                states.append(h)
            there = (np.arange(start, start + steps)[:, None] < long[None, :some]).ravel()
            lp = np.zeros(steps * some)
            lp[there] = net.log_p(np.stack(states).transpose(0, 2, 1).reshape(-1, net.st.width)[there], y.ravel()[there])
            out[group[:some]] += lp.reshape(steps, some).sum(0)
    return out / np.log(10)


# ---- the jobs --------------------------------------------------------------------------------------------------------


def _held_tokens(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    for portion in words.portions(batches, "codes", 2 * most):
        yield portion, [np.frombuffer(c.as_buffer(), np.uint16).astype(np.int64) for c in portion["codes"]]


def _average(table: pa.Table) -> pa.Table:
    """The mean of weights, each counted by its tokens."""
    tokens = np.array(table["tokens"].to_pylist(), np.float64)
    flat = sum(np.frombuffer(w.as_buffer(), np.float32) * t for w, t in zip(table["weights"], tokens, strict=True)) / tokens.sum()
    return pa.table({"part": table["part"][:1], "weights": pa.array([flat.astype(np.float32).tobytes()], pa.binary()), "tokens": pa.array([int(tokens.sum())], pa.int64())})


def fit(coded: DataFrame, net: Network) -> Network:
    """Rounds of local training and averaging over coded(doc_id, held_out, codes); each document is in one round."""
    st = net.st
    kinds = "part long, weights binary, tokens long"
    for k in range(st.rounds):
        flat, rate = net.flat, st.rate / 2**k

        def run(batches: Iterable[pa.RecordBatch], flat: np.ndarray = flat, rate: float = rate) -> Iterator[pa.RecordBatch]:
            own, tokens = Network(st, flat.copy()), 0
            adam = Adam(own.flat, rate)
            for _, codes in _held_tokens(batches, HELD):
                train(own, np.concatenate(codes), adam)
                tokens += sum(map(len, codes))
            if tokens:
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "weights": [own.flat.tobytes()], "tokens": [tokens]}, pa.schema([("part", pa.int64()), ("weights", pa.binary()), ("tokens", pa.int64())]))

        mine = ~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(st.rounds)) == k)
        parts = coded.filter(mine).select("codes").mapInArrow(run, kinds)
        for most in (1024, 32):  # no group holds more than a bounded share of the tasks' weights
            parts = parts.groupBy((F.col("part") % most).alias("g")).applyInArrow(_average, kinds)
        if rows := parts.collect():
            tokens = np.array([r["tokens"] for r in rows], np.float64)
            flat = sum(np.frombuffer(bytes(r["weights"]), np.float32) * t for r, t in zip(rows, tokens, strict=True)) / tokens.sum()
            net = Network(st, flat.astype(np.float32))
    return net


def encode(docs: DataFrame, st: Settings) -> tuple[DataFrame, Totals, list[int]]:
    """(CODED a document of docs(doc_id, text), stashed; totals; counts of the listed words)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_ids"), held_out(F.col("doc_id")).alias("held"), "text")
    blocks = stash(given.mapInArrow(_blocks, BLOCKS), "blocks")
    counts, totals, listed = count_words(blocks, st)
    own = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    n = counts.agg(F.sum("in_blocks")).first()[0] or 0
    known = join_with_hot_keys(own, counts, "word", "in_blocks", n, stashed=counts).select(F.col("block").alias("of"), "pos", "c", "code")
    met = blocks.select("block", "doc_ids", "held", "counts", "ids", F.size("words").alias("size")).groupBy("block").cogroup(known.groupBy("of"))
    coded = stash(met.applyInArrow(_meet(totals, st.listed), CODED), "coded")
    drop(blocks, counts)
    return coded, totals, listed


def score(docs: DataFrame, st: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text)."""
    st = st or Settings()
    coded, totals, listed = encode(docs, st)
    net = Network(st)
    net.start_from(listed, totals.form_tokens)
    flat = fit(coded, net).flat

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(st, flat)
        for portion, codes in _held_tokens(batches, HELD):
            total = log10_p(own, codes) + portion["rest_score"].to_numpy()
            kept = portion.drop_columns(["rest_score", "codes"]).append_column("score", pa.array(total))
            yield from kept.combine_chunks().to_batches()

    out = coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(totals.tokens).cast("long"))
