"""Gated recurrent language model with a class-factored softmax.

Tokens are lower-cased words and one end per text. Frequent words (a bounded list) are words of their
own; every other word belongs to one of a fixed number of rare classes by its ending. The network
predicts the class of the next token, and the word inside a class of frequent words; inside a rare
class words share the probability by their smoothed corpus counts, with one unit for all unseen words.
So every text has a proper probability, comparable with the unigram base.

Training runs truncated backpropagation through time in numpy inside the tasks, over all texts of the
training fold, which are dealt to a fixed number of rounds. In each round every task starts from the common
parameters, walks its share of the round's texts with the state carried through each (again and again until it
made a minimum of steps, which matters for small inputs only), and the parameters of all tasks are averaged in
bounded groups, those of a word or class by how often each task met it. Scoring walks every text in windows and
carries the state across them, so the whole text counts. Counts cover all training texts: they are added up in
Spark, and only rare words travel to meet their counts, the frequent ones being the bounded list. What a task
trains on follows from the files it reads, so scores of one corpus in other files differ slightly.

Defined results: null and empty texts are the end token alone; repeated documents count each time; an
empty training set leaves only unseen words; rows without an id are scored like any other.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aeroframe.llm import common

END = "\n"                       # no word holds a newline
FREQUENT = 100_000               # words whose counts travel with the tasks
OWN_WORDS = 2_016                # words the network tells apart
CLASS_SIZE = 63
RARE_CLASSES = 32
HIDDEN, WINDOW = 16, 32
RATES = (0.02, 0.01, 0.003)     # a round each; the training texts are dealt to the rounds
LEAST_STEPS = 100               # of a task in a round
LANES = 16, 512                 # texts a task trains on in step, by its tokens
SCORED = 1_024                  # texts scored in step
LANE_TOKENS = 4_096
_PARTS = 16                     # pieces in which parameters meet
_AVERAGED = 64                  # tasks whose parameters meet at once
BLOCK_TOKENS, BLOCK_TEXTS = 3_000_000, 8_000
_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_TABLE = bytes.maketrans(*_LOWER)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def rare_class(word: bytes) -> int:
    """Class of a word by its last three bytes."""
    return zlib.crc32(word[-3:]) % RARE_CLASSES


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n) over all tokens of ``documents``; every task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                                 names=["word", "n"])
                seen.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
            seen[END.encode()] += batch.num_rows
            if len(seen) > 500_000:
                yield from flush()
        yield from flush()

    return documents.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Grouping:
    """Which class a symbol belongs to."""

    own: int
    own_classes: int

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.own, symbols // CLASS_SIZE, self.own_classes + symbols - self.own)


@dataclass
class Vocabulary:
    """Frequent words with counts, totals, and the mass of every rare class."""

    counts: dict[bytes, int]
    total: int
    distinct: int
    own: list[bytes]
    rare_mass: np.ndarray

    def __post_init__(self) -> None:
        self.index = {w: i for i, w in enumerate(self.own)}
        self.own_classes = -(-len(self.own) // CLASS_SIZE)
        self.symbols = len(self.own) + RARE_CLASSES
        self.place = {w: i for i, w in enumerate(self.counts)}
        own = len(self.own)
        self.symbol_at = np.array([self.index.get(w, -1) if w in self.index else own + rare_class(w) for w in self.counts] + [-1], np.int64)
        self.count_at = np.array([*self.counts.values(), 0], np.float64)
        # log10(count + 1), and for words without an own symbol that over the mass of their class
        self.gain_at = np.log10(self.count_at + 1)
        rare = self.symbol_at >= own
        self.inside_at = np.where(rare, self.gain_at - np.log10(self.rare_mass)[np.maximum(self.symbol_at - own, 0)], 0.0)
        self.inside_at[-1] = 0
        self.classes = self.own_classes + RARE_CLASSES
        self.grouping = Grouping(own, self.own_classes)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, counts) of words; words off the list have count 0 here."""
        at, symbols = self.places(words)
        return symbols, self.count_at[at]

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places in the list, -1 off it; symbols) of words."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        symbols = self.symbol_at[at]
        own = len(self.own)
        for i in np.flatnonzero(at < 0).tolist():
            symbols[i] = own + rare_class(words[i])
        return at, symbols

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return self.grouping.class_of(symbols)

    @property
    def end(self) -> int:
        """Symbol of the end token, which also stands before a text."""
        return self.index.get(END.encode(), len(self.own) + rare_class(END.encode()))


def vocabulary(counted: DataFrame) -> Vocabulary:
    """Totals and the bounded list of frequent words; ``counted`` should be a written table."""
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    # counts in steps of about 1 %, so a few thousand rows; the list ends before the step that would overfill it
    step = F.floor(F.log(F.col("n").cast("double")) * 100).cast("int")
    least, held = None, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        held += r["k"]
        if held > FREQUENT:
            break
        least = r["n"]
    top = counted.where(F.col("n") >= least).collect() if least is not None else []
    counts = {w: n for n, w in sorted((-r["n"], bytes(r["word"])) for r in top)}
    counts = {w: -n for w, n in counts.items()}
    own = list(counts)[:OWN_WORDS]

    @F.arrow_udf("int")
    def class_of(words: pa.Array) -> pa.Array:
        return pa.array([rare_class(w) for w in words.to_pylist()], pa.int32())

    mass = np.ones(RARE_CLASSES)
    for r in counted.select(class_of.asNondeterministic()("word").alias("c"), "n").groupBy("c").agg(F.sum(F.col("n") + 1).alias("m")).collect():
        mass[r["c"]] += r["m"]
    for w in own:
        mass[rare_class(w)] -= counts[w] + 1
    return Vocabulary(counts, sums["total"], sums["distinct"], own, mass)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _exp(z: np.ndarray) -> np.ndarray:
    """exp in place, and the sums of the rows; _Adam keeps logits where exp is finite."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


class Network:
    """Embedding folded into input gates, one gated recurrent layer, class and word output."""

    NAMES = ("w_in", "u", "u_c", "b", "out_c", "bias_c", "out_w", "bias_w")

    def __init__(self, vocabulary: Vocabulary, seed: int = 11, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        v = vocabulary
        self.hidden, self.classes, self.own_classes = hidden, v.classes, v.own_classes
        scale = 1 / np.sqrt(hidden)
        f = np.float32
        self.w_in = rng.normal(0, 0.1, (v.symbols, 3 * hidden)).astype(f)
        self.u = rng.normal(0, scale, (hidden, 2 * hidden)).astype(f)
        self.u_c = rng.normal(0, scale, (hidden, hidden)).astype(f)
        self.b = np.zeros(3 * hidden, f)
        self.out_c = rng.normal(0, 0.1, (hidden, v.classes)).astype(f)
        self.out_w = rng.normal(0, 0.1, (max(v.own_classes, 1), hidden, CLASS_SIZE)).astype(f)
        # start from the unigram distribution
        own = np.array([v.counts[w] for w in v.own], float)
        padded = np.zeros(max(v.own_classes, 1) * CLASS_SIZE)
        padded[:len(own)] = own + 1
        by_class = padded.reshape(-1, CLASS_SIZE)
        mass = np.concatenate((by_class.sum(1)[:v.own_classes], v.rare_mass))
        self.bias_c = np.log(mass / mass.sum()).astype(f)
        with np.errstate(divide="ignore"):
            self.bias_w = np.maximum(np.log(by_class / np.maximum(by_class.sum(1, keepdims=True), 1)), -60).astype(f)

    def step(self, symbols: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Next states for the symbols just read."""
        n = self.hidden
        x = self.w_in[symbols] + self.b
        g = _sigmoid(x[:, :2 * n] + h @ self.u)
        c = np.tanh(x[:, 2 * n:] + (g[:, :n] * h) @ self.u_c)
        return h + g[:, n:] * (c - h)

    def _by_class(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of rows by class, first row of every own class and the end of the last)."""
        order = np.argsort(classes.astype(np.int16), kind="stable")
        return order, np.searchsorted(classes[order], np.arange(self.own_classes + 1))

    def log_probs(self, h: np.ndarray, symbols: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural log P(symbol | state); for a rare class the probability of the class."""
        order, bounds = self._by_class(classes)
        h, symbols, classes = h[order], symbols[order], classes[order]
        z = h @ self.out_c + self.bias_c
        got = z[np.arange(len(z)), classes]
        got -= np.log(_exp(z))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            rows = slice(bounds[k], bounds[k + 1])
            z = h[rows] @ self.out_w[k] + self.bias_w[k]
            got[rows] += z[np.arange(len(z)), symbols[rows] - k * CLASS_SIZE]
            got[rows] -= np.log(_exp(z))
        out = np.empty_like(got)
        out[order] = got
        return out

    def flat(self) -> np.ndarray:
        """All parameters in a line."""
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def set_flat(self, line: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            a = getattr(self, k)
            a[...] = line[at:at + a.size].reshape(a.shape)
            at += a.size

    def _window(self, part: np.ndarray, h: np.ndarray, v: Vocabulary | Grouping) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss over one window, and the state after it.

        A lane may end early, with -1 from there on.
        """
        n, (lanes, steps) = self.hidden, (part.shape[0], part.shape[1] - 1)
        kept = []
        for t in range(steps):
            x = self.w_in[part[:, t]] + self.b
            g = _sigmoid(x[:, :2 * n] + h @ self.u)
            c = np.tanh(x[:, 2 * n:] + (g[:, :n] * h) @ self.u_c)
            new = h + g[:, n:] * (c - h)
            kept.append((h, g, c, new))
            h = new
        states = np.concatenate([k[3] for k in kept])
        target = part[:, 1:].T.ravel()
        at = np.flatnonzero(target >= 0)
        if len(at) < len(target):
            states, target = states[at], target[at]
        size = len(target)
        classes = v.class_of(target)
        order, bounds = self._by_class(classes)
        states, target, classes = states[order], target[order], classes[order]
        p = states @ self.out_c + self.bias_c
        p *= (1 / (size * _exp(p)))[:, None]
        p[np.arange(size), classes] -= 1 / size
        d = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        d["out_c"], d["bias_c"] = states.T @ p, p.sum(0)
        real = p @ self.out_c.T
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            rows = slice(bounds[k], bounds[k + 1])
            read = states[rows]
            q = read @ self.out_w[k] + self.bias_w[k]
            q *= (1 / (size * _exp(q)))[:, None]
            q[np.arange(len(q)), target[rows] - k * CLASS_SIZE] -= 1 / size
            d["out_w"][k], d["bias_w"][k] = read.T @ q, q.sum(0)
            real[rows] += q @ self.out_w[k].T
        back = np.zeros((steps * lanes, n), real.dtype)
        back[at[order]] = real
        back = back.reshape(steps, lanes, n)
        dh = np.zeros((lanes, n), back.dtype)
        dx = np.empty((steps, lanes, 3 * n), back.dtype)
        before, gated = np.stack([k[0] for k in kept]), np.stack([k[1] for k in kept])
        c = np.stack([k[2] for k in kept])
        r, u = gated[:, :, :n], gated[:, :, n:]
        of_c, of_u, of_r = u * (1 - c * c), (c - before) * u * (1 - u), before * r * (1 - r)
        stay = 1 - u
        for t in reversed(range(steps)):
            dh = dh + back[t]
            dc, gates = dx[t, :, 2 * n:], dx[t, :, :2 * n]
            np.multiply(dh, of_c[t], out=dc)
            through = dc @ self.u_c.T
            np.multiply(through, of_r[t], out=gates[:, :n])
            np.multiply(dh, of_u[t], out=gates[:, n:])
            dh = dh * stay[t] + through * r[t] + gates @ self.u.T
        all_dx = dx.reshape(-1, 3 * n)
        d["u_c"] += (r * before).reshape(-1, n).T @ all_dx[:, 2 * n:]
        d["u"] += before.reshape(-1, n).T @ all_dx[:, :2 * n]
        d["b"] = dx.sum((0, 1))
        read = part[:, :-1].T.ravel()
        order = np.argsort(read.astype(np.int16), kind="stable")
        met, first = np.unique(read[order], return_index=True)
        d["w_in"][met] += np.add.reduceat(dx.reshape(-1, 3 * n)[order], first)     # nothing flows back to -1
        self.met = met
        return d, h


class _Adam:
    def __init__(self, network: Network):
        self.network, self.t = network, 0
        self.m = {k: np.zeros_like(getattr(network, k)) for k in network.NAMES}
        self.s = {k: np.zeros_like(getattr(network, k)) for k in network.NAMES}

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        first, second = 1 / (1 - 0.9 ** self.t), 1 / (1 - 0.99 ** self.t)
        for k, g in grads.items():
            # of the symbols' own parameters only those of symbols in the window move
            rows = self.network.met if k == "w_in" else slice(None)
            g = np.clip(g[rows], -1, 1)
            m, s = self.m[k][rows], self.s[k][rows]
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            self.m[k][rows], self.s[k][rows] = m, s
            getattr(self.network, k)[rows] -= ((rate * first) * m / (np.sqrt(second * s) + 1e-6)).astype(np.float32)
        net = self.network
        # states are below 1, so no logit exceeds 64 + 20
        for a, low, high in ((net.out_c, -64 / net.hidden, 64 / net.hidden), (net.out_w, -64 / net.hidden, 64 / net.hidden), (net.bias_c, -60, 20), (net.bias_w, -60, 20)):
            np.clip(a, low, high, out=a)


class Lanes:
    """Trains a network on texts of any number and size: each goes whole to the lane with the fewest tokens."""

    STRIDE = 8 * WINDOW

    def __init__(self, network: Network, grouping: Grouping, end: int, rate: float, lanes: int):
        self.network, self._grouping, self._rate = network, grouping, rate
        self._adam = _Adam(network)
        self._h = np.zeros((lanes, network.hidden), np.float32)
        self._held = [[np.array([end], np.int16)] for _ in range(lanes)]
        self._ends = [(0, i) for i in range(lanes)]         # targets dealt to a lane so far
        self._done = self.tokens = self.steps = 0
        self.read = np.zeros(len(network.w_in), np.int64)
        self.classes = np.zeros(max(network.own_classes, 1), np.int64)

    def add(self, text: np.ndarray) -> None:
        size, lane = self._ends[0]
        self._held[lane].append(text)
        heapq.heapreplace(self._ends, (size + len(text), lane))
        if self._ends[0][0] - self._done >= self.STRIDE:
            lines = [np.concatenate(x) for x in self._held]
            self._held = [[x[self.STRIDE:]] for x in lines]
            self._done += self.STRIDE
            self._walk(np.stack([x[:self.STRIDE + 1] for x in lines]).astype(np.int64))

    def close(self) -> None:
        """Whatever the lanes still hold, to the last token of the longest."""
        lines = [np.concatenate(x) for x in self._held]
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        lines, self._h, self._held = [lines[i] for i in order], self._h[order], [[x[-1:]] for x in lines]
        for a in range(0, len(lines[0]) - 1, self.STRIDE):
            live = [x[a:a + self.STRIDE + 1] for x in lines if len(x) > a + 1]
            part = np.full((len(live), len(live[0])), -1, np.int64)
            for i, x in enumerate(live):
                part[i, :len(x)] = x
            self._walk(part)
        self._done, self._ends = 0, [(0, i) for i in range(len(lines))]

    def _walk(self, part: np.ndarray) -> None:
        for a in range(0, part.shape[1] - 1, WINDOW):
            now = part[:, a:a + WINDOW + 1]
            now = now[now[:, 1] >= 0]                       # lanes are in order of length once they end
            grads, self._h[:len(now)] = self.network._window(now, self._h[:len(now)], self._grouping)
            target = now[:, 1:][now[:, 1:] >= 0]
            share = len(target) / (len(self._h) * WINDOW)   # a few tokens move the parameters less
            self._adam.step(grads, self._rate * share ** 0.5)
            self.steps += 1
            self.tokens += len(target)
            self.read += np.bincount(now[:, :-1][now[:, 1:] >= 0], minlength=len(self.read))
            self.classes += np.bincount(np.minimum(self._grouping.class_of(target), len(self.classes)), minlength=len(self.classes) + 1)[:-1]

    def weights(self) -> np.ndarray:
        """How often each parameter was trained, in the order of ``Network.flat``."""
        net = self.network
        of = {"w_in": self.read[:, None], "out_w": self.classes[:, None, None], "bias_w": self.classes[:, None]}
        return np.concatenate([np.broadcast_to(of.get(k, self.tokens), getattr(net, k).shape).ravel() for k in net.NAMES]).astype(np.float64)


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network

    def symbols(self, words: list[bytes]) -> np.ndarray:
        return self.vocabulary.look_up(words)[0]

    @property
    def end(self) -> int:
        return self.vocabulary.end

    def log_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        return _log_likelihoods(self.network, self.vocabulary.grouping, self.end, texts)


def _log_likelihoods(network: Network, grouping: Grouping, end: int, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of the symbols of every text, state kept across windows; texts of like length in step."""
    out = np.zeros(len(texts))
    order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), np.int64)
    for a in range(0, len(order), SCORED):
        out[order[a:a + SCORED]] = _in_step(network, grouping, end, [texts[i] for i in order[a:a + SCORED]])
    return out


def _in_step(network: Network, grouping: Grouping, end: int, texts: list[np.ndarray]) -> np.ndarray:
    """The same for texts in order of falling length."""
    out = np.zeros(len(texts))
    h = np.zeros((len(texts), network.hidden), np.float32)
    last = np.full(len(texts), end, np.int64)
    lengths = np.array([len(x) for x in texts])
    for at in range(0, lengths[0], WINDOW):
        live = int(np.searchsorted(-lengths, -at, "left"))          # texts longer than ``at``
        part = np.full((WINDOW, live), -1, np.int64)
        for j in range(live):
            piece = texts[j][at:at + WINDOW]
            part[:len(piece), j] = piece
        states = np.empty((WINDOW, live, network.hidden), np.float32)
        state, before = h[:live], last[:live]
        for t in range(WINDOW):
            m = int(np.searchsorted(-lengths[:live], -(at + t), "left"))
            if not m:
                break
            state = network.step(before[:m], state[:m])
            states[t, :m] = state
            before = part[t, :m]
            h[:m], last[:m] = state, before
        real = part.ravel() >= 0
        target = part.ravel()[real]
        got = network.log_probs(states.reshape(-1, network.hidden)[real], target, grouping.class_of(target))
        out[:live] += np.bincount(np.flatnonzero(real) % live, got, live)
    return out


def fit(coded: DataFrame, v: Vocabulary, rates: tuple[float, ...] = RATES) -> Model:
    """Train on all texts of ``coded`` (row, symbols), one round per rate; each text is read in one of the rounds."""
    network, grouping, end = Network(v), v.grouping, v.end
    tasks, rounds = max(coded.rdd.getNumPartitions(), 1), len(rates)
    width = int(np.clip(v.total // rounds // tasks // LANE_TOKENS, *LANES))
    for i, rate in enumerate(rates):
        start = network.flat()

        def run(batches: Iterator[pa.RecordBatch], rate: float = rate) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            lanes = Lanes(network, grouping, end, rate, width)
            held: list[np.ndarray] = []
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    text = np.frombuffer(raw, np.int16)
                    lanes.add(text)
                    if lanes.steps < LEAST_STEPS:
                        held.append(text)
            lanes.close()
            while held and lanes.steps < LEAST_STEPS:
                for text in held:
                    lanes.add(text)
                lanes.close()
            if lanes.tokens:
                weight = lanes.weights()
                pieces = [np.array_split(x, _PARTS) for x in (network.flat() * weight, weight)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(_PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * _PARTS, pa.int64()),
                    *[pa.array([x.tobytes() for x in p], pa.binary()) for p in pieces]], names=["part", "task", "value", "weight"])

        shape = "part int, task long, value binary, weight binary"
        sums, left = coded.where(F.expr(f"pmod(row, {rounds}) = {i}")).select("symbols").mapInArrow(run, shape), tasks
        while left > 1:                                     # at most _AVERAGED rows meet, in the order of their tasks
            left = -(-left // _AVERAGED)
            sums = sums.groupBy("part", F.expr(f"task div {_AVERAGED}").alias("of")).applyInArrow(_added, shape)
        got = sorted(sums.collect())                        # _PARTS rows
        if got:
            value, weight = (np.concatenate([np.frombuffer(r[c]) for r in got]) for c in ("value", "weight"))
            network.set_flat(np.where(weight > 0, value / np.maximum(weight, 1), start))
    return Model(v, network)


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of the parameters and weights of some tasks."""
    order = np.argsort(table["task"].to_numpy(), kind="stable").tolist()
    added = {}
    for c in ("value", "weight"):
        total: np.ndarray | float = 0.0
        for i in order:
            total = total + np.frombuffer(table[c][i].as_buffer())
        added[c] = pa.array([total.tobytes()], pa.binary())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()), **added})


def encode(documents: DataFrame, v: Vocabulary) -> DataFrame:
    """All rows of ``documents`` in symbols, written once for training and scoring.

    Rows get an ordinal of their own. Frequent words are looked up where the text is (kind 0); another word is
    listed once per block of texts together with the texts of the block that hold it (kind 1).
    """
    log_mass = np.log10(v.rare_mass)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 40       # a block has fewer than 2 ** 16 texts
        own, end = len(v.own), END.encode()
        ids: list[int | None] = []
        symbols: list[np.ndarray] = []
        sums: list[tuple[int, float, float]] = []          # known tokens, base part, rare words' share
        places: dict[bytes, list[int]] = {}
        size = 0

        def read(doc_id: int | None, text: str | None) -> None:
            words = [*words_of(text), end]
            at, s = v.places(words)
            off = np.flatnonzero(at < 0)
            # inside a rare class: count over mass; counts of words off the list follow later
            inside = v.inside_at[at].sum() - log_mass[s[off] - own].sum()
            for j in off.tolist():
                places.setdefault(words[j], []).append(len(ids))
            ids.append(doc_id)
            symbols.append(s.astype(np.int16))
            sums.append((len(words) - len(off), float(v.gain_at[at].sum()), float(inside)))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, size
            n = len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * n, pa.int8()), pa.array(range(block, block + n), pa.int64()), pa.array(ids, pa.int64()),
                pa.array([len(s) for s in symbols], pa.int64()), pa.array([t[0] for t in sums], pa.int64()),
                pa.array([t[1] for t in sums], pa.float64()), pa.array([t[2] for t in sums], pa.float64()),
                pa.array([s.tobytes() for s in symbols], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=_NAMES)
            words = list(places)
            for a in range(0, len(words), 50_000):
                part = words[a:a + 50_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array([1] * m, pa.int8()), pa.array([block] * m, pa.int64()), *[pa.nulls(m, pa.int64())] * 3,
                    *[pa.nulls(m, pa.float64())] * 2, pa.nulls(m, pa.binary()), pa.array(part, pa.binary()),
                    pa.array([np.array(places[w], np.uint16).tobytes() for w in part], pa.binary())], names=_NAMES)
            block += 1 << 16
            size = 0
            for held in (ids, symbols, sums, places):
                held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                read(doc_id, text)
                size += len(symbols[-1])
                if size > BLOCK_TOKENS or len(ids) == BLOCK_TEXTS:
                    yield from flush()
        if ids:
            yield from flush()

    return common.materialise(documents.select("doc_id", "text").mapInArrow(
        local, "kind byte, row long, doc_id long, n long, known long, base double, inside double, symbols binary, word binary, rows binary"), "lm-coded")


def texts_of(coded: DataFrame) -> DataFrame:
    return coded.where("kind = 0")


def score(coded: DataFrame, counted: DataFrame, model: Model, fold: tuple[int, int]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for all rows of ``coded``."""
    v = model.vocabulary
    network, grouping, end = model.network, v.grouping, v.end
    names = ["row", "doc_id", "n", "known", "base", "neural"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            log_p = _log_likelihoods(network, grouping, end, [np.frombuffer(s, np.int16) for s in t["symbols"].to_pylist()]) / np.log(10)
            done = [*[t[c] for c in names[:-1]], pa.chunked_array([pa.array(log_p + t["inside"].to_numpy())])]
            return pa.RecordBatch.from_arrays([c.combine_chunks() for c in done], names=names)

        for batch in batches:
            held.append(batch)
            size += int(batch.column("n").to_numpy().sum())
            if size > BLOCK_TOKENS or sum(b.num_rows for b in held) >= BLOCK_TEXTS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    done = common.materialise(texts_of(coded).select("row", "doc_id", "n", "known", "base", "inside", "symbols").mapInArrow(
        walk, "row long, doc_id long, n long, known long, base double, neural double"), "lm-scores")
    rare = coded.where("kind = 1").select("word", "row", "rows").join(counted, "word")
    return _joined(done, rare, v.total + v.distinct + 1, v, *fold)


_NAMES = ["kind", "row", "doc_id", "n", "known", "base", "inside", "symbols", "word", "rows"]


def _joined(texts: DataFrame, rare: DataFrame, unit: int, v: Vocabulary, k: int, r: int) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: its texts' sums of log10(count + 1) and numbers of words, as far as this task holds them."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            lists = batch.column(1).cast(pa.large_binary())
            _, offsets, data = lists.buffers()
            edges = np.frombuffer(offsets, np.int64)[lists.offset:lists.offset + len(lists) + 1]
            lengths = np.diff(edges) // 2
            inside = np.frombuffer(data, np.uint16, int(edges[-1] - edges[0]) // 2, int(edges[0]))
            rows = np.repeat(batch.column(0).to_numpy(), lengths) + inside
            held.append((rows, np.repeat(np.log10(batch.column(2).to_numpy() + 1.0), lengths)))
            size += len(rows)
            if size > 4_000_000:
                yield _by_block(held)
                held, size = [], 0
        if size:
            yield _by_block(held)

    def gathered(key: tuple, table: pa.Table) -> pa.Table:
        """All sums of one block, one row per text."""
        joined = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("rows", np.int64), ("gain", np.float64), ("found", np.int64))]
        rows, at = np.unique(joined[0], return_inverse=True)
        return pa.table({"of": rows, "gain": np.bincount(at, joined[1], len(rows)), "found": np.bincount(at, joined[2], len(rows)).astype(np.int64)})

    # a block holds a bounded number of tokens, so whatever the tasks found for it fits one task
    parts = rare.select("row", "rows", "n").mapInArrow(spread, "block long, rows binary, gain binary, found binary")
    sums = parts.groupBy("block").applyInArrow(gathered, "of long, gain double, found long")
    done = texts.join(sums, texts["row"] == sums["of"], "left")
    gain, found = F.coalesce("gain", F.lit(0.0)), F.coalesce("found", F.lit(0).cast("long"))
    return done.select(
        "doc_id", common.in_fold("doc_id", k, r).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + found).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n") * float(np.log10(unit))).alias("base_score"), (F.col("neural") + gain).alias("score"))


def _by_block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Sums per text, packed into one row per block."""
    rows, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    gain = np.bincount(at, np.concatenate([h[1] for h in held]), len(rows))
    found = np.bincount(at, minlength=len(rows)).astype(np.int64)
    blocks, starts = np.unique(rows >> 16, return_index=True)
    cuts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(rows)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks << 16), *[pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (rows, gain, found)]],
        names=["block", "rows", "gain", "found"])
