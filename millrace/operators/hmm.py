"""Hidden Markov models over many sequences: decoding, likelihoods and posteriors in log space.

A sequence is the rows of a key in an order. It is decoded in stretches, by
matrices that are composed over them, so that one sequence spans tasks; viterbi(),
forward() and backward() are the same for one sequence in memory. Null or unknown
symbols are taken as equally likely in all states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from .graph import cut


@dataclass(frozen=True)
class Model:
    """Chances of the first state, of moves [from][to], and of each symbol [state][symbol]."""

    prior: list[float]
    move: list[list[float]]
    emit: list[dict]

    def logs(self, symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            known = {s: np.log([e.get(s, 0.0) for e in self.emit]) for s in {s for e in self.emit for s in e}}
            flat = np.zeros(len(self.prior))
            return np.log(self.prior), np.log(self.move), np.array([known.get(s, flat) for s in symbols])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis))


def viterbi(m: Model, symbols) -> list[int]:
    """The likeliest states; of equal ones the smallest number."""
    first, move, emit = m.logs(symbols)
    col, back = first + emit[0], []
    for e in emit[1:]:
        ways = col[:, None] + move
        back.append(ways.argmax(0))
        col = ways.max(0) + e
    path = [int(col.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def forward(m: Model, symbols) -> np.ndarray:
    """ln of the chance of the symbols so far and of each state now."""
    first, move, emit = m.logs(symbols)
    out = [first + emit[0]]
    for e in emit[1:]:
        out.append(_log_sum(out[-1][:, None] + move, 0) + e)
    return np.array(out)


def forward_steps(m: Model, symbols) -> Iterator[np.ndarray]:
    """forward() a symbol at a time; what is carried is one number a state."""
    col = None
    for s in symbols:
        first, move, emit = m.logs([s])
        col = (first if col is None else _log_sum(col[:, None] + move, 0)) + emit[0]
        yield col


def backward(m: Model, symbols) -> np.ndarray:
    """ln of the chance of the symbols still to come from each state."""
    _, move, emit = m.logs(symbols)
    out = [np.zeros(len(m.prior))]
    for e in emit[:0:-1]:
        out.append(_log_sum(move + (e + out[-1])[None, :], 1))
    return np.array(out[::-1])


def posterior(m: Model, symbols) -> np.ndarray:
    """The chance of each state at each place, given all symbols."""
    both = forward(m, symbols) + backward(m, symbols)
    return np.exp(both - _log_sum(both, 1)[:, None])


def sample_path(m: Model, symbols, rng: np.random.Generator) -> list[int]:
    """States drawn from their posterior, from the end back."""
    f, (_, move, _) = forward(m, symbols), m.logs(symbols[:0])
    path: list[int] = []
    for row in f[::-1]:
        w = row + (move[:, path[-1]] if path else 0)
        p = np.exp(w - w.max())
        path.append(int(rng.choice(len(p), p=p / p.sum())))
    return path[::-1]


def generate(m: Model, n: int, rng: np.random.Generator) -> tuple[list[int], list]:
    """Random states and their symbols."""
    states: list[int] = []
    for _ in range(n):
        p = m.move[states[-1]] if states else m.prior
        states.append(int(rng.choice(len(p), p=np.array(p) / sum(p))))
    return states, [list(m.emit[s])[int(rng.choice(len(m.emit[s]), p=np.array(list(m.emit[s].values())) / sum(m.emit[s].values())))] for s in states]


#: Symbols of a stretch: the steps that a task takes one by one.
STRETCH = 1024
#: Stretches that are worked out side by side.
TOGETHER = 256


class Steps:
    """A model's steps over many stretches at once, in logs; max-plus gives the likeliest ways, log-sum-exp the chances of all."""

    def __init__(self, model: Model):
        with np.errstate(divide="ignore"):
            self.first, self.move = np.log(np.array(model.prior, float)), np.log(np.array(model.move, float))
            known = sorted({s for e in model.emit for s in e}, key=str)
            # the last column is that of null and unknown symbols
            self.emit = np.column_stack([np.log([e.get(s, 0.0) for e in model.emit]) for s in known] + [np.zeros(len(model.prior))]).T
        self.known = known

    def codes(self, stretches: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(stretches, places) of the symbols `x` and the lengths; places behind a stretch's end don't count."""
        n = pc.list_value_length(stretches).to_numpy(zero_copy_only=False)
        x = stretches.flatten().field("x")
        flat = pc.fill_null(pc.index_in(x, value_set=pa.array(self.known, x.type)), len(self.known)).to_numpy(zero_copy_only=False)
        out = np.full((len(n), n.max()), len(self.known))
        out[np.arange(n.max()) < n[:, None]] = flat
        return out, n

    def across(self, codes: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretches, from, to), by max-plus and by log-sum-exp: from the state before a stretch to the one at its end. In a stretch that starts a sequence all states before are alike."""
        e = self.emit[codes[:, 0]][:, None, :]
        best = every = np.where(starts[:, None, None], self.first, self.move) + e
        for t in range(1, codes.shape[1]):
            on, e = (t < n)[:, None, None], self.emit[codes[:, t]][:, None, :]
            best = np.where(on, (best[:, :, :, None] + self.move).max(2) + e, best)
            every = np.where(on, _log_sum(every[:, :, :, None] + self.move, 2) + e, every)
        return best, every

    def inside(self, codes: np.ndarray, n: np.ndarray, starts: np.ndarray, state_in: np.ndarray, state_out: np.ndarray, every_in: np.ndarray, every_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretches, places): the likeliest states from state_in before to state_out at the end, and the states' posteriors by what comes in on both sides."""
        m, length, i = len(codes), codes.shape[1], np.arange(len(codes))
        e = self.emit[codes]
        col = np.where(starts[:, None], self.first, self.move[state_in]) + e[:, 0]
        f = np.empty(e.shape)
        f[:, 0] = np.where(starts[:, None], self.first, _log_sum(every_in[:, :, None] + self.move, 1)) + e[:, 0]
        back = np.zeros((m, length, len(self.first)), np.int32)
        for t in range(1, length):
            on, ways = (t < n)[:, None], col[:, :, None] + self.move
            back[:, t] = ways.argmax(1)
            col = np.where(on, ways.max(1) + e[:, t], col)
            f[:, t] = _log_sum(f[:, t - 1, :, None] + self.move, 1) + e[:, t]
        states, p = np.zeros((m, length), np.int32), np.zeros((m, length))
        now, b = state_out.astype(np.int32), every_out
        for t in range(length - 1, -1, -1):
            on = t < n
            states[:, t] = now
            both = f[:, t] + b
            p[:, t] = np.exp(both[i, now] - _log_sum(both, 1))
            now = np.where(on, back[i, t, now], now)
            b = np.where(on[:, None], _log_sum(self.move + (e[:, t] + b)[:, None, :], 2), b)
        return states, p

    def between(self, best: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each stretch of one sequence: the states before and at its end of the likeliest way, and what comes in on both sides.

        Scores are taken relative to the best, so that they don't run out of digits.
        """
        k, s, _ = best.shape
        come, ahead, behind = np.zeros((k, s)), np.zeros((k, s)), np.zeros((k, s))
        for t in range(1, k):
            come[t], ahead[t] = (come[t - 1][:, None] + best[t - 1]).max(0), _log_sum(ahead[t - 1][:, None] + every[t - 1], 0)
            come[t], ahead[t] = _beside_best(come[t]), _beside_best(ahead[t])
        for t in range(k - 2, -1, -1):
            behind[t] = _log_sum(every[t + 1] + behind[t + 1][None, :], 1)
            behind[t] = _beside_best(behind[t])
        state_in, state_out = np.zeros(k, np.int32), np.zeros(k, np.int32)
        now = int((come[-1][:, None] + best[-1]).max(0).argmax())
        for t in range(k - 1, -1, -1):
            state_out[t] = now
            now = state_in[t] = int((come[t] + best[t][:, now]).argmax())
        return state_in, state_out, ahead, behind


def _beside_best(v: np.ndarray) -> np.ndarray:
    return v - v.max() if np.isfinite(v.max()) else v


def _lists(a: np.ndarray) -> pa.ListArray:
    """The rows of a (rows x n) array."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def decode(df: DataFrame, by: str, order: list[str], symbol: str, model: Model, stretch: int = STRETCH) -> DataFrame:
    """(by, *order, state, p): the likeliest path of every sequence and its states' posteriors; of equally likely states at an end the smaller one.

    A sequence is cut into stretches of so many symbols, which go to different tasks. A
    stretch becomes a matrix of its best scores, and one of its chances, from each state before it
    to each state at its end; a sequence's matrices, one for a stretch, are composed in one
    task, and with what that gives each stretch is decoded on its own. Null symbols are unknown, null keys
    are a key; where paths are equally likely the one over smaller states at the ends of stretches is taken, from the
    last one back.
    """
    held = [c for c in order if c != by]
    rows = scan.lay(df.select(*dict.fromkeys([by, *order, symbol])), [by], order).add(_n=scan.place()).done()
    item = F.struct("_n", *(F.col(c).alias(f"o{i}") for i, c in enumerate(held)), F.col(symbol).alias("x"))
    parts = rows.groupBy(F.col(by).alias("key"), F.floor(F.col("_n") / stretch).alias("k")).agg(F.array_sort(F.collect_list(item)).alias("s"))
    # stretches are short to store and long to work out, so they are dealt by number and not by size
    parts = cut(parts).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "k")
    steps, n_states = Steps(model), len(model.prior)
    key = parts.schema["key"].dataType

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(a, TOGETHER) for a in range(0, batch.num_rows, TOGETHER))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            codes, n = steps.codes(batch.column("s"))
            got = steps.across(codes, n, batch.column("k").to_numpy() == 0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), *(_lists(m.reshape(len(n), -1)) for m in got)], ["key", "k", "best", "every"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                line = batch.column("line").slice(i, 1).flatten()
                best, every = (line.field(c).flatten().to_numpy().reshape(-1, n_states, n_states) for c in ("best", "every"))
                states = steps.between(best, every)
                keys = batch.column("key").take(pa.array(np.full(len(best), i)))
                yield pa.RecordBatch.from_arrays([keys, line.field("k"), pa.array(states[0]), pa.array(states[1]), _lists(states[2]), _lists(states[3])], ["key", "k", "state_in", "state_out", "ahead", "behind"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            codes, n = steps.codes(batch.column("s"))
            known = [batch.column(c).to_numpy() for c in ("state_in", "state_out")] + [batch.column(c).flatten().to_numpy().reshape(-1, n_states) for c in ("ahead", "behind")]
            states, p = steps.inside(codes, n, batch.column("k").to_numpy() == 0, *known)
            there = np.arange(codes.shape[1]) < n[:, None]
            s = batch.column("s").flatten()
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([keys, *(s.field(f"o{i}") for i in range(len(held))), pa.array(states[there]), pa.array(p[there])], [by, *held, "state", "p"])

    matrix = T.ArrayType(T.DoubleType())
    made = parts.mapInArrow(across, T.StructType([T.StructField("key", key), T.StructField("k", T.LongType()), T.StructField("best", matrix), T.StructField("every", matrix)]))
    lines = made.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "best", "every"))).alias("line"))
    ends = T.StructType([T.StructField("key", key), T.StructField("k", T.LongType()), T.StructField("state_in", T.IntegerType()), T.StructField("state_out", T.IntegerType()), T.StructField("ahead", matrix), T.StructField("behind", matrix)])
    met = lines.mapInArrow(between, ends).withColumnsRenamed({"key": "_key", "k": "_k"})
    both = parts.join(met, F.col("key").eqNullSafe(F.col("_key")) & (F.col("k") == F.col("_k"))).select("key", "k", "s", "state_in", "state_out", "ahead", "behind")
    fields = [T.StructField(by, key)] + [T.StructField(c, df.schema[c].dataType) for c in held] + [T.StructField("state", T.IntegerType()), T.StructField("p", T.DoubleType())]
    return both.mapInArrow(inside, T.StructType(fields)).select(by, *(c for c in order if c != by), "state", "p")


def likelihood(df: DataFrame, by: str, order: list[str], symbol: str, model: Model) -> DataFrame:
    """(by, lnl): ln of the chance of every sequence.

    In the JVM: a sequence's symbols are folded over, with the states' numbers
    scaled at every step, so that neither Python nor logs of sums are needed.
    """
    states = range(len(model.prior))
    known = sorted({s for e in model.emit for s in e})

    def emit(x, j):
        out = F.when(x == known[0], float(model.emit[j].get(known[0], 0.0)))
        for s in known[1:]:
            out = out.when(x == s, float(model.emit[j].get(s, 0.0)))
        return out.otherwise(1.0)

    def step(acc, x):
        def total(j):
            out = F.lit(0.0)
            for i in states:
                out = out + acc["p"][i] * float(model.move[i][j])
            return out

        raw = [F.when(acc["n"] == 0, F.lit(float(model.prior[j]))).otherwise(total(j)) * emit(x, j) for j in states]
        return F.struct((acc["n"] + 1).alias("n"), F.array(*raw).alias("p"), acc["l"].alias("l"))

    def scale(acc):
        s = acc["p"][0]
        for j in list(states)[1:]:
            s = s + acc["p"][j]
        return F.struct(acc["n"].alias("n"), F.transform(acc["p"], lambda v: v / F.when(s > 0, s).otherwise(1.0)).alias("p"), (acc["l"] + F.log(s)).alias("l"))

    seq = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(symbol).alias("_x")))).alias("s"))
    zero = F.struct(F.lit(0).alias("n"), F.array(*(F.lit(0.0) for _ in states)).alias("p"), F.lit(0.0).alias("l"))
    return seq.select(by, F.aggregate("s", zero, lambda a, r: scale(step(a, r["_x"])), lambda a: a["l"]).alias("lnl"))
