"""Quality scores by Bradley-Terry pairwise ranking over features of the whole text.

A document's strength is a linear function of its features. For a pair of a
label-1 and a label-0 document, the chance that the first is preferred is the
logistic function of the difference of strengths; the weights minimise the mean
of that loss over all pairs of labelled training rows (Newton steps with a
small ridge). The threshold is a quantile of the training strengths: the one
with the best mean of the two shares of right decisions, where the share of good
documents kept counts double; a score is the logistic function of the strength,
shifted so that the threshold is at 0.7.

Every labelled row that isn't held out teaches, in every pair with a row of the
other label, and the quantiles are those of all these rows. The pairs needn't be
written down: what a row adds to loss, slope and curvature is a smooth function
of its strength, given by the strengths of the other label. Strengths are cut into
cells of ``WIDTH``, and in a cell such a function is its polynomial through ``NODES``
points, right to about 11 digits. A Newton step is two passes of the tasks over the
labelled rows; the sums for each cell, merged over a tree of tasks, go to the driver, and at the end the at most 1,998
strengths that surround the 999 quantiles.
Features come from one pass over the texts, scores from plain columns.

Defined cases: null text counts as empty, and empty texts have a score like
any other; repeated labels of one document count once, contradicting ones not
at all; of several texts under one labelled id, that of the largest feature
array (compared element by element) teaches; without both labels every strength is 0 and the threshold is 0.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, shared_dir, table, tree_merge, written

NAMES = [
    "log_chars", "log_words", "upper", "digit", "space", "punct", "symbol", "bang", "bar", "beyond_ascii",
    "word_length", "distinct", "heaviness", "repeats", "line_repeats", "odd_words", "shouted_words", "short_words",
]
CUT_AT = 0.7

_KIND = np.zeros(256, np.uint8)
for _chars, _k in ((string.ascii_uppercase, 1), (string.digits, 2), (string.whitespace, 3), (".,;:'\"()?-", 4), ("#$%&*@^~=+<>\\/_[]{}`", 5), ("!", 6), ("|", 7)):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:] = 8
_PLAIN = str.maketrans("", "", string.punctuation)


def features(text: str | None) -> list[float]:
    """In the order of NAMES; shares lie between 0 and 1."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    kind = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9) / n
    w = text.split()
    m = max(1, len(w))
    distinct = set(w)
    repeats = sum(map(str.__eq__, w, w[1:])) / m
    lines = [x for x in text.split("\n") if x]
    shouted = sum(map(str.isupper, distinct)) / max(1, len(distinct))
    odd = sum(1 for x in distinct if not x[-1].isalnum() and x[-1] not in ".,;:?") / max(1, len(distinct))
    return [
        np.log1p(len(text)), np.log1p(len(w)), kind[1], kind[2], kind[3], kind[4], kind[5], kind[6], kind[7], kind[8],
        min(30.0, sum(map(len, w)) / m), len(distinct) / m, np.log1p(len(distinct)) / np.log1p(m), repeats,
        1 - len(set(lines)) / max(1, len(lines)), odd, shouted, sum(1 for x in distinct if len(x) == 1) / max(1, len(distinct)),
    ]


def with_features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs and an array `features` (a column so named gives way)."""
    keep = [c for c in keep if c != "features"]
    schema = T.StructType([f for c in keep for f in docs.schema.fields if f.name == c] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array([features(t.as_py()) for t in batch.column(at_text)], np.float64).reshape(-1, len(NAMES))
            at = pa.array(np.arange(0, flat.size + 1, len(NAMES), dtype=np.int32))
            got = pa.ListArray.from_arrays(at, pa.array(flat.ravel()))
            cols = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, got], [*keep, "features"])

    # a text that is kept goes to Python once
    at_text = f"k{keep.index(text_col)}" if text_col in keep else "text"
    src = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *([] if text_col in keep else [F.col(text_col).alias("text")]))
    return src.mapInArrow(run, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        """To 9 places, as columns have it, so that a row at the cut is there in both."""
        return np.rint(expand((x - self.mean) / self.scale) @ self.weight * 1e9) / 1e9


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares: a text may be worse for too much or too little."""
    z = np.clip(z, -6, 6)
    return np.concatenate((z, z * z / 6), axis=-1)


#: Sums by (label, cell) that a function of features and labels makes of a block of rows.
Sums = dict[tuple[int, int], np.ndarray]
#: Applies such a function to all rows and adds up what it returns.
Pass = Callable[[Callable[[np.ndarray, np.ndarray], Sums]], Sums]

WIDTH, NODES = 2.0, 14
_ANGLE = (np.arange(NODES) + 0.5) * np.pi / NODES
_WAVES = np.cos(np.outer(np.arange(NODES), _ANGLE)) * 2 / NODES
_WAVES[0] /= 2


def spread(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each strength and the shares of its nodes in it: a smooth f(s) is the sum of shares times f(nodes)."""
    cell = np.floor(s / WIDTH)
    u = np.clip(2 * (s / WIDTH - cell) - 1, -1, 1)
    return cell.astype(np.int64), np.cos(np.outer(np.arccos(u), np.arange(NODES))) @ _WAVES


def nodes(cells: np.ndarray) -> np.ndarray:
    return (cells[:, None] + (1 + np.cos(_ANGLE)) / 2) * WIDTH


def logistic(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -700, 700)))


def side(sums: Sums, label: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a label in order, and what was added up in each."""
    cells = sorted(c for k, c in sums if k == label)
    return np.array(cells, np.int64), np.array([sums[label, c] for c in cells])


def crowds(x: np.ndarray, y: np.ndarray, model: Model) -> Sums:
    """How many rows of a label are at each node."""
    cell, share = spread(expand((x - model.mean) / model.scale) @ model.weight)
    return {(k, c): share[(y == k) & (cell == c)].sum(0) for k, c in set(zip(y.tolist(), cell.tolist(), strict=True))}


def slopes(x: np.ndarray, y: np.ndarray, model: Model, met: dict[int, tuple]) -> Sums:
    """Slope and curvature by the rows alone under (2, 0); sums of features at each node for what pairs add to the curvature."""
    z = expand((x - model.mean) / model.scale)
    cell, share = spread(z @ model.weight)
    grad, hess, out = 0.0, 0.0, {}
    for k, (cells, pull, bend) in met.items():
        own = y == k
        at = np.searchsorted(cells, cell[own])
        zk, ck, sk = z[own], cell[own], share[own]
        grad = grad + (sk * pull[at]).sum(1) @ zk
        hess = hess + (zk * (sk * bend[at]).sum(1)[:, None]).T @ zk
        out |= {(k, c): sk[ck == c].T @ zk[ck == c] for c in np.unique(ck).tolist()}
    return out | {(2, 0): np.vstack((grad, hess))}


def pairs(sums: Sums) -> tuple[float, dict[int, tuple]]:
    """The mean loss of all pairs, and for each label cells with slope and curvature at their nodes, as a row's share of the means."""
    (gc, g), (bc, b) = side(sums, 1), side(sums, 0)
    n_good, n_bad = g.sum(), b.sum()
    loss, met = 0.0, {}
    for k, cells, own, others, there in ((1, gc, g, b, nodes(bc)), (0, bc, b, g, nodes(gc))):
        # neighbouring cells too: a strength at an edge may be rounded otherwise in the next pass
        wide = np.unique(cells[:, None] + np.arange(-1, 2))
        own = dict(zip(cells.tolist(), own, strict=True))
        pull, bend = np.empty((len(wide), NODES)), np.empty((len(wide), NODES))
        for i, here in enumerate(nodes(wide)):
            behind = (there[None] - here[:, None, None]) * (1 if k else -1)
            p = logistic(behind)
            pull[i] = (p * others).sum((1, 2)) * (-1 if k else 1)
            bend[i] = (p * (1 - p) * others).sum((1, 2))
            if k and wide[i] in own:
                loss += float(own[wide[i]] @ (np.logaddexp(0, behind) * others).sum((1, 2)))
        met[k] = (wide, pull / n_good / n_bad, bend / n_good / n_bad)
    return loss / n_good / n_bad, met


def newton(over: Pass, model: Model, ridge: float) -> np.ndarray:
    """The weights of the least mean loss over all pairs; a step that doesn't lower the loss is halved."""
    low, at, step = np.inf, model.weight, np.zeros_like(model.weight)
    for _ in range(100):
        now = Model(model.mean, model.scale, at - step, 0.0)
        sums = over(lambda x, y, now=now: crowds(x, y, now))
        loss, met = pairs(sums)
        loss += ridge / 2 * now.weight @ now.weight
        if loss > low + 1e-10:
            step = step / 2
            continue
        low, at = loss, now.weight
        got = over(lambda x, y, now=now, met=met: slopes(x, y, now, met))
        (gc, g), (bc, b) = side(got, 1), side(got, 0)
        there, b = nodes(bc).ravel(), b.reshape(-1, len(at))
        cross = np.zeros((len(at), len(at)))
        for here, z in zip(nodes(gc), g, strict=True):
            p = logistic(here[:, None] - there)
            cross += z.T @ (p * (1 - p) @ b)
        cross /= side(sums, 1)[1].sum() * side(sums, 0)[1].sum()
        grad = got[2, 0][0] + ridge * at
        hess = got[2, 0][1:] - cross - cross.T + ridge * np.eye(len(at))
        step = np.linalg.solve(hess, grad)
        if np.abs(step).max() < 1e-9:
            break
    else:
        raise ArithmeticError("the weights haven't settled after 100 steps")
    # rounded, so that the order in which tasks add up doesn't show
    return np.round(at - step, 7)


def best_quantile(quantiles: np.ndarray, right: np.ndarray) -> float:
    """The middle one of the quantiles that decide best."""
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(quantiles[best[len(best) // 2]])


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int | None = None, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Of rows in memory: over all pairs, or over max_pairs seeded random ones if the caller asks for that (no query does)."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model(mean, scale, np.zeros(2 * len(NAMES)), 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    if max_pairs is None:
        model.weight = newton(lambda f: f(x, y), model, ridge)
    else:
        rng = np.random.default_rng(seed)
        z = expand((x - mean) / scale)
        d = z[rng.choice(good, max_pairs)] - z[rng.choice(bad, max_pairs)]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ model.weight, -30, 30)))
            grad = d.T @ (p - 1) / len(d) + ridge * model.weight
            hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(d.shape[1])
            step = np.linalg.solve(hess, grad)
            model.weight = model.weight - step
            if np.abs(step).max() < 1e-6:
                break
    s = model.strength(x)
    grid = np.quantile(s, np.linspace(0.001, 0.999, 999))
    # the mean of the two shares of right decisions; clean documents weigh double
    model.cut = best_quantile(grid, np.array([2 * (s[good] >= t).mean() + (s[bad] < t).mean() for t in grid]))
    return model


def teachers(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(features, y) of every labelled document that isn't held out."""
    # both sides meet by a grouping, which adds up a repeated id before it is shuffled
    both = feats.select(F.col(id_col).alias("id"), "features", F.lit(None).cast("int").alias("y")).unionByName(
        labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.lit(None).cast("array<double>").alias("features"), F.col(label_col).cast("int").alias("y"))
    )
    rows = both.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("features").alias("features"), F.min("y").alias("y"), F.max("y").alias("high"))
    return rows.where("features is not null and y = high").select("features", "y")


def added(a: Sums, b: Sums) -> Sums:
    return a | {k: a[k] + v if k in a else v for k, v in b.items()}


def passes(taught: DataFrame) -> Pass:
    """Passes over the rows of teachers(). Tasks add up what they make, and their sums are merged over a tree, so that the driver gets no more of many tasks than of few."""

    def over(f: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Sums | None:
            got: Sums = {}
            for batch in batches:
                if batch.num_rows:
                    got = added(got, f(*_arrays(batch)))
            return got or None

        return tree_merge(taught, run, added) or {}

    return over


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("features").flatten().to_numpy().reshape(-1, len(NAMES)), batch.column("y").to_numpy()


def threshold(taught: DataFrame, model: Model, n_good: int, n_bad: int, path: str) -> float:
    """The cut of fit(), by exact ranks of all strengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _arrays(batch)
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(x)), pa.array(y)], ["s", "y"])

    n = n_good + n_bad
    rows = taught.mapInArrow(run, "s double, y int").groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("good")).sort("s")
    rows = written(rows.withColumn("part", F.spark_partition_id()), path, "strengths")
    # only the sums of each range are put in order in one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("good").alias("pg")).select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("pn", "pg")))
    upto = Window.partitionBy("part").orderBy("s")
    rows = rows.join(F.broadcast(per), "part").select("s", "n", "good", (F.col("pn") + F.sum("n").over(upto)).alias("upto"), (F.col("pg") + F.sum("good").over(upto)).alias("good_upto"))

    def below(k: str) -> str:
        """How many of the ranks floor(i (n - 1) / 1000), i from 1 to 999, are less than k."""
        return f"greatest(0, least(999, (1000 * ({k}) - 1) div {n - 1}))"

    need = f"{below('upto')} > {below('upto - n')} or {below('upto - 1')} > {below('upto - n - 1')}"
    got = rows.where(need).orderBy("s").toPandas()
    s, count, good, last, good_last = (got[c].to_numpy() for c in ("s", "n", "good", "upto", "good_upto"))
    rank, rest = np.divmod(np.arange(1, 1000) * (n - 1), 1000)
    lo, hi = np.searchsorted(last, rank, "right"), np.searchsorted(last, rank + 1, "right")
    t = s[lo] + (s[hi] - s[lo]) * rest / 1000
    # rows below t: those before its lower neighbour, and that one's too where t is above it
    above = t > s[lo]
    less = np.where(above, last[lo], last[lo] - count[lo])
    good_less = np.where(above, good_last[lo], good_last[lo] - good[lo])
    return best_quantile(t, 2 * (1 - good_less / n_good) + (less - good_less) / n_bad)


def train(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", ridge: float = 1e-3) -> Model:
    """From the features of documents and all their labels."""
    path = shared_dir(feats.sparkSession)
    taught = written(teachers(feats, labels, id_col, label_col), path, "teachers")
    over = passes(taught)
    sums = over(lambda x, y: {(k, 0): np.append(x[y == k].sum(0), (y == k).sum()) for k in (0, 1)})
    n_bad, n_good = (int(sums[k, 0][-1]) if sums else 0 for k in (0, 1))
    model = Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(2 * len(NAMES)), 0.0)
    if not n_good or not n_bad:
        return model
    mean = (sums[0, 0] + sums[1, 0])[:-1] / (n_good + n_bad)
    square = over(lambda x, y: {(0, 0): ((x - mean) ** 2).sum(0)})[0, 0] / (n_good + n_bad)
    model.mean, model.scale = np.round(mean, 12), np.round(np.sqrt(square) + 1e-9, 12)
    model.weight = newton(over, model, ridge)
    model.cut = threshold(taught, model, n_good, n_bad, path)
    return model


def scored(feats: DataFrame, model: Model) -> DataFrame:
    """Adds score and predicted, by columns alone."""
    k = len(NAMES)

    def lit(v: np.ndarray):
        return F.array(*(F.lit(float(a)) for a in v))

    z = F.zip_with("features", F.zip_with(lit(model.mean), lit(model.scale), lambda m, s: F.struct(m.alias("m"), s.alias("s"))), lambda v, p: F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (v - p["m"]) / p["s"])))
    w = F.zip_with(lit(model.weight[:k]), lit(model.weight[k:]), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    s = F.rint(F.aggregate(F.zip_with(z, w, lambda v, p: v * p["a"] + v * v / 6 * p["b"]), F.lit(0.0), lambda a, b: a + b) * 1e9) / 1e9
    margin = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), s - model.cut)) + float(np.log(CUT_AT / (1 - CUT_AT)))
    out = feats.withColumn("score", F.round(1 / (1 + F.exp(-margin)), 12))
    return out.withColumn("predicted", (F.col("score") >= CUT_AT).cast("int"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    feats = written(with_features(table(spark, sf_dir, "documents"), ["doc_id"]), shared_dir(spark), "features")
    model = train(feats, table(spark, sf_dir, "labels"))
    return scored(feats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
