"""Approximate nearest neighbours by collision counting.

For the largest inner product, every vector gets one more component that
brings it to the largest norm, so that nearness on the sphere is the order of
inner products. An index is ``projections`` sorted arrays, one for each random
direction. A query opens a window around its own projection in every array; a
vector in the window of an array collides. The windows widen by a constant
factor (virtual rehashing, only the new margins are counted); vectors that
collide in ``threshold`` of the arrays or more are verified exactly, in double precision.

The search ends by distance: along a random direction, a vector at distance d of the
query lies as far from it as a normal variable of deviation d, so how often it collides
in windows of half-width w hangs on w / d alone. Once w is so wide against the distance
of the k-th best vector found that one as near would have been verified with a chance
of 1 - ``miss``, nearer ones would have been more likely still, and the query is done;
the last window is no wider than that. So the expected share of the true k nearest that is
missed is at most ``miss``, whatever the vectors and however many an index holds.

The rows are dealt by a hash of their content into index parts of about ``part_rows`` and
query blocks of ``block_rows``; a task meets one part and one block, and keeps its k best for
each query. Every row is indexed, and nothing depends on how rows lie in files.

Defined cases: vectors that are null, empty, zero, of another length than most (of equally
common lengths the smaller one counts), or that hold null or non-finite components take no part;
a row of null id takes no part either, as it couldn't be told in a result;
rows of equal id, and equal rows, are rows of their own, and only a query's own row isn't its
candidate; ties go to the smaller id.
Norms are taken of vectors scaled by the largest component, so none overflows; a product beyond the
range of doubles comes out as infinite, one of infinite terms of both signs as NaN and last. An empty
table gives an empty one, and other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vectors, shared_dir, table, written

PROJECTIONS, THRESHOLD, MISS, WIDEN, FIRST = 64, 0.6, 0.02, 1.3, 0.5
PART_ROWS, BLOCK_ROWS = 32768, 1024


@cache
def reach(projections: int, need: int, miss: float) -> float:
    """The half-width, in distances, at which a vector collides `need` times or more of `projections` with a chance of 1 - miss."""

    def missed(c: float) -> float:
        p = math.erf(c / math.sqrt(2))
        return sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(need))

    low, high = 0.0, 16.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if missed(mid) <= miss else (mid, high)
    return high


class Index:
    """Sorted arrays over vectors (n x d), scaled by `scale` and then, with one component more, to the length `norm`."""

    def __init__(self, x: np.ndarray, scale: float, norm: float, projections: int = PROJECTIONS, seed: int = 3):
        self.x, self.n, self.unit = x, len(x), x / scale / norm
        lift = np.sqrt(np.maximum(0.0, 1 - (self.unit * self.unit).sum(1)))
        self.directions = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, projections))
        p = np.column_stack((self.unit, lift)) @ self.directions
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(p, axis=0).T.copy()

    def search(self, q: np.ndarray, k: int, rows: np.ndarray, own: np.ndarray, threshold: float = THRESHOLD, miss: float = MISS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row of q, itself the row `own`) the places of the k best verified, and of those as good as the last of them, with their products; rows are the places' rows."""
        m = len(self.sorted)
        need = math.ceil(threshold * m)
        far = reach(m, need, miss)
        inner = q / np.abs(q).max(1, keepdims=True)
        inner /= np.sqrt((inner * inner).sum(1, keepdims=True))
        at = np.stack([v @ self.directions[:-1] for v in inner]) if len(q) else np.zeros((0, m))
        lo = np.stack([a.searchsorted(at[:, j]) for j, a in enumerate(self.sorted)], axis=1)
        hi, width, open_ = lo.copy(), np.full(len(q), FIRST), np.arange(len(q))
        counts = np.zeros((len(q), self.n), np.int16)
        near = [np.zeros(0)] * len(q)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in q]
        while len(open_):
            w = width[open_]
            new_lo = np.stack([a.searchsorted(at[open_, j] - w) for j, a in enumerate(self.sorted)], axis=1)
            new_hi = np.stack([a.searchsorted(at[open_, j] + w, "right") for j, a in enumerate(self.sorted)], axis=1)
            still = []
            for i, low, high in zip(open_.tolist(), new_lo, new_hi, strict=True):
                margins = [o[a:b] for o, a, b in zip(self.order, low.tolist(), lo[i].tolist(), strict=True)]
                margins += [o[a:b] for o, a, b in zip(self.order, hi[i].tolist(), high.tolist(), strict=True)]
                before, lo[i], hi[i] = counts[i] >= need, low, high
                counts[i] += np.bincount(np.concatenate(margins), minlength=self.n).astype(np.int16)
                fresh = np.flatnonzero((counts[i] >= need) & ~before)
                fresh = fresh[rows[fresh] != own[i]]
                # cosines, which don't overflow
                cosine = self.unit[fresh] @ inner[i]
                found[i].append((fresh, cosine))
                both = np.concatenate((near[i], cosine))
                near[i] = both if len(both) < k else np.partition(both, len(both) - k)[-k:]
                done = math.inf if len(near[i]) < k else far * math.sqrt(max(0.0, 2 - 2 * near[i][0]))
                if width[i] < done and (low.any() or (high < self.n).any()):
                    width[i] = min(width[i] * WIDEN, done)
                    still.append(i)
            open_ = np.array(still, np.int64)
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for i, parts in enumerate(found):
                c, cosine = (np.concatenate(x) for x in zip(*parts, strict=True))
                # the products are those of the vectors as they are; cosines are right to far more digits than the margin
                c = c[cosine >= near[i].min() - 1e-9] if len(near[i]) else c
                out.append((c, (self.x[c] * q[i]).sum(1)))
        return out


def nearest(vectors: DataFrame, k: int = 20, *, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows whose id `every` divides."""
    spark, path = vectors.sparkSession, shared_dir(vectors.sparkSession)
    rows = finite_vectors(vectors, [id_col], vector_col).select(F.col("k0").cast("long").alias("vec_id"), "v").where(F.col("vec_id").isNotNull() & F.exists("v", lambda c: c != 0))
    # equal rows are numbered, so that a row's hash tells it from all others in any layout
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("n")).select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    rows = written(rows.select("vec_id", "v", F.xxhash64("vec_id", "v", "copy").alias("h"), F.monotonically_increasing_id().alias("row")), path, "rows")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (size[0] if size else 0))
    ask = F.pmod("vec_id", F.lit(every)) == 0
    n, asked, scale = rows.agg(F.count("*"), F.count_if(ask), F.max(F.array_max(F.transform("v", F.abs)))).first()
    scale = scale or 1.0
    norm = math.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / scale) * (c / scale)))).first()[0] or 1.0)
    parts, blocks = max(1, -(-n // part_rows)), max(1, -(-asked // block_rows))
    part, block = F.pmod("h", F.lit(parts)).cast("int"), F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")
    given = rows.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(0))
    asking = rows.where(ask).withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("asks", F.lit(1))
    cols = ["part", "block", "asks", "vec_id", "row", "h", "v"]
    units = given.select(cols).union(asking.select(cols))
    dealt = units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "block").sortWithinPartitions("part", "block", "asks", "h", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, index = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("part", "block", "asks")])
            vid, row = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
            flat = batch.column("v").flatten().to_numpy().reshape(len(vid), -1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(vid)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if tuple(keys[a, :2]) != unit:
                    unit, held, index = tuple(keys[a, :2]), [], None
                if not keys[a, 2]:
                    held.append((flat[a:b], vid[a:b], row[a:b]))
                    continue
                if index is None:
                    if not held:
                        continue
                    x, ids, own = (np.concatenate([p[i] for p in held]) for i in range(3))
                    index = Index(x, scale, norm)
                # some queries at a time bound the counts, queries x rows
                for s in range(a, b, 256):
                    e, out = min(b, s + 256), []
                    for i, (c, score) in zip(range(s, e), index.search(flat[s:e], k, own, row[s:e]), strict=True):
                        best = np.lexsort((ids[c], -np.nan_to_num(score, nan=-math.inf, posinf=math.inf, neginf=-math.inf)))[:k]
                        out.append((np.full(len(best), vid[i]), np.full(len(best), row[i]), ids[c][best], score[best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "query_row", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, query_row bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc(F.nanvl("score", F.lit(-math.inf))), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
