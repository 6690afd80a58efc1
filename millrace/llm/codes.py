"""Compression of vectors to codes: a codebook for each of several parts, by the filtering form of Lloyd's rounds.

A component x becomes the integer floor(scale * x). Every task gathers its vectors into blocks
and builds a k-d tree over each part of a block: nodes are split at the middle along their
widest dimension, down to leaves of ``LEAF`` points, and hold the bounding box, the
sums and the number of their points. The trees are written once; each round walks
them with the codebook of the last one. A node's candidates are those of its parent;
the one nearest to the middle of the box stays, and with it those that are as near
as it somewhere in the box (the difference of two squared distances is linear, so
one corner decides). Where one candidate is left the whole subtree is assigned at once, by its
sums; the points of leaves are compared with the candidates that are left.
Sums of a task are merged by tree_sum; the driver and the tasks hold a codebook,
of ``entries`` vectors.

All distances are integers: worked out in doubles where they stay below 2^53, else as
64-bit integers, with the same results. So neither blocks nor files show in the result.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part,
nor do those of another length than most (of equally common lengths the smaller one
counts); a length that the parts don't divide, or a component so large that a
squared distance may not fit 64 bits, is an error. The first entries are the vectors of
the smallest ids, null ids last, equal ids by vector; fewer vectors than entries
make a smaller codebook. Repeated rows are rows of their own. Null labels are a label. An empty
table gives an empty one. Columns named like those that are added give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import finite_vectors, join_split, shared_dir, table, tree_sum, written

BLOCK_ROWS, LEAF = 16384, 24


@dataclass
class Tree:
    """A k-d tree over points (n x d integers), levels one after another; node i of a level has children 2i and 2i + 1 in the next.

    ``order`` sorts the points so that a node has those from its start to its stop.
    """

    points: np.ndarray
    order: np.ndarray
    starts: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @classmethod
    def over(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order, starts = np.arange(len(points)), [np.array([0, len(points)])]
        while np.diff(starts[-1]).max() > leaf:
            at = starts[-1]
            middle = (at[:-1] + at[1:]) // 2
            for a, m, b in zip(at.tolist(), middle.tolist(), at[1:].tolist(), strict=False):
                own = points[order[a:b]]
                widest = int((own.max(0) - own.min(0)).argmax())
                order[a:b] = order[a:b][np.argpartition(own[:, widest], m - a)]
            starts.append(np.append(np.column_stack((at[:-1], middle)).ravel(), at[-1]))
        p = points[order]
        low, high, sums = ([f.reduceat(p, at[:-1], axis=0) for at in starts] for f in (np.minimum, np.maximum, np.add))
        return cls(p, order, starts, low, high, sums)

    def pack(self) -> bytes:
        """As numbers: depth, rows, dimensions, then what over() can't tell at once."""
        head = np.array([len(self.starts), *self.points.shape], np.int64)
        return b"".join(np.ascontiguousarray(a, np.int64).tobytes() for a in (head, self.points, self.order, *self.starts, *self.low, *self.high, *self.sums))

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        a = np.frombuffer(raw, np.int64)
        (levels, n, d), at = a[:3].tolist(), 3

        def take(*shape: int) -> np.ndarray:
            nonlocal at
            at += int(np.prod(shape))
            return a[at - int(np.prod(shape)) : at].reshape(shape)

        points, order = take(n, d), take(n)
        starts = [take((1 << i) + 1) for i in range(levels)]
        return cls(points, order, starts, *([take(1 << i, d) for i in range(levels)] for _ in range(3)))

    def walk(self, book: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """What is assigned at once, as (level, is a leaf, nodes or points, entries, squared distances of points)."""
        kind = np.float64 if 16 * book.shape[1] * (int(max(np.abs(self.points).max(initial=0), np.abs(book).max(initial=0))) + 1) ** 2 < 1 << 53 else np.int64
        z = book.astype(kind)
        square = (z * z).sum(1)
        apart = np.abs(z[:, None] - z[None])
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
        last = len(self.starts) - 1
        for level, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            left = []
            # some nodes at a time bound the memory of nodes x entries x dimensions
            for a in range(0, len(nodes), 128):
                some, may = nodes[a : a + 128], open_[a : a + 128]
                middle, wide = (low[some] + high[some]).astype(kind), (high[some] - low[some]).astype(kind)
                dots = middle @ z.T
                # squared distance of each entry to the middle, but for what all have in common
                near = np.where(may, square - dots, np.inf if kind is np.float64 else np.iinfo(np.int64).max).argmin(1)
                i = np.arange(len(some))
                # |p - z|^2 - |p - z near|^2 at the corner of the box where it is least
                least = (dots[i, near][:, None] - dots) - np.matmul(apart[near], wide[:, :, None])[:, :, 0] + square - square[near][:, None]
                left.append(may & ((least < 0) | ((least == 0) & (np.arange(len(z)) <= near[:, None]))))
                left[-1][i, near] = True
            open_ = np.concatenate(left)
            alone = open_.sum(1) == 1
            if alone.any():
                yield level, 0, nodes[alone], open_[alone].argmax(1), None
            nodes, open_ = nodes[~alone], open_[~alone]
            if level < last:
                nodes, open_ = np.column_stack((2 * nodes, 2 * nodes + 1)).ravel(), np.repeat(open_, 2, axis=0)
        at = self.starts[last]
        for a in range(0, len(nodes), 256):
            some = nodes[a : a + 256]
            size = at[some + 1] - at[some]
            rows = np.concatenate([np.arange(s, e) for s, e in zip(at[some], at[some + 1], strict=True)])
            p = self.points[rows].astype(kind)
            far = np.where(np.repeat(open_[a : a + 256], size, axis=0), square - 2 * (p @ z.T), np.inf if kind is np.float64 else np.iinfo(np.int64).max)
            entry = far.argmin(1)
            yield last, 1, rows, entry, (far[np.arange(len(rows)), entry] + (p * p).sum(1)).astype(np.int64)

    def totals(self, book: np.ndarray) -> np.ndarray:
        """For each entry the sums and, last, the number of its points."""
        out = np.zeros((len(book), book.shape[1] + 1), np.int64)
        for level, is_leaf, at, entry, _ in self.walk(book):
            if is_leaf:
                np.add.at(out, entry, np.column_stack((self.points[at], np.ones(len(at), np.int64))))
            else:
                np.add.at(out, entry, np.column_stack((self.sums[level][at], self.starts[level][at + 1] - self.starts[level][at])))
        return out

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every point, in the order over() was given them."""
        entry, far = np.empty(len(self.points), np.int64), np.empty(len(self.points), np.int64)
        for level, is_leaf, at, found, gap in self.walk(book):
            if not is_leaf:
                starts = self.starts[level]
                size = starts[at + 1] - starts[at]
                at, found = np.concatenate([np.arange(s, e) for s, e in zip(starts[at], starts[at + 1], strict=True)]), np.repeat(found, size)
                gap = ((self.points[at] - book[found]) ** 2).sum(1)
            entry[self.order[at]], far[self.order[at]] = found, gap
        return entry, far


def trees(rows: DataFrame, names: list[str], parts: int, block_rows: int) -> DataFrame:
    """A row for each block of vectors `v`: its columns `names` as a list, and a packed tree for each part."""
    item = T.StructType([rows.schema[k] for k in names])
    schema = T.StructType([T.StructField("rows", T.ArrayType(item)), T.StructField("trees", T.ArrayType(T.BinaryType()))])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        n = whole.num_rows
        v = whole.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        # the largest squared distance, and a sum of such over the parts
        if 8 * v.shape[1] * (int(np.abs(v).max()) + 1) ** 2 >= 1 << 63:
            raise ValueError("a component is too large: squared distances must fit 64 bits")
        packed = [Tree.over(p).pack() for p in np.split(v, parts, axis=1)]
        kept = pa.StructArray.from_arrays([whole.column(k).chunk(0) for k in names], names)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), kept), pa.array([packed], pa.list_(pa.binary()))], ["rows", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                some = batch.slice(at, block_rows)
                if n + some.num_rows > block_rows:
                    yield block(held)
                    held, n = [], 0
                held.append(some)
                n += some.num_rows
        if n:
            yield block(held)

    return rows.mapInArrow(run, schema)


def codebooks(blocks: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The entries after so many rounds of assigning the parts and taking floors of means; unused entries stay."""
    for _ in range(rounds):

        def totals(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> np.ndarray | None:
            out = None
            for batch in batches:
                for packed in batch.column("trees"):
                    got = np.stack([Tree.unpack(t.as_py()).totals(b) for t, b in zip(packed.values, books, strict=True)])
                    out = got if out is None else out + got
            return out

        found = tree_sum(blocks.select("trees"), totals)
        books = [np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(t[:, -1:], 1), b) for t, b in zip(found, books, strict=True)]
    return books


ADDED = {"codes": T.ArrayType(T.IntegerType()), "error": T.LongType()}


def compress(vectors: DataFrame, keep: list[str], id_col: str = "vec_id", vector_col: str = "embedding", *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """The columns `keep` of vectors with `codes` (an entry for each part) and `error`, and the codebooks."""
    spark, keep, path = vectors.sparkSession, [c for c in keep if c not in ADDED], shared_dir(vectors.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    largest = float(1 << 40)
    whole = F.transform("v", lambda c: F.when(F.abs(c) < largest, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large to be compressed"))).cast("long"))
    rows = written(finite_vectors(vectors, [*keep, id_col], vector_col).select(*names, F.col(f"k{len(keep)}").alias("id"), whole.alias("v")), path, "whole")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (size[0] if size else 0))
    schema = T.StructType([T.StructField(c, rows.schema[k].dataType) for c, k in zip(keep, names, strict=True)] + [T.StructField(c, t) for c, t in ADDED.items()])
    if size is None:
        return spark.createDataFrame([], schema), []
    if size[0] % parts:
        raise ValueError(f"vectors of length {size[0]} can't be cut into {parts} equal parts")
    first = np.array([r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()], np.int64)
    blocks = written(trees(rows.select(*names, "v"), names, parts, block_rows), path, "trees")
    books = codebooks(blocks, np.split(first, parts, axis=1), rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept, packed in zip(batch.column("rows"), batch.column("trees"), strict=True):
                found = [Tree.unpack(t.as_py()).assigned(b) for t, b in zip(packed.values, books, strict=True)]
                codes = np.column_stack([e for e, _ in found]).astype(np.int32)
                at = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts)
                cols = [*kept.values.flatten(), pa.ListArray.from_arrays(at, pa.array(codes.ravel())), pa.array(sum(f for _, f in found))]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return blocks.mapInArrow(run, schema), books


def op13_codes(spark, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    sha = hashlib.sha256(",".join(map(str, np.concatenate([b.ravel() for b in books]).tolist() if books else [])).encode()).hexdigest()
    # null labels are a label
    rows = written(rows.select("vec_id", "codes", "error", F.struct("label").alias("group")), shared_dir(spark), "coded")
    sums = rows.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("in_label"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return join_split(rows, sums, ["group"], "in_label", rows.count()).select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _rounds(rounds: int) -> str:
    """CTEs a0, b1, a1, ...: parts with their nearest entry, and the entries that follow from them."""
    out = ""
    for i in range(rounds + 1):
        out += f"""
  a{i} AS (SELECT r, part, any_value(v.x) AS x, any_value(v.sq) + min(b.sq - 2 * list_dot_product(v.x, b.x)) AS far, arg_min(entry, (b.sq - 2 * list_dot_product(v.x, b.x)) * 256 + entry) AS entry
    FROM v JOIN b{i} b USING (part) GROUP BY r, part),"""
        if i < rounds:
            out += f"""
  m{i} AS (SELECT part, entry, list(mean ORDER BY pos) AS x FROM (SELECT part, entry, pos, floor(sum(e) / count(*)) AS mean FROM (SELECT part, entry, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY part, entry, pos) GROUP BY part, entry),
  b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x, list_dot_product(coalesce(m.x, b.x), coalesce(m.x, b.x)) AS sq FROM b{i} b LEFT JOIN m{i} m USING (part, entry)),"""
    return out


OP13_SQL = f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(1024 * c)) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  d AS (SELECT len(x) AS d FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), w AS MATERIALIZED (SELECT e.* FROM e, d WHERE len(x) = d.d),
  v AS MATERIALIZED (SELECT r, part, y AS x, list_dot_product(y, y) AS sq FROM (SELECT r, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS y FROM w, range(4) t(part))),
  f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM w ORDER BY 2 LIMIT 256),
  b0 AS MATERIALIZED (SELECT part, entry, x, sq FROM v JOIN f USING (r)),{_rounds(4)}
  c AS (SELECT r, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a4 GROUP BY r),
  s AS (SELECT sha256(string_agg(CAST(e AS BIGINT), ',' ORDER BY part, entry, pos)) AS sha FROM (SELECT part, entry, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM b4))
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM c JOIN w USING (r), s"""
