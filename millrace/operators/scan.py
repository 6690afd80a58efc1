"""Running sums, maxima, places and neighbours of rows in an order, also where a key holds most of the rows.

A key with more rows than a task's share is cut into pieces, ranges of the order that
are about a share long, by bounds from a sample of its rows. Each piece is
scanned on its own; what the pieces before it add up to is worked out from one
row a piece and added afterwards. So a key with all the rows spreads over all
tasks, and other keys are plain windows.

Rows that are equal in all columns of the order lie in one piece, and their order
among themselves is open, as in any window; null keys are a key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Rows of the sample for each piece.
SAMPLED = 64


@dataclass(frozen=True)
class Fold:
    """What a column is over the rows up to, before or after a row; see the functions that make one."""

    kind: str
    value: Column


def total(value: str | Column) -> Fold:
    """The sum of the rows up to and with this one; null before the first value that isn't null."""
    return Fold("total", F.col(value) if isinstance(value, str) else value)


def largest_before(value: str | Column) -> Fold:
    """The largest value of the rows before this one; null without one."""
    return Fold("largest", F.col(value) if isinstance(value, str) else value)


def place() -> Fold:
    """The number of rows before this one."""
    return Fold("place", F.lit(1))


def previous(value: str | Column) -> Fold:
    """A struct with `v`, the value of the row before; null for the first row."""
    return Fold("previous", F.struct((F.col(value) if isinstance(value, str) else value).alias("v")))


def following(value: str | Column) -> Fold:
    """A struct with `v`, the value of the row after; null for the last row."""
    return Fold("following", F.struct((F.col(value) if isinstance(value, str) else value).alias("v")))


@dataclass(frozen=True)
class Laid:
    """Rows in an order within each key; in pieces if `pieces` is true, numbered by `_piece`."""

    rows: DataFrame
    by: list[str]
    order: list[str]
    pieces: bool

    def add(self, **folds: Fold) -> Laid:
        """The rows with more columns, the folds; they see the columns that are there."""
        held = [*self.by, "_piece"] if self.pieces else self.by
        w = Window.partitionBy(*held).orderBy(*self.order)
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        local = {
            "total": lambda v: F.sum(v).over(upto), "largest": lambda v: F.max(v).over(before), "place": lambda v: (F.row_number().over(w) - 1).cast("long"),
            "previous": lambda v: F.lag(v).over(w), "following": lambda v: F.lead(v).over(w),
        }
        out = self.rows.withColumns({name: local[f.kind](f.value) for name, f in folds.items()})
        if not self.pieces:
            return Laid(out, self.by, self.order, False)
        at = F.struct(*self.order)
        summary = {"total": F.sum, "largest": F.max, "place": lambda v: F.count(v), "previous": lambda v: F.max_by(v, at), "following": lambda v: F.min_by(v, at)}
        each = self.rows.groupBy(*held).agg(*(summary[f.kind](f.value).alias(f"_{name}") for name, f in folds.items()))
        line = Window.partitionBy(*self.by).orderBy("_piece")
        earlier = line.rowsBetween(Window.unboundedPreceding, -1)
        carry = {"total": lambda c: F.sum(c).over(earlier), "largest": lambda c: F.max(c).over(earlier), "place": lambda c: F.sum(c).over(earlier), "previous": lambda c: F.lag(c).over(line), "following": lambda c: F.lead(c).over(line)}
        # keys of one piece carry nothing; what is left are rows of pieces, fewer than twice the tasks
        carried = each.withColumn("_last", F.max("_piece").over(Window.partitionBy(*self.by))).where("_last > 0")
        carried = carried.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(self.by)), F.col("_piece").alias("_of"), *(carry[f.kind](F.col(f"_{name}")).alias(f"_{name}") for name, f in folds.items()))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(self.by)), F.col("_piece") == F.col("_of"))
        joined = out.join(F.broadcast(carried), same, "left")
        both = {
            "total": lambda a, b: F.coalesce(a + b, a, b), "largest": lambda a, b: F.greatest(a, b), "place": lambda a, b: F.coalesce(a, F.lit(0)) + b,
            "previous": lambda a, b: F.coalesce(b, a), "following": lambda a, b: F.coalesce(b, a),
        }
        new = {name: both[f.kind](F.col(f"_{name}"), F.col(name)).cast(out.schema[name].dataType) for name, f in folds.items()}
        return Laid(joined.select(*(new.get(c, F.col(c)).alias(c) for c in out.columns)), self.by, self.order, True)

    def with_columns(self, **columns: Column) -> Laid:
        return Laid(self.rows.withColumns(columns), self.by, self.order, self.pieces)

    def done(self) -> DataFrame:
        return self.rows.drop("_piece")


def lay(df: DataFrame, by: list[str], order: list[str], tasks: int | None = None) -> Laid:
    """df in an order within the keys `by` (none: the whole table). A key of more than its share, all rows over `tasks` (at default the number of shuffle partitions), is cut."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = df.groupBy(*by).agg(F.count("*").alias("_n"))
    rows, most = per.agg(F.sum("_n"), F.max("_n")).first()
    share = max(1, -(-(rows or 0) // tasks))
    if (most or 0) <= share:
        return Laid(df, by, order, False)
    # fewer keys than tasks have more than a share, and their sampled rows are about SAMPLED a piece
    names = [f"_by{i}" for i in range(len(by))]
    hot = per.where(F.col("_n") > share).select(*(F.col(c).alias(k) for c, k in zip(by, names, strict=True)), "_n")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, names, strict=True)), F.lit(True))
    some = df.select(*by, F.struct(*order).alias("_at")).sample(min(1.0, SAMPLED / share), seed=5).join(F.broadcast(hot), same)
    got = some.groupBy(*names, "_n").agg(F.array_sort(F.collect_list("_at")).alias("_all"))
    pieces = F.ceil(F.col("_n") / share)
    # a bound starts a piece; equal bounds are one
    bounds = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), pieces - 1)), lambda i: F.get("_all", F.floor(i * F.size("_all") / pieces).cast("int"))))
    edges = cut(got.select(*names, bounds.alias("_bounds")))
    piece = F.coalesce(F.aggregate("_bounds", F.lit(0), lambda n, b: n + (b <= F.struct(*order)).cast("int")), F.lit(0))
    rows_ = df.join(F.broadcast(edges), same, "left").withColumn("_piece", piece).select(*df.columns, "_piece")
    return Laid(cut(rows_), by, order, True)
