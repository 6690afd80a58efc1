"""Interval operators over columns s and e (closed), within groups of key columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, scan


def union_ids(df: DataFrame, key: list[str], ident: str, s: str = "s", e: str = "e") -> DataFrame:
    """Adds `u`: the number of the run of overlapping intervals, from 0 in each group."""
    rows = scan.lay(df, key, [s, ident]).add(_reach=scan.largest_before(e))
    new = F.when(F.col("_reach").isNull() | (F.col(s) <= F.col("_reach")), 0).otherwise(1)
    return rows.with_columns(_new=new).add(u=scan.total("_new")).done().drop("_new", "_reach")


def union(df: DataFrame, key: list[str], ident: str, s: str = "s", e: str = "e") -> DataFrame:
    """The spans of overlapping intervals with their numbers of members."""
    return union_ids(df, key, ident, s, e).groupBy(*key, "u").agg(F.min(s).alias(s), F.max(e).alias(e), F.count("*").alias("n")).drop("u")


def coverage(df: DataFrame, key: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """Depth between neighbouring end points: key, s, e, depth. Gaps inside have depth 0."""
    ends = df.select(*key, F.explode(F.array(F.struct(F.col(s).alias("p"), F.lit(1).alias("d")), F.struct(F.col(e).alias("p"), F.lit(-1).alias("d")))).alias("x"))
    ends = ends.groupBy(*key, F.col("x.p").alias(s)).agg(F.sum("x.d").alias("d"))
    out = scan.lay(ends, key, [s]).add(depth=scan.total("d"), _e=scan.following(s)).done()
    return out.where("_e is not null").select(*key, s, F.col("_e.v").alias(e), "depth")


def subtract(a: DataFrame, b: DataFrame, key: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """What is in an interval of a and in none of b, as spans of positive length."""
    both = a.select(*key, s, e, F.lit(1).alias("g")).union(b.select(*key, s, e, F.lit(0).alias("g")))
    ends = both.select(*key, F.explode(F.array(F.struct(F.col(s).alias("p"), F.lit(1).alias("d")), F.struct(F.col(e).alias("p"), F.lit(-1).alias("d")))).alias("x"), "g")
    ends = ends.groupBy(*key, F.col("x.p").alias(s)).agg(F.sum(F.when(F.col("g") == 1, F.col("x.d")).otherwise(0)).alias("da"), F.sum(F.when(F.col("g") == 0, F.col("x.d")).otherwise(0)).alias("db"))
    cut = scan.lay(ends, key, [s]).add(da=scan.total("da"), db=scan.total("db"), _e=scan.following(s))
    cut = cut.with_columns(on=F.col("_e").isNotNull() & (F.col("da") > 0) & (F.col("db") == 0)).add(_on=scan.previous("on"))
    # neighbouring pieces are one span
    joined = F.when(F.col("on") & F.coalesce(F.col("_on.v"), F.lit(False)), 0).otherwise(1)
    spans = cut.with_columns(_new=joined).add(run=scan.total("_new")).done().where("on").withColumn(e, F.col("_e.v"))
    return spans.groupBy(*key, "run").agg(F.min(s).alias(s), F.max(e).alias(e)).drop("run")


def _cell_width(df: DataFrame, s: str, e: str) -> float:
    """The mean length of the intervals and one: an interval then reaches two cells or so."""
    return float(df.agg(F.avg(F.col(e) - F.col(s))).first()[0] or 0) + 1


def _starts_in(points: DataFrame, df: DataFrame, key: list[str], point: str, s: str, e: str, width: float) -> DataFrame:
    """Rows of points beside the intervals of df whose cells hold the point."""
    cells = df.withColumn("_c", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    return points.withColumn("_c", F.floor(F.col(point) / width)).join(cells, [*key, "_c"]).drop("_c")


def overlap_join(a: DataFrame, b: DataFrame, key: list[str], width: float | None = None, inclusive: bool = True) -> DataFrame:
    """Pairs of overlapping intervals of a (s, e) and b (s2, e2) of equal key.

    Of two that overlap, one starts within the other: each side's starts meet the
    other side's intervals, dealt into cells of `width` (at default their mean length
    and one), so that long groups spread over tasks and no pair is made twice.
    """
    touch = (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")) if inclusive else (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e"))
    one = _starts_in(a, b, key, "s", "s2", "e2", width or _cell_width(b, "s2", "e2")).where(touch & (F.col("s2") <= F.col("s")))
    two = _starts_in(b, a, key, "s2", "s", "e", width or _cell_width(a, "s", "e")).where(touch & (F.col("s2") > F.col("s")))
    return one.unionByName(two)


def stab(points: DataFrame, df: DataFrame, key: list[str], width: float | None = None, point: str = "p") -> DataFrame:
    """Intervals (s, e) of df that hold a point of the same key; cells as in overlap_join()."""
    met = _starts_in(points, df, key, point, "s", "e", width or _cell_width(df, "s", "e"))
    return met.where((F.col("s") <= F.col(point)) & (F.col(point) <= F.col("e")))


def following(points: DataFrame, df: DataFrame, key: list[str], point: str = "p") -> DataFrame:
    """Adds to points `next`: the start of the first interval of df, of equal key, that starts at the point or after; null without one."""
    from .relational import brackets

    return brackets(points, df.select(*key, "s"), key, point, "s").drop("below").withColumnRenamed("above", "next")


#: Rectangles of both sides of a key up to which they are held against each other in one task.
HELD = 10_000


def rectangle_join(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of overlapping rectangles (x1, y1, x2, y2) and (u1, v1, u2, v2) of equal key; half open.

    Each side is dealt by key once and the key's rectangles meet there; those of keys of more than HELD
    meet on grids, which deal a rectangle to every cell it is in or looks into. Of rectangles with a null
    or non-finite side no pair is made.
    """
    one, two = ("x1", "y1", "x2", "y2"), ("u1", "v1", "u2", "v2")
    a, b = (df.where(reduce(lambda p, q: p & q, (F.abs(F.col(c).cast("double")) < float("inf") for c in cols))) for df, cols in ((a, one), (b, two)))
    if not key:
        return _on_grids(a, b, key)
    many = a.groupBy(*key).agg(F.count("*").alias("_n")).join(b.groupBy(*key).agg(F.count("*").alias("_m")), key)
    large = graph.cut(many.where(F.col("_n") + F.col("_m") > HELD).select(*key))
    touch = (F.col("x2") > F.col("u1")) & (F.col("x1") <= F.col("u2")) & (F.col("y2") > F.col("v1")) & (F.col("y1") <= F.col("v2"))
    if large.isEmpty():
        return a.hint("merge").join(b, key).where(touch)
    small = a.join(large, key, "left_anti").hint("merge").join(b.join(large, key, "left_anti"), key).where(touch)
    return small.unionByName(_on_grids(a.join(large, key, "left_semi"), b.join(large, key, "left_semi"), key).select(*small.columns))


def _on_grids(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """rectangle_join() of finite rectangles on grids of cells that double in width from level to level.

    A rectangle is held at the level
    whose cells are as wide as its longer side or up to twice that, in four of them
    at most, and looks for wider ones in four cells at most of each level above where the other side
    has any. So a wide rectangle costs no more than a small one, and a pair is met once, in
    the cell that holds the lower corner of what the two share.
    """
    one, two = ("x1", "y1", "x2", "y2"), ("u1", "v1", "u2", "v2")
    sides = []
    for df, cols in ((a, one), (b, two)):
        longer = F.greatest(F.col(cols[2]) - F.col(cols[0]), F.col(cols[3]) - F.col(cols[1])).cast("double")
        far = F.greatest(*(F.abs(F.col(c).cast("double")) for c in cols))
        # cells are numbered by longs: so far from the origin none is narrower than 2^-50 of the way
        sides.append(df.withColumn("_level", F.greatest(F.ceil(F.log2(F.when(longer > 0, longer))), F.ceil(F.log2(F.when(far > 0, far))) - 50, F.lit(-1000)).cast("int")))
    levels = [sorted(r[0] for r in df.select("_level").distinct().collect()) for df in sides]

    def cells(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
        width = F.pow(F.lit(2.0), F.col("_grid"))
        df = df.withColumn("_cx", F.explode(F.sequence(F.floor(F.col(cols[0]) / width), F.floor(F.col(cols[2]) / width))))
        return df.withColumn("_cy", F.explode(F.sequence(F.floor(F.col(cols[1]) / width), F.floor(F.col(cols[3]) / width))))

    def seeking(df: DataFrame, cols: tuple[str, ...], wider: list[int], strictly: bool) -> DataFrame:
        these = F.filter(F.array(*(F.lit(i) for i in wider)).cast("array<int>"), lambda i: (i > F.col("_level")) if strictly else (i >= F.col("_level")))
        return cells(df.withColumn("_grid", F.explode(these)).drop("_level"), cols)

    def held(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
        return cells(df.withColumn("_grid", F.col("_level")).drop("_level"), cols)

    on = [*key, "_grid", "_cx", "_cy"]
    (x, y), (of_x, of_y) = sides, levels
    met = held(x, one).join(seeking(y, two, of_x, False), on).unionByName(seeking(x, one, of_y, True).join(held(y, two), on))
    width = F.pow(F.lit(2.0), F.col("_grid"))
    first = (F.col("_cx") == F.floor(F.greatest("x1", "u1") / width)) & (F.col("_cy") == F.floor(F.greatest("y1", "v1") / width))
    touch = (F.col("x2") > F.col("u1")) & (F.col("x1") <= F.col("u2")) & (F.col("y2") > F.col("v1")) & (F.col("y1") <= F.col("v2"))
    return met.where(first & touch).drop("_grid", "_cx", "_cy")


def segments(df: DataFrame, key: list[str], ident: str, width: int) -> DataFrame:
    """(key, s, e, n, ids): the parts between neighbouring ends of any intervals, with the sorted ids of those that cover them.

    Parts without a cover are left out. Ends are ordered a key at a time.
    """
    at = df.select(*key, F.col("s").alias("s")).union(df.select(*key, "e")).distinct()
    parts = at.withColumn("e", F.lead("s").over(Window.partitionBy(*key).orderBy("s"))).where("e is not null")
    met = overlap_join(parts, df.select(*key, F.col(ident).alias("_id"), F.col("s").alias("s2"), F.col("e").alias("e2")), key, width, inclusive=False)
    return met.groupBy(*key, "s", "e").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_id")).alias("ids"))


def clip(df: DataFrame, pos: float, left: bool) -> DataFrame:
    """What of the intervals lies left or right of pos; those without any go."""
    got = df.withColumn("e", F.least("e", F.lit(pos))) if left else df.withColumn("s", F.greatest("s", F.lit(pos)))
    return got.where("s < e")
