"""Operators on an explicit order: runs, ranks, running sums, sliding means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def uniq(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The first row of every run of equal values."""
    rows = scan.lay(df, by, order).add(_p=scan.previous(value)).done()
    return rows.where(F.col("_p").isNull() | ~F.col(value).eqNullSafe(F.col("_p.v"))).drop("_p")


def islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: their value, number of rows and place of the first row (from 0)."""
    rows = scan.lay(df.select(*dict.fromkeys([*by, *order, value])), by, order).add(_p=scan.previous(value), _n=scan.place())
    new = (F.col("_p").isNull() | ~F.col(value).eqNullSafe(F.col("_p.v"))).cast("int")
    out = rows.with_columns(_new=new).add(run=scan.total("_new")).done()
    return out.groupBy(*by, "run").agg(F.first(value).alias(value), F.min("_n").cast("long").alias("start"), F.count("*").alias("n"))


def cumsum(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    return scan.lay(df, by, order).add(**{out: scan.total(value)}).done()


def map_window(df: DataFrame, by: list[str], order: list[str], value: str, radius: int, f, out: str) -> DataFrame:
    """f of the array of values up to radius away on both sides; towards the ends both sides shrink alike.

    The radius differs by row, which no frame can do: the rows within the
    largest radius are gathered and the middle cut out, so a row holds at most
    2 * radius + 1 values.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    place = F.row_number().over(w) - 1
    after = F.count(F.lit(1)).over(w.rowsBetween(0, Window.unboundedFollowing)) - 1
    near = df.withColumn("_r", F.least(place, after, F.lit(radius)).cast("int")).withColumn("_b", F.least(place, F.lit(radius)))
    # structs keep nulls in their places
    near = near.withColumn("_w", F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(-radius, radius)))
    cut = F.slice("_w", F.col("_b") - F.col("_r") + 1, 2 * F.col("_r") + 1)
    return near.withColumn(out, f(F.transform(cut, lambda x: x["v"]))).drop("_r", "_b", "_w")


def smooth(df: DataFrame, by: list[str], order: list[str], value: str, radius: int, out: str) -> DataFrame:
    """map_window with the mean."""
    return map_window(df, by, order, value, radius, lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a), out)


def smooth_by_value(df: DataFrame, by: list[str], x: str, y: str, radius: float, min_size: int = 0) -> DataFrame:
    """(by, x, mean_x, mean_y, n): means of the rows within a distance of x that shrinks towards the ends of x's range.

    Rows meet their neighbours by cells as wide as the radius, so that long
    groups spread; each row is sent to three cells.
    """
    ends = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = df.select(*by, F.col(x).alias("_x")).distinct().join(ends, by) if by else df.select(F.col(x).alias("_x")).distinct().crossJoin(F.broadcast(ends))
    at = at.withColumn("_d", F.least(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_x"), F.lit(radius))).withColumn("_c", F.explode(F.sequence(F.floor(F.col("_x") / radius) - 1, F.floor(F.col("_x") / radius) + 1)))
    # sums of equal x first, so that ties don't multiply
    rows = df.groupBy(*by, F.col(x).alias("_p")).agg(F.sum(y).alias("_q"), F.count("*").alias("_k")).withColumn("_c", F.floor(F.col("_p") / radius))
    met = at.join(rows, [*by, "_c"]).where((F.col("_p") >= F.col("_x") - F.col("_d")) & (F.col("_p") <= F.col("_x") + F.col("_d")))
    out = met.groupBy(*by, F.col("_x").alias(x)).agg((F.sum(F.col("_p") * F.col("_k")) / F.sum("_k")).alias("mean_x"), (F.sum("_q") / F.sum("_k")).alias("mean_y"), F.sum("_k").alias("n"))
    return out.where(F.col("n") >= min_size)


def step_windows(df: DataFrame, by: list[str], x: str, width: float, step: float, value: str, min_size: int = 0) -> DataFrame:
    """(by, low, n, mean): windows [low, low + width) from the smallest x on, a step apart, that begin before the largest."""
    lo = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    rows = df.join(lo, by) if by else df.crossJoin(F.broadcast(lo))
    far = F.col(x) - F.col("_lo")
    first = F.greatest(F.lit(0), F.floor((far - width) / step) + 1)
    rows = rows.withColumn("_i", F.explode(F.sequence(first, F.floor(far / step)))).withColumn("low", F.col("_lo") + F.col("_i") * step)
    rows = rows.where((F.col(x) >= F.col("low")) & (F.col(x) < F.col("low") + width))
    return rows.groupBy(*by, "low").agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= min_size)


def rank_average(value: str, by: list[str]) -> Column:
    """Rank from 0, the mean rank for equal values."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) - 1 + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def cdf(df: DataFrame, by: list[str], value: str, ties: str) -> DataFrame:
    """Every value with its place among the sorted ones over their number."""
    w = Window.partitionBy(*by).orderBy(value, ties)
    return df.withColumn("p", F.row_number().over(w) / F.count("*").over(Window.partitionBy(*by)))


def percentile(df: DataFrame, by: list[str], value: str, p: float, ceil: bool = False) -> DataFrame:
    """The order statistic at int(p * n), held to the last; not interpolated."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    at = F.least(n - 1, F.greatest(F.lit(0), (F.ceil if ceil else F.floor)(n * p)))
    return df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_at", at).where("_n = _at").select(*by, F.col(value).alias("v"))


def ranged(df: DataFrame, order: list) -> DataFrame:
    """The rows sorted by ranges, with `_part` (the range's number) and `_at` (the place in it), written to the checkpoint folder."""
    from .graph import cut

    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut(df.sort(*order).withColumns({"_part": F.spark_partition_id(), "_at": at}))


def numbered(df: DataFrame, order: list, out: str, first: int = 0) -> DataFrame:
    """Adds the rows' numbers in an order over the whole table: only the ranges' sizes meet in one task."""
    rows = ranged(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + F.col("_at") + first).drop("_part", "_at", "_before")


def event_windows(df: DataFrame, by: list[str], x: str, width: int, min_size: int = 0) -> DataFrame:
    """(by, low, high, n, mean): windows of a width that slide over the distinct values of x and stop wherever a value enters or leaves.

    The first window is [least, least + width); a later one holds what is above low and
    at most high. The largest value in a window isn't counted in n and mean. A group's
    values meet its windows by cells of the window's width, so long groups spread.
    """
    xs = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x")).distinct()
    ends = xs.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    stops = xs.select(*by, F.explode(F.array(F.col("_x"), F.col("_x") - width)).alias("low")).distinct()
    stops = stops.join(ends, by) if by else stops.join(F.broadcast(ends))
    stops = stops.where((F.col("low") == F.col("_lo")) | ((F.col("low") > F.col("_lo")) & (F.col("low") <= F.col("_hi") - width)))
    stops = stops.withColumn("_c", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("low") / width) + 1)))
    met = stops.join(xs.withColumn("_c", F.floor(F.col("_x") / width)), [*by, "_c"])
    first = F.col("low") == F.col("_lo")
    inside = F.when(first, (F.col("_x") >= F.col("low")) & (F.col("_x") < F.col("low") + width)).otherwise((F.col("_x") > F.col("low")) & (F.col("_x") <= F.col("low") + width))
    got = met.where(inside).groupBy(*by, "low").agg((F.count("*") - 1).alias("n"), (F.sum("_x") - F.max("_x")).alias("_s"))
    return got.where(F.col("n") >= min_size).select(*by, "low", (F.col("low") + width).alias("high"), "n", F.try_divide("_s", "n").alias("mean"))


def spearman_z(df: DataFrame, by: list[str], a: str, b: str, tie: str) -> DataFrame:
    """(by, z): the rank test's score (6R - n(n^2 - 1)) / (n (n + 1) sqrt(n - 1)), of ranks whose ties go by `tie`."""
    n = F.count("*")
    ranks = df.select(*by, *(F.row_number().over(Window.partitionBy(*by).orderBy(c, tie)).alias(f"_{k}") for k, c in (("a", a), ("b", b))))
    # ranks are ints, whose squares leave their type from 46,341 on; sums of squares and cubes leave longs from about 2 million
    apart = F.col("_a").cast("decimal(10,0)") - F.col("_b")
    whole = n.cast("decimal(12,0)")
    r = 6 * F.sum((apart * apart).cast("decimal(22,0)")) - whole * (whole * whole - 1).cast("decimal(25,0)")
    m = n.cast("double")
    return ranks.groupBy(*by).agg(F.try_divide(r.cast("double"), m * (m + 1) * F.sqrt(m - 1)).alias("z"))
