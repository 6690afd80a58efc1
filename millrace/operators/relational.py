"""Keyed joins, lookups, frequency tables and partition operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def histtab(df: DataFrame, cols: list[str], count: str = "count", percent: str | None = "percent") -> DataFrame:
    """Frequency table: distinct values, count and share of all rows; the number of rows is one row that is broadcast."""
    out = df.groupBy(*cols).agg(F.count("*").alias(count))
    if percent:
        total = df.agg(F.count("*").alias("_total"))
        out = out.join(F.broadcast(total)).withColumn(percent, F.col(count) / F.col("_total")).drop("_total")
    return out


def join_tables(*tables: tuple[DataFrame, str | Column], on_duplicates: str = "error") -> DataFrame:
    """Inner join of any number of (table, key) on equal keys.

    A key that a table has twice is an error, or with on_duplicates="last" the
    row of the largest remaining columns stands for it.
    """
    sides = []
    for i, (df, key) in enumerate(tables):
        df = df.withColumn("_key", F.col(key) if isinstance(key, str) else key)
        if i:
            rest = [c for c in df.columns if c != "_key"]
            picked = df.groupBy("_key").agg(F.max(F.struct(*rest)).alias("_r"), F.count("*").alias("_n"))
            if on_duplicates == "error":
                bad = F.raise_error(F.concat(F.lit("duplicate key "), F.col("_key").cast("string")))
                picked = picked.withColumn("_r", F.when(F.col("_n") > 1, bad.cast(picked.schema["_r"].dataType)).otherwise(F.col("_r")))
            seen = {c for s in sides for c in s.columns}
            df = picked.select("_key", *(F.col("_r")[c].alias(c) for c in rest if c not in seen))
        sides.append(df)
    return reduce(lambda a, b: a.join(b, "_key"), sides).drop("_key")


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, default=None) -> DataFrame:
    """Adds `value` of the row of table with the key; the default where there is none. Of equal keys the largest value counts."""
    side = table.groupBy(F.col(table_key).alias("_k")).agg(F.max(value).alias("_v"))
    return df.join(side, F.col(key) == F.col("_k"), "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def best_hits(hits: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of the largest score of each group; ties go by the order of `ties`."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_bidirectional(hits: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs that are each other's best; one row a pair (a, b, score)."""
    best_a = hits.groupBy(a).agg(F.min(F.struct((-F.col(score)).alias("_s"), b)).alias("m")).select(a, F.col(f"m.{b}").alias(b), (-F.col("m._s")).alias(score))
    best_b = hits.groupBy(b).agg(F.min(F.struct((-F.col(score)).alias("_s"), a)).alias("m")).select(b, F.col(f"m.{a}").alias(a))
    return best_a.join(best_b, [a, b]).select(a, b, score)


def confusion(left: DataFrame, right: DataFrame, item: str, p1: str, p2: str) -> DataFrame:
    """How many items each pair of parts shares; -1 stands for an item in no part."""
    both = left.select(F.col(item), F.col(p1)).join(right.select(F.col(item), F.col(p2)), item, "full_outer")
    return both.groupBy(F.coalesce(p1, F.lit(-1)).alias(p1), F.coalesce(p2, F.lit(-1)).alias(p2)).agg(F.count("*").alias("n"))


def part_lookup(left: DataFrame, right: DataFrame, item: str, p1: str, p2: str) -> DataFrame:
    """For each part of the left the sorted parts of the right that share items; -1 for items in none."""
    both = left.join(right, item, "left").select(p1, F.coalesce(p2, F.lit(-1)).alias(p2)).distinct()
    return both.groupBy(p1).agg(F.array_join(F.transform(F.array_sort(F.collect_set(p2)), lambda x: x.cast("string")), ",").alias("parts"))


def to_matrix(df: DataFrame, row: str, col: str, value: str, cols: list) -> DataFrame:
    """Coordinate rows to a dense table with a column for each of cols; absent cells are 0."""
    out = df.groupBy(row).pivot(col, cols).agg(F.sum(value))
    return out.select(row, *(F.coalesce(f"`{c}`", F.lit(0)).alias(f"c{c}") for c in cols))


def transpose(df: DataFrame, i: str, j: str) -> DataFrame:
    return df.withColumnsRenamed({i: "_i", j: i}).withColumnRenamed("_i", j)


def submatrix(df: DataFrame, i: str, j: str, rows: list | DataFrame | None = None, cols: list | DataFrame | None = None) -> DataFrame:
    """The cells of the rows and columns of a list, or of a table with one column."""
    for c, keep in ((i, rows), (j, cols)):
        if isinstance(keep, DataFrame):
            df = df.join(keep.toDF(c), c, "left_semi")
        elif keep is not None:
            df = df.where(F.col(c).isin(keep))
    return df


def all_extreme(df: DataFrame, by: list[str], value: str, largest: bool = True) -> DataFrame:
    """All rows that attain their group's extreme."""
    top = df.groupBy(*by).agg((F.max if largest else F.min)(value).alias("_t"))
    return df.join(top, by).where(F.col(value) == F.col("_t")).drop("_t")


def prediction_scores(actual: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sensitivity and predictive value of predicted pairs; division by 0 gives infinity."""
    a, p = actual.select(keys).distinct(), predicted.select(keys).distinct()
    both = a.withColumn("a", F.lit(1)).join(p.withColumn("p", F.lit(1)), keys, "full_outer")
    out = both.agg(F.count("a").alias("n_actual"), F.count("p").alias("n_predicted"), F.count(F.when(F.col("a") == F.col("p"), 1)).alias("n_both"))
    inf = F.lit(float("inf"))
    return out.withColumn("sensitivity", F.coalesce(F.try_divide("n_both", "n_actual"), inf)).withColumn("ppv", F.coalesce(F.try_divide("n_both", "n_predicted"), inf))


def same_parts(left: DataFrame, right: DataFrame, item: str, part: str) -> DataFrame:
    """(p1, p2): parts of both sides with exactly the same items."""
    a = left.groupBy(part).agg(F.count("*").alias("_n")).withColumnRenamed(part, "p1")
    b = right.groupBy(part).agg(F.count("*").alias("_m")).withColumnRenamed(part, "p2")
    met = left.select(item, F.col(part).alias("p1")).join(right.select(item, F.col(part).alias("p2")), item).groupBy("p1", "p2").agg(F.count("*").alias("_k"))
    return met.join(a, "p1").join(b, "p2").where("_k = _n and _k = _m").select("p1", "p2")


def one_to_ones(members: DataFrame, part: str, species: str) -> DataFrame:
    """Members of parts that have every species at most once, of those with the most members."""
    sizes = members.groupBy(part).agg(F.count("*").alias("_n"), F.countDistinct(species).alias("_s")).where("_n = _s")
    top = sizes.agg(F.max("_n").alias("_t"))
    return members.join(sizes.join(F.broadcast(top)).where("_n = _t").select(part), part, "left_semi")


def families(members: DataFrame, part: str, item: str, first: int = 0) -> DataFrame:
    """(famid, genes): parts numbered from `first` in order, their items joined by commas."""
    rows = members.groupBy(part).agg(F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), ",").alias("genes"))
    return numbered(rows, [part], "famid", first).select("famid", "genes")


def family_members(families_: DataFrame) -> DataFrame:
    """(famid, gene) of families()."""
    return families_.select("famid", F.explode(F.split("genes", ",")).alias("gene"))


def stable_unique(df: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """The first row of equal values by the order; one aggregation, no window."""
    rest = [c for c in df.columns if c not in cols and c not in order]
    picked = df.groupBy(*cols).agg(F.min(F.struct(*[c for c in order if c not in cols], F.struct(*rest).alias("_x") if rest else F.lit(0).alias("_x"))).alias("_m"))
    have = {c: F.col(c) if c in cols else F.col("_m")[c] if c in order else F.col("_m._x")[c] for c in df.columns}
    return picked.select(*(v.alias(c) for c, v in have.items()))


def brackets(df: DataFrame, table: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Adds `below` and `above` to df: the nearest values of the table's rows of the same key, at most and at least `at`; null where there is none.

    Both sides are sorted together within each key, twice, so no rows are paired;
    a key's sort runs in one task and spills.
    """
    mine = df.select(*key, F.col(at).alias("_v"), F.lit(None).cast(table.schema[value].dataType).alias("_t"), F.struct(*df.columns).alias("_row"))
    theirs = table.select(*key, F.col(value).alias("_v"), F.col(value).alias("_t")).where("_v is not null").distinct().withColumn("_row", F.lit(None).cast(mine.schema["_row"].dataType))
    # ranges take in rows of the same value; a frame to the end would be summed anew for every row, so the order is turned instead
    so_far = (Window.unboundedPreceding, Window.currentRow)
    below = F.max("_t").over(Window.partitionBy(*key).orderBy("_v").rangeBetween(*so_far))
    above = F.min("_t").over(Window.partitionBy(*key).orderBy(F.desc("_v")).rangeBetween(*so_far))
    known = F.col("_v").isNotNull()
    got = mine.unionByName(theirs).withColumns({"below": F.when(known, below), "above": F.when(known, above)})
    return got.where("_row is not null").select("_row.*", "below", "above")


def block_best(hits: DataFrame, block: str, a: str, b: str, score: str) -> DataFrame:
    """(block, n, total): number and sum of the scores of the hits in each block that are the best of both their sides there."""
    whole = hits.select(block, F.struct(block, a).alias("_a"), F.struct(block, b).alias("_b"), F.col(score).alias("_score"))
    best = best_bidirectional(whole, "_a", "_b", "_score")
    return best.groupBy(F.col(f"_a.{block}").alias(block)).agg(F.count("*").alias("n"), F.sum("_score").alias("total"))


def unpivot(df: DataFrame, row: str, columns: list[str] | None = None) -> DataFrame:
    """(rlabel, clabel, v) of a table whose column `row` names its rows; the other columns, or those given, are its columns."""
    columns = columns if columns is not None else [c for c in df.columns if c != row]
    return df.select(F.col(row).alias("rlabel"), *columns).unpivot("rlabel", columns, "clabel", "v")


def joined_parts(memberships: list[DataFrame], item: str, part: str) -> DataFrame:
    """(item, part): the parts of several partitions that share items, joined; a part is named by its smallest item."""
    from . import graph

    stars = [m.join(m.groupBy(part).agg(F.min(item).alias("_a")), part).select(F.col("_a").alias("a"), F.col(item).alias("b")) for m in memberships]
    return graph.components(reduce(DataFrame.union, stars)).select(F.col("item").alias(item), F.col("component").alias(part))


def region_lookup(regions: DataFrame, key: str = "ID") -> DataFrame:
    """The rows of regions with an attribute `key`, by it in column `id`; a value given twice is an error, rows without it are left out."""
    got = regions.withColumn("id", F.try_element_at("attrs", F.lit(key))).where("id is not null")
    twice = Window.partitionBy("id")
    return got.withColumn("_n", F.count("*").over(twice)).withColumn("id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col("id"))).cast("string")).otherwise(F.col("id"))).drop("_n")
