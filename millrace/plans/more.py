"""Queries of sweep segments, brackets, divergences, curves, shapes, densities and consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, population, samplers
from ..operators import intervals, rearrange, relational, stats, synteny
from .driver import IV, query, spans, t
from .forests import RECON, reconciled


@query(f"""WITH {IV}, p AS (SELECT k, s AS x FROM iv UNION SELECT k, e FROM iv), g AS (SELECT k, x AS s, lead(x) OVER (PARTITION BY k ORDER BY x) AS e FROM p)
  SELECT g.k, g.s, g.e, count(*) AS n, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS ids FROM g JOIN iv ON iv.k = g.k AND iv.s < g.e AND g.s < iv.e WHERE g.e IS NOT NULL GROUP BY 1, 2, 3""")
def interval_segments(spark, d):
    out = intervals.segments(spans(spark, d), ["k"], "id", 60)
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), " "))


@query(f"WITH {IV} SELECT k, id, s, least(e, 11000) AS e FROM iv WHERE s < least(e, 11000)")
def clip_left(spark, d):
    return intervals.clip(spans(spark, d).drop("pr"), 11000, True)


@query(f"""WITH {IV}, o AS (SELECT o_custkey AS k, o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS p FROM orders)
  SELECT o_orderkey, coalesce(max(s) FILTER (WHERE s <= p), -1) AS below, coalesce(min(s) FILTER (WHERE s >= p), -1) AS above FROM o LEFT JOIN iv USING (k) GROUP BY 1""")
def brackets(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("p"))
    out = relational.brackets(o, spans(spark, d), ["k"], "p", "s")
    return out.select("o_orderkey", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("below", "above")))


@query("""WITH h AS (SELECT l_returnflag AS f, l_partkey AS a, l_suppkey AS b, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2, 3),
  x AS (SELECT *, row_number() OVER (PARTITION BY f, a ORDER BY score DESC, b) AS i, row_number() OVER (PARTITION BY f, b ORDER BY score DESC, a) AS j FROM h)
  SELECT f, count(*) AS n, sum(score) AS total FROM x WHERE i = 1 AND j = 1 GROUP BY 1""")
def block_best(spark, d):
    h = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").alias("score"))
    return relational.block_best(h, "f", "a", "b", "score")


@query("""WITH c AS (SELECT l_returnflag, l_linenumber, count(*) FILTER (WHERE l_quantity > 25) AS p, count(*) FILTER (WHERE l_discount > 0.05) AS q FROM lineitem GROUP BY 1, 2),
  x AS (SELECT l_returnflag, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM c WINDOW w AS (PARTITION BY l_returnflag))
  SELECT l_returnflag, round(-sum(p * log2(q)), 6) AS cross_entropy, round(sum(p * log2(p / q)), 6) AS kl FROM x WHERE p > 0 GROUP BY 1""")
def divergence(spark, d):
    c = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count_if(F.col("l_quantity") > 25).alias("p"), F.count_if(F.col("l_discount") > 0.05).alias("q"))
    return stats.divergence(c, "p", "q", ["l_returnflag"]).select("l_returnflag", F.round("cross_entropy", 6).alias("cross_entropy"), F.round("kl", 6).alias("kl"))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size <= 25) AS rank, round(count(*) FILTER (WHERE p_size <= 25) / (count(p_size) + 1), 6) AS share FROM part GROUP BY 1")
def rank_of(spark, d):
    return stats.rank_of(t(spark, d, "part"), ["p_brand"], "p_size", 25).withColumn("share", F.round("share", 6))


@query("""WITH x AS (SELECT p_partkey, (p_partkey % 101) / 101.0::DOUBLE AS t, p_size::DOUBLE AS s FROM part)
  SELECT p_partkey, round(s * (1 - t) + 7 * t, 7) AS line, round((2 * t ** 3 - 3 * t ** 2 + 1) * s + (3 * t ** 2 - 2 * t ** 3) * 7 + (t ** 3 - 2 * t ** 2 + t) * 2 + (t ** 3 - t ** 2) * 3, 7) AS hermite,
  round((1 - t) ** 3 * s + 3 * (1 - t) ** 2 * t * 9 + 3 * (1 - t) * t ** 2 * 4 + t ** 3 * 7, 7) AS bezier,
  round(0.5 * (2 * s + (7 - 3) * t + (2 * 3 - 5 * s + 4 * 7 - 11) * t ** 2 + (3 * s - 3 - 3 * 7 + 11) * t ** 3), 7) AS spline FROM x""")
def curves(spark, d):
    x, s = (F.col("p_partkey") % 101) / F.lit(101.0), F.col("p_size").cast("double")
    got = {"line": geometry.lerp(s, 7, x), "hermite": geometry.hermite(s, 7, 2, 3, x), "bezier": geometry.bezier(s, 9, 4, 7, x), "spline": geometry.catmull_rom(3, s, 7, 11, x)}
    return t(spark, d, "part").select("p_partkey", *(F.round(c, 7).alias(k) for k, c in got.items()))


@query("SELECT p_partkey, p_size BETWEEN 10 AND 30 AND p_partkey % 100 BETWEEN 20 AND 70 AS box, p_partkey % 100 >= 0 AND p_size >= 0 AND 2 * p_size + p_partkey % 100 <= 100 AS triangle FROM part")
def shapes(spark, d):
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 100).cast("double")
    box = geometry.in_convex([10, 10, 30, 30], [20, 70, 70, 20], x, y)
    return t(spark, d, "part").select("p_partkey", box.alias("box"), geometry.in_convex([0, 50, 0], [0, 0, 100], x, y).alias("triangle"))


@query("""WITH x AS (SELECT p_partkey, 1 - 2 * ((p_partkey % 99 + 1) / 100.0::DOUBLE) AS z, p_size / 60.0::DOUBLE AS p, p_retailprice AS t FROM part), y AS (SELECT *, 1 - 2 * p AS w FROM x)
  SELECT p_partkey, round(p * (1 - p) * (6 * exp(-2 * t / 4000) + 5 * 2.0 / 3 * 9 * z * w * exp(-6 * t / 4000) + 7.0 / 3 * (7.5 * z * z - 1.5) * (7.5 * w * w - 1.5) * exp(-12 * t / 4000)), 7) AS density FROM y""")
def allele_density(spark, d):
    x = samplers.frequency_density((F.col("p_partkey") % 99 + 1) / F.lit(100.0), F.col("p_size") / F.lit(60.0), 1000, F.col("p_retailprice"), 3)
    return t(spark, d, "part").select("p_partkey", F.round(x, 7).alias("density"))


@query("""WITH e AS (SELECT user_id, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS t, count(*) OVER (PARTITION BY user_id) + 2 - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  w AS (SELECT user_id, k, t - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY k DESC), 0) AS w FROM e) SELECT user_id, round(sum(w * k * (k - 1) / 2) / count(*), 1) AS n FROM w GROUP BY 1""")
def popsize(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    e = t(spark, d, "events").select("user_id", (sec - F.min(sec).over(w)).alias("t"), (F.count("*").over(w) + 2 - F.row_number().over(w.orderBy("ts", "event_id"))).alias("k"))
    return population.popsize_of_times(e, ["user_id"]).withColumn("n", F.round("n", 1))


@query(f"""WITH {RECON}, c AS (SELECT tree_id, f AS node, leaf AS side, s FROM g UNION ALL SELECT tree_id, 'o', f, s FROM g),
  x AS (SELECT tree_id, node, s, count(DISTINCT side) AS n FROM c GROUP BY 1, 2, 3)
  SELECT x.tree_id, x.node, round(count(*) FILTER (WHERE n > 1) / count(*), 6) AS consistency FROM x JOIN recon ON recon.tree_id = x.tree_id AND recon.node = x.node WHERE event = 'dup' GROUP BY 1, 2""")
def duplication_consistency(spark, d):
    nodes, _, recon = reconciled(spark, d)
    return rearrange.duplication_consistency(nodes, recon).withColumn("consistency", F.round("consistency", 6))


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderpriority AS c, o_orderkey AS pos1, o_orderkey + o_custkey % 4 * 6 AS pos2, CASE WHEN o_custkey % 9 = 0 THEN -1 ELSE 1 END AS strand FROM orders),
  a AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos2, id) AS r FROM p), b AS (SELECT *, row_number() OVER w AS i, coalesce(r - lag(r) OVER w, 0) AS d FROM a WINDOW w AS (PARTITION BY c ORDER BY pos1, id)),
  e AS (SELECT *, CASE WHEN abs(d) = 1 THEN d ELSE 0 END AS s FROM b), f AS (SELECT *, s = lag(s) OVER (PARTITION BY c ORDER BY i) AND strand = s AS fits FROM e),
  g AS (SELECT *, max(CASE WHEN s = 0 THEN 2 * i + 1 WHEN fits THEN 2 * i END) OVER (PARTITION BY c ORDER BY i) AS z FROM f), h AS (SELECT *, (z % 2 + i - z // 2) % 2 AS n FROM g),
  k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY c ORDER BY i) AS BIGINT) AS block FROM h)
  SELECT id, c AS chrom1, block, CAST(coalesce(max(CASE WHEN n = 0 THEN s END) OVER (PARTITION BY c, block), 0) AS INTEGER) AS direction FROM k""")
def collinear_blocks(spark, d):
    strand = F.when(F.col("o_custkey") % 9 == 0, -1).otherwise(1)
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("chrom1"), F.col("o_orderkey").alias("pos1"), F.col("o_orderpriority").alias("chrom2"), (F.col("o_orderkey") + F.col("o_custkey") % 4 * 6).alias("pos2"), strand.alias("strand"))
    return synteny.collinear(o)
