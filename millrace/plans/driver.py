"""A query for every operator, over whole driver tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph, intervals, ordered, relational, stats, tours
from ..streaming import events as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query("SELECT l_returnflag, l_linestatus, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY 1, 2")
def histtab(spark, d):
    out = relational.histtab(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    return out.withColumn("percent", F.round("percent", 6))


@query("SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_tables(spark, d):
    cust = relational.join_tables((t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("k")), "c_custkey"))
    cust = cust.join(t(spark, d, "nation"), F.col("k") == F.col("n_nationkey"))
    return t(spark, d, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_name", "n_name")


@query("""SELECT o_orderkey, c_name, n_max FROM orders JOIN (SELECT c_custkey, c_name FROM customer) ON o_orderkey = c_custkey
  JOIN (SELECT p_partkey, p_size AS n_max FROM part) ON o_orderkey = p_partkey""")
def join_three_keys(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    c, p = t(spark, d, "customer").select("c_custkey", "c_name"), t(spark, d, "part").select("p_partkey", F.col("p_size").alias("n_max"))
    return relational.join_tables((o, "o_orderkey"), (c, "c_custkey"), (p, "p_partkey")).select("o_orderkey", "c_name", "n_max")


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, 'none') AS p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def lookup(spark, d):
    small = t(spark, d, "part").where("p_size < 25")
    return relational.lookup(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), small, "l_partkey", "p_partkey", "p_name", "none").drop("l_partkey")


HITS = "SELECT l_partkey AS a, l_suppkey AS b, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2"


def hits(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").alias("score"))


@query(f"SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM ({HITS})) WHERE r = 1")
def best_hit(spark, d):
    return relational.best_hits(hits(spark, d), ["a"], "score", ["b"])


@query(f"""WITH h AS ({HITS}), x AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM h),
  y AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS r FROM h)
  SELECT x.a, x.b, x.score FROM x JOIN y ON x.a = y.a AND x.b = y.b WHERE x.r = 1 AND y.r = 1""")
def best_bidir(spark, d):
    return relational.best_bidirectional(hits(spark, d), "a", "b", "score")


@query("""SELECT coalesce(p1, -1) AS p1, coalesce(p2, -1) AS p2, count(*) AS n FROM (SELECT c_custkey AS k, c_nationkey AS p1 FROM customer)
  FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS p2 FROM supplier) USING (k) GROUP BY 1, 2""")
def confusion(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("p1"))
    return relational.confusion(a, t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("p2")), "k", "p1", "p2")


@query("""SELECT p1, string_agg(CAST(p2 AS VARCHAR), ',' ORDER BY p2) AS parts FROM (SELECT DISTINCT c_nationkey AS p1, coalesce(s_nationkey, -1) AS p2
  FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey) GROUP BY 1""")
def part_lookup(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("p1"))
    return relational.part_lookup(a, t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("p2")), "k", "p1", "p2")


@query(f"SELECT c_mktsegment, {', '.join(f'count(*) FILTER (WHERE c_nationkey = {i}) AS c{i}' for i in range(25))} FROM customer GROUP BY 1")
def matrix_pivot(spark, d):
    cells = t(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("v"))
    return relational.to_matrix(cells, "c_mktsegment", "c_nationkey", "v", list(range(25)))


@query("SELECT c_nationkey AS i, c_mktsegment AS j, count(*) AS v FROM customer GROUP BY 1, 2")
def matrix_transpose(spark, d):
    cells = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("i"), F.col("c_nationkey").alias("j")).agg(F.count("*").alias("v"))
    return relational.transpose(cells, "i", "j")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier s WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)")
def all_extreme(spark, d):
    return relational.all_extreme(t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], "s_acctbal")


@query("""WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 25), p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.05),
  n AS (SELECT (SELECT count(*) FROM a) AS n_actual, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM a JOIN p USING (l_partkey, l_suppkey)) AS n_both)
  SELECT *, n_both / n_actual AS sensitivity, n_both / n_predicted AS ppv FROM n""")
def relation_scores(spark, d):
    li = t(spark, d, "lineitem")
    return relational.prediction_scores(li.where("l_quantity > 25"), li.where("l_discount > 0.05"), ["l_partkey", "l_suppkey"])


DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER)"
IV = f"iv AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderpriority AS pr, min({DAY}) AS s, max({DAY}) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"


def spans(spark, d):
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    return li.join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pr"), day("a").alias("s"), day("b").alias("e"))


UNION = f"""WITH {IV}, n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv),
  g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, id) AS u FROM n) SELECT k, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY k, u"""


@query(UNION)
def interval_union(spark, d):
    return intervals.union(spans(spark, d), ["k"], "id")


@query(f"""WITH {IV}, p AS (SELECT k, s, 1 AS d FROM iv UNION ALL SELECT k, e, -1 FROM iv), q AS (SELECT k, s, sum(d) AS d FROM p GROUP BY 1, 2),
  r AS (SELECT k, s, lead(s) OVER (PARTITION BY k ORDER BY s) AS e, CAST(sum(d) OVER (PARTITION BY k ORDER BY s) AS BIGINT) AS depth FROM q) SELECT * FROM r WHERE e IS NOT NULL""")
def coverage_depth(spark, d):
    return intervals.coverage(spans(spark, d), ["k"])


@query(f"""WITH {IV}, p AS (SELECT k, s, CASE WHEN pr = '1-URGENT' THEN 0 ELSE 1 END AS a, CASE WHEN pr = '1-URGENT' THEN 1 ELSE 0 END AS b FROM iv
    UNION ALL SELECT k, e, CASE WHEN pr = '1-URGENT' THEN 0 ELSE -1 END, CASE WHEN pr = '1-URGENT' THEN -1 ELSE 0 END FROM iv),
  q AS (SELECT k, s, sum(a) AS a, sum(b) AS b FROM p GROUP BY 1, 2), r AS (SELECT k, s, lead(s) OVER w AS e, sum(a) OVER w > 0 AND sum(b) OVER w = 0 AS o FROM q WINDOW w AS (PARTITION BY k ORDER BY s)),
  x AS (SELECT * FROM r WHERE e IS NOT NULL), y AS (SELECT *, CASE WHEN o AND coalesce(lag(o) OVER (PARTITION BY k ORDER BY s), FALSE) THEN 0 ELSE 1 END AS n FROM x),
  z AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s) AS u FROM y) SELECT k, min(s) AS s, max(e) AS e FROM z WHERE o GROUP BY k, u""")
def interval_subtract(spark, d):
    iv = spans(spark, d)
    return intervals.subtract(iv.where("pr <> '1-URGENT'"), iv.where("pr = '1-URGENT'"), ["k"])


@query(f"WITH {IV} SELECT a.k, a.id, b.id AS id2 FROM iv a JOIN iv b ON a.k = b.k AND a.id < b.id AND a.s <= b.e AND b.s <= a.e")
def overlap_join(spark, d):
    iv = spans(spark, d).drop("pr")
    return intervals.overlap_join(iv, iv.withColumnsRenamed({"id": "id2", "s": "s2", "e": "e2"}), ["k"]).where("id < id2").select("k", "id", "id2")


@query(f"WITH {IV} SELECT k, o_orderkey, id FROM iv JOIN (SELECT o_custkey AS k, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS p FROM orders) USING (k) WHERE s <= p AND p <= e")
def stab(spark, d):
    p = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("p"))
    return intervals.stab(p, spans(spark, d), ["k"]).select("k", "o_orderkey", "id")


RECT = "q AS (SELECT l_suppkey AS k, l_partkey AS id, min(l_quantity) AS x1, max(l_quantity) AS x2, min(l_linenumber) * 5.0 AS y1, max(l_linenumber) * 5.0 AS y2 FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {RECT} SELECT a.k, a.id, b.id AS id2 FROM q a JOIN q b ON a.k = b.k AND a.id < b.id AND a.x2 > b.x1 AND a.x1 <= b.x2 AND a.y2 > b.y1 AND a.y1 <= b.y2")
def rectangle_overlap(spark, d):
    five = F.lit(5.0)
    q = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("id")).agg(F.min("l_quantity").alias("x1"), F.max("l_quantity").alias("x2"), (F.min("l_linenumber") * five).alias("y1"), (F.max("l_linenumber") * five).alias("y2"))
    q = graph.cut(q)
    b = q.withColumnsRenamed({"id": "id2", "x1": "u1", "x2": "u2", "y1": "v1", "y2": "v2"})
    return intervals.rectangle_join(q, b, ["k"]).where("id < id2").select("k", "id", "id2")


EV = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) {EV} AS p, row_number() {EV} AS n FROM events) WHERE n = 1 OR event_type IS DISTINCT FROM p")
def uniq_runs(spark, d):
    return ordered.uniq(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query(f"""WITH a AS (SELECT *, row_number() {EV} - 1 AS i, CASE WHEN event_type IS DISTINCT FROM lag(event_type) {EV} OR row_number() {EV} = 1 THEN 1 ELSE 0 END AS new FROM events),
  b AS (SELECT *, sum(new) {EV} AS run FROM a) SELECT user_id, any_value(event_type) AS event_type, min(i) AS start, count(*) AS n FROM b GROUP BY user_id, run""")
def islands(spark, d):
    return ordered.islands(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").drop("run")


@query(f"SELECT event_id, round(sum(value) {EV}, 4) AS total FROM events")
def cumsum(spark, d):
    return ordered.cumsum(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", "total").select("event_id", F.round("total", 4).alias("total"))


@query(f"""SELECT event_id, round(CASE least(i, n - 1 - i) WHEN 0 THEN value WHEN 1 THEN avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS mean
  FROM (SELECT *, row_number() {EV} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def smooth(spark, d):
    return ordered.smooth(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 2, "mean").select("event_id", F.round("mean", 6).alias("mean"))


@query("""WITH e AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1), a AS (SELECT DISTINCT p_brand, p_retailprice AS x, least(p_retailprice - lo, hi - p_retailprice, 50) AS d FROM part JOIN e USING (p_brand))
  SELECT p_brand, x AS p_retailprice, round(avg(p_retailprice), 7) AS mean_x, round(avg(p_size), 6) AS mean_y, count(*) AS n FROM a JOIN part USING (p_brand) WHERE p_retailprice BETWEEN x - d AND x + d GROUP BY 1, 2 HAVING count(*) >= 3""")
def smooth_by_value(spark, d):
    out = ordered.smooth_by_value(t(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size", 50.0, 3)
    return out.withColumns({"mean_x": F.round("mean_x", 7), "mean_y": F.round("mean_y", 6)})


@query("""WITH e AS (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1), w AS (SELECT p_brand, lo + 3 * i AS low FROM e, range(0, 40) r(i) WHERE lo + 3 * i <= hi)
  SELECT p_brand, CAST(low AS DOUBLE) AS low, count(*) AS n, round(avg(p_retailprice), 7) AS mean FROM w JOIN part USING (p_brand) WHERE p_size >= low AND p_size < low + 7 GROUP BY 1, 2""")
def step_windows(spark, d):
    out = ordered.step_windows(t(spark, d, "part"), ["p_brand"], "p_size", 7.0, 3.0, "p_retailprice")
    return out.withColumn("mean", F.round("mean", 7))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS r FROM part")
def rank_avg(spark, d):
    return t(spark, d, "part").select("p_partkey", ordered.rank_average("p_retailprice", ["p_brand"]).alias("r"))


@query("SELECT s_suppkey, round(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) / count(*) OVER (PARTITION BY s_nationkey), 6) AS p FROM supplier")
def cdf(spark, d):
    return ordered.cdf(t(spark, d, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey").select("s_suppkey", F.round("p", 6).alias("p"))


@query("""SELECT p_brand, v FROM (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i,
  count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))""")
def percentile(spark, d):
    return ordered.percentile(t(spark, d, "part"), ["p_brand"], "p_retailprice", 0.9)


BIN = "least(19, CAST(floor((o_totalprice - lo) / ((hi - lo) / 20)) AS BIGINT))"


@query(f"SELECT {BIN} AS bin, round(any_value(lo) + {BIN} * any_value((hi - lo) / 20), 4) AS low, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def bucket_hist(spark, d):
    return stats.histogram(t(spark, d, "orders"), "o_totalprice").withColumn("low", F.round("low", 4))


@query("""SELECT least(9, CAST(floor((l_quantity - a) / ((b - a) / 10)) AS BIGINT)) AS bin_x, least(9, CAST(floor((l_extendedprice - c) / ((e - c) / 10)) AS BIGINT)) AS bin_y, count(*) AS n
  FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS e FROM lineitem) GROUP BY 1, 2""")
def hist2(spark, d):
    return stats.histogram2(t(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice) / 1000, 4) AS cov FROM lineitem GROUP BY 1")
def correlation(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(stats.correlation("l_quantity", "l_extendedprice"), "r"), F.round(F.covar_samp("l_quantity", "l_extendedprice") / 1000, 4).alias("cov"))


RK = "rank() OVER (ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"SELECT p_brand, round(corr(a, b), 6) AS rho FROM (SELECT p_brand, {RK.format('p_size').replace('OVER (ORDER', 'OVER (PARTITION BY p_brand ORDER').replace('PARTITION BY p_size', 'PARTITION BY p_brand, p_size')} AS a, {RK.format('p_retailprice').replace('OVER (ORDER', 'OVER (PARTITION BY p_brand ORDER').replace('PARTITION BY p_retailprice', 'PARTITION BY p_brand, p_retailprice')} AS b FROM part) GROUP BY 1")
def spearman(spark, d):
    ranks = t(spark, d, "part").select("p_brand", ordered.rank_average("p_size", ["p_brand"]).alias("a"), ordered.rank_average("p_retailprice", ["p_brand"]).alias("b"))
    return ranks.groupBy("p_brand").agg(r6(stats.correlation("a", "b"), "rho"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def fit_line(spark, d):
    out = t(spark, d, "lineitem").groupBy("l_returnflag").agg(*stats.fit_line("l_quantity", "l_extendedprice"))
    return out.select("l_returnflag", r6("slope", "slope"), F.round("intercept", 4).alias("intercept"), r6("r2", "r2"))


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER w) / stddev_samp(s_acctbal) OVER w, 6) AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def z_scores(spark, d):
    return stats.z_scores(t(spark, d, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", F.round("z", 6).alias("z"))


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, round(var_samp(p_retailprice), 4) AS variance, round(stddev_samp(p_retailprice) / sqrt(count(*)), 6) AS serror FROM part GROUP BY 1")
def moments(spark, d):
    c = "p_retailprice"
    return t(spark, d, "part").groupBy("p_brand").agg(r6(F.avg(c), "mean"), r6(F.median(c), "median"), F.round(F.var_samp(c), 4).alias("variance"), r6(F.stddev_samp(c) / F.sqrt(F.count("*")), "serror"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1")
def entropy(spark, d):
    counts = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return stats.entropy(counts, "n", ["user_id"]).withColumn("entropy", F.round("entropy", 6) + F.lit(0.0))


@query("""WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS cn FROM c GROUP BY 1)
  SELECT round((SELECT sum(n) FROM c) * (sum(n * n / (rn * cn)) - 1), 4) AS chi2, CAST((SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM k) AS BIGINT) AS df FROM c JOIN r USING (a) JOIN k USING (b)""")
def chi_square(spark, d):
    counts = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linenumber").alias("b")).agg(F.count("*").alias("n"))
    return stats.chi_square(counts, "a", "b", "n").withColumn("chi2", F.round("chi2", 4))


TREE = """tree AS (SELECT 'root' AS node, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
  up AS (SELECT node, node AS ancestor, 0 AS depth FROM tree UNION ALL SELECT u.node, x.parent, u.depth + 1 FROM up u JOIN tree x ON u.ancestor = x.node WHERE x.parent IS NOT NULL)"""


def tree(spark, d):
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"))
    part = lambda table, a, c, b, p: t(spark, d, table).select(F.concat(F.lit(a), F.col(c).cast("string")).alias("node"), p.alias("parent"))
    up = lambda b, p: F.concat(F.lit(b), F.col(p).cast("string"))
    return root.union(part("region", "r", "r_regionkey", None, F.lit("root"))).union(part("nation", "n", "n_nationkey", None, up("r", "n_regionkey"))).union(part("supplier", "s", "s_suppkey", None, up("n", "s_nationkey")))


@query(f"WITH RECURSIVE {TREE} SELECT node, ancestor, depth FROM up")
def tree_closure(spark, d):
    return graph.closure(tree(spark, d))


@query(f"""WITH RECURSIVE {TREE}, p AS (SELECT 's' || s_suppkey AS a, 's' || (s_suppkey + 1) AS b FROM supplier), m AS (
  SELECT a, b, x.ancestor AS lca, x.depth + y.depth AS distance, row_number() OVER (PARTITION BY a, b ORDER BY x.depth) AS r FROM p JOIN up x ON a = x.node JOIN up y ON b = y.node AND x.ancestor = y.ancestor)
  SELECT a, b, lca, distance FROM m WHERE r = 1""")
def tree_lca(spark, d):
    pairs = t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("b"))
    return tours.lca(tours.heavy_paths(tours.tour(tree(spark, d))), pairs)


@query(f"""WITH RECURSIVE {TREE}, q AS (SELECT node, [node] AS way FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, list_append(q.way, t.node) FROM q JOIN tree t ON t.parent = q.node),
  f AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)),
  n AS (SELECT ancestor AS node, count(*) AS size, count(f.node) AS leaves FROM up LEFT JOIN f ON f.node = up.node GROUP BY 1),
  o AS (SELECT q.node, row_number() OVER (ORDER BY way) - 1 AS pre, len(way) - 1 AS level, count(f.node) OVER (ORDER BY way) - CASE WHEN f.node IS NULL THEN 0 ELSE 1 END AS first_leaf FROM q LEFT JOIN f ON f.node = q.node)
  SELECT node, pre, size, level, first_leaf, leaves FROM o JOIN n USING (node)""")
def tree_numbers(spark, d):
    return tours.tour(tree(spark, d)).select("node", "pre", "size", "level", "first_leaf", "leaves")


def supply_graph(spark, d):
    """Parts lead to all their suppliers, these to their nation and to the supplier of half their number, nations to regions."""
    name = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    s = F.col("s_suppkey")
    out = t(spark, d, "lineitem").select(name("p", F.col("l_partkey")).alias("node"), name("s", F.col("l_suppkey")).alias("parent"))
    out = out.union(t(spark, d, "supplier").select(name("s", s), name("n", F.col("s_nationkey"))))
    out = out.union(t(spark, d, "supplier").where(s > 1).select(name("s", s), name("s", F.floor(s / 2))))
    return out.union(t(spark, d, "nation").select(name("n", F.col("n_nationkey")), name("r", F.col("n_regionkey"))))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT 'p' || l_partkey AS node, 's' || l_suppkey AS parent FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
    UNION SELECT 's' || s_suppkey, 's' || (s_suppkey // 2) FROM supplier WHERE s_suppkey > 1 UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
  u AS (SELECT node, node AS ancestor, 0 AS depth FROM (SELECT node FROM e UNION SELECT parent FROM e) UNION SELECT u.node, e.parent, u.depth + 1 FROM u JOIN e ON u.ancestor = e.node)
  SELECT node, ancestor, min(depth) AS depth FROM u GROUP BY 1, 2""")
def supply_closure(spark, d):
    return graph.above(supply_graph(spark, d))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS b, lag(o_orderkey) OVER w AS a, date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  e AS (SELECT a, b FROM o WHERE gap <= 120), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), c AS (SELECT o_orderkey AS item, o_orderkey AS x FROM orders UNION SELECT c.item, s.b FROM c JOIN s ON c.x = s.a)
  SELECT item, min(x) AS component FROM c GROUP BY item""")
def components(spark, d):
    """Orders linked by the same customer's next one within 120 days; one alone is its own component."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("b"), F.lag("o_orderkey").over(w).alias("a"), F.datediff(F.col("o_orderdate").cast("date"), F.lag("o_orderdate").over(w).cast("date")).alias("gap"))
    return graph.components(o.select(F.when(F.col("gap") <= 120, F.col("a")).otherwise(F.col("b")).alias("a"), "b"))


@query(None)
def components_all(spark, d):
    """Parts linked by orders, over every line item: a star from an order's smallest part instead of all pairs."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey is not null and l_partkey is not null")
    hub = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"))
    return graph.components(li.join(hub, "l_orderkey").select("a", F.col("l_partkey").alias("b")))


@query("SELECT doc_id, reverse(translate(text, 'ACGTUNacgtun', 'TGCAANtgcaan')) AS rc, length(text) AS n FROM documents")
def reverse_complement(spark, d):
    return t(spark, d, "documents").select("doc_id", S.reverse_complement(F.col("text")).alias("rc"), F.length("text").cast("long").alias("n"))


@query("SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def vector_pairs(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(b, "vec_id").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("e2")), 5).alias("dot"), F.round(S.distance(F.col("embedding"), F.col("e2")), 5).alias("dist"))


@query("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS pretty, CAST(floor(o_totalprice) AS BIGINT) AS back FROM orders")
def pretty_ints(spark, d):
    p = S.pretty_int(F.floor("o_totalprice"))
    return t(spark, d, "orders").select("o_orderkey", p.alias("pretty"), S.int_of_pretty(p).alias("back"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'int' AS kind FROM events")
def guess_types(spark, d):
    k = F.get_json_object("props", "$.k")
    return t(spark, d, "events").select("event_id", k.alias("k"), S.guess_type(k).alias("kind"))


@query("""WITH w AS (SELECT epoch(ts) AS s, event_type, value FROM events), x AS (SELECT CAST(floor(s / 1800) AS BIGINT) * 1800 - o AS start, event_type, value FROM w, (VALUES (0), (1800)) h(o))
  SELECT start, start + 3600 AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY start, event_type""")
def hop_window(spark, d):
    return streams.hop_window(t(spark, d, "events"), "ts", ["event_type"], "value", "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
  SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts)) + 3600) AS BIGINT) AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, g""")
def session_merge(spark, d):
    return streams.sessions(t(spark, d, "events"), "ts", ["user_id"], "1 hour")


@query("SELECT CAST(g AS BIGINT) AS p_size, count(p_partkey) AS n FROM generate_series(0, 60) s(g) LEFT JOIN part ON p_size = g GROUP BY 1")
def dense_counts(spark, d):
    return stats.dense_counts(t(spark, d, "part").select("p_size"), "p_size", 60)


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def one_norm(spark, d):
    return stats.one_norm(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "share").select("o_orderkey", F.round("share", 6).alias("share"))


@query("""SELECT p_brand, round(m + ln(sum(exp(x - m))), 6) AS v FROM (SELECT p_brand, p_size / 3.0::DOUBLE AS x,
  max(p_size / 3.0::DOUBLE) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY p_brand, m""")
def log_sum(spark, d):
    x = t(spark, d, "part").select("p_brand", (F.col("p_size") / F.lit(3.0)).alias("x"))
    return stats.log_sum(x, ["p_brand"], "x", "v").withColumn("v", F.round("v", 6))


@query("SELECT l_returnflag, round(avg((l_tax - l_discount) * (l_tax - l_discount)), 8) AS mse FROM lineitem GROUP BY 1")
def mean_squared_error(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(stats.error("l_tax", "l_discount"), 8).alias("mse"))


@query("SELECT l_suppkey, l_linenumber, n FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE l_linenumber IN (1, 3, 5, 7) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def submatrix(spark, d):
    m = t(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return relational.submatrix(m, "l_suppkey", "l_linenumber", t(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"), [1, 3, 5, 7])


@query("""WITH a AS (SELECT c_custkey AS item, c_nationkey AS p1 FROM customer), b AS (SELECT c_custkey AS item, CASE WHEN c_nationkey % 3 = 0 THEN 'n' || c_nationkey ELSE n_name || (c_custkey % 2) END AS p2 FROM customer JOIN nation ON c_nationkey = n_nationkey),
  x AS (SELECT p1, list(item ORDER BY item) AS items FROM a GROUP BY 1), y AS (SELECT p2, list(item ORDER BY item) AS items FROM b GROUP BY 1) SELECT p1, p2 FROM x JOIN y USING (items)""")
def same_parts(spark, d):
    """Customers by nation, and again with two nations of three cut in halves."""
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cut = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise(F.concat("n_name", (F.col("c_custkey") % 2).cast("string")))
    return relational.same_parts(c.select("c_custkey", F.col("c_nationkey").alias("q")), c.select("c_custkey", cut.alias("q")), "c_custkey", "q")


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1, 2")
def stable_unique(spark, d):
    return relational.stable_unique(t(spark, d, "part").select("p_brand", "p_size", "p_partkey", "p_name"), ["p_brand", "p_size"], ["p_partkey"])
