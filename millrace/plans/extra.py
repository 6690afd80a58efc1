"""Queries of unpivoted tables, event windows, matrices of correlations, fits, picks, variates and guarded scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..functions import special as X
from ..operators import align, intervals, ordered, relational, stats
from .driver import IV, query, spans, t
from .sequences import ALN, names

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""WITH m AS (SELECT CAST(c_nationkey AS VARCHAR) AS rlabel, {', '.join(f"count(*) FILTER (WHERE c_mktsegment = '{x}') AS {x}" for x in SEGMENTS)} FROM customer GROUP BY 1)
  {' UNION ALL '.join(f"SELECT rlabel, '{x}' AS clabel, {x} AS v FROM m" for x in SEGMENTS)}""")
def matrix_unpivot(spark, d):
    wide = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("nation")).agg(*(F.count_if(F.col("c_mktsegment") == x).alias(x) for x in SEGMENTS))
    return relational.unpivot(wide, "nation")


@query("""WITH x AS (SELECT DISTINCT o_custkey AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS x FROM orders), e AS (SELECT k, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1),
  s AS (SELECT DISTINCT k, low, lo, hi FROM (SELECT k, x AS low FROM x UNION ALL SELECT k, x - 300 FROM x) JOIN e USING (k) WHERE low = lo OR (low > lo AND low <= hi - 300)),
  m AS (SELECT s.k, low, x FROM s JOIN x ON s.k = x.k AND ((low = lo AND x >= low AND x < low + 300) OR (low > lo AND x > low AND x <= low + 300)))
  SELECT k, low, low + 300 AS high, count(*) - 1 AS n, round((sum(x) - max(x)) / nullif(count(*) - 1, 0), 6) AS mean FROM m GROUP BY 1, 2""")
def event_windows(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("x"))
    return ordered.event_windows(o, ["k"], "x", 300).withColumn("mean", F.round("mean", 6))


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{x}' AS x, '{y}' AS y, round(covar_samp({x}, {y}), 4) AS cov, round(corr({x}, {y}), 6) AS r FROM lineitem GROUP BY 1" for x in COLS for y in COLS))
def pair_matrix(spark, d):
    out = stats.pair_matrix(t(spark, d, "lineitem"), ["l_returnflag"], COLS)
    return out.withColumns({"cov": F.round("cov", 4), "r": F.round("r", 6)})


@query("SELECT p_brand, p_size AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS r FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r = 1")
def modes(spark, d):
    return stats.modes(t(spark, d, "part"), ["p_brand"], "p_size")


@query("SELECT o_custkey, round(product(1 + o_totalprice / 1e7), 6) AS prod, round(sum(ln(1 + o_totalprice / 1e7)), 6) AS log_prod FROM orders GROUP BY 1")
def products(spark, d):
    o = t(spark, d, "orders").withColumn("x", 1 + F.col("o_totalprice") / F.lit(1e7))
    out = o.groupBy("o_custkey").agg(*stats.products("x"))
    return out.withColumns({c: F.round(c, 6) for c in ("prod", "log_prod")})


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS b FROM part)
  SELECT p_brand, round((6 * sum((a - b) * (a - b)) - count(*) * (count(*) * count(*) - 1)) / nullif(count(*) * (count(*) + 1) * sqrt(count(*) - 1), 0), 6) AS z FROM r GROUP BY 1""")
def spearman_z(spark, d):
    return ordered.spearman_z(t(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice", "p_partkey").withColumn("z", F.round("z", 6))


@query("""WITH x AS (SELECT p_partkey, (p_size - 25) / 60.0::DOUBLE AS r FROM part), y AS (SELECT p_partkey, r * sqrt(2 / (1 - r * r)) AS a, r * sqrt(4 / (1 - r * r)) AS b FROM x)
  SELECT p_partkey, round(0.5 - a / (2 * sqrt(2 + a * a)), 8) AS p4, round(0.5 - 0.375 * b / sqrt(1 + b * b / 4) * (1 - b * b / (12 * (1 + b * b / 4))), 8) AS p6 FROM y""")
def correlation_p(spark, d):
    r = (F.col("p_size") - 25) / F.lit(60.0)
    return t(spark, d, "part").select("p_partkey", *(F.round(stats.correlation_p(r, F.lit(n)), 8).alias(f"p{n}") for n in (4, 6)))


@query("""WITH n AS (SELECT count(*) AS n, CASE WHEN count(*) // 20 >= 5 THEN count(*) // 20 ELSE count(*) // greatest(1, count(*) // 5) END AS size FROM orders),
  b AS (SELECT (i - 1) // size AS bin, count(*) AS k, min(v) AS low, any_value(n) AS n FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i FROM orders), n GROUP BY 1),
  e AS (SELECT k, n * (coalesce(1 - exp(-lead(low) OVER w / 250000), 1) - CASE WHEN lag(low) OVER w IS NULL THEN 0 ELSE 1 - exp(-low / 250000) END) AS expected FROM b WINDOW w AS (ORDER BY bin))
  SELECT round(sum((k - expected) * (k - expected) / expected), 4) AS chi2, count(*) - 1 AS df FROM e""")
def goodness_of_fit(spark, d):
    out = stats.goodness_of_fit(t(spark, d, "orders"), "o_totalprice", lambda x: 1 - F.exp(-x / 250000))
    return out.withColumn("chi2", F.round("chi2", 4))


@query("""SELECT round(regr_intercept(y, x), 4) AS a, round(regr_slope(y, x), 4) AS b, round(regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x), 4) AS error
  FROM (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) * 10 + x / 25 AS y FROM lineitem)""")
def curve_fit(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount").cast("double") * 10 + F.col("l_quantity").cast("double") / 25).alias("y"))
    (a, b), error = stats.fit_curve(rows, "x", "y", lambda x, p: p[0] + p[1] * x, [0.0, 0.0])
    return spark.range(1).select(*(F.lit(round(v, 4)).alias(n) for n, v in (("a", a), ("b", b), ("error", error))))


@query("""WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 7 / 51 AS t FROM part), w AS (SELECT p_partkey, t, [CASE WHEN u < 0 OR u >= 3 THEN 0 WHEN u < 1 THEN u * u / 2 WHEN u < 2 THEN (6 * u - 2 * u * u - 3) / 2 ELSE (3 - u) * (3 - u) / 2 END FOR u IN [t, t - 1, t - 2, t - 3]] AS w FROM x)
  SELECT p_partkey, round(2 * w[1] - w[2] + 4 * w[3] + 0.5 * w[4], 8) AS y FROM w""")
def b_spline(spark, d):
    t_ = F.col("p_size").cast("double") * 7 / 51
    return t(spark, d, "part").select("p_partkey", F.round(G.b_spline([2.0, -1.0, 4.0, 0.5], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0], t_), 8).alias("y"))


@query("""WITH c AS (SELECT s_suppkey AS item, sum(s_acctbal) OVER (ORDER BY s_suppkey) AS hi, sum(s_acctbal) OVER () AS s FROM supplier WHERE s_acctbal > 0)
  SELECT p_partkey, (SELECT min(item) FROM c WHERE hi / s > (p_partkey % 997) / 997.0::DOUBLE) AS s_suppkey FROM part""")
def weighted_pick(spark, d):
    choices = t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return stats.weighted_pick(choices, "s_suppkey", "s_acctbal", (F.col("p_partkey") % 997) / F.lit(997.0), t(spark, d, "part").select("p_partkey"))


@query(f"""WITH u AS (SELECT p_partkey, (p_partkey % 997) / 997.0::DOUBLE AS u, p_retailprice AS v FROM part), c AS (SELECT i, sum(exp(-3.0::DOUBLE) * 3.0::DOUBLE ** i / gamma(i + 1)) OVER (ORDER BY i) AS c FROM range(0, 40) r(i))
  SELECT p_partkey, round(-ln(1 - u) / 2.5, 8) AS wait, CAST((SELECT count(*) FROM c WHERE c <= u) AS INTEGER) AS n, round(v + (2 * u - 1) * 5, 6) AS near FROM u""")
def variates(spark, d):
    u = (F.col("p_partkey") % 997) / F.lit(997.0)
    return t(spark, d, "part").select("p_partkey", F.round(S.exponential(u, 2.5), 8).alias("wait"), S.poisson(u, 3.0).alias("n"), F.round(S.jitter(F.col("p_retailprice"), u, 5.0), 6).alias("near"))


@query("""SELECT s_suppkey, CAST(sign(s_acctbal) AS INTEGER) AS sign, round(CASE WHEN s_acctbal > 0 THEN log2(s_acctbal) ELSE -99 END, 6) AS log, CAST(floor(s_acctbal / 7) AS BIGINT) AS quotient, greatest(0, least(5000, s_acctbal)) AS clamped,
  round(coalesce(s_acctbal / nullif(s_nationkey, 0), -1), 6) AS ratio FROM supplier""")
def guarded_scalars(spark, d):
    x = F.col("s_acctbal")
    got = {"sign": F.signum(x).cast("int"), "log": F.round(S.safe_log(x, 2.0, -99.0), 6), "quotient": S.floor_divide(x, F.lit(7)), "clamped": S.clamp(x, 0.0, 5000.0), "ratio": F.round(S.safe_divide(x, F.col("s_nationkey"), -1.0), 6)}
    return t(spark, d, "supplier").select("s_suppkey", *(c.alias(k) for k, c in got.items()))


@query("""WITH x AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS a, (p_partkey % 50 + 1) / 10.0::DOUBLE AS b, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS sa, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END AS sb FROM part), y AS (SELECT *, sa * exp(a) + sb * exp(b) AS s FROM x)
  SELECT p_partkey, CASE WHEN sa = -sb AND a = b THEN 0 ELSE CAST(sign(s) AS INTEGER) END AS sign, CASE WHEN sa = -sb AND a = b THEN -99 ELSE round(ln(abs(s)), 6) END AS log FROM y""")
def signed_logs(spark, d):
    a, b = F.col("p_size") / F.lit(10.0), (F.col("p_partkey") % 50 + 1) / F.lit(10.0)
    sa, sb = F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1), F.when(F.col("p_partkey") % 3 == 0, -1).otherwise(1)
    got = t(spark, d, "part").select("p_partkey", S.signed_log_add(sa, a, sb, b).alias("x"))
    return got.select("p_partkey", F.col("x.sign").alias("sign"), F.when(F.col("x.sign") == 0, -99.0).otherwise(F.round("x.log", 6)).alias("log"))


@query("""WITH w AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: length(x)) AS n FROM part)
  SELECT p_partkey, array_to_string(list_transform(list_filter(range(0, len(n)), lambda i: n[i + 1] > 5), lambda i: CAST(i AS VARCHAR)), ' ') AS long_at, CAST(len(list_filter(n, lambda x: x <> 5)) AS INTEGER) AS others FROM w""")
def positions(spark, d):
    n = F.transform(F.split("p_name", " "), lambda x: F.length(x))
    at = F.array_join(F.transform(S.positions(n, lambda x: x > 5), lambda i: i.cast("string")), " ")
    return t(spark, d, "part").select("p_partkey", at.alias("long_at"), S.count_where(n, lambda x: x != 5).alias("others"))


@query("SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#(\\d)(\\d)', 1) AS word, regexp_extract(p_brand, '([A-Za-z]+)#(\\d)(\\d)', 3) AS last FROM part")
def named_groups(spark, d):
    m = S.named_groups(F.col("p_brand"), r"(?P<word>[A-Za-z]+)#(\d)(?P<last>\d)")
    return t(spark, d, "part").select("p_partkey", *(F.coalesce(m[k], F.lit("")).alias(k) for k in ("word", "last")))


@query("""SELECT p_partkey, CAST(greatest(0, ceil(p_size / 2.5)) AS INTEGER) AS n, round(list_sum(list_transform(range(0, CAST(ceil(p_size / 2.5) AS BIGINT)), lambda i: i * 2.5::DOUBLE)), 6) AS total FROM part""")
def float_ranges(spark, d):
    r = S.steps(F.lit(0.0), F.col("p_size").cast("double"), 2.5)
    return t(spark, d, "part").select("p_partkey", F.size(r).alias("n"), F.round(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""WITH {IV}, o AS (SELECT o_custkey AS k, o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS p FROM orders)
  SELECT o_orderkey, coalesce(min(s), -1) AS next FROM o LEFT JOIN iv ON iv.k = o.k AND s >= p GROUP BY 1""")
def following(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("p"))
    return intervals.following(o, spans(spark, d), ["k"]).select("o_orderkey", F.coalesce("next", F.lit(-1)).alias("next"))


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS part FROM orders")
def joined_parts(spark, d):
    """The partition by customer and month joined with that by customer and priority, and that by customer."""
    o = t(spark, d, "orders")
    by = [o.select("o_orderkey", F.concat_ws("/", "o_custkey", x).alias("part")) for x in (F.month("o_orderdate"), F.col("o_orderpriority"), F.lit(""))]
    return relational.joined_parts(by, "o_orderkey", "part")


@query("SELECT p_partkey, round(2 * p_size + p_retailprice, 4) AS aic, round(2 * p_size + p_retailprice + 2 * p_size * (p_size + 1) / (100.0::DOUBLE - p_size - 1), 4) AS aicc, round(p_size * ln(100.0::DOUBLE) + p_retailprice, 4) AS bic FROM part")
def information_criteria(spark, d):
    lnl, k, n = -F.col("p_retailprice") / 2, F.col("p_size"), F.lit(100.0)
    got = {"aic": X.akaike(lnl, k), "aicc": X.akaike_corrected(lnl, n, k), "bic": X.bayesian(lnl, n, k)}
    return t(spark, d, "part").select("p_partkey", *(F.round(c, 4).alias(a) for a, c in got.items()))


@query("SELECT p_partkey, round(lgamma(p_size / 3.0::DOUBLE), 8) AS log_gamma, round(lgamma(p_size + 1.0::DOUBLE), 8) AS log_factorial, round(1 - exp(-(p_size / 9.0::DOUBLE)), 8) AS gamma_inc FROM part")
def special_functions(spark, d):
    x = F.col("p_size").cast("double")
    return t(spark, d, "part").select("p_partkey", F.round(X.log_gamma(x / 3), 8).alias("log_gamma"), F.round(X.log_factorial(x), 8).alias("log_factorial"), F.round(X.gamma_inc(F.lit(1.0), x / 9), 8).alias("gamma_inc"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 1000 AS s, o_custkey % 1000 + 500 AS e, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS strand, o_custkey % 1000 + o_orderkey % 500 AS p FROM orders)
  SELECT o_orderkey, CASE WHEN strand = 1 THEN p - s ELSE e - p END AS local, p AS back FROM r""")
def region_coordinates(spark, d):
    k = F.col("o_custkey")
    s, e, strand = k % 1000, k % 1000 + 500, F.when(k % 2 == 0, 1).otherwise(-1)
    local = align.global_to_local(s + F.col("o_orderkey") % 500, s, e, strand)
    return t(spark, d, "orders").select("o_orderkey", local.alias("local"), align.local_to_global(local, s, e, strand).alias("back"))


@query(f"""WITH {ALN} SELECT name, array_to_string(list_transform(list_filter(range(0, len(seq)), lambda i: substr(seq, i + 1, 1) <> '-'), lambda i: CAST(i AS VARCHAR)), ' ') AS places,
  array_to_string(list_transform(range(1, len(seq) + 1), lambda i: CAST(len(replace(substr(seq, 1, i), '-', '')) - 1 AS VARCHAR)), ' ') AS letters FROM a""")
def align_places(spark, d):
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return names(spark, d).select("name", text(align.local_to_align(F.col("seq"))).alias("places"), text(align.align_to_local(F.col("seq"))).alias("letters"))


@query("""WITH s AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents), c AS (SELECT doc_id, substr(s, 1, (len(s) // 3 * 3)::INT) AS s FROM s)
  SELECT doc_id, array_to_string(list_transform(list_transform(range(1, len(s), 3), lambda i: substr(s, i, 3)), lambda x: CASE WHEN x IN ('TAA', 'TAG', 'TGA') THEN 'NNN' ELSE x END), '') AS masked FROM c""")
def stops_masked(spark, d):
    whole = t(spark, d, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s")).select("doc_id", F.expr("substring(s, 1, cast(length(s) div 3 * 3 as int))").alias("s"))
    return whole.select("doc_id", align.stops_masked(F.col("s")).alias("masked"))
