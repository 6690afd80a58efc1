"""Part names as alignments, texts as coding sequences, event types as symbols, and densities of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import population as P
from ..functions import special as X
from ..operators import align, arg, hmm
from .driver import query, t

ALN = "a AS (SELECT p_brand AS aln_id, p_partkey AS name, translate(rpad(p_name, 24, '-'), ' ', '-') AS seq FROM part)"
COLS = f"{ALN}, l AS (SELECT aln_id, name, i - 1 AS pos, substr(seq, i, 1) AS c FROM a, range(1, 25) r(i)), p AS (SELECT aln_id, pos, c, count(*) AS k FROM l GROUP BY 1, 2, 3)"


def names(spark, d):
    seq = F.translate(F.rpad("p_name", 24, "-"), " ", "-")
    return t(spark, d, "part").select(F.col("p_brand").alias("aln_id"), F.col("p_partkey").alias("name"), seq.alias("seq"))


@query(f"""WITH {COLS}, s AS (SELECT aln_id, pos, coalesce(max(k) FILTER (WHERE c <> '-'), 0) / sum(k) AS share FROM p GROUP BY 1, 2)
  SELECT aln_id, CAST(pos AS INTEGER) AS pos, round(share, 6) AS share, CASE WHEN share = 1 THEN '*' WHEN share > 0.5 THEN '.' ELSE ' ' END AS mark FROM s""")
def conservation(spark, d):
    return align.conservation(names(spark, d)).withColumn("share", F.round("share", 6))


@query(f"""WITH {COLS}, s AS (SELECT aln_id, pos FROM p GROUP BY 1, 2 HAVING sum(k) FILTER (WHERE c <> '-') >= 0.8 * sum(k))
  SELECT aln_id, name, coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE s.pos IS NOT NULL), '') AS seq FROM l LEFT JOIN s USING (aln_id, pos) GROUP BY 1, 2""")
def align_filter(spark, d):
    return align.require(names(spark, d), ratio=0.8)


@query(f"WITH {COLS} SELECT aln_id, CAST(pos AS INTEGER) AS pos, c, round(log2(k / sum(k) OVER (PARTITION BY aln_id, pos)), 6) AS score FROM p")
def pssm(spark, d):
    out = align.pssm(names(spark, d))
    return out.withColumn("score", F.round("score", 6) + F.lit(0.0))


@query(f"""WITH {COLS} SELECT aln_id, CAST(pos AS INTEGER) AS pos, round(sum(k) * 0.2 * log2(5.0::DOUBLE) - (log2(sum(k)) - sum(k * log2(k)) / sum(k)), 6) AS bits FROM p GROUP BY 1, 2""")
def align_information(spark, d):
    return align.information(names(spark, d)).withColumn("bits", F.round("bits", 6))


@query(f"""WITH s AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents), c AS (SELECT doc_id, substr(s, 1, (len(s) // 3 * 3)::INT) AS s FROM s)
  SELECT doc_id, array_to_string(list_transform(range(1, len(s), 3), lambda i: substr('{align.AMINO}', CAST((strpos('TCAG', substr(s, i, 1)) - 1) * 16 + (strpos('TCAG', substr(s, i + 1, 1)) - 1) * 4 + strpos('TCAG', substr(s, i + 2, 1)) AS INTEGER), 1)), '') AS protein FROM c""")
def codon_translate(spark, d):
    s = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    whole = t(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.expr("substring(s, 1, cast(length(s) div 3 * 3 as int))").alias("s"))
    return whole.select("doc_id", align.translate(F.col("s")).alias("protein"))


@query("""SELECT p_partkey, round(exp(-pow((p_retailprice - 1000) / 200, 2) / 2) / (200 * sqrt(2 * pi())), 8) AS normal,
  round(exp(3 * ln(0.2::DOUBLE) + 2 * ln(p_size) - 0.2 * p_size - lgamma(3)), 8) AS gamma, round(exp(p_size * ln(20::DOUBLE) - 20 - lgamma(p_size + 1)), 8) AS poisson,
  round(0.1 * exp(-0.1 * p_size), 8) AS exponential, round(lgamma(61) - lgamma(p_size + 1) - lgamma(61 - p_size), 6) AS log_choose,
  round(exp(lgamma(7) - lgamma(2) - lgamma(5) + ln(p_size / 61.0::DOUBLE) + 4 * ln(1 - p_size / 61.0::DOUBLE)), 8) AS beta FROM part""")
def densities(spark, d):
    k = F.col("p_size")
    cols = {"normal": X.normal_pdf(F.col("p_retailprice"), 1000, 200), "gamma": X.gamma_pdf(k, 3, 0.2), "poisson": X.poisson_pdf(k, 20), "exponential": X.exponential_pdf(k, 0.1), "beta": X.beta_pdf(k / 61.0, 2, 5)}
    return t(spark, d, "part").select("p_partkey", F.round(X.log_choose(F.lit(60), k), 6).alias("log_choose"), *(F.round(c, 8).alias(n) for n, c in cols.items()))


@query("""WITH x AS (SELECT p_partkey, p_size % 8 + 3 AS k, p_size % 3 + 1 AS b, p_retailprice AS t FROM part)
  SELECT p_partkey, round(k * (k - 1) / 2000.0::DOUBLE * exp(-k * (k - 1) / 2000.0::DOUBLE * t), 8) AS coal,
  round(list_sum(list_transform(range(b, k + 1), lambda j: exp(-j * (j - 1) * t / 2000.0::DOUBLE) * (2 * j - 1) * pow(-1, j - b) * exp(lgamma(b + j - 1 + CASE WHEN b + j = 1 THEN 1 ELSE 0 END) - lgamma(b) + lgamma(k + 1) - lgamma(k - j + 1) + lgamma(k) - lgamma(k + j) - lgamma(b + 1) - lgamma(j - b + 1)))), 6) AS counts,
  round((1 - 0.5 * (1 - exp(-t / 1000)) / (1 - 0.5 * exp(-t / 1000))) * (1 - (1 - exp(-t / 1000)) / (1 - 0.5 * exp(-t / 1000))) * pow((1 - exp(-t / 1000)) / (1 - 0.5 * exp(-t / 1000)), k - 1), 8) AS birth_death FROM x""")
def population(spark, d):
    x = t(spark, d, "part").select("p_partkey", (F.col("p_size") % 8 + 3).alias("k"), (F.col("p_size") % 3 + 1).alias("b"), F.col("p_retailprice").alias("t"))
    k, b, at = F.col("k"), F.col("b"), F.col("t")
    return x.select("p_partkey", F.round(P.prob_coal(at, k, 1000), 8).alias("coal"), F.round(P.prob_coal_counts(k, b, at, 1000), 6).alias("counts"), F.round(P.prob_birth_death1(k, at, 0.002, 0.001), 8).alias("birth_death"))


@query("""WITH x AS (SELECT p_partkey, p_size / 25.0::DOUBLE AS t FROM part), m AS (SELECT *, 1 - 1.5 * exp(-(2.5 - t) / 1.5) + 0.5 * exp(-(2.5 - t) * 2) AS rest, 1 - 1.5 * exp(-2.5 / 1.5) + 0.5 * exp(-5::DOUBLE) AS whole FROM x)
  SELECT p_partkey, round(1 - exp(-2 * t) * rest / whole, 8) AS bounded, round(1 - exp(-2 * t) * (exp(-(2.5 - t) / 1.5) - exp(-(2.5 - t) * 2)) / (exp(-2.5 / 1.5) - exp(-5::DOUBLE)), 8) AS counted,
  round(2 * 0.5 * exp(-2 * 0.5 * t) * (1 - 0.375 * exp(-0.5 * (2.5 - t))) / pow(1 - 0.375 * exp(-0.5 * 2.5), 2), 8) AS birth FROM m""")
def conditional_waits(spark, d):
    at, k = F.col("p_size") / F.lit(25.0), F.lit(3)
    out = {"bounded": P.cdf_bounded_coal(at, k, 1.5, F.lit(2.5)), "counted": P.cdf_coal_cond_counts(at, k, F.lit(2), F.lit(2.5), 1.5), "birth": P.birth_wait_time(at, F.lit(2), F.lit(2.5), 0.8, 0.3)}
    return t(spark, d, "part").select("p_partkey", *(F.round(c, 8).alias(n) for n, c in out.items()))


SYMBOLS = """WITH RECURSIVE k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
  s AS MATERIALIZED (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i_at, coalesce(2.0::DOUBLE * (n + 1 - i) / (n * (n + 1)), 1) AS x, coalesce(2.0::DOUBLE * i / (n * (n + 1)), 1) AS y FROM events LEFT JOIN k USING (event_type))"""


def user_model(spark, d) -> hmm.Model:
    """Two states over the kinds of events there are: one that favours the first kinds by name, one the last."""
    kinds = sorted(r[0] for r in t(spark, d, "events").select("event_type").where("event_type is not null").distinct().collect())  # a handful of kinds
    n = len(kinds)
    up = [2 * (i + 1) / (n * (n + 1)) for i in range(n)]
    return hmm.Model([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [dict(zip(kinds, reversed(up), strict=True)), dict(zip(kinds, up, strict=True))])


@query(SYMBOLS + """,
  v AS (SELECT user_id, i_at, ln(0.5::DOUBLE) + ln(x) AS a, ln(0.5::DOUBLE) + ln(y) AS b, 0 AS from_a, 0 AS from_b FROM s WHERE i_at = 1
    UNION ALL SELECT user_id, i_at, greatest(aa, ba) + ln(x), greatest(ab, bb) + ln(y), CASE WHEN aa >= ba THEN 0 ELSE 1 END, CASE WHEN ab >= bb THEN 0 ELSE 1 END
      FROM (SELECT s.user_id, s.i_at, x, y, a + ln(0.9::DOUBLE) AS aa, b + ln(0.2::DOUBLE) AS ba, a + ln(0.1::DOUBLE) AS ab, b + ln(0.8::DOUBLE) AS bb FROM v JOIN s ON s.user_id = v.user_id AND s.i_at = v.i_at + 1)),
  f AS (SELECT user_id, i_at, x / (x + y) AS a, y / (x + y) AS b FROM s WHERE i_at = 1
    UNION ALL SELECT user_id, i_at, u / (u + w), w / (u + w) FROM (SELECT s.user_id, s.i_at, (a * 0.9::DOUBLE + b * 0.2::DOUBLE) * x AS u, (a * 0.1::DOUBLE + b * 0.8::DOUBLE) * y AS w FROM f JOIN s ON s.user_id = f.user_id AND s.i_at = f.i_at + 1)),
  e AS (SELECT user_id, max(i_at) AS n FROM s GROUP BY 1),
  r AS (SELECT user_id, n AS i_at, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b FROM e
    UNION ALL SELECT user_id, i_at, u / (u + w), w / (u + w) FROM (SELECT s.user_id, s.i_at - 1 AS i_at, 0.9::DOUBLE * x * a + 0.1::DOUBLE * y * b AS u, 0.2::DOUBLE * x * a + 0.8::DOUBLE * y * b AS w FROM r JOIN s USING (user_id, i_at) WHERE s.i_at > 1)),
  z AS (SELECT user_id, i_at, CASE WHEN a >= b THEN 0 ELSE 1 END AS state FROM v JOIN e USING (user_id) WHERE i_at = n
    UNION ALL SELECT z.user_id, v.i_at - 1, CASE WHEN state = 0 THEN from_a ELSE from_b END FROM z JOIN v ON v.user_id = z.user_id AND v.i_at = z.i_at WHERE v.i_at > 1)
  SELECT user_id, event_id, state, round(CASE WHEN state = 0 THEN f.a * r.a ELSE f.b * r.b END / (f.a * r.a + f.b * r.b), 6) AS p FROM z JOIN s USING (user_id, i_at) JOIN f USING (user_id, i_at) JOIN r USING (user_id, i_at)""")
def hmm_decode(spark, d):
    return hmm.decode(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", user_model(spark, d)).select("user_id", "event_id", "state", F.round("p", 6).alias("p"))


@query(SYMBOLS + """,
  f AS (SELECT user_id, i_at, x / (x + y) AS a, y / (x + y) AS b, ln((x + y) / 2) AS l FROM s WHERE i_at = 1
    UNION ALL SELECT user_id, i_at, u / (u + v), v / (u + v), l + ln(u + v) FROM (SELECT s.user_id, s.i_at, l, (a * 0.9::DOUBLE + b * 0.2::DOUBLE) * x AS u, (a * 0.1::DOUBLE + b * 0.8::DOUBLE) * y AS v FROM f JOIN s ON s.user_id = f.user_id AND s.i_at = f.i_at + 1))
  SELECT user_id, round(arg_max(l, i_at), 6) AS lnl FROM f GROUP BY 1""")
def hmm_likelihood(spark, d):
    return hmm.likelihood(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", user_model(spark, d)).withColumn("lnl", F.round("lnl", 6))


@query(f"""WITH {ALN}, l AS (SELECT aln_id, name, i - 1 AS pos, substr(seq, i, 1) AS c FROM a, range(1, 25) r(i)), k AS (SELECT aln_id, pos, c, list_sort(list(name)) AS s FROM l GROUP BY 1, 2, 3),
  m AS (SELECT aln_id, pos, list_sort(list({{'n': len(s), 's': s}})) AS x FROM k GROUP BY 1, 2 HAVING count(*) = 2)
  SELECT aln_id, CAST(pos AS INTEGER) AS pos, array_to_string(x[1].s, ' ') AS side, array_to_string(x[2].s, ' ') AS other FROM m""")
def alignment_splits(spark, d):
    got = arg.alignment_splits(names(spark, d))
    return got.select("aln_id", "pos", *(F.array_join(F.transform(c, lambda n: n.cast("string")), " ").alias(c) for c in ("side", "other")))


@query("""WITH a AS (SELECT p_brand, p_size, rpad(min(p_name), 24, '-') AS seq FROM part GROUP BY 1, 2) SELECT CAST(n AS INTEGER) AS name, string_agg(coalesce(seq, repeat('N', 24)), '' ORDER BY b) AS seq
  FROM (SELECT DISTINCT p_size AS n FROM part) CROSS JOIN (SELECT DISTINCT p_brand AS b FROM part) LEFT JOIN a ON p_brand = b AND p_size = n GROUP BY 1""")
def concatenated(spark, d):
    aln = t(spark, d, "part").groupBy(F.col("p_brand").alias("aln_id"), F.col("p_size").alias("name")).agg(F.rpad(F.min("p_name"), 24, "-").alias("seq"))
    return align.concatenated(aln)
