"""Queries of genes and families: orders are genes on chromosomes (priorities), parts and suppliers two sides of hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, genes
from .driver import IV, query, spans, t, tree

ORDINALS = "g AS (SELECT o_orderpriority AS chrom, o_orderkey AS gene, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS pos, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS strand, o_custkey % 25 AS fam FROM orders)"


def placed(spark, d):
    strand = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("chrom"), F.col("o_orderkey").alias("gene"), "o_orderdate", strand.alias("strand"), (F.col("o_custkey") % 25).alias("fam"))
    return genes.ordinals(rows, ["chrom"], ["o_orderdate", "gene"]).drop("o_orderdate")


@query(f"WITH {ORDINALS} SELECT * FROM g")
def region_ordinals(spark, d):
    return placed(spark, d)


@query(f"""WITH {ORDINALS}, r AS (SELECT *, pos - row_number() OVER (PARTITION BY fam, chrom, strand ORDER BY pos) AS run FROM g)
  SELECT fam, chrom, strand, gene, min(pos) OVER (PARTITION BY fam, chrom, strand, run) AS streak FROM r""")
def gene_streaks(spark, d):
    return genes.streaks(placed(spark, d), ["fam"]).select("fam", "chrom", "strand", "gene", "streak")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN reverse(translate(substr(text, 11, 50), 'ACGTUNacgtun', 'TGCAANtgcaan')) ELSE substr(text, 11, 50) END AS part, substr(text, 21) AS rest FROM documents""")
def subsequences(spark, d):
    strand = F.when(F.col("doc_id") % 2 == 1, -1).otherwise(1)
    text, none = F.col("text"), F.lit(None).cast("int")
    return t(spark, d, "documents").select("doc_id", align.subsequence(text, F.lit(11), F.lit(60), strand).alias("part"), align.subsequence(text, F.lit(21), none, F.lit(1)).alias("rest"))


@query("""WITH h AS (SELECT l_partkey AS a, l_suppkey AS b, l_orderkey AS o, l_linenumber AS n, l_quantity AS q FROM lineitem),
  x AS (SELECT a AS name, b AS other, * FROM h UNION ALL SELECT b, a, * FROM h WHERE a <> b)
  SELECT name, other, a, b, o, n, q FROM (SELECT *, row_number() OVER (PARTITION BY name, other ORDER BY o DESC, n DESC, a DESC, b DESC, q DESC) AS r FROM x) WHERE r = 1""")
def hits_by_name(spark, d):
    hits = t(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    return genes.hits_by_name(hits, "a", "b", ["o", "n"])


CLOSE = "l_quantity >= 4 * l_linenumber AND least(l_quantity / 50, l_linenumber / 7.0::DOUBLE) >= 0.3 AND greatest(l_quantity / 50, l_linenumber / 7.0::DOUBLE) >= 0.5 AND l_tax <= 0.05"


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS g, '1 part ' || p_brand || p_type AS u FROM part), s AS (SELECT s_suppkey AS g, '2 part ' || s_nationkey AS u FROM supplier),
  m AS (SELECT p.u AS a, s.u AS b, avg(l_quantity) AS v FROM lineitem JOIN p ON p.g = l_partkey JOIN s ON s.g = l_suppkey WHERE {CLOSE} GROUP BY 1, 2),
  f AS (SELECT u, avg(l_quantity) AS v FROM (SELECT u, l_quantity FROM lineitem JOIN (SELECT * FROM p UNION ALL SELECT * FROM s) x ON x.g = l_partkey WHERE l_returnflag = 'R') GROUP BY 1),
  n AS (SELECT a, b, m.v FROM m LEFT JOIN f x ON x.u = a LEFT JOIN f y ON y.u = b WHERE m.v > greatest(coalesce(x.v, 0), coalesce(y.v, 0))),
  e AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY v DESC, b) AS r FROM (SELECT a, b, v FROM n UNION ALL SELECT b, a, v FROM n)) WHERE r = 1),
  l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(x, y) AS (SELECT u, u FROM (SELECT u FROM p UNION SELECT u FROM s) UNION SELECT c.x, l.b FROM c JOIN l ON c.y = l.a),
  k AS (SELECT x, min(y) AS family FROM c GROUP BY 1) SELECT 'p' || g AS gene, family FROM p JOIN k ON x = u UNION ALL SELECT 's' || g, family FROM s JOIN k ON x = u""")
def merged_families(spark, d):
    name = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    part = t(spark, d, "part").select(name("p", "p_partkey").alias("gene"), F.concat("p_brand", "p_type").alias("part"))
    supplier = t(spark, d, "supplier").select(name("s", "s_suppkey").alias("gene"), F.col("s_nationkey").alias("part"))
    li = t(spark, d, "lineitem")
    sized = li.select(name("p", "l_partkey").alias("gene1"), name("s", "l_suppkey").alias("gene2"), F.col("l_quantity").alias("score"), F.col("l_quantity").alias("bits"), F.col("l_linenumber").alias("sites"), F.col("l_quantity").alias("len1"), F.lit(50).alias("whole1"), F.col("l_linenumber").alias("len2"), F.lit(7).alias("whole2"), F.col("l_tax").alias("evalue"))
    far = li.where("l_returnflag = 'R'").select(F.explode(F.array(name("p", "l_partkey"), name("s", "l_partkey"))).alias("gene"), F.col("l_quantity").alias("score"))
    return genes.merge_families(genes.close_hits(sized, 4, 0.3, 0.5, 0.05), part, supplier, far)


@query(f"""WITH {IV}, m AS (SELECT *, CASE WHEN pr = '1-URGENT' THEN -1 ELSE 1 END AS strand FROM iv),
  l AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM m WINDOW w AS (PARTITION BY k, pr ORDER BY id * strand)),
  n AS (SELECT *, CASE WHEN ps IS NULL THEN 0 WHEN greatest(pe - s, 0) < 0.1::DOUBLE * (greatest(pe, e) - least(ps, s)) THEN 0 WHEN greatest(pe, e) = least(ps, s) THEN 0 ELSE 1 END AS new FROM l),
  g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY k, pr ORDER BY id * strand) AS BIGINT) AS piece_of FROM n)
  SELECT k, pr, id AS gene, piece_of FROM (SELECT *, count(*) OVER (PARTITION BY k, pr, piece_of) AS c FROM g) WHERE c > 1""")
def merge_candidates(spark, d):
    strand = F.when(F.col("pr") == "1-URGENT", -1).otherwise(1)
    members = spans(spark, d).select("k", "pr", F.col("id").alias("gene"), F.col("id").alias("start"), strand.alias("strand"), F.col("s").alias("first"), F.col("e").alias("last"))
    return genes.merge_candidates(members, ["k", "pr"]).select("k", "pr", "gene", "piece_of")


@query("""WITH p AS (SELECT p_brand, p_type || '-' || p_size AS name, p_name || '; ' || p_type AS x FROM part), d AS (SELECT p_brand, w, count(*) AS n FROM (SELECT p_brand, unnest(string_split(x, '; ')) AS w FROM p) WHERE w <> 'ECONOMY' GROUP BY 1, 2)
  SELECT p_brand, names, descriptions FROM (SELECT p_brand, array_to_string(list_sort(list(DISTINCT regexp_replace(name, '[0-9-]', '', 'g'))), ',') AS names FROM p GROUP BY 1)
  JOIN (SELECT p_brand, string_agg(w || '[' || n || ']', '; ' ORDER BY n DESC, w) AS descriptions FROM d GROUP BY 1) USING (p_brand)""")
def family_names(spark, d):
    rows = t(spark, d, "part").select("p_brand", F.concat_ws("-", "p_type", "p_size").alias("name"), F.concat_ws("; ", "p_name", "p_type").alias("x"))
    return genes.family_names(rows, "p_brand", "name", "x", ["ECONOMY"])


@query("""SELECT fam, species, count(*) FILTER (WHERE o_orderstatus = species) AS genes, count(*) FILTER (WHERE o_orderstatus = species AND o_totalprice > 200000) AS dup
  FROM (SELECT o_custkey AS fam, o_orderstatus, o_totalprice FROM orders), (VALUES ('F'), ('O'), ('P')) v(species) GROUP BY 1, 2""")
def wide_events(spark, d):
    one = lambda s: [F.count_if(F.col("o_orderstatus") == s).alias(f"{s}-genes"), F.count_if((F.col("o_orderstatus") == s) & (F.col("o_totalprice") > 200000)).alias(f"{s}-dup")]
    wide = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("fam")).agg(*one("F"), *one("O"), *one("P"))
    return genes.wide_events(wide, "fam", ["F", "O", "P"], ["genes", "dup"])


def trade(spark, d):
    """Nations and regions as a species tree, customers and suppliers as genes, what one sold the other as hits."""
    name = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    genes = c.select(name("c", "c_custkey").alias("gene"), name("n", "c_nationkey").alias("species")).union(s.select(name("s", "s_suppkey"), name("n", "s_nationkey")))
    li = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    hits = li.groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("score")).select(name("c", "o_custkey").alias("gene1"), name("s", "l_suppkey").alias("gene2"), "score")
    return tree(spark, d).where("substring(node, 1, 1) <> 's'"), genes, hits


@query(None)
def families_up_tree(spark, d):
    return genes.merge_up_tree(*trade(spark, d))
