"""Line dedup by site-relative frequency.

A page's lines are its text between block-level tags, trimmed. For every host
the pages that contain a line are counted and divided by the host's pages; a
line on at least ``min_pages`` pages of its host and above ``ratio`` of them is
boilerplate, and every copy of it is dropped from the host's pages.

``min_pages`` is there for small hosts: on a host of fewer than 1 / ratio pages
any line of any page is above the ratio, and all text would go; a line has to
recur before it counts as the site's.

The html is parsed once. Only hashes are counted and shuffled (128 bits a
line), map-side first; a line of a very common host and text meets its verdict
by broadcast, others by a shuffle; verdicts return to a page, by its row number,
as line positions. A line counts once a page; a page given twice counts twice. All
of it is DataFrame functions.

Defined cases: null html has no lines; a url without a host, or a null one, has
the host ""; empty lines aren't lines; a script, style or comment that isn't closed
ends with the page; "<" within a tag starts another one. Work is in
proportion to a page's length and number of lines, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_split, shared_dir, table, written

RATIO, MIN_PAGES = 0.1, 3
#: What ends a line of text in a page; other tags go away within the line.
HIDDEN = r"(?is)<(script|style)\b.*?(</(script|style)>|\z)|<!--.*?(-->|\z)"
BREAKS = r"(?i)</?(p|br|div|h[1-6]|li|ul|ol|nav|article|section|footer|header|table|tr|td|title|head|body|html)\b[^<>]*>"
TAGS = r"<[^<>]*>"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#:]*)", 1))


def lines(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def without(items: Column, drop: Column) -> Column:
    """An array without the elements at the sorted positions `drop` (from 0): the stretches between them, joined."""
    edge = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(items)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), lambda k: F.slice(items, F.get(edge, k) + 2, F.get(edge, k + 1) - F.get(edge, k) - 1)))


def drop_boilerplate(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all at default) with n_lines, n_dropped and kept_text; those names give way."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("n_lines", "n_dropped", "kept_text")]
    src = pages.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(keep)), host(F.col(url_col)).alias("host"), lines(F.col(html_col)).alias("lines"))
    path = shared_dir(pages.sparkSession)
    src = written(src.withColumn("row", F.monotonically_increasing_id()), path, "parsed")
    total = src.groupBy("host").agg(F.count("*").alias("pages"))
    hashes = F.transform("lines", lambda x: F.unhex(F.md5(x)))
    each = written(src.select("row", "host", F.posexplode(hashes).alias("at", "line")), path, "lines")
    seen = src.select("host", F.explode(F.array_distinct(hashes)).alias("line")).groupBy("host", "line").agg(F.count("*").alias("with")).where(F.col("with") >= min_pages)
    bad = written(seen.join(total, "host").where(F.col("with") > F.col("pages") * ratio).select("host", "line", "with"), path, "bad")
    verdict = join_split(each, bad, ["host", "line"], "with", each.count()).groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("drop"))
    out = src.join(verdict, "row", "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(without(F.col("lines"), F.col("drop")))
    n = F.size("lines").cast("long")
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(keep)), n.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))


def op9_lines(spark, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "pages"), keep=["page_id"])
    return out.select("page_id", "n_lines", "n_dropped", F.md5("kept_text").alias("kept_md5"))


_LINES = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'), chr(10)), lambda x: trim(x, concat(' ', chr(9), chr(13)))), lambda x: x <> '')"""

OP9_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#:]*)', 1)) AS host, {_LINES} AS lines FROM pages
), t AS (SELECT host, count(*) AS pages FROM p GROUP BY host
), e AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p
), s AS (SELECT host, line, count(DISTINCT r) AS n FROM e GROUP BY host, line
), b AS (SELECT s.host, line FROM s JOIN t ON s.host = t.host WHERE n >= {MIN_PAGES} AND n > pages * {RATIO}
), k AS (
  SELECT e.r, string_agg(e.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL) AS kept, count(b.line) AS n_dropped
  FROM e LEFT JOIN b ON e.host = b.host AND e.line = b.line GROUP BY e.r
)
SELECT page_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, md5(coalesce(kept, '')) AS kept_md5
FROM p LEFT JOIN k ON p.r = k.r
"""
