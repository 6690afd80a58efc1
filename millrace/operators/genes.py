"""Genes on chromosomes, their hits, families and annotation: stores are tables, lookups are filters and joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import align, graph, intervals, tours
from .ordered import numbered


def ordinals(regions: DataFrame, by: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Adds each region's place, from 0, among those of its keys; sorted by ranges, so a long chromosome spreads over tasks."""
    every = numbered(regions, [*by, *order], "_place")
    first = every.groupBy(*by).agg(F.min("_place").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    got = every.join(first.withColumnsRenamed({c: f"_{c}" for c in by}), same)
    return got.withColumn(out, F.col("_place") - F.col("_first")).drop("_place", "_first", *(f"_{c}" for c in by))


def hits_by_name(hits: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """(name, other, and the columns of hits): every hit under both its names; of a pair's hits the last by the order stays."""
    turned = F.when(F.col(a) == F.col(b), F.array(F.struct(F.col(a).alias("name"), F.col(b).alias("other"))))
    turned = turned.otherwise(F.array(F.struct(F.col(a).alias("name"), F.col(b).alias("other")), F.struct(F.col(b).alias("name"), F.col(a).alias("other"))))
    both = hits.withColumn("_names", F.explode(turned)).select("_names.*", *hits.columns)
    last = both.groupBy("name", "other").agg(F.max(F.struct(*order, F.struct(*hits.columns).alias("_row"))).alias("_m"))
    return last.select("name", "other", "_m._row.*")


def close_hits(hits: DataFrame, bits_per_site: float, small: float, big: float, evalue: float) -> DataFrame:
    """Hits (bits, sites, len1, len2, whole1, whole2, evalue) that are dense, cover enough of the shorter and the longer side's gene, and aren't by chance."""
    one, two = F.col("len1") / F.col("whole1"), F.col("len2") / F.col("whole2")
    dense = F.col("bits") >= bits_per_site * F.col("sites")
    return hits.where(dense & (F.least(one, two) >= small) & (F.greatest(one, two) >= big) & (F.col("evalue") <= evalue))


def merge_families(hits: DataFrame, parts1: DataFrame, parts2: DataFrame, outside: DataFrame) -> DataFrame:
    """(gene, family): two sides' families (gene, part), joined where they are nearer to each other than to outgroups.

    hits are (gene1, gene2, score) between the sides, outside is (gene, score) of
    hits with outgroups. A family's partner is the one of the largest mean score
    of those whose mean is above both families' means outside (0 without any);
    ties go to the first by name. Genes without a family are one of their own.
    A family is named by the side and name of its first member family.
    """
    sides = []
    for n, (parts, gene) in enumerate(((parts1, "gene1"), (parts2, "gene2")), 1):
        own = parts.select("gene", F.concat(F.lit(f"{n} part "), F.col("part").cast("string")).alias("node"))
        lone = hits.select(F.col(gene).alias("gene")).distinct().join(own, "gene", "left_anti")
        sides.append(own.union(lone.select("gene", F.concat(F.lit(f"{n} gene "), F.col("gene").cast("string")).alias("node"))))
    one, two = sides
    met = hits.join(one.select(F.col("gene").alias("gene1"), F.col("node").alias("a")), "gene1").join(two.select(F.col("gene").alias("gene2"), F.col("node").alias("b")), "gene2")
    means = met.groupBy("a", "b").agg(F.avg("score").alias("mean"))
    known = one.union(two)
    far = outside.join(known, "gene").groupBy("node").agg(F.avg("score").alias("far"))
    for side in ("a", "b"):
        means = means.join(far.select(F.col("node").alias(side), F.col("far").alias(f"far_{side}")), side, "left")
    bound = F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in ("far_a", "far_b")))
    near = means.where(F.col("mean") > bound)
    each = near.select("a", "b", "mean").union(near.select("b", "a", "mean"))
    top = each.groupBy("a").agg(F.min(F.struct((-F.col("mean")).alias("_m"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    joined = graph.components(top).withColumnsRenamed({"item": "node"})
    return known.join(joined, "node", "left").select("gene", F.coalesce("component", "node").alias("family"))


def streaks(genes: DataFrame, by: list[str]) -> DataFrame:
    """Adds `streak`: the place of the first of the genes (chrom, pos, strand) of a group that follow each other on one strand without another gene between."""
    w = Window.partitionBy(*by, "chrom", "strand").orderBy("pos")
    new = F.when(F.col("pos") - 1 == F.lag("pos").over(w), F.lit(None)).otherwise(F.col("pos"))
    return genes.withColumn("_new", new).withColumn("streak", F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def extent(seq: Column) -> Column:
    """(first, last) place of a letter in a gapped sequence, from 0; nulls where it has none."""
    at = align.local_to_align(seq)
    return F.struct(F.try_element_at(at, F.lit(1)).alias("first"), F.try_element_at(at, F.lit(-1)).alias("last"))


def merge_candidates(members: DataFrame, by: list[str], cutoff: float = 0.1) -> DataFrame:
    """Rows of members (gene, start, strand, first, last) that may be pieces of one gene, with `piece_of`, the number of the group in its streak.

    In the strand's order a gene goes with the one before it if the end of the
    former reaches over the beginning of the latter by less than `cutoff` of what
    both span in the alignment (a span of 0 counts as no overlap). Groups of one
    gene, and genes of gaps alone, are left out.
    """
    w = Window.partitionBy(*by).orderBy(F.col("start") * F.col("strand"), "gene")
    first, last = F.lag("first").over(w), F.lag("last").over(w)
    over = F.greatest(last - F.col("first"), F.lit(0))
    span = F.greatest(last, "last") - F.least(first, "first")
    whole = members.where("first is not null")
    marked = whole.withColumn("_new", F.when(over < cutoff * span, 0).when((span == 0) & (over == 0), 0).otherwise(1))
    groups = marked.withColumn("piece_of", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
    return groups.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "piece_of"))).where("_n > 1").drop("_n")


def merge_up_tree(species: DataFrame, genes: DataFrame, hits: DataFrame) -> DataFrame:
    """(gene, family) of all genes, merged from the leaves of a species tree to its root.

    species is (node, parent), genes is (gene, species), hits are (gene1, gene2, score). A
    gene begins as a family of its own at its species. All nodes of one height are worked out in
    one round: families of different children of a node are joined by the rule of
    merge_families(), what is outside being the genes that aren't below the node; families that
    are joined in one round may be many, as they are components of partners. A family is
    named by its first gene. Hits of a gene with itself, with unknown genes or without a score don't
    count, nor do genes without a species of the tree; repeated hits count each.
    """
    order = graph.cut(tours.tour(species).select("node", "parent", "pre", "size"))
    up = graph.closure(order.select("node", "parent"))
    height = up.groupBy(F.col("ancestor").alias("node")).agg(F.max("depth").alias("height"))
    nodes = graph.cut(order.join(height, "node"))
    above = nodes.select(F.col("node").alias("up"), F.col("height").alias("up_height"), F.col("pre").alias("low"), (F.col("pre") + F.col("size")).alias("high"))
    kids = nodes.select(F.col("node").alias("top"), F.col("parent").alias("up")).join(above, "up")
    state = graph.cut(genes.join(nodes.select(F.col("node").alias("species"), "pre"), "species").select("gene", F.col("gene").alias("family"), F.col("species").alias("top"), "pre").distinct())
    one = hits.where("gene1 <> gene2 and score is not null").select(F.col("gene1").alias("gene"), F.col("gene2").alias("other"), F.col("score").cast("double").alias("score"))
    both = graph.cut(one.union(one.select(F.col("other").alias("gene"), F.col("gene").alias("other"), "score")))
    for h in range(1, (nodes.agg(F.max("height")).first()[0] or 0) + 1):
        now = state.join(kids.where(F.col("up_height") == h), "top")
        far = both.join(now, "gene").join(state.select(F.col("gene").alias("other"), F.col("family").alias("of"), F.col("top").alias("side"), F.col("pre").alias("at")), "other")
        inside = (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
        # both kinds of means in one pass over the hits; sums of a pair of families are made before they are shuffled
        means = graph.cut(far.where(~inside | ~F.col("side").isin(F.col("top"), F.col("up"))).groupBy("family", F.when(inside, F.col("of")).alias("of")).agg(F.avg("score").alias("mean")))
        beyond = means.where("of is null").select("family", F.col("mean").alias("out"))
        near = means.where("of is not null")
        for c in ("family", "of"):
            near = near.join(beyond.withColumnsRenamed({"family": c, "out": f"out_{c}"}), c, "left")
        near = near.where(F.col("mean") > F.greatest(F.coalesce("out_family", F.lit(0.0)), F.coalesce("out_of", F.lit(0.0))))
        partner = near.groupBy("family").agg(F.min_by("of", F.struct(-F.col("mean"), F.col("of"))).alias("of"))
        joined = graph.components(partner, "family", "of").select(F.col("item").alias("family"), F.col("component").alias("first"))
        moved = now.select("gene", "family", F.col("up").alias("top"), "pre").join(joined, "family", "left").select("gene", F.coalesce("first", "family").alias("family"), "top", "pre")
        state = graph.cut(moved.unionByName(state.join(now.select("gene"), "gene", "left_anti").select("gene", "family", "top", "pre")))
    return state.select("gene", "family")


def window_alignments(blocks: DataFrame, seqs: DataFrame, windows: DataFrame, collapse: bool = False) -> DataFrame:
    """(window, name, seq): for each window (window, key columns species and chrom, s, e) the overlapping blocks' alignments, cut to it and joined.

    blocks are (block, species, chrom, s, e), closed intervals in the letters of the
    block's first sequence; seqs are (block, ord, name, seq), ord 0 the first. With
    collapse, columns in which the first sequence has a gap go. A name that a block
    lacks, or has empty, gets gaps there. Blocks are joined by s, then by name.
    """
    met = intervals.overlap_join(windows, blocks.withColumnsRenamed({"s": "s2", "e": "e2"}), ["species", "chrom"])
    main = seqs.where("ord = 0").select("block", F.col("seq").alias("_main"))
    cut = met.join(main, "block").withColumn("_at", align.local_to_align(F.col("_main")))
    size = F.size("_at")
    begin = F.when(F.col("s") > F.col("s2"), F.get("_at", (F.col("s") - F.col("s2")).cast("int"))).otherwise(0)
    end = F.when(F.col("e") < F.col("e2"), F.get("_at", size - (F.col("e2") - F.col("e")).cast("int"))).otherwise(F.length("_main"))
    cut = cut.withColumns({"_from": begin, "_to": end}).withColumn("_kept", F.filter("_at", lambda i: (i >= F.col("_from")) & (i < F.col("_to"))))
    cut = cut.withColumn("_len", F.size("_kept") if collapse else F.col("_to") - F.col("_from")).where("_from is not null and _to is not null")
    picked = F.array_join(F.transform("_kept", lambda i: F.substring(F.col("seq"), i + 1, F.lit(1))), "") if collapse else F.substring(F.col("seq"), F.col("_from") + 1, F.col("_len"))
    pieces = cut.select("window", "block", "_from", "_to", "_kept", "_len").join(seqs, "block").where("seq <> ''").select("window", "block", "name", picked.alias("piece"))
    named = seqs.join(cut.select("window", "block"), "block").select("window", "name").distinct()
    order = cut.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("s2", "block", "_len"))).alias("_blocks"))
    have = pieces.groupBy("window", "name").agg(F.map_from_entries(F.collect_list(F.struct("block", "piece"))).alias("_have"))
    text = F.array_join(F.transform("_blocks", lambda b: F.coalesce(F.try_element_at(F.col("_have"), b["block"]), F.repeat(F.lit("-"), b["_len"]))), "")
    return named.join(have, ["window", "name"], "left").join(order, "window").select("window", "name", text.alias("seq"))


def wide_events(df: DataFrame, family: str, species: Iterable[str], fields: Iterable[str] = ("genes", "dup", "loss", "appear")) -> DataFrame:
    """(family, species, fields): rows of a table whose columns are named species-field."""
    fields = list(fields)
    each = [F.struct(F.lit(s).alias("species"), *(F.col(f"`{s}-{f}`").alias(f) for f in fields)) for s in species]
    return df.select(family, F.explode(F.array(*each)).alias("_x")).select(family, "_x.*")


def family_names(genes: DataFrame, family: str, name: str, description: str, skip: Iterable[str] = ()) -> DataFrame:
    """(family, names, descriptions): names without digits and dashes, distinct and sorted; parts of descriptions with their counts.

    Descriptions are parted at "; "; the most frequent comes first, then by text. Empty
    ones and those of `skip` don't count. Counted before a family's few distinct texts meet.
    """
    bare = F.regexp_replace(name, "[0-9-]", "")
    every = genes.select(family).distinct()
    names = genes.where(F.col(name) != "").groupBy(family).agg(F.array_join(F.array_sort(F.collect_set(bare)), ",").alias("names"))
    parts = genes.select(family, F.explode(F.split(description, "; ")).alias("_d")).where((F.col("_d") != "") & ~F.col("_d").isin(list(skip)))
    counts = parts.groupBy(family, "_d").agg(F.count("*").alias("_n"))
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), F.col("_d").alias("d"))))
    texts = counts.groupBy(family).agg(F.array_join(F.transform(sorted_, lambda x: F.concat(x["d"], F.lit("["), (-x["m"]).cast("string"), F.lit("]"))), "; ").alias("descriptions"))
    return every.join(names, family, "left").join(texts, family, "left").select(family, F.coalesce("names", F.lit("")).alias("names"), F.coalesce("descriptions", F.lit("")).alias("descriptions"))
