"""The operators as commands: python -m millrace.plans.commands NAME [options] FILES.

Every command reads files into DataFrames, applies one operator and prints
lines as they come, so that a result needn't fit in the driver. Trees are
newick files (a tree's id is its file and number), genes are dealt to
species by a file of `pattern species` lines (-S), the species tree is a newick
file (-s).
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import samplers
from ..operators import align, graph, intervals, rearrange, relational, synteny, trees
from ..sources import formats, text

COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(name: str, *options: tuple):
    def add(f):
        def arguments(p: argparse.ArgumentParser) -> None:
            p.add_argument("files", nargs="+")
            for flags, kw in options:
                p.add_argument(*flags.split(), **kw)

        COMMANDS[name] = (arguments, f)
        return f

    return add


def opt(flags: str, **kw) -> tuple:
    return flags, kw


SPECIES = opt("-s --stree", required=True), opt("-S --smap", required=True)
DELIM = opt("-d --delim", default="\t")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _lines(spark: SparkSession, a) -> DataFrame:
    return _all([spark.read.text(f) for f in a.files]).where("value <> ''")


def _trees(spark: SparkSession, files: list[str]) -> DataFrame:
    return _all([formats.read_trees(spark, f) for f in files])


def _cells(a) -> Column:
    return F.split("value", a.delim)


def _tab(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)).alias("line")


def _species(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gene trees, species tree and the species of the gene leaves."""
    nodes = _trees(spark, a.files)
    species = formats.read_trees(spark, a.stree).select("node", "parent", "dist")
    rules = formats.read_pairs(spark, a.smap).select(F.monotonically_increasing_id().alias("ord"), F.col("k").alias("pattern"), F.col("v").alias("species"))
    tips = formats.species_of(trees.leaves(nodes).select("tree_id", "node"), rules, "node")
    return nodes, species, tips


def _recon(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, species, tips = _species(spark, a)
    return nodes, species, graph.cut(trees.reconcile(nodes, species, tips))


@command("hist", DELIM)
def hist(spark, a):
    """Lines by their number and percentage, the commonest first."""
    return relational.histtab(_lines(spark, a), ["value"]).sort(F.desc("count"), "value").select(_tab("value", "count", F.round(F.col("percent") * 100, 6)))


@command("connected-comp", DELIM)
def connected_comp(spark, a):
    """A component a line: items that stand in one line belong together."""
    rows = _lines(spark, a).select(_cells(a).alias("c"))
    edges = rows.select(F.get("c", F.lit(0)).alias("a"), F.explode("c").alias("b"))
    return graph.components(edges).groupBy("component").agg(F.sort_array(F.collect_list("item")).alias("items")).select(F.array_join("items", a.delim).alias("line"))


@command("union-regions", DELIM, opt("-c --columns", default="0,1,2", help="columns of chromosome, start and end"))
def union_regions(spark, a):
    """The number of its union (from 1) before every line; lines come by chromosome and start."""
    k, s, e = (int(x) for x in a.columns.split(","))
    rows = _lines(spark, a).select("value", F.get(_cells(a), F.lit(k)).alias("k"), F.get(_cells(a), F.lit(s)).cast("double").alias("s"), F.get(_cells(a), F.lit(e)).cast("double").alias("e"))
    ids = intervals.union_ids(rows, ["k"], "value")
    per = ids.groupBy("k").agg((F.max("u") + 1).alias("n"))  # a row for each chromosome
    before = per.select("k", F.coalesce(F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return ids.join(before, "k").sort("k", "s", "value").select(_tab(F.col("first") + F.col("u") + 1, "value"))


def _scored(spark, a) -> DataFrame:
    i, j, k = (int(x) for x in a.columns.split(","))
    c = _cells(a)
    return _lines(spark, a).select(F.get(c, F.lit(i)).alias("a"), F.get(c, F.lit(j)).alias("b"), F.get(c, F.lit(k)).cast("double").alias("score"), "value")


HIT = opt("-c --columns", default="0,1,11", help="columns of query, subject and score")


@command("blastbest", DELIM, HIT)
def blastbest(spark, a):
    """The line of the best score above 0 of every query."""
    return relational.best_hits(_scored(spark, a).where("score > 0"), ["a"], "score", ["b", "value"]).select(F.col("value").alias("line"))


@command("bestbidir", DELIM, HIT)
def bestbidir(spark, a):
    """The lines of pairs that are each other's best."""
    hits = _scored(spark, a)
    return hits.join(relational.best_bidirectional(hits, "a", "b", "score"), ["a", "b", "score"]).select(F.col("value").alias("line"))


@command("pfam2tab")
def pfam2tab(spark, a):
    df = _all([formats.read_domains(spark, f) for f in a.files])
    return df.select(_tab(*df.columns))


@command("matrix-convert", opt("-l --labels", help="folder for the files of row and column names", default=None), opt("-q --square", action="store_true", help="one numbering for rows and columns"))
def matrix_convert(spark, a):
    """Labelled triples as a sparse matrix of numbered rows, after a line of its sizes."""
    cells = _all([text.read_matrix(spark, f, labelled=True) for f in a.files])
    one = (F.col("rlabel"), F.col("clabel"))
    sides = [cells.select(F.explode(F.array(*one)).alias("x"))] * 2 if a.square else [cells.select(c.alias("x")) for c in one]
    from ..operators.ordered import numbered

    rows, cols = (graph.cut(numbered(s.distinct(), ["x"], "n")) for s in sides)
    if a.labels:
        for name, side in (("rows", rows), ("columns", cols)):
            side.sort("n").select(F.col("x").alias("value")).write.mode("overwrite").text(f"{a.labels}/{name}")
    out = cells.join(rows.select(F.col("x").alias("rlabel"), F.col("n").alias("i")), "rlabel").join(cols.select(F.col("x").alias("clabel"), F.col("n").alias("j")), "clabel")
    out = out.select(F.col("i").cast("long"), F.col("j").cast("long"), "v")
    lines = formats.row_pair_lines(out, rows.count(), cols.count())
    return lines.sort("ord").select("line")


@command("fasta-convert", opt("-t --to", choices=["fasta", "phylip", "nexus", "tab"], default="fasta"))
def fasta_convert(spark, a):
    seqs = _all([text.read_fasta(spark, f) for f in a.files])
    if a.to == "fasta":
        return seqs.select(text.fasta_lines(F.col("key"), F.col("seq")).alias("line"))
    if a.to == "tab":
        return seqs.select(_tab("key", "seq"))
    out = (formats.phylip_lines if a.to == "phylip" else formats.nexus_text)(seqs.select(F.lit("0").alias("aln_id"), F.col("key").alias("name"), "seq"))
    return (out.sort("ord") if "ord" in out.columns else out).select(F.col(out.columns[-1]).alias("line"))


@command("partfasta", opt("-f --families", required=True, help="lines of family and genes"), opt("-o --out", required=True))
def partfasta(spark, a):
    """Writes every family's sequences below OUT/famid=...; prints families and their numbers of sequences."""
    c = F.split("value", "\\s+")
    member = spark.read.text(a.families).where("trim(value) <> ''").select(c[0].alias("famid"), F.explode(F.slice(c, F.lit(2), F.greatest(F.lit(0), F.size(c) - 1))).alias("key"))
    seqs = _all([text.read_fasta(spark, f) for f in a.files]).join(member, "key")
    seqs.select("famid", text.fasta_lines(F.col("key"), F.col("seq")).alias("value")).write.mode("overwrite").partitionBy("famid").text(a.out)
    return seqs.groupBy("famid").agg(F.count("*").alias("n")).sort("famid").select(_tab("famid", "n"))


def _alignments(spark, a) -> DataFrame:
    return _all([text.read_fasta(spark, f).select(F.lit(f"{i:06d}").alias("aln_id"), F.col("key").alias("name"), "seq") for i, f in enumerate(a.files)])


def _fasta(aln: DataFrame) -> DataFrame:
    return aln.select(text.fasta_lines(F.col("name"), F.col("seq")).alias("line"))


@command("align-filter", opt("-r --ratio", type=float, default=0.5))
def align_filter(spark, a):
    return _fasta(align.require(_alignments(spark, a), ratio=a.ratio))


@command("catalign", opt("-u --ungap", action="store_true"))
def catalign(spark, a):
    """All alignments side by side, N for what is missing."""
    out = align.concatenated(_alignments(spark, a)).withColumn("aln_id", F.lit("0"))
    return _fasta(align.without_gaps(out) if a.ungap else out)


@command("samplealign", opt("--seed", type=int, default=0))
def samplealign(spark, a):
    return _fasta(align.sampled_columns(_alignments(spark, a), a.seed))


@command("revtrans", opt("-d --dna", required=True))
def revtrans(spark, a):
    """The codons of DNA in the places of amino acid alignments."""
    dna = text.read_fasta(spark, a.dna).select(F.col("key").alias("name"), F.col("seq").alias("dna"))
    return _fasta(_alignments(spark, a).join(dna, "name").withColumn("seq", align.back_translate(F.col("seq"), F.col("dna"))))


@command("tree-rf")
def tree_rf(spark, a):
    """The distance of each pair of trees of the same number in the first two files."""
    one, two = (formats.read_trees(spark, f).withColumn("tree_id", F.substring_index("tree_id", "#", -1)) for f in a.files[:2])
    out = trees.robinson_foulds(one, two)
    return out.select(_tab(*out.columns))


@command("tree-eq")
def tree_eq(spark, a):
    """Whether trees of the same number in the first two files have one topology."""
    one, two = (trees.each_string(formats.read_trees(spark, f), trees.topology, f"t{i}").withColumn("tree_id", F.substring_index("tree_id", "#", -1)) for i, f in enumerate(a.files[:2]))
    return one.join(two, "tree_id", "full").select(_tab("tree_id", F.coalesce(F.col("t0") == F.col("t1"), F.lit(False))))


def _newick(nodes: DataFrame, lengths: bool = True) -> DataFrame:
    return trees.each_string(nodes, lambda t: trees.newick(t, lengths), "line").sort("tree_id").select("line")


@command("tree-convert", opt("-t --to", choices=["newick", "table"], default="newick"), opt("--from-table", action="store_true"))
def tree_convert(spark, a):
    """Newick trees as lines of node, parent and distance, or back."""
    nodes = _all([text.read_parents(spark, f).withColumn("tree_id", F.lit(f)) for f in a.files]) if a.from_table else _trees(spark, a.files)
    return _newick(nodes) if a.to == "newick" else text.parent_lines(nodes).select(F.col("value").alias("line"))


@command("tree-hashorder")
def tree_hashorder(spark, a):
    """Trees with the children of every node in the order of their topology strings."""
    return trees.each_string(_trees(spark, a.files), lambda t: trees.newick(trees.in_topology_order(t)), "line").sort("tree_id").select("line")


@command("tree-unroot")
def tree_unroot(spark, a):
    return _newick(trees.each_tree(_trees(spark, a.files), trees.unrooted))


@command("treeboot", opt("-b --trees", required=True, help="newick file of the replicates"))
def treeboot(spark, a):
    """The splits of the trees with the share of the replicates that have them."""
    out = trees.split_support(_trees(spark, a.files), formats.read_trees(spark, a.trees))
    return out.select(_tab(*(F.to_json(c) if t.startswith(("array", "struct")) else F.col(c) for c, t in out.dtypes)))


@command("treecons", opt("-x --strict-majority", action="store_true"))
def treecons(spark, a):
    """The consensus of all trees, with the share of trees as branch lengths. Distinct splits and leaves are the driver's."""
    nodes = graph.cut(_trees(spark, a.files))
    counted = trees.splits(nodes).groupBy("side").agg(F.count("*").alias("n")).limit(100_001).collect()
    leaves = [r[0] for r in trees.leaves(nodes).select("node").distinct().limit(100_001).collect()]
    if max(len(counted), len(leaves)) > 100_000:
        raise ValueError("more than 100,000 splits or leaves")
    n = nodes.select("tree_id").distinct().count()
    t = trees.consensus(leaves, [(tuple(r["side"]), r["n"]) for r in counted], n, extended=not a.strict_majority)
    return spark.createDataFrame([(trees.newick(t),)], "line string")


@command("mpr", *SPECIES)
def mpr(spark, a):
    """Reconciliations: tree, node, species node and event."""
    return _recon(spark, a)[2].select(_tab("tree_id", "node", "snode", "event"))


COMMANDS["recon"] = COMMANDS["mpr"]


@command("reconroot", *SPECIES, opt("-m --midpoint", action="store_true"))
def reconroot(spark, a):
    """Trees rooted to the fewest duplications and losses, or at the middle of their longest way."""
    nodes, species, tips = _species(spark, a)
    return _newick(trees.each_tree(nodes, trees.midpoint) if a.midpoint else rearrange.rooted_forest(nodes, species, tips))


@command("tree-events", *SPECIES, opt("-f --by-family", action="store_true"))
def tree_events(spark, a):
    """Genes, duplications and losses of every species node, over all trees or for each."""
    nodes, species, recon = _recon(spark, a)
    if not a.by_family:
        return trees.event_counts(nodes, species, recon).sort("snode").select(_tab("snode", "genes", "dups", "lost"))
    per = recon.groupBy("tree_id", "snode").agg(F.count_if(F.col("event") == "gene").alias("genes"), F.count_if(F.col("event") == "dup").alias("dups"))
    gone = trees.losses(nodes, species, recon).groupBy("tree_id", F.col("lost").alias("snode")).agg(F.count("*").alias("lost"))
    out = per.join(gone, ["tree_id", "snode"], "full").na.fill(0, ["genes", "dups", "lost"])
    return out.sort("tree_id", "snode").select(_tab("tree_id", "snode", "genes", "dups", "lost"))


@command("dupconsistency", *SPECIES)
def dupconsistency(spark, a):
    nodes, _, recon = _recon(spark, a)
    return rearrange.duplication_consistency(nodes, recon).select(_tab("tree_id", "node", "consistency"))


def _kin(spark, a, event: str) -> DataFrame:
    """Pairs of leaves with the one of the smaller species name first."""
    nodes, _, recon = _recon(spark, a)
    at = recon.where("event = 'gene'").select("tree_id", "node", "snode")
    rows = trees.relations(nodes, recon, event)
    for k in ("a", "b"):
        rows = rows.join(at.select("tree_id", F.col("node").alias(k), F.col("snode").alias(f"s_{k}")), ["tree_id", k])
    turn = F.col("s_a") > F.col("s_b")
    return rows.select("tree_id", *(F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("n_a", "n_b"), ("n_b", "n_a"))))


@command("tree-orth", *SPECIES)
def tree_orth(spark, a):
    return _kin(spark, a, "spec").select(_tab("a", "b", "n_a", "n_b"))


@command("tree-paralog", *SPECIES)
def tree_paralog(spark, a):
    return _kin(spark, a, "dup").select(_tab("a", "b"))


@command("tree-relations", *SPECIES)
def tree_relations(spark, a):
    """Lines of the genes, duplications, speciations and losses of every tree: kind, tree, then nodes or leaves and the species node.

    A duplication or speciation has the leaves of its sides, joined by commas.
    """
    nodes, species, recon = _recon(spark, a)
    genes = recon.where("event = 'gene'").select(_tab(F.lit("gene"), "tree_id", "node", "snode"))
    tips = recon.where("event = 'gene'").select("tree_id", "node")
    below = trees.paths(nodes).join(tips, trees.ID).groupBy("tree_id", F.col("ancestor").alias("side")).agg(F.array_join(F.sort_array(F.collect_list("node")), ",").alias("leaves"))
    sides = nodes.where("parent is not null").select("tree_id", F.col("node").alias("side"), F.col("parent").alias("node")).join(below, ["tree_id", "side"]).groupBy("tree_id", "node").agg(F.array_join(F.sort_array(F.collect_list("leaves")), "\t").alias("sides"))
    inner = recon.where("event <> 'gene'").join(sides, trees.ID).select(_tab("event", "tree_id", "sides", "snode"))
    lost = trees.losses(nodes, species, recon).select(_tab(F.lit("loss"), "tree_id", "node", "lost"))
    return genes.union(inner).union(lost)


@command("stree2gtrees", opt("-p --parts", required=True, help="lines of family and genes"), opt("-S --smap", required=True))
def stree2gtrees(spark, a):
    """The species tree with genes for its leaves, for every family of one gene a species; other families are left out."""
    c = F.split("value", "\\s+")
    member = spark.read.text(a.parts).where("trim(value) <> ''").select(c[0].alias("tree_id"), F.explode(F.slice(c, F.lit(2), F.greatest(F.lit(0), F.size(c) - 1))).alias("gene"))
    rules = formats.read_pairs(spark, a.smap).select(F.monotonically_increasing_id().alias("ord"), F.col("k").alias("pattern"), F.col("v").alias("species"))
    member = formats.species_of(member, rules, "gene")
    species = _trees(spark, a.files).select("node", "parent", "dist")
    rows = trees.small_tree(species)
    single = member.groupBy("tree_id").agg(F.count("*").alias("n"), F.countDistinct("species").alias("k")).where("n = k").select("tree_id")

    def run(pdf):
        import pandas as pd

        gene = dict(zip(pdf["species"], pdf["gene"], strict=True))
        t = trees.keep_leaves(trees.Tree(rows), set(gene))
        got = [(pdf["tree_id"].iloc[0], gene.get(n, n), gene.get(p, p), d) for n, p, d in (t.rows() if t else [])]
        return pd.DataFrame(got, columns=["tree_id", "node", "parent", "dist"])

    return _newick(member.join(single, "tree_id", "left_semi").groupBy("tree_id").applyInPandas(run, "tree_id string, node string, parent string, dist double"))


@command("sim-tree", opt("-n", type=int, default=1, help="gene trees"), opt("-b --birth", type=float, default=0.1), opt("-e --death", type=float, default=0.1), opt("--seed", type=int, default=0))
def sim_tree(spark, a):
    """Gene trees grown in a species tree by births and deaths."""
    species = _trees(spark, a.files[:1]).select("node", "parent", "dist")
    rows = spark.range(a.n).select(F.col("id").cast("string").alias("tree_id"), (F.col("id") + a.seed * 1_000_003).alias("seed"))
    return _newick(samplers.sample_gene_trees(rows, species, a.birth, a.death, "seed").select("tree_id", "node", "parent", "dist"))


@command("find-synteny-orth", opt("-r --radius", type=int, default=100_000), opt("-t --task", choices=["neighbours", "clusters", "best"], default="clusters"))
def find_synteny(spark, a):
    """Of tab tables of hits (id, chrom1, s1, e1, chrom2, s2, e2, strand): neighbour counts, clusters, or the hits of clusters of three or more."""
    hits = _all([text.read_table(spark, f) for f in a.files])
    if a.task == "neighbours":
        near = synteny.neighbours(hits, a.radius)
        n = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
        return hits.join(n, "id", "left").select(_tab("id", F.coalesce("n", F.lit(0))))
    parts = synteny.clusters(hits, a.radius)
    item, part = parts.columns[:2]
    if a.task == "clusters":
        return parts.select(_tab(item, part))
    big = parts.groupBy(part).agg(F.count("*").alias("n")).where("n >= 3")
    return parts.join(big, part).select(_tab(item, part))


@command("phylofiles", opt("-e --ext", required=True), opt("-n --missing", action="store_true", help="families without the file"))
def phylofiles(spark, a):
    """Files OUT/family/family.ext that exist, or the families (folders of any file) that have none."""
    every = _all([spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f).select("path") for f in a.files])
    each = every.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).withColumn("family", F.regexp_extract("folder", "([^/]*)$", 1))
    mine = each.where(F.endswith(F.col("path"), F.concat(F.lit("/"), "family", F.lit(a.ext))))
    if not a.missing:
        return mine.sort("path").select(F.col("path").alias("line"))
    return each.join(mine.select("folder").distinct(), "folder", "left_anti").select("folder").distinct().sort("folder").select(F.col("folder").alias("line"))


@command("runpar", opt("-n", type=int, default=8, help="groups"), opt("-c --run", required=True, help="a command that reads lines and writes lines"))
def runpar(spark, a):
    """The lines in groups, each through a command of the shell in a task of its own; a failing command fails the task."""

    def run(batches):
        import subprocess

        import pandas as pd

        lines = "".join(x + "\n" for b in batches for x in b["value"])
        got = subprocess.run(["sh", "-c", a.run], input=lines, capture_output=True, text=True, check=True).stdout
        yield pd.DataFrame({"line": got.splitlines()}, dtype="object")

    return _lines(spark, a).repartition(a.n).mapInPandas(run, "line string")


def main(argv: list[str] | None = None, out: TextIO | None = None) -> None:
    p = argparse.ArgumentParser(prog="commands", description=__doc__)
    sub = p.add_subparsers(dest="name", required=True)
    for name, (arguments, f) in COMMANDS.items():
        arguments(sub.add_parser(name, description=f.__doc__))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("commands").getOrCreate()
    for row in COMMANDS[a.name][1](spark, a).toLocalIterator():
        print(row["line"], file=out or sys.stdout)


if __name__ == "__main__":
    main()
