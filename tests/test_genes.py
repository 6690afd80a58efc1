"""Operators of genes and families on small tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import align, genes


def test_subsequence(spark):
    df = spark.createDataFrame([("ACGTTN", 2, 4, 1), ("ACGTTN", 2, 4, -1), ("ACGTTN", 5, None, 1), ("ACGTTN", 7, 9, 1), (None, 1, 2, 1)], "q string, s int, e int, strand int")
    got = [r[0] for r in df.select(align.subsequence(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["CGT", "ACG", "TN", "", None]


def test_ordinals_of_null_keys(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), (None, 3), (None, 2), ("b", 9)], "chrom string, s int")
    got = {(r.chrom, r.s): r.pos for r in genes.ordinals(df, ["chrom"], ["s"]).collect()}
    assert got == {("a", 1): 0, ("a", 5): 1, (None, 2): 0, (None, 3): 1, ("b", 9): 0}
    assert genes.ordinals(df.where("false"), ["chrom"], ["s"]).count() == 0


def test_hit_with_itself_is_there_once(spark):
    hits = spark.createDataFrame([("x", "y", 1), ("y", "x", 2), ("x", "x", 3)], "a string, b string, n int")
    got = sorted((r.name, r.other, r.n) for r in genes.hits_by_name(hits, "a", "b", ["n"]).collect())
    assert got == [("x", "x", 3), ("x", "y", 2), ("y", "x", 2)]


def test_families_against_plain_merge(spark):
    rng = random.Random(4)
    parts1 = {f"a{i}": i // 3 for i in range(12)}
    parts2 = {f"b{i}": i // 2 for i in range(10)}
    hits = [(f"a{rng.randrange(14)}", f"b{rng.randrange(12)}", float(rng.randrange(100))) for _ in range(60)]
    far = [(rng.choice("ab") + str(rng.randrange(14)), float(rng.randrange(60))) for _ in range(30)]
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = genes.merge_families(t(hits, "gene1 string, gene2 string, score double"), t(list(parts1.items()), "gene string, part int"), t(list(parts2.items()), "gene string, part int"), t(far, "gene string, score double"))

    node = {g: f"1 part {p}" for g, p in parts1.items()} | {g: f"2 part {p}" for g, p in parts2.items()}
    for a, b, _ in hits:
        node.setdefault(a, f"1 gene {a}")
        node.setdefault(b, f"2 gene {b}")
    scores, out = defaultdict(list), defaultdict(list)
    for a, b, s in hits:
        scores[node[a], node[b]].append(s)
        scores[node[b], node[a]].append(s)
    for g, s in far:
        if g in node:
            out[node[g]].append(s)
    mean = lambda x: sum(x) / max(1, len(x))
    family = {n: {n} for n in node.values()}
    for n in list(family):
        near = [(-mean(v), b) for (a, b), v in scores.items() if a == n and mean(v) > mean(out[a]) and mean(v) > mean(out[b])]
        if near:
            both = family[n] | family[min(near)[1]]
            for x in both:
                family[x] = both
    assert {r.gene: r.family for r in got.collect()} == {g: min(family[n]) for g, n in node.items()}
    assert 1 < len({min(f) for f in family.values()}) < len(family)


def test_merge_candidates(spark):
    rows = [("f", "g1", 10, 1, 0, 9), ("f", "g2", 20, 1, 9, 20), ("f", "g3", 30, 1, 2, 19), ("f", "g4", 40, 1, None, None), ("r", "h1", 10, -1, 12, 20), ("r", "h2", 20, -1, 0, 11)]
    df = spark.createDataFrame(rows, "k string, gene string, start int, strand int, first int, last int")
    assert sorted((r.k, r.gene) for r in genes.merge_candidates(df, ["k"]).collect()) == [("f", "g1"), ("f", "g2"), ("r", "h1"), ("r", "h2")]
    seqs = spark.createDataFrame([("--AC-G-",), ("---",), ("",)], "q string").select(genes.extent(F.col("q")).alias("x"))
    assert [tuple(r.x) for r in seqs.collect()] == [(2, 5), (None, None), (None, None)]


@pytest.mark.parametrize("collapse", [False, True])
def test_window_alignments(spark, collapse):
    rng = random.Random(9)
    blocks, seqs, whole = [], [], {}
    for b, (s, e) in enumerate([(10, 29), (35, 44), (60, 60)]):
        main = list("".join(rng.choice("ACGT") for _ in range(e - s + 1)))
        for _ in range(6):
            main.insert(rng.randrange(len(main) + 1), "-")
        whole[b] = {"main": "".join(main)} | {n: "".join(rng.choice("ACGT-") for _ in main) for n in (["x", "y"] if b != 1 else ["y"])}
        if b == 0:
            whole[b]["z"] = ""
        blocks.append((b, "s", "c", s, e))
        seqs += [(b, i, n, q) for i, (n, q) in enumerate(whole[b].items())]
    windows = [(w, "s", "c", *sorted((rng.randrange(5, 65), rng.randrange(5, 65)))) for w in range(25)]
    t = spark.createDataFrame
    got = genes.window_alignments(t(blocks, "block int, species string, chrom string, s int, e int"), t(seqs, "block int, ord int, name string, seq string"), t(windows, "window int, species string, chrom string, s int, e int"), collapse)
    want = {}
    for w, _, _, s, e in windows:
        met = [(b, x, y) for b, _, _, x, y in blocks if x <= e and s <= y]
        cut = {}
        for b, x, _ in met:
            keep, place = [], x - 1
            for i, c in enumerate(whole[b]["main"]):
                place += c != "-"
                # gaps before the block's first letter, or after the one cut to, stay with what is before them
                if place >= (s if s > x else x - 1) and place <= e and (c != "-" or not collapse):
                    keep.append(i)
            cut[b] = keep
        for n in {n for b, _, _ in met for n in whole[b]}:
            want[w, n] = "".join("".join(whole[b][n][i] for i in cut[b]) if whole[b].get(n) else "-" * len(cut[b]) for b, _, _ in met)
    assert {(r.window, r.name): r.seq for r in got.collect()} == want


def test_names_and_events(spark):
    rows = [("f", "ab-12", "x; y"), ("f", "ab3", "y; "), ("f", "", None), ("f", "7", "skip; z"), ("g", None, "")]
    df = spark.createDataFrame(rows, "fam string, name string, d string")
    got = {r.fam: (r.names, r.descriptions) for r in genes.family_names(df, "fam", "name", "d", ["skip"]).collect()}
    assert got == {"f": (",ab", "y[2]; x[1]; z[1]"), "g": ("", "")}
    wide = spark.createDataFrame([("f", 1, 2, 3, 4)], "fam string, `a.b-genes` int, `a.b-dup` int, `c-genes` int, `c-dup` int")
    assert sorted(map(tuple, genes.wide_events(wide, "fam", ["a.b", "c"], ["genes", "dup"]).collect())) == [("f", "a.b", 1, 2), ("f", "c", 3, 4)]
