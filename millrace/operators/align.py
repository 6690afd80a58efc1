"""Alignments as rows (aln_id, name, seq) of equal length: columns, codons, conservation, coordinates.

Letters are exploded to (aln_id, pos, name, c), pos from 0; what is kept is
joined to strings again. A column's statistics are one aggregation.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import reverse_complement

#: Amino acids of the codons TTT, TTC, TTA, TTG, TCT, ... in the standard code.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, product(BASES, repeat=3)), AMINO, strict=True))
GAP = "-"


def _amino(codon: Column) -> Column:
    place = [F.position(F.substring(codon, i, 1), F.lit(BASES)) for i in (1, 2, 3)]
    known = (place[0] > 0) & (place[1] > 0) & (place[2] > 0)
    index = (place[0] - 1) * 16 + (place[1] - 1) * 4 + place[2]
    return F.when(codon == "---", GAP).when(known, F.substring(F.lit(AMINO), index, F.lit(1))).otherwise("X")


def codons(seq: Column) -> Column:
    """The sequence in threes; a length that isn't a multiple of three is an error."""
    bad = F.raise_error(F.lit("length of a coding sequence isn't a multiple of three"))
    return F.when(F.length(seq) % 3 != 0, bad.cast("array<string>")).when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3)), lambda i: F.substring(seq, i, F.lit(3))))


def translate(seq: Column) -> Column:
    """Amino acids of a coding sequence; --- is -, a codon with an unknown letter X."""
    return F.array_join(F.transform(codons(F.upper(seq)), _amino), "")


def back_translate(amino: Column, dna: Column) -> Column:
    """The codons of dna in the places of a gapped amino acid sequence."""
    letters = F.split(amino, "(?!$)")
    step = F.aggregate(letters, F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), lambda a, c: F.struct((a["n"] + F.when(c == GAP, 0).otherwise(1)).alias("n"), F.concat(a["s"], F.when(c == GAP, "---").otherwise(F.substring(dna, a["n"] * 3 + 1, F.lit(3)))).alias("s")))
    return step["s"]


def letters(aln: DataFrame) -> DataFrame:
    """(aln_id, name, pos, c)."""
    return aln.select("aln_id", "name", F.posexplode(F.split("seq", "(?!$)")).alias("pos", "c")).where("c <> ''")


def _joined(cells: DataFrame) -> DataFrame:
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "")
    return cells.groupBy("aln_id", "name").agg(seq.alias("seq"))


def keep_columns(aln: DataFrame, columns: DataFrame) -> DataFrame:
    """The alignment with only the columns (aln_id, pos); sequences of which nothing is left are empty."""
    kept = _joined(letters(aln).join(columns.select("aln_id", "pos").distinct(), ["aln_id", "pos"]))
    return aln.select("aln_id", "name").join(kept, ["aln_id", "name"], "left").select("aln_id", "name", F.coalesce("seq", F.lit("")).alias("seq"))


def column_stats(aln: DataFrame) -> DataFrame:
    """(aln_id, pos, n, n_gaps, top): sequences, gaps, and rows of the commonest letter that isn't a gap."""
    per = letters(aln).groupBy("aln_id", "pos", "c").agg(F.count("*").alias("k"))
    return per.groupBy("aln_id", "pos").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("c") == GAP, F.col("k")).otherwise(0)).alias("n_gaps"), F.max(F.when(F.col("c") != GAP, F.col("k")).otherwise(0)).alias("top"))


def without_empty(aln: DataFrame, by_codon: bool = False) -> DataFrame:
    """No columns of gaps alone; by_codon drops only whole codons of gaps."""
    at = (F.col("pos") - F.col("pos") % 3) if by_codon else F.col("pos")
    live = column_stats(aln).groupBy("aln_id", at.alias("at")).agg(F.max((F.col("n_gaps") < F.col("n")).cast("int")).alias("live")).where("live = 1")
    if by_codon:
        live = live.withColumn("at", F.explode(F.sequence(F.col("at"), F.col("at") + 2)))
    return keep_columns(aln, live.withColumnRenamed("at", "pos"))


def without_gaps(aln: DataFrame) -> DataFrame:
    return keep_columns(aln, column_stats(aln).where("n_gaps = 0"))


def require(aln: DataFrame, n: int | None = None, ratio: float | None = None) -> DataFrame:
    """Columns in which at least n sequences, or a share of them, have a letter."""
    s = column_stats(aln)
    return keep_columns(aln, s.where(F.col("n") - F.col("n_gaps") >= (n if n is not None else F.col("n") * ratio)))


def conservation(aln: DataFrame) -> DataFrame:
    """(aln_id, pos, share, mark): the commonest letter's share of all sequences; * for all, . for over half."""
    share = F.col("top") / F.col("n")
    return column_stats(aln).select("aln_id", "pos", share.alias("share"), F.when(share == 1, "*").when(share > 0.5, ".").otherwise(" ").alias("mark"))


def information(aln: DataFrame) -> DataFrame:
    """(aln_id, pos, bits): n/5 log2 5 less the entropy of the column's letters."""
    per = letters(aln).groupBy("aln_id", "pos", "c").agg(F.count("*").alias("k"))
    tot = per.groupBy("aln_id", "pos").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    return tot.select("aln_id", "pos", (F.col("n") * 0.2 * F.log2(F.lit(5.0)) - (F.log2("n") - F.col("s") / F.col("n"))).alias("bits"))


def base_frequencies(aln: DataFrame) -> DataFrame:
    """(aln_id, a, c, g, t): shares of the bases, one of each added; all letters count in the divisor."""
    seq = F.upper("seq")
    n = F.sum(F.length("seq")) + 4
    return aln.groupBy("aln_id").agg(*(((F.sum(F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit("")))) + 1) / n).alias(b.lower()) for b in "ACGT"))


def pssm(aln: DataFrame, pseudo: dict[str, float] | None = None) -> DataFrame:
    """(aln_id, pos, c, score): log2 of the share of each letter in each column, with counts added to it."""
    pseudo = pseudo or {}
    extra = sum(pseudo.values())
    per = letters(aln).groupBy("aln_id", "pos", "c").agg(F.count("*").cast("double").alias("k"))
    n = column_stats(aln).select("aln_id", "pos", "n")
    if pseudo:
        added = n.select("aln_id", "pos", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(float(v)).alias("k")) for c, v in pseudo.items()))).alias("x")).select("aln_id", "pos", "x.c", "x.k")
        per = per.union(added).groupBy("aln_id", "pos", "c").agg(F.sum("k").alias("k"))
    return per.join(n, ["aln_id", "pos"]).select("aln_id", "pos", "c", F.log2(F.col("k") / (F.col("n") + extra)).alias("score"))


def pssm_scores(scores: DataFrame, seqs: DataFrame) -> DataFrame:
    """(aln_id, name, score): the sum of the matrix's scores of every sequence."""
    return letters(seqs).join(scores, ["aln_id", "pos", "c"]).groupBy("aln_id", "name").agg(F.sum("score").alias("score"))


def _codon_rows(aln: DataFrame) -> DataFrame:
    """(aln_id, name, at, codon)."""
    return aln.select("aln_id", "name", F.posexplode(codons(F.col("seq"))).alias("i", "codon")).select("aln_id", "name", (F.col("i") * 3).alias("at"), "codon")


def aligned_codons(aln: DataFrame) -> DataFrame:
    """Only the codon columns in which every sequence has a whole codon or none."""
    bad = F.col("codon").contains(GAP) & (F.col("codon") != "---")
    ok = _codon_rows(aln).groupBy("aln_id", "at").agg(F.max(bad.cast("int")).alias("bad")).where("bad = 0")
    return keep_columns(aln, ok.select("aln_id", F.explode(F.sequence("at", F.col("at") + 2)).alias("pos")))


#: Amino acid and place in the codon where any of the four bases gives it.
FOUR_FOLD = sorted({(a, 2) for c, a in CODONS.items() if all(CODONS[c[:2] + b] == a for b in BASES)})


def four_fold_columns(aln: DataFrame) -> DataFrame:
    """(aln_id, pos): third places where one amino acid, apart from - and X, is shared and any base gives it."""
    rows = _codon_rows(aln).select("aln_id", "at", _amino(F.upper("codon")).alias("aa")).where("aa not in ('-', 'X')")
    one = rows.groupBy("aln_id", "at").agg(F.min("aa").alias("a"), F.max("aa").alias("b")).where("a = b")
    free = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(i).alias("i")) for a, i in FOUR_FOLD))
    return one.select("aln_id", "at", F.explode(F.filter(free, lambda x: x["a"] == F.col("a"))).alias("x")).select("aln_id", (F.col("at") + F.col("x.i")).alias("pos"))


def four_fold(aln: DataFrame) -> DataFrame:
    """aligned_codons, then its four-fold columns."""
    whole = aligned_codons(aln)
    return keep_columns(whole, four_fold_columns(whole))


def overlap(a: Column, b: Column) -> Column:
    """Places where neither of two gapped sequences has a gap."""
    return F.size(F.filter(F.zip_with(F.split(a, "(?!$)"), F.split(b, "(?!$)"), lambda x, y: (x != GAP) & (y != GAP) & (x != "") & (y != "")), lambda x: x))


def stops_masked(seq: Column) -> Column:
    """Stop codons as NNN."""
    stops = [c for c, a in CODONS.items() if a == "*"]
    return F.array_join(F.transform(codons(seq), lambda c: F.when(F.upper(c).isin(stops), "NNN").otherwise(c)), "")


def local_to_align(seq: Column) -> Column:
    """The places in the gapped sequence of its letters, from 0."""
    return F.filter(F.transform(F.split(seq, "(?!$)"), lambda c, i: F.when(~c.isin(GAP, ""), i)), lambda i: i.isNotNull())


def align_to_local(seq: Column) -> Column:
    """For every place the number of the last letter up to it; -1 before the first."""
    start = F.array().cast("array<int>")
    return F.aggregate(F.split(seq, "(?!$)"), start, lambda a, c: F.array_append(a, F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(-1) + F.when(c == GAP, 0).otherwise(1)))


def global_to_local(pos: Column, start: Column, end: Column, strand: Column) -> Column:
    """From a chromosome's places from 1 to a region's from 0."""
    return F.when(strand == 1, pos - start).otherwise(end - pos)


def local_to_global(pos: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == 1, pos + start).otherwise(end - pos)


def concatenated(aln: DataFrame, order: str = "aln_id") -> DataFrame:
    """(name, seq): all alignments side by side; N for the letters of a missing sequence."""
    lengths = aln.groupBy(order).agg(F.max(F.length("seq")).alias("n"))
    every = aln.select("name").distinct().crossJoin(lengths)  # names times alignments are the result's own cells
    cells = every.join(aln, ["name", order], "left").withColumn("s", F.coalesce("seq", F.expr("repeat('N', n)")))
    return cells.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "s"))), lambda x: x["s"]), "").alias("seq"))


def sampled_columns(aln: DataFrame, seed: int) -> DataFrame:
    """Every alignment with as many columns as before, drawn with replacement; equal for all its sequences."""
    n = aln.groupBy("aln_id").agg(F.max(F.length("seq")).alias("n")).where("n > 0")
    picks = n.select("aln_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("to")).select("aln_id", F.pmod(F.xxhash64("aln_id", "to", F.lit(seed)), F.col("n")).cast("int").alias("pos"), "to")
    return _joined(letters(aln).join(picks, ["aln_id", "pos"]).select("aln_id", "name", F.col("to").alias("pos"), "c"))


def subsequence(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Letters start to end (from 1, both in it; a null end is the last letter); on strand -1 their reverse complement."""
    part = F.substring(seq, start, F.coalesce(end, F.length(seq)) - start + 1)
    return F.when(strand == -1, reverse_complement(part)).otherwise(part)
