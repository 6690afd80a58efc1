"""Readers and line writers of sequence, matrix, hit, region and graph formats.

Line formats are split by Spark; formats whose lines depend on those before
are parsed a file at a time, so a file must fit in a task and many files
spread. Writers give columns of lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import parse_newick


def per_file(spark: SparkSession, path: str, parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """(file, *schema): what parse makes of every whole file."""
    import pandas as pd

    names = ["file", *(x.split()[0] for x in re.split(r",\s*(?![^<]*>)", schema))]

    def run(batches):
        for pdf in batches:
            rows = [(f, *r) for f, text in zip(pdf["file"], pdf["value"], strict=True) for r in parse(text)]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(run, f"file string, {schema}")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return spark.read.text(path).where("trim(value) <> ''").where(~F.col("value").startswith("#"))


HIT = (("query", "string"), ("subject", "string"), ("identity", "double"), ("length", "long"), ("mismatches", "long"), ("gaps", "long"), ("q_start", "long"), ("q_end", "long"), ("s_start", "long"), ("s_end", "long"), ("evalue", "double"), ("bitscore", "double"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-column search hits of any number of files."""
    c = F.split("value", "\t")
    return _rows(spark, path).select(*(F.trim(c[i]).cast(t).alias(n) for i, (n, t) in enumerate(HIT)))


def flipped(hits: DataFrame) -> DataFrame:
    """Query and subject changed over."""
    return hits.select(*(F.col({"query": "subject", "subject": "query", "q_start": "s_start", "q_end": "s_end", "s_start": "q_start", "s_end": "q_end"}.get(n, n)).alias(n) for n, _ in HIT))


def read_pairs(spark: SparkSession, path: str, delim: str = "\t") -> DataFrame:
    """(k, v) of every line, split at the first delimiter."""
    at = F.instr("value", delim)
    return spark.read.text(path).where(at > 0).select(F.expr(f"substring(value, 1, instr(value, '{delim}') - 1)").alias("k"), F.expr(f"substring(value, instr(value, '{delim}') + {len(delim)})").alias("v"))


def species_of(genes: DataFrame, rules: DataFrame, gene: str = "gene") -> DataFrame:
    """Adds `species` by rules (ord, pattern, species): wildcards `x*` and `*x` in order, then exact names.

    A gene without a rule is an error. The rules are a small table: they meet
    the genes by the lengths and texts of prefixes and suffixes, not by pairs.
    """
    star = F.col("pattern").contains("*")
    rules = rules.select("ord", F.replace("pattern", F.lit("*"), F.lit("")).alias("_key"), "species", F.when(~star, "exact").when(F.col("pattern").startswith("*"), "end").otherwise("start").alias("_kind"))
    sizes = rules.select("_kind", F.length("_key").alias("_n")).distinct().agg(F.collect_set(F.struct("_kind", "_n")).alias("_s"))
    each = genes.select(gene).distinct().join(F.broadcast(sizes)).select(gene, F.explode("_s").alias("_s")).where(F.length(gene) >= F.col("_s._n"))
    text = F.when(F.col("_s._kind") == "exact", F.col(gene)).when(F.col("_s._kind") == "start", F.expr(f"left(`{gene}`, _s._n)")).otherwise(F.expr(f"right(`{gene}`, _s._n)"))
    met = each.select(gene, F.col("_s._kind").alias("_kind"), text.alias("_key")).join(rules, ["_kind", "_key"])
    first = met.groupBy(gene).agg(F.min_by("species", F.struct((F.col("_kind") == "exact").cast("int"), F.col("ord"))).alias("_sp"))
    bad = F.raise_error(F.concat(F.lit("no species for "), F.col(gene)))
    return genes.join(first, gene, "left").withColumn("species", F.when(F.col("_sp").isNull(), bad.cast("string")).otherwise(F.col("_sp"))).drop("_sp")


def _phylip(text: str) -> Iterator[tuple]:
    lines = [x for x in text.splitlines() if x.strip()]
    n, width = (int(x) for x in lines[0].split()[:2])
    names = [x[:10].split()[0] if x[:10].strip() else "" for x in lines[1 : n + 1]]
    seqs = [["".join(x[10:].split())] for x in lines[1 : n + 1]]
    for i, line in enumerate(lines[n + 1 :]):
        seqs[i % n].append("".join(line.split()))
    for name, parts in zip(names, seqs, strict=True):
        if len(seq := "".join(parts)) != width:
            raise ValueError(f"{name}: {len(seq)} letters, not {width}")
        yield name, seq


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, seq) of interleaved alignments: names in the first ten columns."""
    return per_file(spark, path, _phylip, "name string, seq string")


def _clustal(text: str) -> Iterator[tuple]:
    seqs: dict[str, list[str]] = {}
    for line in text.splitlines()[1:]:
        if line.strip() and not line[0].isspace():
            name, part = line.split()[:2]
            seqs.setdefault(name, []).append(part)
    yield from ((n, "".join(p)) for n, p in seqs.items())


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, seq); the lines of marks below the blocks are left out."""
    return per_file(spark, path, _clustal, "name string, seq string")


def _distances(text: str) -> Iterator[tuple]:
    words = text.split()
    n, at = int(words[0]), 1

    def number(w: str) -> float | None:
        try:
            return float(w)
        except ValueError:
            return None

    names, rows = [], []
    lower = at + 1 < len(words) and number(words[at + 1]) is None or n == 1 and len(words) == 2
    for i in range(n):
        names.append(words[at])
        k = i if lower else n
        rows.append([float(w) for w in words[at + 1 : at + 1 + k]])
        at += 1 + k
    finite = [x for r in rows for x in r if abs(x) < float("inf")]
    far = 10 * max(finite, default=0.0)  # x is not below infinity if it is not a number either
    for i, row in enumerate(rows):
        for j, x in enumerate(row):
            x = x if abs(x) < float("inf") else far
            yield names[i], names[j], x
            if lower:
                yield names[j], names[i], x
        if lower:
            yield names[i], names[i], 0.0


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, distance) of square or lower matrices with wrapped lines; nan and inf are ten times the largest."""
    return per_file(spark, path, _distances, "a string, b string, distance double")


def _nexus(text: str) -> Iterator[tuple]:
    bare = re.sub(r"\[(?!&&NHX)[^\]]*\]", "", text)
    names: dict[str, str] = {}
    if m := re.search(r"translate(.*?);", bare, re.I | re.S):
        names = {p[0]: p[1] for x in m[1].split(",") if len(p := x.split()) == 2}
    for m in re.finditer(r"^\s*u?tree\s+\*?\s*([^\s=]+)\s*=\s*([^;]*;)", bare, re.I | re.M):
        yield m[1], re.sub(r"(?<=[(,])\s*([^\s():,;]+)", lambda k: names.get(k[1], k[1]), m[2].strip())


def read_nexus_trees(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, newick) of the tree lines, with numbers translated to names."""
    return per_file(spark, path, _nexus, "name string, newick string")


def _domains(text: str) -> Iterator[tuple]:
    query, inside = None, False
    for line in text.splitlines():
        if line.startswith("Query sequence"):
            query, inside = line.split(":", 1)[1].strip().split()[0], False
        elif line.startswith("Parsed for domains"):
            inside = True
        elif inside and (not line.strip() or line[0].isspace()):
            inside = False
        elif inside and len(p := line.split()) >= 10 and "/" in p[1]:
            yield query, p[0], int(p[2]), int(p[3]), float(p[8]), float(p[9])


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """(file, query, domain, start, end, score, evalue) of domain search reports."""
    return per_file(spark, path, _domains, "query string, domain string, start long, end long, score double, evalue double")


def read_ontology(spark: SparkSession, path: str, term: str = "go:term", schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Terms (accession, name, definition) and links (accession, parent, kind) of an ontology in XML."""
    link = "array<struct<`_rdf:resource`:string>>"
    kind = schema or f"`go:accession` string, `go:name` string, `go:definition` string, `go:is_a` {link}, `go:part_of` {link}"
    rows = spark.read.format("xml").option("rowTag", term).schema(kind).load(path)
    terms = rows.select(F.col("`go:accession`").alias("accession"), F.col("`go:name`").alias("name"), F.col("`go:definition`").alias("definition"))
    both = [rows.select(F.col("`go:accession`").alias("accession"), F.explode(f"`go:{k}`").alias("x"), F.lit(k).alias("kind")) for k in ("is_a", "part_of")]
    links = both[0].union(both[1]).select("accession", F.regexp_extract(F.col("x").getField("_rdf:resource"), r"([^#]*)$", 1).alias("parent"), "kind")
    return terms, links


def read_dense(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(i, j, v) of a matrix with a row a line; rows of differing widths are an error. header leaves the first line out."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["value"]:
                lines = [x for x in text.splitlines() if x.strip()][int(header) :]
                width = len(lines[0].split()) if lines else 0
                for i, line in enumerate(lines):
                    if len(cells := line.split()) != width:
                        raise ValueError(f"row {i}: {len(cells)} cells, not {width}")
                    out.extend((i, j, float(x)) for j, x in enumerate(cells))
            yield pd.DataFrame(out, columns=["i", "j", "v"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "i long, j long, v double")


def dense_lines(cells: DataFrame, n_cols: int) -> DataFrame:
    """(i, line): rows of n_cols numbers, absent cells 0."""
    full = F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda j: F.format_string("%f", F.coalesce(F.try_element_at(F.col("m"), j.cast("long")), F.lit(0.0))))
    return cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("long"), "v"))).alias("m")).select("i", F.concat_ws("\t", full).alias("line"))


def _sizes(line: str) -> tuple[int, int, int]:
    """Rows, columns and cells of a header of two or three numbers."""
    n = [int(x) for x in line.split()]
    if len(n) not in (2, 3):
        raise ValueError(f"header {line!r} doesn't have two or three numbers")
    return n[0], n[-2], n[-1]


def _row_pairs(text: str) -> Iterator[tuple]:
    lines = text.splitlines()
    _sizes(lines[0])
    for i, line in enumerate(lines[1:]):
        p = line.split()
        yield from ((i, int(j) - 1, float(v)) for j, v in zip(p[::2], p[1::2], strict=True))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j, v) of `i j v` lines after a line of sizes, each file's first; a file is split over tasks."""
    c = F.split(F.trim("value"), r"\s+")
    lines = spark.read.csv(path, schema="value string", sep="\x01", header=True, quote="", escape="", mode="FAILFAST")
    bad = F.raise_error(F.concat(F.lit("not three cells: "), F.col("value"))).cast("array<string>")
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.when(F.size(c) == 3, c).otherwise(bad).alias("c"))
    return rows.select("file", F.col("c")[0].cast("long").alias("i"), F.col("c")[1].cast("long").alias("j"), F.col("c")[2].cast("double").alias("v"))


def read_row_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j, v) of a line `j v j v ...` a row after a line of sizes; columns count from 1 on disk and from 0 here."""
    return per_file(spark, path, _row_pairs, "i long, j long, v double")


def cell_lines(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(ord, line): the line of sizes, then the cells in order."""
    head = cells.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.format_string(f"{n_rows}\t{n_cols}\t%d", "n").alias("line"))
    return head.union(cells.select(F.col("i").cast("long"), F.col("j").cast("long"), F.format_string("%d\t%d\t%f", "i", "j", "v"))).select(F.struct("i", "j").alias("ord"), "line")


def row_pair_lines(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(ord, line): the line of sizes, then a line for every row, empty ones too."""
    pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: F.format_string("%d\t%f", x["j"] + 1, x["v"])), "\t")
    body = cells.groupBy(F.col("i").cast("long").alias("ord")).agg(pairs.alias("line"))
    every = cells.sparkSession.range(n_rows).select(F.col("id").alias("ord")).join(body, "ord", "left").select("ord", F.coalesce("line", F.lit("")).alias("line"))
    return cells.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("ord"), F.format_string(f"{n_rows}\t{n_cols}\t%d", "n").alias("line")).union(every)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of nine columns or more: two regions (species, chrom, start, end) and a direction."""
    c = F.split("value", "\t")
    side = lambda k: [F.struct(c[k].alias("species"), c[k + 1].alias("chrom"), c[k + 2].cast("long").alias("start"), c[k + 3].cast("long").alias("end")).alias(f"region{k // 4 + 1}")]
    return _rows(spark, path).where(F.size(c) >= 9).select(*side(0), *side(4), c[8].cast("int").alias("direction"), F.try_element_at(c, F.lit(10)).alias("name"))


def block_lines(one: Column, two: Column, direction: Column) -> Column:
    return F.concat_ws("\t", *(r[f].cast("string") for r in (one, two) for f in ("species", "chrom", "start", "end")), direction.cast("string"))


def read_arg(spark: SparkSession, path: str) -> DataFrame:
    """(name, event, age, pos, parents, children) of a recombination graph's rows."""
    c = F.split("value", "\t", -1)
    names = lambda k: F.filter(F.split(F.coalesce(F.try_element_at(c, F.lit(k)), F.lit("")), ","), lambda x: x != "")
    rows = spark.read.text(path).where(F.size(c) >= 4).where(~F.col("value").startswith("start=")).where(~F.col("value").startswith("name\tevent\t"))
    return rows.select(c[0].alias("name"), c[1].alias("event"), c[2].cast("double").alias("age"), c[3].cast("double").alias("pos"), names(5).alias("parents"), names(6).alias("children"))


def arg_lines(arg: DataFrame) -> DataFrame:
    return arg.select(F.concat_ws("\t", "name", "event", F.col("age").cast("string"), F.col("pos").cast("string"), F.array_join("parents", ","), F.array_join("children", ",")).alias("line"))


def phylip_lines(seqs: DataFrame, width: int = 60) -> DataFrame:
    """(aln_id, line): one block of all letters a sequence, names cut and filled to ten columns."""
    rows = seqs.groupBy("aln_id").agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("w"), F.array_sort(F.collect_list(F.struct("name", "seq"))).alias("s"))
    body = F.transform("s", lambda x: F.concat(F.rpad(x["name"], 10, " "), x["seq"]))
    return rows.select("aln_id", F.explode(F.concat(F.array(F.concat_ws(" ", F.lit(""), F.col("n").cast("string"), F.col("w").cast("string"))), body)).alias("line"))


def nexus_text(seqs: DataFrame, kind: str = "protein") -> DataFrame:
    """(aln_id, text): the data block of every alignment."""
    rows = seqs.groupBy("aln_id").agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("w"), F.array_sort(F.collect_list(F.struct("name", "seq"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat_ws("  ", x["name"], x["seq"])), "\n")
    return rows.select("aln_id", F.format_string(f"#NEXUS\nbegin data;\ndimensions ntax=%d nchar=%d;\nformat datatype={kind} gap=- missing=?;\nmatrix\n%s\n;\nend;\n", "n", "w", body).alias("text"))


def gff_lines(regions: DataFrame) -> DataFrame:
    """Nine columns with key=value attributes in order of the keys; nulls are dots."""
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    sign = F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").otherwise(".")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return regions.select(F.concat_ws("\t", "seqname", dot("source"), dot("feature"), F.col("start").cast("string"), F.col("end").cast("string"), dot("score"), sign, dot("frame"), F.coalesce(attrs, F.lit(""))).alias("line"))


def html_rows(df: DataFrame) -> Column:
    """A row of a table as HTML, its cells escaped."""
    cells = []
    for c in df.columns:
        s = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            s = F.replace(s, F.lit(a), F.lit(b))
        cells.append(F.concat(F.lit("<td>"), s, F.lit("</td>")))
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def parse_sexp(text: str) -> list:
    """Nested lists of the expressions of a text: integers, floats, "strings" and names as strings, ; starts a comment."""
    words = re.findall(r';[^\n]*|"(?:\\.|[^"\\])*"|[()]|[^\s()";]+', text)
    stack: list[list] = [[]]
    for w in words:
        if w == "(":
            stack.append([])
        elif w == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced )")
            done = stack.pop()
            stack[-1].append(done)
        elif w[0] == '"':
            stack[-1].append(re.sub(r"\\(.)", r"\1", w[1:-1]))
        elif w[0] != ";":
            for cast in (int, float, str):
                try:
                    stack[-1].append(cast(w))
                    break
                except ValueError:
                    pass
    if len(stack) > 1:
        raise ValueError("unbalanced (")
    return stack[0]


def sexp_json(c: Column) -> Column:
    """Expressions as JSON arrays."""
    import pandas as pd

    def run(s):
        import json

        return s.map(lambda x: None if x is None else json.dumps(parse_sexp(x)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


def read_tree_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, newick) of local trees along a sequence."""
    c = F.split("value", "\t")
    return _rows(spark, path).select(c[0].cast("long").alias("start"), c[1].cast("long").alias("end"), c[2].alias("newick"))


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """(site, age, carriers)."""
    c = F.split("value", "\t", -1)
    return _rows(spark, path).select(c[0].cast("double").alias("site"), c[1].cast("double").alias("age"), F.filter(F.split(c[2], ","), lambda x: x != "").alias("carriers"))


def tree_track_lines(parts: DataFrame, newicks: DataFrame) -> DataFrame:
    """(lo, line): start, end and tree of parts (lo, hi), newicks being (tree_id, newick) with tree_id the part's lo."""
    met = parts.join(newicks.select(F.col("tree_id").cast("double").alias("lo"), "newick"), "lo")
    return met.select("lo", F.concat_ws("\t", F.col("lo").cast("long").cast("string"), F.col("hi").cast("long").cast("string"), "newick").alias("line"))


def mutation_lines(mutations: DataFrame) -> DataFrame:
    """(site, line) of mutations (site, age, carriers)."""
    return mutations.select("site", F.concat_ws("\t", F.col("site").cast("string"), F.col("age").cast("string"), F.array_join("carriers", ",")).alias("line"))


def read_ancestral(spark: SparkSession, path: str) -> DataFrame:
    """(node, lo, hi): the parts of the sequence that each node carries; a node without one has no row."""
    c = F.split("value", "\t", -1)
    rows = _rows(spark, path).select(c[0].alias("node"), F.transform(F.filter(F.slice(c, 2, 1 << 30), lambda x: x != ""), lambda x: x.cast("long")).alias("p"))
    pairs = F.transform(F.filter(F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("lo"), F.get("p", i + 1).alias("hi"))), lambda x: x["i"] % 2 == 0), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))
    return rows.select("node", F.inline(pairs))


def ancestral_lines(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of every node (node) with its parts (node, lo, hi) in order."""
    per = parts.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: F.array(x["lo"].cast("long").cast("string"), x["hi"].cast("long").cast("string"))))
    return nodes.select("node").join(per, "node", "left").select("node", F.concat_ws("\t", "node", flat).alias("line"))


def read_parent_array(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """(file, node, parent) of files with a parent's number a line, -1 at the root; the first nodes are the labelled leaves."""

    def parse(text: str):
        up = [int(x) for x in text.split()]
        name = [*labels, *(str(i) for i in range(len(labels), len(up)))]
        yield from ((name[i], None if p < 0 else name[p]) for i, p in enumerate(up))

    return per_file(spark, path, parse, "node string, parent string")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, node, parent, dist) of all the trees of newick files."""

    def parse(text: str):
        for k, one in enumerate(x for x in text.split(";") if x.strip()):
            yield from ((f"{k}", n, p, d) for n, p, _, d, _ in parse_newick(one + ";"))

    out = per_file(spark, path, parse, "k string, node string, parent string, dist double")
    return out.select(F.concat_ws("#", "file", "k").alias("tree_id"), "node", "parent", "dist")
