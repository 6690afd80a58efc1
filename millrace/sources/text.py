"""Typed tab tables, FASTA, GFF, matrices and newick trees as DataFrames, and their writers.

Headers are read on the driver (a few lines); rows are parsed by Spark.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of column types in a table's directive line.
TYPES = {"string": T.StringType(), "str": T.StringType(), "unknown": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


class TableError(ValueError):
    pass


def _guess(cell: str) -> T.DataType:
    for cast, kind in ((int, T.LongType()), (float, T.DoubleType())):
        try:
            cast(cell)
            return kind
        except ValueError:
            pass
    return T.BooleanType() if cell.strip().lower() in ("true", "false") else T.StringType()


def _head(lines: DataFrame) -> list[str]:
    """The type directives before the second row, and the first two rows, of the first part of a text; the rest isn't read."""

    def run(batches):
        rows = 0
        if TaskContext.get().partitionId() == 0:
            for batch in batches:
                got = [x for x in batch.column(0).to_pylist() if x.strip()]
                keep = []
                for x in got:
                    rows += not x.startswith("#")
                    if not x.startswith("#") or x.startswith("##types:"):
                        keep.append(x)
                    if rows == 2:
                        break
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["value"])
                if rows == 2:
                    return

    return [r[0] for r in lines.mapInArrow(run, "value string").collect()]


def read_table(spark: SparkSession, path: str, delim: str = "\t", header: bool = True, types: dict | None = None, guess: bool = True, names: list[str] | None = None) -> DataFrame:
    """A tab table with an optional ##types: line, # comments, blank lines and a header row.

    Types: the given ones, else those of the directive, else a guess from the
    first row, else string. A row of another width, or a cell that isn't of its
    type, raises an error. With `names` the columns are named so and every line is a
    row. A header is the first line of a file that is neither blank nor a comment, and
    only that one: a row that repeats it is a row. The directive stands before the
    second row, in the first part of the first file.
    """
    head = _head(spark.read.text(path))
    directive = next((x.split(":", 1)[1].split(delim) for x in head if x.startswith("##types:")), None)
    body = [x for x in head if not x.startswith("#")]
    if not body:
        raise TableError(f"{path}: no rows")
    header = header and names is None
    first = body[0].split(delim)
    names = names or (first if header else [f"_{i}" for i in range(len(first))])
    if len(set(names)) < len(names):
        raise TableError(f"{path}: duplicate header in {names}")
    row = body[1 if header else 0].split(delim) if len(body) > int(header) else None
    kinds = []
    for i, name in enumerate(names):
        if types and name in types:
            kinds.append(TYPES[types[name]])
        elif directive:
            kinds.append(TYPES[directive[i].strip()])
        else:
            kinds.append(_guess(row[i]) if guess and row and i < len(row) else T.StringType())
    cells = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(len(names))), T.StructField("bad", T.StringType())])
    reader = spark.read.option("columnPruning", "false").option("columnNameOfCorruptRecord", "bad")
    got = reader.csv(path, schema=cells, sep=delim, header=header, comment="#", quote="", escape="", mode="PERMISSIVE", nullValue="\0", emptyValue="", enforceSchema=True, maxColumns=len(names) + 1024)
    wrong = F.raise_error(F.concat(F.lit(f"{path}: wrong number of cells: "), F.col("bad")))
    return got.select(*(F.when(F.col("bad").isNotNull(), wrong.cast("string")).otherwise(F.col(f"c{i}")).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))))


def list_files(spark: SparkSession, path: str, ext: str = "") -> DataFrame:
    """(path, length) of the files of a folder whose names end with ext, sorted; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(path).select("path", "length").sort("path")


def read_labelled_dense(spark: SparkSession, path: str, delim: str = "\t") -> DataFrame:
    """(rlabel, clabel, v) of a matrix whose first line names its columns and whose lines start with their row's name."""
    rows = read_table(spark, path, delim, guess=False)
    first, *rest = rows.columns
    return rows.select(F.col(first).alias("rlabel"), *(F.col(f"`{c}`").cast("double").alias(c) for c in rest)).unpivot("rlabel", [f"`{c}`" for c in rest], "clabel", "v")


def read_recon(spark: SparkSession, path: str) -> DataFrame:
    """(node, snode, event) of a reconciliation's lines; event is null where a line has two cells."""
    c = F.split("value", "\t")
    return spark.read.text(path).where("trim(value) <> ''").select(c[0].alias("node"), c[1].alias("snode"), F.get(c, F.lit(2)).alias("event"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_recon(spark, path).select("node", F.col("snode").alias("event"))


def recon_lines(recon: DataFrame, events: bool = True) -> DataFrame:
    """Lines of a reconciliation, with its events or without."""
    return recon.select(F.concat_ws("\t", "node", "snode", *([F.coalesce("event", F.lit(""))] if events else [])).alias("value"))


def parent_lines(nodes: DataFrame, data: list[str] | None = None) -> DataFrame:
    """A tree's nodes as lines of node, parent (-1 for the root), distance, and the named entries of its data."""
    more = [F.coalesce(F.try_element_at("data", F.lit(k)), F.lit("")) for k in data or []]
    return nodes.select(F.concat_ws("\t", "node", F.coalesce("parent", F.lit("-1")), F.coalesce(F.col("dist").cast("string"), F.lit("0.0")), *more).alias("value"))


def read_parents(spark: SparkSession, path: str) -> DataFrame:
    """(node, parent, dist) of the lines of parent_lines()."""
    c = F.split("value", "\t")
    return spark.read.text(path).where("trim(value) <> ''").select(c[0].alias("node"), F.when(c[1] != "-1", c[1]).alias("parent"), c[2].cast("double").alias("dist"))


def table_lines(df: DataFrame, delim: str = "\t") -> Column:
    """A row as a line of a tab table; nulls are empty, booleans True and False."""
    return F.concat_ws(delim, *(F.coalesce(F.initcap(F.col(c).cast("string")) if t == "boolean" else F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes))


def write_table(df: DataFrame, path: str, delim: str = "\t") -> None:
    """Part files with neither header nor directive, and the header line beside them under _header."""
    df.select(table_lines(df, delim).alias("value")).write.mode("overwrite").text(path)
    df.sparkSession.createDataFrame([(delim.join(df.columns),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_header")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, seq): the first word of a record's line, the line, and its joined sequence."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) <> ''")
    name = F.substring_index("v", "\n", 1)
    return records.select(F.regexp_extract(name, r"^(\S*)", 1).alias("key"), name.alias("name"), F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s", "").alias("seq"))


def fasta_lines(name: Column, seq: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", ""))


def read_gff(spark: SparkSession, path: str, version: int = 3) -> DataFrame:
    """Nine-column annotations; attributes as a map (key=value; or key "value";), '.' as null."""
    rows = spark.read.text(path).where("trim(value) <> ''").where(~F.col("value").startswith("#"))
    c = F.split("value", "\t")

    def cell(i: int) -> Column:
        return F.when(c[i] != ".", c[i])

    parts = F.filter(F.transform(F.split(c[8], ";"), F.trim), lambda x: x != "")
    sep = "=" if version == 3 else " "
    pair = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, sep, 1)).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(x, f"^[^{sep}]*{sep}?", ""), '"', "")).alias("v")))
    strand = F.when(c[6] == "+", 1).when(c[6] == "-", -1).otherwise(0)
    return rows.select(c[0].alias("seqname"), cell(1).alias("source"), cell(2).alias("feature"), c[3].cast("long").alias("start"), c[4].cast("long").alias("end"), cell(5).cast("double").alias("score"), strand.alias("strand"), cell(7).cast("int").alias("frame"), F.map_from_entries(pair).alias("attrs"))


def gff_parents(regions: DataFrame) -> DataFrame:
    """(child, parent) of every ID and each of its Parents."""
    return regions.select(F.col("attrs")["ID"].alias("child"), F.explode(F.split(F.col("attrs")["Parent"], ",")).alias("parent"))


def read_matrix(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """Sparse triples of a text file: (i, j, v) after a line of sizes, or (rlabel, clabel, v)."""
    if not labelled:
        from .formats import read_cells

        return read_cells(spark, path).select("i", "j", "v")
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(c) == 3).select(c[0].alias("rlabel"), c[1].alias("clabel"), c[2].cast("double").alias("v"))


NODES = "node string, parent string, child_ix int, dist double, data map<string,string>"


def parse_newick(text: str) -> list[tuple]:
    """Rows of NODES for one tree; unnamed nodes are numbered from 1 in preorder, a repeated name gets _n.

    An explicit stack, so that deep trees don't meet the recursion limit.
    """
    at, n = 0, len(text)
    nodes: list[dict] = [{"name": "", "parent": None, "ix": 0, "dist": None, "data": {}, "kids": 0}]
    stack, now = [0], 0

    def child() -> int:
        p = stack[-1]
        nodes.append({"name": "", "parent": p, "ix": nodes[p]["kids"], "dist": None, "data": {}, "kids": 0})
        nodes[p]["kids"] += 1
        return len(nodes) - 1

    while at < n and text[at] != ";":
        ch = text[at]
        if ch == "(":
            if now != stack[-1]:
                stack.append(now)
            now = child()
            at += 1
        elif ch == ",":
            now = child()
            at += 1
        elif ch == ")":
            now = stack[-1]
            if len(stack) > 1:
                stack.pop()
            at += 1
        elif ch == "[":
            depth, end = 1, at + 1
            while depth:
                depth += {"[": 1, "]": -1}.get(text[end], 0)
                end += 1
            note = text[at + 1 : end - 1]
            if note.startswith("&&NHX"):
                nodes[now]["data"] |= dict(x.split("=", 1) for x in note.split(":")[1:] if "=" in x)
            at = end
        elif ch.isspace():
            at += 1
        else:
            end = at
            while end < n and text[end] not in "(),;[":
                end += 1
            label, _, dist = text[at:end].strip().partition(":")
            nodes[now]["name"] = label.strip() or nodes[now]["name"]
            nodes[now]["dist"] = float(dist) if dist.strip() else nodes[now]["dist"]
            at = end
    used: dict[str, int] = {}
    free = 1
    for x in nodes:
        if not x["name"]:
            x["name"], free = str(free), free + 1
        elif x["name"] in used:
            used[x["name"]] += 1
            x["name"] = f"{x['name']}_{used[x['name']]}"
        used.setdefault(x["name"], 0)
    return [(x["name"], None if x["parent"] is None else nodes[x["parent"]]["name"], x["ix"], x["dist"], x["data"]) for x in nodes]


def newick_nodes(trees: DataFrame, id_col: str = "tree_id", text_col: str = "newick") -> DataFrame:
    """The node table of every tree: tree_id and NODES."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(t, *x) for t, s in zip(pdf["tree_id"], pdf["newick"], strict=True) if s for x in parse_newick(s)]
            yield pd.DataFrame(rows, columns=["tree_id", "node", "parent", "child_ix", "dist", "data"])

    return trees.select(F.col(id_col).cast("string").alias("tree_id"), F.col(text_col).alias("newick")).mapInPandas(run, f"tree_id string, {NODES}")
