import pytest
from pyspark.sql import functions as F

from millrace.sources import formats, text


def put(tmp_path, name, s):
    p = tmp_path / name
    p.write_text(s)
    return str(p)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_alignments(spark, tmp_path):
    p = put(tmp_path, "a.phy", " 2 8\nalpha     ACGT\nbeta      AC-T\n\nGG-G\nGGGG\n")
    assert rows(formats.read_phylip(spark, p), "name", "seq") == [("alpha", "ACGTGG-G"), ("beta", "AC-TGGGG")]
    with pytest.raises(Exception, match="letters, not 9"):
        formats.read_phylip(spark, put(tmp_path, "b.phy", "1 9\nalpha     ACGT\n")).collect()
    p = put(tmp_path, "a.aln", "CLUSTAL W\n\nx1  ACG-\ny1  ACGT\n    *** \n\nx1  TT\ny1  TA\n    * \n")
    assert rows(formats.read_clustal(spark, p), "name", "seq") == [("x1", "ACG-TT"), ("y1", "ACGTTA")]
    df = spark.createDataFrame([("q", "b", "AC"), ("q", "a", "GT")], "aln_id string, name string, seq string")
    lines = [r.line for r in formats.phylip_lines(df).collect()]
    assert lines == [" 2 2", "a         GT", "b         AC"]
    back = put(tmp_path, "c.phy", "\n".join(lines))
    assert rows(formats.read_phylip(spark, back), "name", "seq") == [("a", "GT"), ("b", "AC")]
    assert "ntax=2 nchar=2" in formats.nexus_text(df).first()["text"]


def test_distances(spark, tmp_path):
    want = [("a", "a", 0.0), ("a", "b", 2.0), ("b", "a", 2.0), ("b", "b", 0.0)]
    assert rows(formats.read_distances(spark, put(tmp_path, "s", "2\na 0.0\n 2.0\nb 2.0 0.0\n")), "a", "b", "distance") == want
    assert rows(formats.read_distances(spark, put(tmp_path, "l", "2\na\nb 2.0\n")), "a", "b", "distance") == want
    far = formats.read_distances(spark, put(tmp_path, "n", "2\na 0.0 nan\nb 3.0 0.0\n"))
    assert rows(far.where("a = 'a' and b = 'b'"), "distance") == [(30.0,)]


def test_matrices(spark, tmp_path):
    p = put(tmp_path, "i", "2\t3\t2\n0\t2\t1.5\n1\t0\t2\n")
    cells = text.read_matrix(spark, p)
    assert rows(cells, "i", "j", "v") == [(0, 2, 1.5), (1, 0, 2.0)]
    assert [r.line for r in formats.cell_lines(cells, 2, 3).orderBy("ord").collect()] == ["2\t3\t2", "0\t2\t1.500000", "1\t0\t2.000000"]
    lines = [r.line for r in formats.row_pair_lines(cells, 3, 3).orderBy("ord").collect()]
    assert lines == ["3\t3\t2", "3\t1.500000", "1\t2.000000", ""]
    assert rows(formats.read_row_pairs(spark, put(tmp_path, "r", "\n".join(lines))), "i", "j", "v") == [(0, 2, 1.5), (1, 0, 2.0)]
    assert rows(formats.read_dense(spark, put(tmp_path, "d", "1 2\n3 4\n")), "i", "j", "v") == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    assert [r.line for r in formats.dense_lines(cells, 3).orderBy("i").collect()] == ["0.000000\t0.000000\t1.500000", "2.000000\t0.000000\t0.000000"]
    with pytest.raises(Exception, match="cells, not 2"):
        formats.read_dense(spark, put(tmp_path, "e", "1 2\n3\n")).collect()


def test_hits_pairs_and_species(spark, tmp_path):
    p = put(tmp_path, "h", "# c\nq\ts\t99.0\t10\t1\t0\t1\t10\t5\t14\t1e-5\t50\n")
    hits = formats.read_hits(spark, p)
    assert rows(hits, "query", "s_start", "bitscore") == [("q", 5, 50.0)]
    assert rows(formats.flipped(hits), "query", "q_start", "s_end") == [("s", 5, 10)]
    assert rows(formats.read_pairs(spark, put(tmp_path, "k", "a\tb\tc\nd\te\n")), "k", "v") == [("a", "b\tc"), ("d", "e")]
    rules = spark.createDataFrame([(0, "ab*", "one"), (1, "a*", "two"), (2, "*z", "three"), (3, "qq", "four")], "ord int, pattern string, species string")
    genes = spark.createDataFrame([("abx",), ("acz",), ("xz",), ("qq",)], "gene string")
    assert rows(formats.species_of(genes, rules), "gene", "species") == [("abx", "one"), ("acz", "two"), ("qq", "four"), ("xz", "three")]
    with pytest.raises(Exception, match="no species for"):
        formats.species_of(spark.createDataFrame([("m",)], "gene string"), rules).collect()


def test_reports(spark, tmp_path):
    s = "Query sequence: p1\nParsed for domains:\nModel Domain seq-f seq-t hmm-f hmm-t score E\n-----\nPF1 1/1 3 20 .. 1 18 [] 15.5 1e-4\n\nQuery sequence: p2\nParsed for domains:\n\t[no hits]\n"
    assert rows(formats.read_domains(spark, put(tmp_path, "p", s)), "query", "domain", "start", "end", "score", "evalue") == [("p1", "PF1", 3, 20, 15.5, 1e-4)]
    s = "#NEXUS\nbegin trees;\n translate\n 1 ape,\n 2 bat,\n 3 cat;\n tree t1 = [&U] ((1:1,2:1):0.5,3:2);\nend;\n"
    assert rows(formats.read_nexus_trees(spark, put(tmp_path, "n", s)), "name", "newick") == [("t1", "((ape:1,bat:1):0.5,cat:2);")]
    s = '<?xml version="1.0"?><r xmlns:go="g" xmlns:rdf="f"><go:term><go:accession>A</go:accession><go:name>n</go:name><go:is_a rdf:resource="http://x#B"/><go:part_of rdf:resource="http://x#C"/></go:term><go:term><go:accession>B</go:accession></go:term></r>'
    terms, links = formats.read_ontology(spark, put(tmp_path, "o.xml", s))
    assert rows(terms, "accession") == [("A",), ("B",)] and rows(links, "accession", "parent", "kind") == [("A", "B", "is_a"), ("A", "C", "part_of")]


def test_regions_graphs_and_trees(spark, tmp_path):
    b = formats.read_blocks(spark, put(tmp_path, "b", "s1\tc1\t1\t9\ts2\tc2\t4\t8\t-1\n"))
    line = b.select(formats.block_lines(F.col("region1"), F.col("region2"), F.col("direction"))).first()[0]
    assert line == "s1\tc1\t1\t9\ts2\tc2\t4\t8\t-1" and b.first()["name"] is None
    s = "start=0\tend=10\nname\tevent\tage\tpos\tparents\tchildren\na\tgene\t0.0\t0\tr\t\nr\trecomb\t1.0\t4\tx,y\ta\n"
    arg = formats.read_arg(spark, put(tmp_path, "g", s))
    assert rows(arg.where("name = 'r'"), "event", "pos", "parents", "children") == [("recomb", 4.0, ["x", "y"], ["a"])]
    assert sorted(r.line for r in formats.arg_lines(arg).collect())[0] == "a\tgene\t0.0\t0.0\tr\t"
    assert rows(formats.read_parent_array(spark, put(tmp_path, "pa", "2\n2\n-1\n"), ["a", "b"]), "node", "parent") == [("2", None), ("a", "2"), ("b", "2")]
    t = formats.read_trees(spark, put(tmp_path, "nw", "(a:1,b:2);\n(c,d);\n"))
    assert t.select("tree_id").distinct().count() == 2 and t.count() == 6
    assert rows(formats.read_mutations(spark, put(tmp_path, "m", "3.5\t10\ta,b\n")), "site", "carriers") == [(3.5, ["a", "b"])]
    assert rows(formats.read_tree_tracks(spark, put(tmp_path, "tt", "0\t10\t(a,b);\n")), "start", "newick") == [(0, "(a,b);")]


def test_lines_and_expressions(spark):
    g = spark.createDataFrame([("c", None, "gene", 1, 9, None, -1, None, {"b": "2", "a": "1"})], "seqname string, source string, feature string, start long, end long, score double, strand int, frame int, attrs map<string,string>")
    assert formats.gff_lines(g).first()["line"] == "c\t.\tgene\t1\t9\t.\t-\t.\ta=1;b=2"
    assert spark.range(1).select(F.lit("<&>").alias("a")).select(formats.html_rows(spark.range(1).select(F.lit("").alias("a")))).first()[0] == "<tr><td>&lt;&amp;&gt;</td></tr>"
    assert formats.parse_sexp('(a (1 2.5 "x\\"y") ; no\n b)') == [["a", [1, 2.5, 'x"y'], "b"]]
    for bad in ("(", ")"):
        with pytest.raises(ValueError, match="unbalanced"):
            formats.parse_sexp(bad)
    assert spark.createDataFrame([("(a 1)",), (None,)], "s string").select(formats.sexp_json(F.col("s")).alias("j")).collect()[0].j == '[["a", 1]]'
