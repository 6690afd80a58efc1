import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, intervals, relational
from millrace.sources import text


def test_table_types(spark, tmp_path):
    p = tmp_path / "t.tab"
    p.write_text("##types:str\tint\tfloat\tbool\nname\tnum\treal\ttruth\n# a note\n\nmatt\t-123\t10.0\ttrue\nalex\t456\t2.5\tfalse\n")
    df = text.read_table(spark, str(p))
    assert df.dtypes == [("name", "string"), ("num", "bigint"), ("real", "double"), ("truth", "boolean")]
    assert sorted(map(tuple, df.collect())) == [("alex", 456, 2.5, False), ("matt", -123, 10.0, True)]


def test_table_guess_and_override(spark, tmp_path):
    p = tmp_path / "t.tab"
    p.write_text("name\tnum\ttext\ttruth\njohn\t-10\t1a\ttrue\n")
    assert [k for _, k in text.read_table(spark, str(p)).dtypes] == ["string", "bigint", "string", "boolean"]
    assert [k for _, k in text.read_table(spark, str(p), guess=False).dtypes] == ["string"] * 4
    assert text.read_table(spark, str(p), types={"truth": "str"}).first()["truth"] == "true"


def test_table_errors(spark, tmp_path):
    p = tmp_path / "a.tab"
    p.write_text("num\tnum\n1\t2\n")
    with pytest.raises(text.TableError):
        text.read_table(spark, str(p))
    p = tmp_path / "b.tab"
    p.write_text("a\tb\n1\t2\n3\t4\t5\n")
    with pytest.raises(Exception, match="wrong number of cells"):
        text.read_table(spark, str(p)).collect()
    p = tmp_path / "c.tab"
    p.write_text("a\tb\n1\t2\nx\t4\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.read_table(spark, str(p)).collect()


def test_table_lines(spark):
    df = spark.createDataFrame([(1, None, True, 10.0)], "a long, b string, c boolean, d double")
    assert df.select(text.table_lines(df)).first()[0] == "1\t\tTrue\t10.0"


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">a first\nACG\nTT\n>b\nGG\n")
    rows = sorted(map(tuple, text.read_fasta(spark, str(p)).collect()))
    assert rows == [("a", "a first", "ACGTT"), ("b", "b", "GG")]
    df = spark.createDataFrame([("a", "ACGTT")], "n string, s string")
    assert df.select(text.fasta_lines(F.col("n"), F.col("s"), 2)).first()[0] == ">a\nAC\nGT\nT"


def test_gff(spark, tmp_path):
    p = tmp_path / "x.gff"
    p.write_text("# note\nctg\t.\tmRNA\t10\t90\t.\t+\t.\tID=m1;Parent=g1,g2;Note=a=b\n")
    df = text.read_gff(spark, str(p))
    r = df.first()
    assert (r["seqname"], r["source"], r["start"], r["strand"], r["attrs"]["Note"]) == ("ctg", None, 10, 1, "a=b")
    assert sorted(map(tuple, text.gff_parents(df).collect())) == [("m1", "g1"), ("m1", "g2")]


def test_newick(spark):
    rows = text.parse_newick("((a:1,b:2[&&NHX:k=v])x:3,(a,));")
    assert [(r[0], r[1], r[3]) for r in rows] == [("1", None, None), ("x", "1", 3.0), ("a", "x", 1.0), ("b", "x", 2.0), ("2", "1", None), ("a_1", "2", None), ("3", "2", None)]
    assert rows[3][4] == {"k": "v"}
    df = text.newick_nodes(spark.createDataFrame([("t", "(a,b);")], "tree_id string, newick string"))
    assert df.count() == 3
    deep = "(" * 5000 + "a" + ")" * 5000 + ";"
    assert len(text.parse_newick(deep)) == 5001


def test_interval_union(spark):
    rows = [(0, i, *x) for i, x in enumerate([(1, 10), (2, 4), (2, 5), (12, 20), (13, 22)])]
    df = spark.createDataFrame(rows, "k int, id int, s long, e long")
    assert sorted(map(tuple, intervals.union(df, ["k"], "id").collect())) == [(0, 1, 10, 3), (0, 12, 22, 2)]


def test_components_and_lca(spark):
    df = spark.createDataFrame([(1, 2), (3, 4), (4, 5), (5, 6), (6, 7)], "a long, b long")
    assert dict(map(tuple, graph.components(df).collect())) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3}


def test_join_tables(spark):
    a = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    b = spark.createDataFrame([(1, 5), (9, 6)], "a2 int, d int")
    assert [tuple(r) for r in relational.join_tables((a, "a"), (b, "a2")).select("a", "b", "d").collect()] == [(1, 2, 5)]
    twice = b.union(b)
    with pytest.raises(Exception, match="duplicate key"):
        relational.join_tables((a, "a"), (twice, "a2")).select("d").collect()
    assert relational.join_tables((a, "a"), (twice, "a2"), on_duplicates="last").count() == 1


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_long_comments_and_repeated_headers(spark, tmp_path):
    f = tmp_path / "x.tab"
    f.write_text("# note\n" * 250 + "##types:string\tint\n\nname\tn\na\t1\nname\t2\n# later\nb\t3\n")
    assert [tuple(r) for r in text.read_table(spark, str(f)).collect()] == [("a", 1), ("name", 2), ("b", 3)]
    assert [tuple(r) for r in text.read_table(spark, str(f), names=["p", "q"], types={"q": "string"}).collect()][:2] == [("name", "n"), ("a", "1")]


def test_lists_and_labels(spark, tmp_path):
    for n in ("b.txt", "a.txt", "c.tab"):
        (tmp_path / n).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in text.list_files(spark, str(tmp_path), ".txt").collect()] == ["a.txt", "b.txt"]
    m = tmp_path / "m" / "x.tab"
    m.parent.mkdir()
    m.write_text("row\tc1\tc2\nr1\t1\t2\nr2\t3\t4\n")
    assert sorted(map(tuple, text.read_labelled_dense(spark, str(m)).collect())) == [("r1", "c1", 1.0), ("r1", "c2", 2.0), ("r2", "c1", 3.0), ("r2", "c2", 4.0)]


def test_tree_tables(spark, tmp_path):
    recon = spark.createDataFrame([("g1", "s1", "gene"), ("1", "s", "dup")], "node string, snode string, event string")
    for events in (True, False):
        at = str(tmp_path / f"r{events}")
        text.recon_lines(recon, events).write.text(at)
        want = recon.collect() if events else [(a, b, None) for a, b, _ in recon.collect()]
        assert sorted(map(tuple, text.read_recon(spark, at).collect())) == sorted(map(tuple, want))
    nodes = spark.createDataFrame([("r", None, 0.0, {"k": "1"}), ("a", "r", 2.5, {})], "node string, parent string, dist double, data map<string,string>")
    text.parent_lines(nodes).write.text(str(tmp_path / "p"))
    assert sorted(text.read_parents(spark, str(tmp_path / "p")).collect()) == [("a", "r", 2.5), ("r", None, 0.0)]
    assert [r["value"] for r in text.parent_lines(nodes, ["k"]).collect()] == ["r\t-1\t0.0\t1", "a\tr\t2.5\t"]
