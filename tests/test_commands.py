import io

import pytest

from millrace.plans import commands

GENES = "((a1:1,b1:1):1,(a2:1,c1:1):2);"
SPECIES = "((a:1,b:1):1,c:2);"


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


@pytest.fixture
def species(put):
    return ["-s", put("s.nwk", SPECIES), "-S", put("s.map", "a*\ta\nb*\tb\nc*\tc\n")]


def run(*args):
    out = io.StringIO()
    commands.main(list(args), out)
    return out.getvalue().splitlines()


def test_lines(spark, put):
    f = put("x.txt", "b\na\nb\n")
    assert run("hist", f) == ["b\t2\t66.666667", "a\t1\t33.333333"]
    assert sorted(run("connected-comp", put("c.tab", "x\ty\nz\ty\nq\n"))) == ["q", "x\ty\tz"]
    assert run("union-regions", put("r.tab", "c1\t1\t5\nc1\t4\t9\nc1\t20\t30\nc2\t1\t2\n")) == ["1\tc1\t1\t5", "1\tc1\t4\t9", "2\tc1\t20\t30", "3\tc2\t1\t2"]
    assert sorted(run("runpar", "-n", "2", "-c", "tr a-z A-Z", f)) == ["A", "B", "B"]


def test_hits(spark, put):
    f = put("h.tab", "q\ts\t5\nq\tt\t7\nr\tt\t9\nz\ts\t0\n")
    assert sorted(run("blastbest", "-c", "0,1,2", f)) == ["q\tt\t7", "r\tt\t9"]
    assert sorted(run("bestbidir", "-c", "0,1,2", f)) == ["r\tt\t9"]


def test_sequences(spark, put, tmp_path):
    one, two = put("1.fa", ">x\nAC-T\n>y\nA--T\n"), put("2.fa", ">x\nGG\n>z\nCC\n")
    assert sorted(run("catalign", one, two)) == sorted([">x", "AC-TGG", ">y", "A--TNN", ">z", "NNNNCC"])
    assert sorted(run("align-filter", "-r", "0.5", one)) == sorted([">x", "ACT", ">y", "A-T"])
    assert run("fasta-convert", "-t", "tab", two) == ["x\tGG", "z\tCC"]
    assert len(run("samplealign", one)) == 4
    assert run("revtrans", "-d", put("d.fa", ">p\nATGTGG\n"), put("p.fa", ">p\nM-W\n")) == [">p", "ATG---TGG"]
    assert run("partfasta", "-f", put("f.txt", "f1 x z\nf2 x\n"), "-o", str(tmp_path / "out"), two) == ["f1\t2", "f2\t1"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["famid=f1", "famid=f2"]


def test_matrix(spark, put, tmp_path):
    got = run("matrix-convert", "-l", str(tmp_path / "labels"), put("m.txt", "r1 c1 2\nr2 c2 3\n"))
    assert got[0].split()[:2] == ["2", "2"] and len(got) == 3


def test_trees(spark, put):
    f = put("g.nwk", GENES)
    assert run("tree-eq", f, put("h.nwk", "((c1,a2),(b1,a1));")) == ["0\ttrue"]
    assert float(run("tree-rf", f, f)[0].split("\t")[1]) == 0
    table = run("tree-convert", "-t", "table", f)
    assert len(table) == 7 and sum("\t-1\t" in x for x in table) == 1
    assert run("tree-convert", "--from-table", put("t.tab", "\n".join(table))) == run("tree-convert", f)
    assert run("tree-hashorder", f) == run("tree-hashorder", put("i.nwk", "((c1:1,a2:1):2,(b1:1,a1:1):1);"))
    assert run("tree-unroot", put("u.nwk", "((a:1,b:1):1,c:2);"))[0].count("(") == 1
    cons = run("treecons", put("k.nwk", "((a,b),(c,d));((a,b),(c,d));((a,c),(b,d));"))
    assert "(a:1.000000,b:1.000000)" in cons[0] or "(c:1.000000,d:1.000000)" in cons[0]
    assert run("treeboot", "-b", f, f)


def test_gene_trees(spark, put, species):
    f = put("g.nwk", GENES)
    events = {x.split("\t")[1]: x.split("\t")[3] for x in run("mpr", *species, f)}
    assert sorted(events.values()) == ["dup", "gene", "gene", "gene", "gene", "spec", "spec"]
    assert run("recon", *species, f) == run("mpr", *species, f)
    assert sorted(x.split("\t")[:2] for x in run("tree-orth", *species, f)) == [["a1", "b1"], ["a2", "c1"]]
    assert sorted(x.split("\t") for x in run("tree-paralog", *species, f)) == [["a1", "a2"], ["a1", "c1"], ["a2", "b1"], ["b1", "c1"]]
    total = [x.split("\t") for x in run("tree-events", *species, f)]
    each = [x.split("\t")[1:] for x in run("tree-events", "-f", *species, f)]
    assert sum(int(x[2]) for x in total) == 1 and [x for x in total if x[1:] != ["0"] * 3] == [x for x in each if x[1:] != ["0"] * 3]
    assert run("dupconsistency", *species, f)[0].split("\t")[2] == "0.3333333333333333"
    kinds = [x.split("\t")[0] for x in run("tree-relations", *species, f)]
    assert {k: kinds.count(k) for k in ("gene", "dup", "spec")} == {"gene": 4, "dup": 1, "spec": 2} and kinds.count("loss") == sum(int(x[3]) for x in total)
    assert len(run("reconroot", *species, f)) == 1 and len(run("reconroot", "-m", *species, f)) == 1
    grown = run("stree2gtrees", "-p", put("p.txt", "f1 a1 b1 c1\nf2 a1 a2\n"), *species[2:], species[1])
    assert len(grown) == 1 and "a1" in grown[0] and "c1" in grown[0]
    assert len(run("sim-tree", "-n", "3", "-b", "0.1", "-e", "0.05", species[1])) == 3


def test_files(spark, put, tmp_path):
    put("d/f1/f1.tree", "x")
    put("d/f2/f2.align", "x")
    assert [x.rsplit("/", 1)[1] for x in run("phylofiles", "-e", ".tree", str(tmp_path / "d"))] == ["f1.tree"]
    assert [x.rsplit("/", 1)[1] for x in run("phylofiles", "-n", "-e", ".tree", str(tmp_path / "d"))] == ["f2"]


def test_synteny(spark, put):
    rows = [(i, "x", i * 10, i * 10 + 5, "y", i * 10, i * 10 + 5, 1) for i in (0, 1, 2, 50)]
    f = put("s.tab", "\n".join(["id\tchrom1\ts1\te1\tchrom2\ts2\te2\tstrand", *("\t".join(map(str, r)) for r in rows)]))
    assert sorted(run("find-synteny-orth", "-r", "6", "-t", "neighbours", f)) == ["0\t1", "1\t2", "2\t1", "50\t0"]
    assert sorted(x.split("\t")[0] for x in run("find-synteny-orth", "-r", "6", "-t", "best", f)) == ["0", "1", "2"]
