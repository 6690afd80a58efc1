import pytest
from pyspark.sql import functions as F

from millrace.operators import relational
from millrace.plans import sqlfiles


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.tab").write_text("name\tage\nmatt\t30\nalex\t40\n")
    (tmp_path / "b.tab").write_text("who\tjob\nalex\tcook\n")
    return [str(tmp_path / "a.tab"), f"jobs={tmp_path / 'b.tab'}"]


def test_sql(spark, files):
    out = sqlfiles.sql(spark, files, "SELECT name, age, job FROM a LEFT JOIN jobs ON name = who ORDER BY age", headers=["n", "a", "j"])
    assert [tuple(r) for r in out.collect()] == [("matt", 30, None), ("alex", 40, "cook")] and out.columns == ["n", "a", "j"]
    assert sqlfiles.sql(spark, files, "SELECT * FROM a", max_rows=1).count() == 1
    assert dict(sqlfiles.sql(spark, files[:1], "SELECT age FROM a", types={"age": "str"}).dtypes)["age"] == "string"


def test_command(spark, files, capsys):
    sqlfiles.main(["-i", files[0], "-f", "age:float", "SELECT name, age FROM a WHERE age > 35"])
    assert capsys.readouterr().out == "name\tage\nalex\t40.0\n"


def test_parts(spark):
    m = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "x"), (2, "d", "x"), (3, "e", "x")], "part int, gene string, sp string")
    assert sorted(r.gene for r in relational.one_to_ones(m, "part", "sp").collect()) == ["a", "b"]
    fam = relational.families(m, "part", "gene", 10)
    assert sorted(map(tuple, fam.collect())) == [(10, "a,b"), (11, "c,d"), (12, "e")]
    assert relational.family_members(fam).where(F.col("gene") == "d").first()["famid"] == 11
    other = m.select((F.col("part") * 10).alias("part"), "gene").where("gene <> 'e'")
    assert sorted(map(tuple, relational.same_parts(m.select("part", "gene"), other, "gene", "part").collect())) == [(1, 10), (2, 20)]


def test_many_views(spark, files):
    names = sqlfiles.add_views(spark, [files[0]] * 28)
    assert len(names) == 28 and names[25:] == ["z", "aa", "ab"]
    with pytest.raises(ValueError, match="two inputs"):
        sqlfiles.add_views(spark, [files[0], f"A={files[0]}"])
