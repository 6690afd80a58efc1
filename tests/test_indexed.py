"""Indexed FASTA files: what is read is what was asked for, and no more."""

import random

import pytest

from millrace.sources import indexed


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("fasta")
    seqs = {f"s{i}": "".join(rng.choices("ACGT", k=n)) for i, n in enumerate([0, 1, 59, 60, 61, 5000, 200_000])}
    seqs["ünï"] = "MKV" * 50
    for part, names in enumerate((["s0", "s1", "s2", "s6"], ["s3", "s4", "s5", "ünï"])):
        end = "\r\n" if part else "\n"
        with open(folder / f"{part}.fa", "w", newline="") as f:
            f.write(f"; a comment{end}" if part else "")
            for n in names:
                f.write(f">{n} more words{end}" + "".join(seqs[n][i : i + 60] + end for i in range(0, len(seqs[n]), 60)) + (end if n == "s3" else ""))
    at = str(tmp_path_factory.mktemp("index") / "i")
    indexed.index(spark, f"{folder}/*.fa").write.parquet(at)
    return at, seqs, folder


def test_index(spark, written):
    at, seqs, _ = written
    assert {r.name: r.letters for r in spark.read.parquet(at).collect()} == {n: len(s) for n, s in seqs.items()}


@pytest.mark.parametrize(("piece", "partition"), [(1 << 16, 32 << 20), (97, 1000)])
def test_pieces_are_the_sequences(spark, written, piece, partition):
    at, seqs, _ = written
    got = {}
    for r in sorted(indexed.pieces(spark, at, piece=piece, partition=partition).collect(), key=lambda r: (r.name, r.start)):
        assert r.stop - r.start == len(r.seq) and r.start == len(got.get(r.name, ""))
        got[r.name] = got.get(r.name, "") + r.seq
    assert got == {n: s for n, s in seqs.items() if s}


def test_only_the_bytes_asked_for_are_read(spark, written):
    at, seqs, _ = written
    df = indexed.pieces(spark, at, ["s6"], 121_300, 123_500, piece=1000)
    rows = df.collect()
    assert sorted(r.start for r in rows) == [121_000, 122_000, 123_000] and sum(r.n_bytes for r in rows) < 3100
    # three pieces make one partition; all of them would make many
    assert df.rdd.getNumPartitions() == 1 < indexed.pieces(spark, at, piece=1000, partition=10_000).rdd.getNumPartitions()
    assert indexed.pieces(spark, at, ["none"]).count() == 0 == indexed.pieces(spark, at, ["s2"], 60).count()
    # a filter of Spark's own doesn't stay with the frame
    every = indexed.pieces(spark, at, piece=1000)
    assert every.where("name = 's2'").count() == 1 < every.count()


def test_ranges(spark, written):
    at, seqs, _ = written
    rng = random.Random(5)
    asked = [(i, n, s := rng.randrange(-3, len(seqs[n]) + 5), s + rng.choice([0, 1, 30, 700, 70_000])) for i, n in enumerate(rng.choices(sorted(seqs), k=80))] + [(90, "none", 0, 5), (91, None, 0, 5)]
    rows = indexed.ranges(spark, at, spark.createDataFrame(asked, "id int, name string, s int, e int"), piece=1 << 12).collect()
    # letters and the ends of the lines between, two bytes at most for 60 letters
    assert all(len(r.seq) <= r.n_bytes <= len(r.seq) * 62 // 60 + 4 for r in rows)
    got = {r.id: r.seq for r in rows}
    want = {i: seqs[n][max(0, s) : max(0, e)] for i, n, s, e in asked if n in seqs}
    assert got == {i: s for i, s in want.items() if s}


def test_uneven_lines_are_an_error(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(Exception, match="differ in length"):
        indexed.index(spark, str(tmp_path / "a.fa")).collect()
    (tmp_path / "none.fa").write_text("")
    assert indexed.index(spark, str(tmp_path / "none.fa")).count() == 0
