import pytest

from millrace.sources import results

REPORT = """\
program, version

Nei & Gojobori 1986. dN/dS (dN, dS)
(Note: something.)

mouse
rat                  0.2500 (0.0500 0.2000)
human                0.1000 (0.0300 0.3000) 0.5000 (0.1000 0.2000)

Model 0: one-ratio

lnL(ntime:  4  np:  6):  -1200.500000      +0.000000
tree length =   1.25
kappa (ts/tv) =  2.50
omega (dN/dS) =  0.31
tree length for dN:       0.2100
tree length for dS:       0.6800

Model 1: NearlyNeutral
lnL(ntime:  4  np:  7):  -1190.250000      +0.000000

Model 2: PositiveSelection
lnL(ntime:  4  np:  9):  -1185.000000      +0.000000

Bayes Empirical Bayes (BEB) analysis (a reference)
Positively selected sites (*: P>95%; **: P>99%)
(amino acids refer to 1st sequence: mouse)

            Pr(w>1)     post mean +- SE for w

    12 K      0.991**       3.500 +- 1.250
    40 S      0.620         2.100 +- 1.500

    99 T      0.500         1.000 +- 1.000

(1) Branch lengths and substitution pattern
   4..1    4..5    5..2    5..3
   0.10    0.20    0.30    0.40

dN/dS for site classes (K=4)

site class             0        1       2a       2b
proportion       0.70000  0.20000  0.08000  0.02000
background w     0.10000  1.00000  0.10000  1.00000
foreground w     0.10000  1.00000  4.50000  4.50000

list of extant and reconstructed sequences

   3   6

mouse        ACG TTT
node #4      ACG TTA

after
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("reports")
    (d / "whole.txt").write_text(REPORT)
    (d / "none.txt").write_text("nothing\n")
    (d / "cut.txt").write_text("Nei & Gojobori 1986.\n\nmouse\nrat   0.25 (0.05\n")
    return str(d)


def rows(df):
    return [tuple(r)[1:] for r in df.collect()]


def test_reports(spark, files):
    assert rows(results.read_site_scores(spark, files)) == [(12, "K", 0.991, 3.5, 1.25), (40, "S", 0.62, 2.1, 1.5)]
    assert rows(results.read_pair_rates(spark, files)) == [("rat", "mouse", 0.25, 0.05, 0.2), ("human", "mouse", 0.1, 0.03, 0.3), ("human", "rat", 0.5, 0.1, 0.2)]
    got = rows(results.read_model_values(spark, files))
    assert got == [("0", "lnl", -1200.5), ("0", "length", 1.25), ("0", "kappa", 2.5), ("0", "omega", 0.31), ("0", "dn", 0.21), ("0", "ds", 0.68), ("1", "lnl", -1190.25), ("2", "lnl", -1185.0)]
    assert rows(results.read_branch_numbers(spark, files)) == [("1", "4", 0.1), ("5", "4", 0.2), ("2", "5", 0.3), ("3", "5", 0.4), ("4", None, None)]
    assert rows(results.read_ancestors(spark, files)) == [("mouse", "ACGTTT"), ("4", "ACGTTA")]
    assert rows(results.read_site_classes(spark, files)) == [("0", 0.7, 0.1, 0.1), ("1", 0.2, 1.0, 1.0), ("2a", 0.08, 0.1, 4.5), ("2b", 0.02, 1.0, 4.5)]
