"""Readers of codon and ancestor likelihood reports, a file in a task.

A report has sections that other programs' lines surround; a file without the
section a reader is for makes no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .formats import per_file

# How the reports' lines begin.
BY_SITE = "Bayes Empirical Bayes"
COUNTED = "Nei & Gojobori 1986"
BRANCHES = "(1) Branch lengths and substitution pattern"
ANCESTORS = "list of extant and reconstructed sequences"
CLASSES = "dN/dS for site classes (K=4)"
VALUES = {"omega (dN/dS) =": "omega", "kappa (ts/tv) =": "kappa", "tree length for dN:": "dn", "tree length for dS:": "ds", "tree length =": "length"}

SITE = re.compile(r"\s*(\d+)\s+(\S)\s+([\d.]+)\**\s+([\d.]+)(?:\s*\+-\s*([\d.]+))?\s*$")


def _after(text: str, head: str) -> list[str]:
    """The lines below the first that begins with head."""
    lines = text.splitlines()
    return next((lines[i + 1 :] for i, line in enumerate(lines) if line.startswith(head)), [])


def _block(lines: list[str], skip=lambda line: not line.strip()) -> Iterator[str]:
    """The lines up to a blank one, without those at the start that `skip` holds for."""
    begun = False
    for line in lines:
        if not begun and skip(line):
            continue
        if not line.strip():
            return
        begun = True
        yield line


def _by_site(text: str) -> Iterator[tuple]:
    for line in _block(_after(text, BY_SITE), lambda x: not SITE.match(x)):
        if m := SITE.match(line):
            yield int(m[1]), m[2], float(m[3]), float(m[4]), float(m[5]) if m[5] else None


def read_site_scores(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, letter, prob, omega, error) of the sites under selection."""
    return per_file(spark, path, _by_site, "pos long, letter string, prob double, omega double, error double")


def _values(text: str) -> Iterator[tuple]:
    model = None
    for line in text.splitlines():
        if m := re.match(r"Model (\d+)", line):
            model = int(m[1])
        elif line.startswith("lnL"):
            yield model, "lnl", float(line.split(":")[3].split()[0])
        else:
            for head, name in VALUES.items():
                if line.startswith(head):
                    yield model, name, float(line[len(head) :].split()[0])
                    break


def read_model_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, model, name, value): lnl, omega, kappa, dn, ds and length of every model; model is null before the first."""
    return per_file(spark, path, lambda text: ((None if m is None else str(m), n, v) for m, n, v in _values(text)), "model string, name string, value double")


def _counted(text: str) -> list[tuple]:
    lines = _after(text, COUNTED)
    below = next((lines[i:] for i, line in enumerate(lines) if not line.strip()), [])
    names, out = [], []
    for line in _block(below):
        name, *cells = re.sub(r"[()]", " ", line).split()
        if len(cells) != 3 * len(names):
            return []  # cut short
        out += [(name, other, *map(float, cells[3 * i : 3 * i + 3])) for i, other in enumerate(names)]
        names.append(name)
    return out


def read_pair_rates(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, omega, dn, ds) of the counted rates of every two genes; a table that is cut short makes no row."""
    return per_file(spark, path, _counted, "a string, b string, omega double, dn double, ds double")


def _branches(text: str) -> Iterator[tuple]:
    lines = _after(text, BRANCHES)
    if len(lines) < 2:
        return
    ends = [x.split("..") for x in lines[0].split()]
    yield from ((low, top, float(d)) for (top, low), d in zip(ends, lines[1].split(), strict=True))
    lows = {low for _, low in ends}
    yield from ((top, None, None) for top in dict.fromkeys(top for top, _ in ends) if top not in lows)


def read_branch_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, node, parent, dist) of the numbered nodes of a report's tree."""
    return per_file(spark, path, _branches, "node string, parent string, dist double")


def _ancestors(text: str) -> Iterator[tuple]:
    for line in _block(_after(text, ANCESTORS), lambda x: not re.search(r"[^\d\s]", x)):
        m = re.match(r"node #(\S+)\s+(.*)", line) or re.match(r"(\S+)\s+(.*)", line)
        if m:
            yield m[1], re.sub(r"\s", "", m[2])


def read_ancestors(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, seq): the given and the reconstructed sequences, these named by their node's number."""
    return per_file(spark, path, _ancestors, "name string, seq string")


def _classes(text: str) -> Iterator[tuple]:
    rows = {line.split()[0]: line.split()[1:] for line in _block(_after(text, CLASSES))}
    if rows:
        yield from ((c, float(p), float(b), float(f)) for c, p, b, f in zip(rows["site"][1:], rows["proportion"], rows["background"][1:], rows["foreground"][1:], strict=True))


def read_site_classes(spark: SparkSession, path: str) -> DataFrame:
    """(file, site_class, proportion, background, foreground) of a branch-site model."""
    return per_file(spark, path, _classes, "site_class string, proportion double, background double, foreground double")
