"""SQL over tab tables: python -m millrace.plans.sqlfiles -i people.tab -i b=jobs.tab "SELECT ... FROM a JOIN b".

Inputs are views named a, b, c, ... or as given; rows go out as they come, so
a result needn't fit in the driver.
"""

from __future__ import annotations

import argparse
import itertools
import string
import sys
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from ..sources import text


def letters() -> Iterator[str]:
    """a, b, ..., z, aa, ab, ..."""
    return ("".join(x) for n in itertools.count(1) for x in itertools.product(string.ascii_lowercase, repeat=n))


def add_views(spark: SparkSession, inputs: Iterable[str], types: dict[str, str] | None = None, delim: str = "\t", header: bool = True) -> list[str]:
    """Registers `path` or `name=path` inputs and returns the views' names; a name given twice is an error."""
    names = []
    for letter, item in zip(letters(), inputs, strict=False):
        name, _, path = item.rpartition("=")
        name = name or letter
        if name.lower() in (n.lower() for n in names):
            raise ValueError(f"two inputs are named {name}")
        text.read_table(spark, path, delim=delim, types=types, header=header).createOrReplaceTempView(name)
        names.append(name)
    return names


def sql(spark: SparkSession, inputs: Iterable[str], query: str, max_rows: int | None = None, headers: list[str] | None = None, **kw) -> DataFrame:
    """The result of a query over files; headers rename its columns, max_rows is the caller's limit."""
    add_views(spark, inputs, **kw)
    out = spark.sql(query)
    out = out.toDF(*headers) if headers else out
    return out.limit(max_rows) if max_rows is not None else out


def sql_put(df: DataFrame, name: str, overwrite: bool = True) -> None:
    """The rows as a table of the session's catalogue; an existing one is replaced or, without overwrite, added to."""
    df.write.mode("overwrite" if overwrite else "append").saveAsTable(name)


def print_table(df: DataFrame, out: TextIO, header: bool = True, delim: str = "\t") -> None:
    if header:
        print(delim.join(df.columns), file=out)
    for row in df.select(text.table_lines(df, delim).alias("line")).toLocalIterator():
        print(row["line"], file=out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sqlfiles", description="SQL over tab tables")
    p.add_argument("-i", "--input", action="append", default=[], metavar="[NAME=]FILE")
    p.add_argument("-f", "--fields", action="append", default=[], metavar="COLUMN:TYPE")
    p.add_argument("-d", "--delim", default="\t")
    p.add_argument("-H", "--no-header", action="store_true", help="neither read nor print header lines")
    p.add_argument("query", nargs="+")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sqlfiles").getOrCreate()
    add_views(spark, a.input, types=dict(f.rsplit(":", 1) for f in a.fields), delim=a.delim, header=not a.no_header)
    for q in a.query:
        print_table(spark.sql(q), sys.stdout, header=not a.no_header, delim=a.delim)


if __name__ == "__main__":
    main()
