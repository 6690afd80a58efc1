"""Mixing sources to target weights by a low-discrepancy schedule of slots.

Slot i of the mix has the golden-ratio point frac(i * 0.618...); the source
whose stretch of the cumulative target weights holds the point fills the slot.
Slots are ranked within their source, and rank r takes block r of the
source's shuffled stream: its documents in hash order, end to end, cut into
blocks of equal numbers of words, and repeated for a second round where the
target asks for it. A document's share of the mix is what the taken blocks
cover of it, so every word is accounted for.

A source gets exactly the slots that its target needs, and its last block is
cut where the target ends: points beyond that leave their slots empty, and
slots that the points left out (of a source smaller than a block, all) follow
at the end. So each source takes its target, to the nearest word, whatever the
block.

Targets: the sources by code point (null last) weigh 3, 1, 2, repeating. They
share ``total`` times all words; a target stops at ``repeat`` times its
source's words, and the excess goes to the others by weight until none is
above. One number is found for that, the words per unit of weight, by raising
it until it settles; only sums come to the driver.

A block has 1.5 x all words / ``slots`` words, from 1 to LARGEST_BLOCK, so its
length depends on the table's words, and above that the number of slots does.

Ranks and offsets are prefix sums in two steps (sums of small cells, then
rows within a cell), so that no window holds a source, nor all sources. Points meet their
source through equal cells of the unit interval. All rows are narrow: texts
are read once, to count their words.

Defined cases: null text has no words and is taken 0 times; repeated rows are
rows of their own; rows without id are ordered by their place; without any
word all is 0. Reruns on the same files agree.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_WORD, ranks, shared_dir, table, written

WEIGHTS = (3, 1, 2)
SLOTS = 1 << 16
LARGEST_BLOCK = 4096
_CELLS = 4096

getcontext().prec = 50
_PHI = (Decimal(5).sqrt() - 1) / 2


def golden_point(i):
    """frac(i * 0.618...) of a BIGINT column; the high part's factor is reduced beforehand, to keep the digits."""
    step = 1 << 20
    high, low = F.floor(i / step).cast("double"), (i % step).cast("double")
    x = high * float(_PHI * step % 1) + low * float(_PHI)
    return x - F.floor(x)


def targets(sizes: DataFrame, total: float = 1.5, repeat: int = 2) -> DataFrame:
    """Of rows (source, source_size): adds k (its number by code point), weight and target."""
    path = shared_dir(sizes.sparkSession)
    number, n = ranks(sizes.select("source").where("source is not null"), path, "names")
    number = number.withColumnsRenamed({"value": "_name", "rank": "k"})
    t = sizes.join(F.broadcast(number) if n <= 100_000 else number, F.col("source") == F.col("_name"), "left").withColumn("k", F.coalesce("k", F.lit(n)).cast("long")).drop("_name")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS)).cast("int") + 1)
    t = written(t.withColumn("weight", weight.cast("long")), path, "sources")
    want = total * (t.agg(F.sum("source_size")).first()[0] or 0)
    unit = 0.0
    while True:  # Newton's method on a concave, piecewise linear sum: each round stops all sources that are full
        full = F.col("source_size") * repeat <= F.lit(unit) * F.col("weight")
        held, weights = t.agg(F.sum(F.when(full, F.col("source_size") * repeat).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        new = (want - held) / weights if weights else unit
        if not weights or new <= unit * (1 + 1e-15):
            break
        unit = new
    return t.withColumn("target", F.least((F.col("source_size") * repeat).cast("double"), F.lit(unit) * F.col("weight")))


def prefix(rows: DataFrame, key: str, cells: int, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the same key before each row: by `cell` (0..cells-1), then by order."""
    sums = rows.groupBy(key, "cell").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "cell", F.coalesce(F.sum("_s").over(before), F.lit(0)).cast("long").alias("_before"))
    within = Window.partitionBy(key, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long"))
    return got.join(sums, [key, "cell"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")


def cells_for(n: int, each: int) -> int:
    """A power of two of cells, for about `each` rows in one; at most 65,536."""
    return 1 << min(16, max(4, math.ceil(math.log2(max(1, n / each)))))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: float = 1.5, repeat: int = 2, slots: int = SLOTS, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken; `keep` names more columns to carry."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    carried = [F.col(c).alias(f"c_{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(ASCII_WORD)), F.lit(0)).cast("long").alias("size"), *carried)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), path, "rows")
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), total, repeat)
    by_source = written(by_source.withColumn("want", F.round("target").cast("long")), path, "targets")
    n, words = rows.count(), int(by_source.agg(F.sum("source_size")).first()[0] or 0)
    block = max(1, min(LARGEST_BLOCK, math.ceil(total * words / slots)))
    n_slots = math.ceil(total * words / block)

    # the schedule: stretches of the unit interval, met through equal cells
    stretch = by_source.where("want > 0").select("k", "want", F.lit(0).alias("all"), F.floor(F.col("k") / 1024).cast("int").alias("cell"))
    stretch = prefix(stretch, "all", 0, ["k"], "want", "lo").withColumn("hi", F.col("lo") + F.col("want"))
    whole = by_source.agg(F.sum("want")).first()[0] or 1
    stretch = stretch.select("k", (F.col("lo") / whole).alias("lo"), (F.col("hi") / whole).alias("hi"))
    stretch = stretch.withColumn("at", F.explode(F.sequence(F.floor(F.col("lo") * _CELLS), F.floor(F.col("hi") * _CELLS))))
    slot = spark.range(n_slots).select(F.col("id").alias("i"), golden_point(F.col("id")).alias("u"))
    slot = slot.withColumn("at", F.floor(F.col("u") * _CELLS))
    slot = slot.join(stretch, "at").where("u >= lo and u < hi").select("k", "i")
    n_cells = cells_for(n_slots, 512)
    slot = slot.withColumn("cell", F.floor(F.col("i") * n_cells / max(1, n_slots)).cast("int")).withColumn("one", F.lit(1))
    slot = written(prefix(slot, "k", n_cells, ["i"], "one", "block").select("k", "block"), path, "slots")
    # what the points gave too much or too little, up to the exact number
    need = by_source.withColumn("need", F.ceil(F.col("want") / block)).join(slot.groupBy("k").agg(F.count("*").alias("have")), "k", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    late = need.where("have < need").select("k", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("block"))
    slot = slot.union(late).join(by_source.select("k", "want"), "k").where(F.col("block") * block < F.col("want"))

    # the streams: each document's stretch of its source's shuffled words, in every round
    n_cells = cells_for(n, 512)
    stream = rows.where("size > 0").select("row", "doc_id", "source", "size").withColumn("h", F.xxhash64(F.coalesce("doc_id", "row"), F.lit(17)))
    stream = stream.withColumn("cell", F.pmod(F.shiftrightunsigned("h", 40), F.lit(n_cells)).cast("int"))
    known = by_source.select(F.col("source").alias("s"), "k", "source_size")
    stream = stream.join(known, F.col("source").eqNullSafe(F.col("s"))).select("row", "doc_id", "k", "size", "source_size", "h", "cell")
    stream = prefix(stream, "k", n_cells, ["h", "doc_id", "size", "row"], "size", "start")
    stream = stream.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    stream = stream.withColumn("start", F.col("start") + F.col("round") * F.col("source_size")).withColumn("end", F.col("start") + F.col("size"))
    stream = stream.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    part = F.greatest(F.lit(0), F.least(F.col("end"), (F.col("block") + 1) * block, F.col("want")) - F.greatest(F.col("start"), F.col("block") * block))
    taken = stream.join(slot, ["k", "block"]).groupBy("row").agg(F.sum(part).alias("taken"))

    out = rows.join(known.join(by_source.select("k", "target"), "k"), F.col("source").eqNullSafe(F.col("s"))).join(taken.hint("shuffle_hash"), "row", "left")
    back = [F.col(f"c_{i}").alias(c) for i, c in enumerate(keep or [])]
    own = ["doc_id"] if "doc_id" not in (keep or []) else []
    return out.select(*own, "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *back)


def op2_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
