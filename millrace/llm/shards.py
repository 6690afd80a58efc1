"""Sharding by a k-d tree over metadata, to near-equal bytes.

A unit is the documents of one text, so copies share a shard; its coordinates
are its metadata: length, source and language (their ranks by code point) and
id. A node that is to become m shards is split along its widest dimension,
measured against the whole table's range, at the weighted median (the quantile
of its bytes that its left half of shards is to take), until a node is one
shard. All nodes of a level are split together, and what is known of the nodes is
a small table that is joined to the units, so a plan doesn't grow with the shards.

The median is found by counting, not by sorting: every round is one aggregate
of bytes by node and bin, of which the driver sees at most ``bins`` a node; the
bin that holds the quantile is divided again until it has less than
``tolerance`` of a shard's bytes, or one value. A value that many units share
is divided by the hash of the unit.

Texts whose copies make more than ``heavy`` of a shard are placed before the
tree, whole, largest first, each in the shard that has least; there are fewer than
shards / heavy of them. The tree then fills every shard up to one level, so they
don't unbalance it. Only a text whose copies exceed a whole shard is cut: into whole
shards' worth and a rest, by a hash of its rows.

A document's slot counts the documents of its shard by hash order, by prefix
sums over hash cells, so that no window holds a shard.

Defined cases: null text has no bytes, weighs 8 and is a text of its own for each
id; repeated rows are copies; null metadata comes first; without rows there are
no shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranks, shared_dir, small_table, table, written
from .mixing import cells_for, prefix

SHARDS = 24
BINS = 2048
HEAVY = 0.02
_HASH = (-9.3e18, 9.3e18)
_SEARCH = "node int, dim int, lo double, width double, key_dim int, key_value double"
_CUTS = "node int, dim int, cut double, inclusive boolean, key_dim int, key_value double, below int, above int"


def _value(dim: Column) -> Column:
    return F.get("x", dim)


def kd_tree(units: DataFrame, n_dims: int, room: list[float], path: str, bins: int = BINS, tolerance: float = 1e-3) -> DataFrame:
    """Adds `shard` to units (bytes long, x array<double> whose last element, after n_dims dimensions, is the unit's hash).

    `room` says in what proportion the shards are to take the bytes.
    """
    spark = units.sparkSession
    ranges = units.agg(F.sum("bytes"), *(f(F.get("x", F.lit(d))) for d in range(n_dims) for f in (F.min, F.max))).first()
    units = units.withColumn("node", F.lit(0))
    spread = [max(1e-300, float(ranges[2 * d + 2] - ranges[2 * d + 1])) if ranges[0] else 1.0 for d in range(n_dims)]
    small = (ranges[0] or 0) / len(room) * tolerance
    nodes = {0: (0, len(room))}  # node: first shard, number of shards
    level = 0
    while any(m > 1 for _, m in nodes.values()):
        level += 1
        open_ = {k: v for k, v in nodes.items() if v[1] > 1}
        mine = units.join(F.broadcast(small_table(spark, [(k,) for k in open_], "node int")), "node")
        facts = {r["node"]: r for r in mine.groupBy("node").agg(F.sum("bytes").alias("b"), *(f(F.get("x", F.lit(d))).alias(f"{n}{d}") for d in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
        search = {}
        for k, r in facts.items():
            first, m = nodes[k]
            d = max(range(n_dims), key=lambda x: (r[f"hi{x}"] - r[f"lo{x}"]) / spread[x])
            lo, hi = float(r[f"lo{d}"]), float(r[f"hi{d}"])
            if hi <= lo:
                d, (lo, hi) = n_dims, _HASH
            whole = sum(room[first : first + m])
            share = sum(room[first : first + m // 2]) / whole if whole else (m // 2) / m
            search[k] = {"on": d, "lo": lo, "hi": hi, "left": r["b"] * share, "key": (None, None), "cut": None}
        # a unit is left if it is below the cut of (dimension, then hash) that was found
        while live := {k: s for k, s in search.items() if s["cut"] is None}:
            known = [(k, s["on"], s["lo"], max((s["hi"] - s["lo"]) / bins, 5e-324), *s["key"]) for k, s in live.items()]
            at = units.join(F.broadcast(small_table(spark, known, _SEARCH)), "node").withColumn("v", _value(F.col("dim")))
            at = at.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("lo") + F.col("width") * (bins + 1)) & (F.col("key_dim").isNull() | (_value(F.col("key_dim")) == F.col("key_value"))))
            cell = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.col("width"))).cast("int")
            got: dict[int, list] = {}
            for r in at.groupBy("node", cell.alias("bin")).agg(F.sum("bytes").alias("b"), F.min("v").alias("first"), F.max("v").alias("last")).collect():
                if r["first"] <= live[r["node"]]["hi"]:
                    got.setdefault(r["node"], []).append((r["bin"], r["b"], float(r["first"]), float(r["last"])))
            for k, s in live.items():
                here = None
                for c in sorted(got.get(k, [])):
                    if c[1] > s["left"]:
                        here = c
                        break
                    s["left"] -= c[1]
                if here is None:
                    s["cut"] = (s["hi"], True)
                elif here[1] <= small or here[2] >= here[3] and s["on"] == n_dims:
                    # the whole bin goes to the nearer side
                    over = s["left"] * 2 >= here[1]
                    s["cut"] = (here[3] if over else here[2], over)
                elif here[2] >= here[3]:
                    s["key"] = (s["on"], here[2])
                    s["on"], (s["lo"], s["hi"]) = n_dims, _HASH
                else:
                    s["lo"], s["hi"] = here[2], here[3]
        grown = {k: v for k, v in nodes.items() if v[1] == 1}
        number, cuts = max(nodes) + 1, []
        for k, (first, m) in open_.items():
            grown[number], grown[number + 1] = (first, m // 2), (first + m // 2, m - m // 2)
            if k in search:
                s = search[k]
                cuts.append((k, s["on"], *s["cut"], *s["key"], number, number + 1))
            number += 2
        cut = F.broadcast(small_table(spark, cuts, _CUTS))
        v, tie = _value(F.col("dim")), _value(F.col("key_dim"))
        left = F.when(F.col("inclusive"), v <= F.col("cut")).otherwise(v < F.col("cut"))
        left = F.when(F.col("key_dim").isNull(), left).otherwise((tie < F.col("key_value")) | ((tie == F.col("key_value")) & left))
        to = F.when(F.col("below").isNull(), F.col("node")).when(left, F.col("below")).otherwise(F.col("above"))
        units = written(units.join(cut, "node", "left").select(*(c for c in units.columns if c != "node"), to.alias("node")), path, f"level{level}")
        nodes = grown
    leaves = small_table(spark, [(k, first) for k, (first, _) in nodes.items()], "node int, shard int")
    return units.join(F.broadcast(leaves), "node").drop("node")


def place_heavy(sizes: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """Of (unit, bytes): the shard of each, largest first into the emptiest, and the bytes that each shard then has."""
    heap, where = [(0, s) for s in range(shards)], {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        held, s = heapq.heappop(heap)
        where[unit] = s
        heapq.heappush(heap, (held + size, s))
    held = dict((s, b) for b, s in heap)
    return where, [held[s] for s in range(shards)]


def room_left(held: list[int], more: int) -> list[float]:
    """How the shards take `more` bytes to be at one level, as far as what they hold allows."""
    level, below = 0.0, sorted(held)
    for i, b in enumerate(below):
        level = (more + sum(below[: i + 1])) / (i + 1)
        if i + 1 == len(below) or level <= below[i + 1]:
            break
    return [max(0.0, level - b) for b in held]


def shard(docs: DataFrame, *, shards: int = SHARDS, heavy: float = HEAVY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, shard, slot; `keep` names more columns to carry."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a null text is a group by its id: copies of nothing aren't copies
    key = F.when(F.col(text_col).isNull(), F.xxhash64(F.col(id_col), F.lit(3))).otherwise(F.xxhash64(text))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        key.alias("h"), F.length(text).cast("double").alias("chars"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"),
        *(F.col(c).alias(f"c_{i}") for i, c in enumerate(keep or [])),
    )
    all_rows = written(rows.withColumn("row", F.monotonically_increasing_id()), path, "rows")
    rows = all_rows.select("row", "doc_id", "size", "text_crc32", "h", "chars", "source", "lang")
    facts = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    part = max(1.0, (facts["b"] or 0) / shards)
    text_key = ["h", "text_crc32", "size"]
    groups = rows.groupBy(*text_key).agg(F.count("*").alias("n"))
    # a text above a shard: fewer than `shards` of them
    big = groups.where(F.col("n") * F.col("size") > part).select(*text_key, (F.col("n") * F.col("size") / part).alias("parts"))
    rows = rows.join(F.broadcast(big), text_key, "left")
    even = F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 11).cast("double") / float(1 << 53)
    piece = F.coalesce(F.floor(even * F.col("parts")), F.lit(0))
    rows = written(rows.withColumn("unit", F.xxhash64(*text_key, piece)).drop("parts"), path, "pieces")
    names = {}
    for c in ("source", "lang"):
        number, n = ranks(rows.select(c), path, c)
        names[c] = (number.withColumnsRenamed({"value": c, "rank": f"{c}_rank"}), n)
    units = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.min("chars").alias("chars"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("doc_id").alias("id"))
    for c, (number, n) in names.items():
        number = number.where(F.col(c).isNotNull())
        units = units.join(F.broadcast(number) if n <= 100_000 else number, c, "left")
    dims = ["chars", "source_rank", "lang_rank", "id", "unit"]
    x = F.array(*(F.coalesce(F.col(d).cast("double"), F.lit(-1.0)) for d in dims))
    units = written(units.select("unit", "bytes", x.alias("x")), path, "units")
    # fewer than shards / heavy of them
    first = units.where(F.col("bytes") > part * heavy).select("unit", "bytes").collect()
    where, held = place_heavy([tuple(r) for r in first], shards)
    light = units.where(F.col("bytes") <= part * heavy)
    room = room_left(held, (facts["b"] or 0) - sum(held))
    placed = kd_tree(light, len(dims) - 1, room, path).select("unit", "shard")
    fixed = F.broadcast(small_table(spark, list(where.items()), "unit long, shard int"))
    rows = rows.select("row", "doc_id", "size", "text_crc32", "unit")
    out = rows.join(fixed, "unit").unionByName(rows.join(fixed.select("unit"), "unit", "left_anti").join(placed, "unit"))
    cells = cells_for(facts["n"] // shards, 512)
    out = out.withColumn("order", F.xxhash64("doc_id", "row", F.lit(29))).withColumn("cell", F.pmod(F.shiftrightunsigned("order", 40), F.lit(cells)).cast("int")).withColumn("one", F.lit(1))
    out = prefix(out, "shard", cells, ["order", "doc_id", "row"], "one", "slot").select("row", "doc_id", "size", "text_crc32", "shard", "slot")
    if not keep:
        return out.drop("row")
    # carried columns are dealt out once; the narrow side is hashed, so that texts aren't sorted
    carried = all_rows.select("row", *(F.col(f"c_{i}").alias(f"c_{i}") for i in range(len(keep))))
    out = carried.join(out.hint("shuffle_hash"), "row")
    own = [c for c in ("doc_id", "size", "text_crc32", "shard", "slot") if c not in keep]
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(keep)), *own)


def op6_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
