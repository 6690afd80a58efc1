"""Parent tables and undirected graphs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared checkpoint folder and read again, so that later plans start there.

    Unlike a checkpoint's, their size is known to the planner from the files, and not guessed from
    the plan that made them, which over many rounds of joins grows out of all bounds.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        conf = sc.getConf().get("spark.checkpoint.dir")
        if not conf and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not conf:
            import tempfile

            conf = "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(conf)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def closure(tree: DataFrame, node: str = "node", parent: str = "parent", rounds: int = 30) -> DataFrame:
    """(node, ancestor, depth) with every node its own ancestor at 0; path doubling, so log2(height) rounds."""
    all_ = tree.select(node, F.col(node).alias("ancestor"), F.lit(0).alias("depth"))
    step = tree.where(F.col(parent).isNotNull()).select(node, F.col(parent).alias("ancestor"), F.lit(1).alias("depth"))
    paths, hop = all_.union(step), step
    for _ in range(rounds):
        b = hop.select(F.col(node).alias("_n"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        new = cut(hop.join(b, F.col("ancestor") == F.col("_n")).select(node, F.col("_a").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth")))
        if new.isEmpty():
            break
        far = paths.where("depth > 0").select(F.col(node).alias("_n"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        on = new.join(far, F.col("ancestor") == F.col("_n")).select(node, F.col("_a").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth"))
        paths, hop = cut(paths.union(new).union(on).distinct()), new
    else:
        raise ValueError(f"not settled after {rounds} rounds: the table has a cycle")
    return paths


def lca(paths: DataFrame, pairs: DataFrame, a: str, b: str, node: str = "node") -> DataFrame:
    """The lowest common ancestor of each pair and the number of edges between the two, from closure()."""
    up = paths.select(F.col(node).alias(a), F.col("ancestor").alias("x"), F.col("depth").alias("da"))
    down = paths.select(F.col(node).alias(b), F.col("ancestor").alias("x"), F.col("depth").alias("db"))
    met = pairs.join(up, a).join(down, [b, "x"])
    return met.groupBy(a, b).agg(F.min(F.struct("da", "db", "x")).alias("m")).select(a, b, F.col("m.x").alias("lca"), (F.col("m.da") + F.col("m.db")).alias("distance"))


#: Pairs of a node and what it leads to that go to every task, 8 bytes each.
NEAR_PAIRS = 20_000_000


def above(edges: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, depth): what each node leads to, itself at 0, over the fewest edges.

    Nodes may have several parents, and edges may lead back. Only the pairs that are new
    in a round are followed in the next one, so a node that is reached in many
    ways is one row and goes on once; where no pair is new, as at last in a cycle, it ends. The
    number of rounds is the longest of the shortest ways. Nodes that nothing leads to take no part in the
    rounds: their rows are the least of their parents' and one, in one step. Null ends are left out.
    """
    held = edges.where(F.col(node).isNotNull() & F.col(parent).isNotNull()).select(F.col(node).alias("_from"), F.col(parent).alias("_to")).distinct()
    held = cut(held)
    inner = cut(held.select(F.col("_to").alias(node)).distinct().withColumn("_id", F.monotonically_increasing_id()))
    mine = inner.select(F.col(node).alias("_from"))
    pairs = _followed(inner.select(node), held.join(mine, "_from", "left_semi"), node)
    first = held.join(mine, "_from", "left_anti")
    if first.isEmpty():
        return pairs
    own = first.select(F.col("_from").alias(node), F.col("_from").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    if pairs.count() > NEAR_PAIRS:
        step = first.join(pairs.select(F.col(node).alias("_to"), "ancestor", "depth"), "_to")
        return pairs.union(own).union(step.groupBy(F.col("_from").alias(node), "ancestor").agg(F.min(F.col("depth") + 1).alias("depth")))
    code = F.struct("_id", F.col("depth").cast("int").alias("depth"))
    lists = pairs.join(inner.select(F.col(node).alias("ancestor"), "_id"), "ancestor").groupBy(F.col(node).alias("_to")).agg(F.collect_list(code).alias("_codes"))
    return pairs.union(own).union(_least(first, lists.join(inner.select(F.col(node).alias("_to"), F.col("_id").alias("_own")), "_to"), node))


#: Entries of lists that are laid out in a task at once.
LAID = 2_000_000


def _least(edges: DataFrame, lists: DataFrame, node: str) -> DataFrame:
    """(node, ancestor, depth): for each node of edges (_from, _to) the least depth and one at which what it leads to is in the lists (_to, _own, _codes).

    The lists go to every task as arrays; a node's edges are dealt to one, and rows are only made of what is least.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = edges.schema["_from"].dataType.simpleString()
    got = lists.toArrow().combine_chunks()
    names, codes = got["_to"].combine_chunks(), got["_codes"].combine_chunks()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(codes).to_numpy().astype(np.int64))))
    ids, order = got["_own"].to_numpy(), np.argsort(got["_own"].to_numpy())
    flat = codes.flatten()
    far = order[np.searchsorted(ids, flat.field("_id").to_numpy(), sorter=order)].astype(np.int32)
    shared = edges.sparkSession.sparkContext.broadcast((names, ends, far, flat.field("depth").to_numpy().astype(np.int32)))
    # edges are distinct, so a node's lists are no more than all of them
    grouped = edges.groupBy("_from").agg(F.collect_list("_to").alias("_tos"))

    def task(batches):
        names, ends, far, depth = shared.value
        deep = int(depth.max(initial=0)) + 1
        for batch in batches:
            tos = batch.column("_tos")
            sizes = pc.list_value_length(tos).to_numpy(zero_copy_only=False).astype(np.int64)
            to = pc.index_in(tos.flatten(), value_set=names.cast(tos.type.value_type)).to_numpy(zero_copy_only=False)
            row, many = np.repeat(np.arange(len(sizes)), sizes), ends[to + 1] - ends[to]
            laid = np.bincount(row, weights=many, minlength=len(sizes)).astype(np.int64)
            group = np.cumsum(laid) // LAID
            for low, high in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]))), strict=True):
                mine = slice(*np.searchsorted(row, [low, high]))
                n, t, r = many[mine], to[mine], row[mine]
                at = np.arange(n.sum()) + np.repeat(ends[t] - (np.cumsum(n) - n), n)
                key = np.sort(((np.repeat(r, n) - low) * len(names) + far[at]) * deep + depth[at])
                pair = key // deep
                new = np.ones(len(key), dtype=bool)
                new[1:] = pair[1:] != pair[:-1]
                pair, least = pair[new], (key[new] % deep + 1).astype(np.int32)
                for start in range(0, len(pair), 100_000):
                    p = pair[start : start + 100_000]
                    cols = [batch.column("_from").take(pa.array(p // len(names) + low)), names.take(pa.array(p % len(names))), pa.array(least[start : start + 100_000])]
                    yield pa.RecordBatch.from_arrays(cols, [node, "ancestor", "depth"])

    return grouped.mapInArrow(task, f"{node} {kind}, ancestor {kind}, depth int")


def _followed(nodes: DataFrame, held: DataFrame, node: str) -> DataFrame:
    """above() of the nodes over edges (_from, _to), a table written in every round."""
    held = cut(held)
    fresh = cut(nodes.select(node, F.col(node).alias("ancestor"), F.lit(0).alias("depth")))
    found = [fresh]
    while not fresh.isEmpty():
        step = fresh.join(held, F.col("ancestor") == F.col("_from")).select(node, F.col("_to").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct()
        known = reduce(DataFrame.union, found).select(node, "ancestor")
        fresh = cut(step.join(known, [node, "ancestor"], "left_anti"))
        found.append(fresh)
    return reduce(DataFrame.union, found)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(item, component): the smallest item that edges lead to, by alternating stars."""
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    nodes = edges.select(F.col(a).alias("item")).union(edges.select(F.col(b).alias("item"))).distinct()
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(now.withColumnRenamed("a", "item"), "item", "left").select("item", F.coalesce("b", "item").alias("component"))
