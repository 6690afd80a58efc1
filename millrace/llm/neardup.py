"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A document's set is its shingles of five words (fewer words: all of them as
one). A forest has 32 tries. A document's label in a trie is 12 minimum hashes,
a byte each, and the trie is its labels in sorted order: the labels of all tries
are sorted by ranges, and a task finds its trie cells, the runs of labels with
a common prefix of 7 to 12, by comparing neighbours. A cell cut by the edge of
a range is put together from counts, of which there are a few for each range.

A document's prefix in a trie starts at the longest and is shortened as long
as the cell has at most ``crowd`` members. Where that leaves the chance to meet a
partner at the similarity bound, 1 - (1 - 0.8^depth) x ... over the tries, below
``recall``, all its prefixes in crowded cells are shortened further, level by level,
until the estimate meets it. So most documents are searched with prefixes of 7,
and those of large clusters with longer ones, as far as recall allows.

Equal texts are one node with a number of copies. The nodes of a cell in use are
tied to its smallest node, so a cell of any size makes one row a member;
connected cells are candidate groups. A group's texts are fetched and shingled once,
cut into blocks by number and size, and every two blocks of a group are verified
together in one task: all their pairs, exactly, by counting common shingles as a
matrix product. Only a node's number of links and its smallest partner leave
the task, never the pairs. Where one key (a text, a class, a hub of the
components) may hold many rows, those rows meet their value by broadcast.

Defined cases: null and wordless texts have no shingles, no links and a class
of their own; equal texts with words are linked, as are repeated rows; the
class is named by its smallest id, null ids aside. Of rows given more than once
under one id and text, one_of_each keeps that of the smallest hash of all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_split, shared_dir, table, written
from .decontam import words

SHINGLE, SIMILARITY = 5, (4, 5)
TREES, LONGEST, SHORTEST, CROWD, RECALL = 32, 12, 7, 64, 0.995
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << max(16, n.bit_length())
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    toks = words(text)
    if not toks:
        return np.zeros(0, np.uint64)
    k = min(k, len(toks))
    raw = np.frombuffer(b" ".join(toks), np.uint8).astype(np.uint64)
    up, down = _tables(len(raw) + 1)
    n = np.fromiter(map(len, toks), np.int64, len(toks))
    end = np.cumsum(n + 1) - 1
    start = end - n
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * up[: len(raw)], out=total[1:])
    a, b = start[: len(toks) - k + 1], end[k - 1 :]
    h = (total[b] - total[a]) * down[a]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


class Forest:
    """The labels of a set: in each tree a byte of each of its minimum hashes."""

    def __init__(self, trees: int = TREES, depth: int = LONGEST, seed: int = 41):
        rng = np.random.default_rng(seed)
        n = trees * depth
        self.a = rng.integers(0, 1 << 32, n, np.uint32)[:, None] | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, np.uint32)[:, None]

    def labels(self, h: np.ndarray) -> bytes:
        x = (h >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 256):
            np.minimum(low, (self.a * x[i : i + 256] + self.b).min(axis=1), out=low)
        low ^= low >> np.uint32(15)
        return ((low * np.uint32(0x2C1B3C6D)) >> np.uint32(24)).astype(np.uint8).tobytes()


def trie_cells(tree: np.ndarray, label: np.ndarray, node: np.ndarray, shortest: int) -> tuple[np.ndarray, ...]:
    """Of sorted labels (n x longest bytes): size, cell name, smallest node and whether it may go on beyond
    the rows, of every row's cell at each prefix length from shortest to longest (n x lengths)."""
    n, longest = label.shape
    other = label[1:] != label[:-1]
    common = np.where(other.any(1), other.argmax(1), longest)
    common[tree[1:] != tree[:-1]] = 0
    name = (tree.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    out = tuple(np.zeros((n, longest - shortest + 1), t) for t in (np.int64, np.int64, np.int64, bool))
    for x in range(1, longest + 1):
        name = (name ^ (label[:, x - 1].astype(np.uint64) + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
        name ^= name >> np.uint64(29)
        if x >= shortest:
            start = np.concatenate(([0], np.flatnonzero(common < x) + 1))
            cell = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
            out[0][:, x - shortest] = np.diff(np.append(start, n))[cell]
            out[1][:, x - shortest] = name.view(np.int64)
            out[2][:, x - shortest] = np.minimum.reduceat(node, start)[cell]
            out[3][:, x - shortest] = (cell == 0) | (cell == len(start) - 1)
    return out


def candidates(nodes: DataFrame, path: str, *, trees: int = TREES, longest: int = LONGEST, shortest: int = SHORTEST, crowd: int = CROWD, recall: float = RECALL, part_rows: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Of nodes (node, labels): edges (a, b) that connect what shares a cell in use, and (node, tree, depth)
    of the prefixes in use where a cell has other members at the shortest."""
    spark, levels = nodes.sparkSession, longest - shortest + 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() * trees // part_rows)
    leaf = nodes.select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    leaf = leaf.select("tree", F.expr(f"substring(labels, tree * {longest} + 1, {longest})").alias("label"), "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                raw = batch.column("label")
                at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
                bytes_ = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, longest).copy()
                held.append((batch.column("tree").to_numpy(), bytes_, batch.column("node").to_numpy()))
        if not held:
            return
        tree, label, node = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        size, cell, centre, open_ = trie_cells(tree, label, node, shortest)
        plain = ~open_[:, 0] & (size[:, 0] <= crowd)
        for rows, k in ((np.flatnonzero(plain & (size[:, 0] > 1)), 1), (np.flatnonzero(~plain), levels)):
            for i in range(0, len(rows), 1 << 15):
                r = rows[i : i + (1 << 15)]
                at = pa.array(np.arange(0, len(r) * k + 1, k, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x[r, :k].ravel())) for x in (size, cell, centre, open_)]
                yield pa.RecordBatch.from_arrays([pa.array(node[r]), pa.array(tree[r]), *lists], ["node", "tree", "size", "cell", "centre", "open"])

    sorted_ = leaf.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    tries = written(sorted_.mapInArrow(scan, "node bigint, tree int, size array<bigint>, cell array<bigint>, centre array<bigint>, open array<boolean>"), path, "tries")
    # cells that a range's edge may cut: two for each range and length at most
    cut = tries.where(F.exists("open", lambda x: x))
    each = cut.select("node", "tree", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(levels - 1)).alias("k"), "size", "cell", "centre", "open")).alias("x")).select("node", "tree", "x.*")
    whole = each.where("open").groupBy("cell").agg(F.count("*").alias("all"), F.min("node").alias("first"))
    each = each.join(F.broadcast(whole), "cell", "left").select("node", "tree", F.struct("k", F.coalesce("all", "size").alias("size"), "cell", F.coalesce("first", "centre").alias("centre")).alias("x"))
    mended = each.groupBy("node", "tree").agg(F.sort_array(F.collect_list("x")).alias("x")).select("node", "tree", F.col("x.size").alias("size"), F.col("x.cell").alias("cell"), F.col("x.centre").alias("centre"))
    tries = tries.where(~F.exists("open", lambda x: x)).drop("open").unionByName(mended).where(F.get("size", F.lit(0)) > 1)
    fits = F.array_position(F.transform("size", lambda x: x <= crowd), True).cast("int")
    tries = written(tries.withColumn("level", F.when(fits == 0, levels).otherwise(fits) - 1), path, "levels")

    # by how many levels the prefixes in crowded cells must be shortened for the recall that is asked
    miss = F.array(*(F.lit(float(np.log1p(-((SIMILARITY[0] / SIMILARITY[1]) ** (shortest + k))))) for k in range(levels)))
    crowded = tries.where("level > 0")
    sums = crowded.groupBy("node").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get(miss, F.greatest(F.lit(0), F.col("level") - d))) for d in range(levels))).alias("missed"))
    free = F.get(miss, F.lit(0)) * (trees - F.col("n"))
    enough = F.array_position(F.transform("missed", lambda m: m + free <= float(np.log(1 - recall))), True).cast("int")
    less = sums.select("node", (F.when(enough == 0, levels).otherwise(enough) - 1).alias("less"))
    deep = crowded.join(less.hint("merge"), "node").withColumn("use", F.greatest(F.lit(0), F.col("level") - F.col("less")))
    used = deep.where("use < level").select(F.get("cell", "use").alias("cell"), F.get("size", "use").alias("n")).distinct()
    member = crowded.select("node", F.explode(F.slice(F.arrays_zip("cell", "centre"), F.lit(1), F.col("level"))).alias("x")).select("node", "x.cell", "x.centre")
    more = join_split(member, written(used, path, "used"), ["cell"], "n", nodes.count() * trees)
    edges = tries.select(F.col("node").alias("a"), F.get("centre", "level").alias("b"), F.get("size", "level").alias("n")).where("n > 1").drop("n")
    depths = tries.where("level = 0").select("node", "tree", F.lit(shortest).alias("depth")).union(deep.select("node", "tree", F.col("use") + shortest))
    return edges.union(more.select(F.col("node").alias("a"), F.col("centre").alias("b"))), depths


def components(edges: DataFrame, path: str, name: str, rounds: int = 200) -> DataFrame:
    """(node, root) of every node of edges (a, b), by alternating large and small stars; root is the smallest node."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path, f"{name}0")
    seen, n = None, now.count()
    for step in range(1, rounds + 1):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = join_split(both, low, ["a"], "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, path, f"{name}{step}large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_split(large, low, ["a"], "n", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(small, path, f"{name}{step}")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == state:
            break
        seen, n = state, state[0]
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _links(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Which of rows x cols are similar enough; exact."""
    n = np.array([len(s) for s in sets], np.int64)
    seen, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.full(len(seen), -1, np.int64)
    shared = np.flatnonzero(times > 1)
    place[shared] = np.arange(len(shared))
    owner, at = np.repeat(np.arange(len(sets)), n), place[at]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(rows), len(cols)), np.float32)
    for a in range(0, len(shared), 2048):
        i, j = np.searchsorted(at, (a, a + 2048))
        m = np.zeros((len(sets), min(2048, len(shared) - a)), np.float32)
        m[owner[i:j], at[i:j] - a] = 1
        common += m[rows] @ m[cols].T
    common = common.astype(np.int64)
    union = n[rows][:, None] + n[cols][None, :] - common
    num, den = SIMILARITY
    return den * common >= num * union


def _verify(group: list[tuple[int, int, int, np.ndarray]], i: int, j: int) -> list[tuple[int, int, int]]:
    """Of (node, copies, block, set): (node, smallest node of its part here, links) for linked nodes."""
    node, copies, block = (np.array([g[k] for g in group], np.int64) for k in range(3))
    rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(rows) or not len(cols):
        return []
    near = _links([g[3] for g in group], rows, cols)
    if i == j:
        np.fill_diagonal(near, False)
    links = np.zeros(len(group), np.int64)
    links[rows] += near @ copies[cols]
    if i != j:
        links[cols] += near.T @ copies[rows]
    root = node.copy()
    while True:  # smallest label among neighbours, until it settles
        top = np.iinfo(np.int64).max
        new = root.copy()
        np.minimum.at(new, rows, np.where(near, root[cols][None, :], top).min(axis=1))
        np.minimum.at(new, cols, np.where(near, root[rows][:, None], top).min(axis=0))
        if (new == root).all():
            break
        root = new
    return [(int(a), int(b), int(c)) for a, b, c in zip(node, root, links, strict=True) if c]


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, crowd: int = CROWD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, key (of its text), class_id, n_links (documents at the bound or above)."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("key"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees)
        for batch in batches:
            got = [shingles(t.as_py()) for t in batch.column("text")]
            labels = pa.array([forest.labels(h) if len(h) else None for h in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), labels, pa.array([len(h) for h in got], pa.int64())], ["doc_id", "key", "labels", "size"])

    rows = src.mapInArrow(sign, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, key binary, labels binary, size bigint")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), path, "rows")
    nodes = rows.where("size > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value("labels").alias("labels"), F.any_value("size").alias("size"))
    nodes = written(nodes, path, "nodes")
    edges, _ = candidates(nodes.select("node", "labels"), path, trees=trees, crowd=crowd, recall=recall)
    groups = written(components(edges, path, "candidates"), path, "groups")
    members = written(groups.join(nodes.select("node", "key", "first", "copies", "size"), "node"), path, "members")
    facts = members.agg(F.count("*"), F.sum("size")).first()
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = written(sizes, path, "sizes")
    members = join_split(members, sizes, ["root"], "n", facts[0])
    members = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    members = members.withColumnsRenamed({"key": "k"}).select("root", "node", "k", "first", "copies", "block", "blocks")
    # the text of one row for each node; the small side is hashed, texts aren't sorted
    texts = src.where(F.col("text").isNotNull()).join(members.hint("shuffle_hash"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first")))
    texts = texts.dropDuplicates(["key", "doc_id"]).select("root", "node", "copies", "block", "blocks", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], sets], ["root", "node", "copies", "block", "blocks", "set"])

    sets = texts.mapInArrow(shingled, "root bigint, node bigint, copies bigint, block int, blocks int, set binary")
    units = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "blocks", "set")
    sent = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sent * 8 * (facts[1] or 0) / max(1, facts[0])) >> 26)
    dealt = units.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, many, group, out = None, False, [], []

        def flush() -> None:
            if now is not None:
                out.extend((*x, many) for x in _verify(group, now[1], now[2]))
            group.clear()

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["node", "root", "links", "many"])

        for batch in batches:
            names = ("root", "i", "j", "node", "copies", "block", "blocks", "set")
            for root, i, j, node, copies, b, blocks, set_ in zip(*(batch.column(c) for c in names), strict=True):
                unit = (root.as_py(), i.as_py(), j.as_py())
                if unit != now:
                    flush()
                    now, many = unit, blocks.as_py() > 1
                group.append((node.as_py(), copies.as_py(), b.as_py(), np.frombuffer(set_.as_py(), np.uint64)))
            if len(out) > 20_000:
                yield made()
                out.clear()
        flush()
        yield made()

    found = written(dealt.mapInArrow(verify, "node bigint, root bigint, links bigint, many boolean"), path, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = found.where(~F.col("many")).select("node", "root")
    large = found.where("many").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not large.isEmpty():
        roots = roots.union(components(large, path, "large"))
    known = nodes.select("key", "node", "copies").join(roots, "node", "left").join(links, "node", "left")
    known = written(known.select("key", "copies", F.coalesce("root", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links")), path, "known")
    total = rows.count()
    with_words = join_split(rows.where("size > 0").select("doc_id", "key"), known, ["key"], "copies", total)
    with_words = with_words.select("doc_id", "key", "class", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    with_words = written(with_words, path, "classes")
    name = with_words.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    named = join_split(with_words, name, ["class"], "n", total).select("doc_id", "key", "class_id", "n_links")
    return named.unionByName(rows.where("size = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one for each class (that of the smallest id); every wordless row stays."""
    got = similar(docs, id_col=id_col, text_col=text_col)
    keep = got.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("key", "doc_id").agg(F.count("*").alias("_n")).withColumnsRenamed({"key": "_k", "doc_id": "_d"})
    has = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    texts = docs.where(has).withColumn("_key", F.unhex(F.md5(F.col(text_col))))
    stay = texts.join(keep.hint("shuffle_hash"), (F.col("_key") == F.col("_k")) & F.col(id_col).eqNullSafe(F.col("_d")))
    # of rows given more than once under one id and text: the one of the smallest hash of all columns
    again = Window.partitionBy("_k", "_d").orderBy(F.xxhash64(*docs.columns))
    once = stay.where("_n > 1").withColumn("_r", F.row_number().over(again)).where("_r = 1")
    return stay.where("_n = 1").select(docs.columns).unionByName(once.select(docs.columns)).unionByName(docs.where(~has))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The plain definition, for tests."""
    sets = []
    for _, t in docs:
        w = words(t)
        k = min(SHINGLE, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and SIMILARITY[1] * c >= SIMILARITY[0] * (len(sets[i]) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, ids[find(i)], links[i]) for i, (d, _) in enumerate(docs)]
