"""Benchmark decontamination by an FM-index of every shard of training text.

The benchmark's word windows (13 words; an item of fewer is one window) are
the test phrases. Document words outside the phrases' alphabet can't be part
of an occurrence, so each shard's text is the runs of alphabet words, with a
separator between runs; nothing that could match is left out. Over that text
a task builds the suffix array, its Burrows-Wheeler transform as a wavelet
matrix with rank blocks, and every eighth suffix position. All phrases are
searched backwards at once; occurrences are located by walking to a sampled
position, and overlapping spans merge into removal spans.

The phrases come in blocks of about ``block_bytes`` of text (dealt by hash and
written to the shared folder, where each task reads them one by one), so that
what a task holds is bounded whatever the size of the benchmark, and neither
driver nor broadcast holds it; a shard is searched for each block in turn.
Documents aren't shuffled: they stay where they are read.

Defined cases: null text has no words; null or wordless items, and items
without an id, take no part; a document given twice is judged twice; equal
windows of two items count for both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import local_path, shared_dir, table, written

WINDOW = 13
#: Upper-case ASCII goes to lower case, other ASCII that isn't a letter or digit to a blank.
_FOLD = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words of a text: runs of digits, ASCII letters in lower case and characters beyond ASCII."""
    # the C-level split takes only ASCII blanks of bytes, which all were folded to 0x20
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Phrases:
    """Distinct windows of a block of items, over an alphabet numbered from 1."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.alphabet: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.ids = sorted({i for i, _ in items})
        rank = {x: k for k, x in enumerate(self.ids)}
        for item, text in items:
            seq = [self.alphabet.setdefault(w, len(self.alphabet) + 1) for w in words(text)]
            n = min(window, len(seq))
            for a in range(len(seq) - n + 1 if n else 0):
                found.setdefault(tuple(seq[a : a + n]), set()).add(rank[item])
        self.length = np.array([len(x) for x in found], np.int64)
        self.symbols = np.zeros((len(found), int(self.length.max(initial=0))), np.int64)
        for k, x in enumerate(found):
            self.symbols[k, : len(x)] = x
        self.items = [sorted(x) for x in found.values()]
        self.shortest = int(self.length.min()) if len(found) else 1


class WaveletMatrix:
    """Rank of any symbol in a prefix, from one packed bit row for each bit of the symbols."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.rows = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            packed = np.zeros(len(seq) // 64 * 8 + 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            blocks = packed.view(np.uint64)
            before = np.zeros(len(blocks), np.int64)
            np.cumsum(np.bitwise_count(blocks[:-1]), out=before[1:])
            self.rows.append((level, blocks, before, len(seq) - int(bit.sum())))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    @staticmethod
    def ones(blocks: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(blocks[at] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(i), i
        for level, blocks, before, zeros in self.rows:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones(blocks, before, lo), self.ones(blocks, before, hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the text ends with a symbol below all others that occurs once."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    step = 1
    key = text.astype(np.int64)
    while True:
        s = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(s[1:] != s[:-1], out=new[1:])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step if step < n else 0] = rank[step:] + 1
        key = rank * np.int64(n + 1) + after
        order = np.argsort(key, kind="stable")
        step *= 2


class FMIndex:
    """Of a text of symbols from 1; 0 is added at its end."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.append(text, 0)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma)[:sigma], out=self.first[1:])
        self.ranks = WaveletMatrix(self.bwt, sigma)
        self.marked = order % sample == 0
        self.marks_before = np.concatenate(([0], np.cumsum(self.marked)))
        self.samples = order[self.marked]

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all phrases, one step backwards at a time."""
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), len(self.bwt), np.int64)
        for back in range(1, symbols.shape[1] + 1):
            live = np.flatnonzero((length >= back) & (lo < hi))
            c = symbols[live, length[live] - back]
            lo[live] = self.first[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.first[c] + self.ranks.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.marked[at[live]]
            hit = live[done]
            out[hit] = self.samples[self.marks_before[at[hit]]] + steps[hit]
            live = live[~done]
            c = self.bwt[at[live]]
            at[live] = self.first[c] + self.ranks.rank(c, at[live])
            steps[live] += 1
        return out


class Shard:
    """Documents met so far and, for one block of phrases, the runs of their alphabet words."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.runs, self.owner, self.offset, self.size = phrases, [], [], [], 0

    def add(self, doc: int, toks: list[bytes]) -> None:
        ids = np.fromiter(map(self.phrases.alphabet.get, toks, repeat(0)), np.int64, len(toks))
        edge = np.diff(np.concatenate(([False], ids > 0, [False])).view(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = b - a >= self.phrases.shortest
        for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
            self.runs.append(ids[x:y])
            self.owner.append(doc)
            self.offset.append(x)
            self.size += y - x + 1

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, first word, word after) of merged hits, and (doc, item rank) of what was found."""
        none = np.zeros(0, np.int64)
        if not self.runs or not len(self.phrases.length):
            return none, none, none, none, none
        sep = len(self.phrases.alphabet) + 1
        starts = np.cumsum([0] + [len(r) + 1 for r in self.runs[:-1]])
        text = np.full(int(starts[-1]) + len(self.runs[-1]) + 1, sep, np.int64)
        for s, r in zip(starts.tolist(), self.runs, strict=True):
            text[s : s + len(r)] = r
        index = FMIndex(text, sep + 1)
        lo, hi = index.search(self.phrases.symbols, self.phrases.length)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at = index.locate(rows)
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.phrases.length[which], -1)
        hit = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0])))
        a, b = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        run = np.searchsorted(starts, a, "right") - 1
        owner, offset = np.array(self.owner, np.int64), np.array(self.offset, np.int64)
        base = offset[run] - starts[run]
        docs = owner[np.searchsorted(starts, at, "right") - 1]
        pairs = np.unique(docs * np.int64(len(n)) + which)
        found = [(int(p // len(n)), i) for p in pairs.tolist() for i in self.phrases.items[p % len(n)]]
        found = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return owner[run], a + base, b + base, found[:, 0], found[:, 1]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between words of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = np.ones(len(raw), bool)
    for x, y in spans:
        keep[a[x] : b[y - 1]] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "surrogatepass")


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[str]:
    """Folders in the shared one, each of the items of about block_bytes of text (one longer item is at least its own block)."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    path = shared_dir(benchmark.sparkSession)
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    if not n:
        return []
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))
    written(dealt.repartition(n, "block").sortWithinPartitions("block"), path, "items", by="block")
    fs, root = local_path(f"{path}/items")
    return sorted(f"{path}/items/{x.base_name}" for x in fs.get_file_info(pa.fs.FileSelector(root)) if x.base_name.startswith("block="))


def read_block(folder: str) -> list[tuple[str, str]]:
    fs, path = local_path(folder)
    got = []
    for f in sorted(x.path for x in fs.get_file_info(pa.fs.FileSelector(path)) if x.path.endswith(".parquet")):
        with fs.open_input_file(f) as source:
            t = pq.ParquetFile(source).read(columns=["item", "text"])
        got += zip(t["item"].to_pylist(), t["text"].to_pylist(), strict=True)
    return got


RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    clean_col: str | None = None,
    window: int = WINDOW,
    shard_words: int = 1 << 19,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """The columns `keep` of docs (all of them at default), then n_words, n_hit, item_ids (sorted as
    strings) and spans ([first word, word after], merged, from 0); with clean_col also the text
    without its spans. A shard is the documents of a task with about shard_words alphabet words.
    Columns of docs named like a result column give way to it.
    """
    blocks = phrase_blocks(benchmark, item_col, item_text, block_bytes)
    extra = [*RESULT, *([T.StructField(clean_col, T.StringType())] if clean_col else [])]
    names = {f.name for f in extra}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names or c == text_col]
    kept_out = [c for c in kept if c not in names]
    need_text = text_col not in kept
    src = docs.select(*kept, *([text_col] if need_text else []))
    schema = T.StructType([f for f in src.schema.fields if f.name in kept_out] + extra)
    many = len(blocks) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[list[str | None]] = []
        counts: list[int] = []
        phrases = None if many else [Phrases(read_block(b), window) for b in blocks]
        shards = [Shard(p) for p in phrases or []]

        def search() -> Iterator[pa.RecordBatch]:
            nonlocal shards
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for k, b in enumerate(blocks):
                if many:  # one block in memory at a time; the shard's texts are read again for each
                    p = Phrases(read_block(b), window)
                    shard = Shard(p)
                    for i, t in enumerate(t for part in texts for t in part):
                        shard.add(i, words(t))
                else:
                    shard, p = shards[k], phrases[k]
                owner, a, z, docs_, found = shard.spans()
                for o, x, y in zip(owner.tolist(), a.tolist(), z.tolist(), strict=True):
                    spans.setdefault(o, []).append((x, y))
                for o, i in zip(docs_.tolist(), found.tolist(), strict=True):
                    items.setdefault(o, set()).add(p.ids[i])
            base = 0
            for part, batch in enumerate(held):
                n = batch.num_rows
                got = [merge(spans.get(i, [])) for i in range(base, base + n)]
                cols = [batch.column(c) for c in kept_out] + [
                    pa.array(counts[base : base + n], pa.int64()),
                    pa.array([sum(y - x for x, y in g) for g in got], pa.int64()),
                    pa.array([sorted(items.get(i, ())) for i in range(base, base + n)], pa.list_(pa.string())),
                    pa.array([[[x, y] for x, y in g] for g in got], pa.list_(pa.list_(pa.int64()))),
                ]
                if clean_col:
                    cols.append(pa.array([cut(t, g) if g else t for t, g in zip(texts[part], got, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])
                base += n
            held.clear()
            texts.clear()
            counts.clear()
            shards = [Shard(p) for p in phrases or []]

        chars = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                col = part.column(text_col).to_pylist()
                for t in col:
                    toks = words(t)
                    for s in shards:
                        s.add(len(counts), toks)
                    counts.append(len(toks))
                    chars += len(t or "")
                keep_text = many or clean_col
                texts.append(col if keep_text else [])
                held.append(part.select(kept_out) if kept_out else part)
                if sum(s.size for s in shards) >= shard_words or len(counts) >= 1 << 16 or (keep_text or text_col in kept_out) and chars >= 24 << 20:
                    yield from search()
                    chars = 0
        if held:
            yield from search()

    return src.mapInArrow(run, schema)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(docs: list[tuple], bench: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The plain definition, for tests: (doc_id, n_words, n_hit, n_items, digest, contaminated)."""
    spans = {}
    for item, text in bench:
        w = words(text)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            spans.setdefault(tuple(w[a : a + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(k) for k in spans}:
            for a in range(len(w) - n + 1):
                if got := spans.get(tuple(w[a : a + n])):
                    items |= got
                    hit |= set(range(a, a + n))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
