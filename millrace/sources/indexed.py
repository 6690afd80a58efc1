"""Letters of FASTA files by position: an index of where sequences begin, and a data source that reads only the bytes asked for.

index() finds, once, where each sequence begins and how long its lines are. Reading is a
Python data source, ``fasta_pieces``: its rows are pieces of sequences, its partitions
runs of pieces of about as many bytes, and names and bounds of positions choose the
pieces before anything is opened; without names the driver walks the whole index to
deal it out. ranges() joins a table of wanted ranges with the index and reads
just these.

Files must be in a store that pyarrow opens (local, hdfs, s3 and the like). All lines of a
sequence but its last have one length; another layout is an error, found when
the index is made. Sequences without letters are in the index and have no pieces; of two
sequences of one name in a folder both are read. A carriage return belongs to the line's end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Letters of a piece, and bytes of a partition.
PIECE, PARTITION = 1 << 16, 32 << 20
INDEX = "file string, name string, letters long, offset long, line_letters long, line_bytes long"
PIECES = "name string, start long, stop long, seq string, n_bytes long"


def _opened(file: str):
    """A stream with seek() over a file named by a URI or a path."""
    from pyarrow import fs

    if "://" not in file:
        return fs.LocalFileSystem().open_input_file(file.removeprefix("file:"))
    store, path = fs.FileSystem.from_uri(file.replace("s3a://", "s3://", 1))
    return store.open_input_file(path)


def _entries(file: str) -> Iterator[tuple]:
    """The rows of INDEX of one file, read in blocks."""
    name, letters, offset, width, full, ended, at, rest = None, 0, 0, 0, 0, False, 0, b""

    def entry() -> tuple:
        return (file, name, letters, offset, width, full)

    with _opened(file) as f:
        while True:
            block = f.read(1 << 22)
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            whole = [x + b"\n" for x in lines] + ([rest] if not block and rest else [])
            for line in whole:
                text = line.rstrip(b"\r\n")
                if text.startswith(b">"):
                    if name is not None:
                        yield entry()
                    name, letters, offset, width, full, ended = text[1:].split(b" ")[0].decode(), 0, at + len(line), 0, 0, False
                elif name is not None:
                    if text and (ended or (width and len(text) > width)):
                        raise ValueError(f"{file}: the lines of {name} differ in length")
                    width, full = (len(text), len(line)) if not width else (width, full)
                    ended = len(text) < width or not text
                    letters += len(text)
                at += len(line)
            if not block:
                break
    if name is not None:
        yield entry()


def _letters(f, entry: dict, start: int, stop: int) -> bytes:
    """The bytes that hold a sequence's letters from start to before stop."""

    def place(p: int) -> int:
        return entry["offset"] + p // entry["line_letters"] * entry["line_bytes"] + p % entry["line_letters"]

    f.seek(place(start))
    return f.read(place(stop - 1) + 1 - place(start))


def _bare(raw: bytes) -> str:
    return raw.replace(b"\n", b"").replace(b"\r", b"").decode()


def index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX of the files of a path: each sequence's name (to the first blank), letters, place of the first one in bytes, and the lengths of its lines without and with their end."""
    files = spark.read.format("binaryFile").load(path).select("path")
    schema = pa.schema([("file", pa.string()), ("name", pa.string()), *((c, pa.int64()) for c in ("letters", "offset", "line_letters", "line_bytes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                held = []
                for e in _entries(file):
                    held.append(e)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return files.repartition("path").mapInArrow(run, INDEX)


class Run(InputPartition):
    """Pieces of sequences: index entries with the first and last piece that a task reads."""

    def __init__(self, items: list[tuple]):
        super().__init__(items)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.piece, self.partition = options["path"], int(options.get("piece", PIECE)), int(options.get("partition", PARTITION))
        self.names = json.loads(options["names"]) if "names" in options else None
        self.low, self.high = int(options.get("low", 0)), int(options["high"]) if "high" in options else None

    def partitions(self) -> list[Run]:
        import pyarrow.dataset as ds

        got = ds.dataset(self.index, format="parquet")
        if self.names is not None:
            got = got.filter(ds.field("name").isin(self.names))
        runs, held, size = [], [], 0
        for batch in got.to_batches():
            for e in batch.to_pylist():
                if e["letters"] <= self.low:
                    continue
                first = self.low // self.piece
                last = (e["letters"] - 1 if self.high is None else min(e["letters"], self.high) - 1) // self.piece
                # a long sequence is cut over partitions
                step = max(1, self.partition // self.piece)
                for a in range(first, last + 1, step):
                    b = min(last, a + step - 1)
                    held.append((e, a, b))
                    size += (b - a + 1) * self.piece
                    if size >= self.partition:
                        runs.append(Run(held))
                        held, size = [], 0
        return [*runs, Run(held)] if held or not runs else runs

    def read(self, partition: Run) -> Iterator[tuple]:
        name, f = None, None
        try:
            for e, first, last in partition.value:
                if e["file"] != name:
                    if f is not None:
                        f.close()
                    name, f = e["file"], _opened(e["file"])
                for i in range(first, last + 1):
                    start, stop = i * self.piece, min(e["letters"], (i + 1) * self.piece)
                    raw = _letters(f, e, start, stop)
                    yield (e["name"], start, stop, _bare(raw), len(raw))
        finally:
            if f is not None:
                f.close()


class FastaPieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def pieces(spark: SparkSession, index_path: str, names: list[str] | None = None, low: int = 0, high: int | None = None, piece: int = PIECE, partition: int = PARTITION) -> DataFrame:
    """(name, start, stop, seq, n_bytes): pieces of the sequences of a written index(); letters from start, 0-based, to before stop, and the bytes read for them.

    Of the sequences `names` (all, if none are given) come the pieces that hold letters from low to
    before high. These are options of the source and not filters that Spark hands
    to it, as Spark keeps what it has handed over for later reads of the same frame.
    """
    spark.dataSource.register(FastaPieces)
    chosen = {"piece": piece, "partition": partition, "low": max(0, low)}
    chosen |= {} if names is None else {"names": json.dumps(sorted(set(names)))}
    chosen |= {} if high is None else {"high": high}
    return spark.read.format("fasta_pieces").options(**chosen).load(index_path)


def ranges(spark: SparkSession, index_path: str, wanted: DataFrame, key: str = "id", piece: int = PIECE) -> DataFrame:
    """(key, name, s, e, seq, n_bytes) of wanted ranges (key, name, s, e), from s, 0-based, to before e, cut at the sequence's ends; names that aren't there and ranges without letters are left out.

    Ranges meet the index by name and are read in the tasks, parts of a long one in different ones, so
    that no byte is read that no range wants but for the ends of lines: n_bytes is what was read.
    """
    asked = wanted.select(key, "name", F.greatest("s", F.lit(0)).cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    met = asked.join(spark.read.parquet(index_path), "name").withColumn("_e", F.least("e", "letters")).where("s < _e")
    parts = met.withColumn("_i", F.explode(F.sequence(F.floor(F.col("s") / piece), F.floor((F.col("_e") - 1) / piece))))
    parts = parts.withColumns({"_from": F.greatest("s", F.col("_i") * piece), "_to": F.least("_e", (F.col("_i") + 1) * piece)})
    fields = [key, "name", "s", "e", "_i", "file", "_from", "_to", "offset", "line_letters", "line_bytes"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # parts near each other in a file are read after one another
    parts = parts.select(fields).repartition(tasks, "file", "_i").sortWithinPartitions("file", "offset", "_from")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            seqs, sizes = [], []
            for e in batch.select(["file", "_from", "_to", "offset", "line_letters", "line_bytes"]).to_pylist():
                if e["file"] != name:
                    if f is not None:
                        f.close()
                    name, f = e["file"], _opened(e["file"])
                raw = _letters(f, e, e["_from"], e["_to"])
                seqs.append(_bare(raw))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(seqs, pa.string()), pa.array(sizes, pa.int64())], [*kept, "seq", "n_bytes"])
        if f is not None:
            f.close()

    kept = [key, "name", "s", "e", "_i"]
    types = {x.name: x.dataType.simpleString() for x in parts.schema}
    read = parts.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", seq string, n_bytes long")
    joined = read.groupBy(key, "name", "s", "e").agg(F.array_sort(F.collect_list(F.struct("_i", "seq"))).alias("_cuts"), F.sum("n_bytes").alias("n_bytes"))
    return joined.select(key, "name", "s", "e", F.array_join(F.col("_cuts.seq"), "").alias("seq"), "n_bytes")
