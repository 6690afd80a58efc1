"""SentencePiece encoding and decoding for vocabularies of the merge (BPE) type.

A text is cut where no piece of the vocabulary holds the two neighbouring letters
beside each other: no merge ever crosses such a place, so the stretches between are
encoded on their own, and a stretch met before isn't merged again. In a stretch
all adjacent pairs of symbols that form a piece wait on an agenda, ordered by the
piece's score and then from left to right; the first is merged, and the pairs with
its new neighbours join the agenda, until none is left. The agenda of a short stretch is
a list, that of a long one a heap. Letters without a piece become
their bytes, or the unknown id where the vocabulary has no bytes.

Tasks work on Arrow batches. With ``check``, what the agenda made of the stretches that are new
in a batch is compared with the sentencepiece library, and so is every decoded text; a difference is an
error. The model file is read once, by the driver,
and its bytes (bounded by the vocabulary) go to the tasks.

Token ids are held packed, as little-endian unsigned 32-bit integers.

Defined cases: null text counts as empty and gives the begin and end ids alone; a text
of any length is encoded whole, and memory grows with the longest text of a batch only;
rows are encoded one by one, so repeated rows and ids stay as they are, and the order
of files doesn't show; an empty table gives an empty one; columns that are named like
``ids`` or ``decoded`` give way. Null ids decode to null. Vocabularies of another type,
with pieces that the user defined or that are unused, or with a normaliser that changes
letters, are an error.
"""

from __future__ import annotations

import codecs
import hashlib
import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SPACE = "▁"
#: Stretches that are remembered (twice as many at most), and the longest of them.
REMEMBERED, LONGEST = 1 << 17, 48
NEVER = math.inf

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


class Vocabulary:
    """Pieces, scores and kinds of a model, and the stretches met so far."""

    def __init__(self, raw: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(raw)
        kinds = proto.SentencePiece
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("the model must be of the merge type, without user-defined and unused pieces")
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must take letters as they are, with a space before the text")
        self.library = SentencePieceProcessor(model_proto=raw)
        proto.normalizer_spec.add_dummy_prefix = False
        self.library_inside = SentencePieceProcessor(model_proto=proto.SerializeToString())
        plain = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        self.ids = {p.piece: i for i, p in plain}
        self.cost = {p.piece: -p.score for _, p in plain}
        self.bos, self.eos, self.unk = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        in_bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.bytes = [in_bytes[b] for b in range(256)] if proto.trainer_spec.byte_fallback else None
        # what a piece decodes to, in UTF-8
        self.surface = [p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in proto.pieces]
        self.surface[self.unk] = proto.trainer_spec.unk_surface.encode()
        for b, i in in_bytes.items():
            self.surface[i] = bytes([b])
        self.is_byte, self.control = set(in_bytes.values()), {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        # which letters stand beside each other in a piece; 0 is a letter of none
        letters = sorted({c for p in self.ids for c in p})
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.inside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        both = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        at = self.place[np.array([[ord(a), ord(b)] for a, b in both], np.int64).reshape(-1, 2)]
        self.inside[at[:, 0], at[:, 1]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fresh: list[tuple[str, list[int]]] = []

    def stretches(self, text: str) -> list[str]:
        at = self.place[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ends = (np.flatnonzero(~self.inside[at[:-1], at[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]

    def short(self, text: str) -> list[str]:
        """The symbols that are left of a short stretch."""
        symbol, cost = list(text), self.cost.get
        agenda = [cost(a + b, NEVER) for a, b in zip(symbol, symbol[1:], strict=False)]
        while agenda and (least := min(agenda)) < NEVER:
            i = agenda.index(least)
            symbol[i] += symbol.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbol[i] + symbol[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(symbol[i - 1] + symbol[i], NEVER)
        return symbol

    def long(self, text: str) -> list[str]:
        """The same of any stretch."""
        symbol, cost = list(text), self.cost
        n = len(symbol)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs = [a + b for a, b in zip(symbol, symbol[1:], strict=False)]
        agenda = [(cost[p], i, p) for i, p in enumerate(pairs) if p in cost]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            j = right[i]
            if not symbol[i] or j < 0 or symbol[i] + symbol[j] != piece:
                continue
            symbol[i], symbol[j] = piece, ""
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                p = piece + symbol[after]
                if p in cost:
                    heappush(agenda, (cost[p], i, p))
            if left[i] >= 0:
                p = symbol[left[i]] + piece
                if p in cost:
                    heappush(agenda, (cost[p], left[i], p))
        return [s for s in symbol if s]

    def merged(self, text: str) -> list[int]:
        """The ids of a stretch, by the agenda."""
        out: list[int] = []
        for s in self.short(text) if len(text) <= LONGEST else self.long(text):
            got = self.ids.get(s)
            if got is not None:
                out.append(got)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unk)
        return out

    def remembered(self, text: str) -> bytes:
        """The packed ids of a stretch, merged if it isn't among the last ones."""
        got = self.new.get(text) or self.old.get(text)
        if got is None:
            ids = self.merged(text)
            self.fresh.append((text, ids))
            got = pack(ids)
        if len(text) <= LONGEST:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """Packed ids, with the begin and end ids where the model has them."""
        inside = b""
        if text:
            parts = self.stretches(SPACE + text.replace(" ", SPACE))
            found = list(map(self.new.get, parts))
            inside = b"".join([x or self.remembered(s) for x, s in zip(found, parts, strict=True)] if None in found else found)
        if not self.bytes:
            inside = pack(self.as_one(unpack(inside)))
        return pack([self.bos] if self.bos >= 0 else []) + inside + pack([self.eos] if self.eos >= 0 else [])

    def as_one(self, ids: list[int]) -> list[int]:
        """Neighbouring unknown letters are one."""
        return ids if self.bytes else [x for i, x in enumerate(ids) if x != self.unk or not i or ids[i - 1] != self.unk]

    def check(self) -> None:
        """The stretches merged since the last check, against the library."""
        if self.fresh and [self.as_one(ids) for _, ids in self.fresh] != self.library_inside.encode([t for t, _ in self.fresh], num_threads=1):
            raise ValueError("the agenda and the sentencepiece library differ")
        self.fresh = []

    def decode(self, ids: list[int]) -> str:
        """Bytes that aren't UTF-8 become U+FFFD each."""
        plain = [i for i in ids if i not in self.control]
        text = b"".join([self.surface[i] for i in plain]).decode("utf-8", "each_byte")
        # the space that encode() put before the text
        return text[1:] if plain and plain[0] not in self.is_byte and plain[0] != self.unk and text.startswith(" ") else text


_HELD: dict[str, Vocabulary] = {}


def vocabulary(raw: bytes) -> Vocabulary:
    """One for a Python worker, which serves many tasks."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Vocabulary(raw)
    return _HELD[key]


def _mapped(docs: DataFrame, keep: list[str], column: str, out: T.StructField, work) -> DataFrame:
    """The columns `keep` and `out`, an array that work() makes of a batch's `column`."""
    keep = [c for c in keep if c != out.name]
    schema = T.StructType([f for c in keep for f in docs.schema.fields if f.name == c] + [out])
    src = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(column).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # a few hundred rows at a time, so that lists of ids stay small
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), work(batch.column("given"))], [*keep, out.name])

    return src.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, keep: list[str], text_col: str = "text", check: bool = True) -> DataFrame:
    """The columns `keep` of docs and `ids`, the packed ids of the whole text; model is the path of a model file."""
    with open(model, "rb") as f:
        raw = f.read()

    def work(texts: pa.Array) -> pa.Array:
        voc = vocabulary(raw)
        ids = pa.array([voc.encode(t or "") for t in texts.to_pylist()], pa.binary())
        if check:
            voc.check()
        voc.fresh = []
        return ids

    return _mapped(docs, keep, text_col, T.StructField("ids", T.BinaryType()), work)


def decode(tokens: DataFrame, model: str, keep: list[str], ids_col: str = "ids", check: bool = True) -> DataFrame:
    """The columns `keep` of tokens and `decoded`, the text of the packed ids."""
    with open(model, "rb") as f:
        raw = f.read()

    def work(packed: pa.Array) -> pa.Array:
        voc = vocabulary(raw)
        ids = [None if b is None else unpack(b) for b in packed.to_pylist()]
        texts = [None if x is None else voc.decode(x) for x in ids]
        given = [x for x in ids if x is not None]
        if check and given and [t for t in texts if t is not None] != voc.library.decode(given, num_threads=1):
            raise ValueError("the decoded text and that of the sentencepiece library differ")
        return pa.array(texts, pa.string())

    return _mapped(tokens, keep, ids_col, T.StructField("decoded", T.StringType()), work)


def op12_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    tokens = encode(table(spark, sf_dir, "documents"), model, ["doc_id"])
    found = decode(tokens, model, ["doc_id", "ids"])
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
