"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (1,024 components, drawn by
a hash of its code point, so that no two letters share one). A three-letter group is the product of its letters'
vectors, rotated by two, one and no places; words are framed by blanks. A
text's profile is the sum of its groups' vectors, a language's prototype the
sum of the unit profiles of its training texts. A text gets the language
whose prototype has the largest cosine with its profile, ties to the smaller
name; that cosine, held to 0..1, is the score.

Bound: at most ``max_rows`` training rows are learned from, those of the smallest
id hashes (ids whose hash ties at the bound are left out); the prototypes are
1,024 numbers a language, of ``max_langs`` at most, else an error.

Defined cases: text that is null or has no letter is `und` with score 0, as is
every text when nothing could be learned; rows without lang, or held out,
teach nothing; whole texts are read, however long, with memory that grows with the longest;
repeated rows teach as often as they are there; an empty table gives an empty one; columns of the input named
like lang_pred or score give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, table

DIM = 1024
UNKNOWN = "und"
#: The vectors of letters below this one are kept in a table, those of others made when met.
_OWN = 0x250
#: A letter's number, its code point, has so many bits in a group.
_BITS = 21


class Profiles:
    """Turns texts into rows of a matrix; made once in a task."""

    def __init__(self, dim: int = DIM, seed: int = 20240131):
        self.dim, self.seed = dim, seed
        # 1,024 rows are drawn for the sake of earlier results; the first of them are the table
        self.letters = (np.random.default_rng(seed).integers(0, 2, (1024, dim), np.int8) * 2 - 1)[:_OWN]
        self.third, self.second, self.first = self.letters, np.roll(self.letters, 1, 1), np.roll(self.letters, 2, 1)
        low = np.arange(0x10000)
        self.code = np.where(np.array([chr(c).isalpha() for c in low]), low, 0).astype(np.int64)

    def drawn(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of letters outside the table, a row each: bits of a hash of seed, letter and place."""
        words = -(-self.dim // 64)
        x = codes.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64))
        # fixed values: the mixing constants of splitmix64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8), axis=1)[:, : self.dim]
        return bits.astype(np.int8) * 2 - 1

    def vectors(self, groups: np.ndarray) -> np.ndarray:
        """The product of the rotated vectors of each group's letters."""
        c = np.stack([groups >> 2 * _BITS, groups >> _BITS & (1 << _BITS) - 1, groups & (1 << _BITS) - 1])
        first, second, third = self.first, self.second, self.third
        if (c >= _OWN).any():
            far = np.unique(c[c >= _OWN])
            third = np.concatenate((third, self.drawn(far)))
            first, second = np.roll(third, 2, 1), np.roll(third, 1, 1)
            c = np.where(c < _OWN, c, _OWN + np.searchsorted(far, c))
        return first[c[0]] * second[c[1]] * third[c[2]]

    def groups(self, text: str | None) -> np.ndarray:
        """The codes of a text's three-letter groups; empty without a letter."""
        cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        c = self.code[np.minimum(cp, 0xFFFF)]
        if len(far := np.flatnonzero(cp > 0xFFFF)):
            c[far] = [x if chr(x).isalpha() else 0 for x in cp[far].tolist()]
        c = np.concatenate(([0], c, [0]))
        c = c[(c != 0) | (np.concatenate(([1], c[:-1])) != 0)]  # one blank between words
        if not c.any():
            return np.zeros(0, np.int64)
        g = (c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:]
        return g[c[1:-1] != 0]

    def of(self, texts: list[str | None]) -> np.ndarray:
        """One unit row for each text; zeros where there is no letter."""
        groups = [self.groups(t) for t in texts]
        n = np.array([len(g) for g in groups])
        if not n.sum():
            return np.zeros((len(texts), self.dim), np.float32)
        seen, at = np.unique(np.concatenate(groups), return_inverse=True)
        out = np.zeros((len(texts), self.dim), np.float32)
        cell = np.repeat(np.arange(len(texts)), n) * len(seen) + at
        counts = np.bincount(cell, minlength=len(texts) * len(seen)).reshape(len(texts), -1).astype(np.float32)
        for a in range(0, len(seen), 8192):  # bounded memory, whatever a text holds
            out += counts[:, a : a + 8192] @ self.vectors(seen[a : a + 8192]).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _parts(texts: list[str | None], chars: int = 1 << 17) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about so many characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or i - start >= 63:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 20_000, max_langs: int = 1000) -> dict[str, np.ndarray]:
    """A unit vector for each language of the rows that may teach."""
    may = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.xxhash64(id_col, F.lit(5))
    n, bound = may.select(h.alias("h")).orderBy("h").limit(max_rows + 1).agg(F.count("*"), F.max("h")).first()
    if n > max_rows:
        may = may.where(h < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, total = Profiles(), {}
        for batch in batches:
            texts, langs = batch.column("t").to_pylist(), batch.column("g").to_pylist()
            for a, part in _parts(texts):
                rows = maker.of(part).astype(np.float64)
                for lang in set(langs[a : a + len(part)]):
                    mine = [x == lang for x in langs[a : a + len(part)]]
                    total[lang] = total.get(lang, 0) + rows[mine].sum(0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"])

    parts = may.select(F.col(text_col).alias("t"), F.col(lang_col).alias("g")).mapInArrow(run, "lang string, i int, v double")
    out: dict[str, np.ndarray] = {}
    if may.select(lang_col).distinct().limit(max_langs + 1).count() > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    for lang, i, v in parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(lang, np.zeros(DIM))[i] = v
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sorted(out.items()) if np.linalg.norm(v)}


def predicted(docs: DataFrame, learned: dict[str, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, then lang_pred and score."""
    names, matrix = list(learned), np.array(list(learned.values()), np.float32).reshape(-1, DIM).T
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    schema = T.StructType([f for c in keep for f in docs.schema.fields if f.name == c] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Profiles()
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            lang, score = [], []
            for _, part in _parts(texts):
                rows = maker.of(part)
                if not names:
                    lang += [UNKNOWN] * len(part)
                    score += [0.0] * len(part)
                    continue
                cos = np.clip((rows @ matrix).astype(np.float64), 0, 1)
                best = cos.argmax(1)
                some = rows.any(1)
                lang += [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                score += np.where(some, cos.max(1), 0.0).tolist()
            cols = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [f.name for f in schema.fields])

    src = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_t"))
    return src.mapInArrow(run, schema)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs, prototypes(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
