"""What the pipeline's stages do to texts, copies and shards, row by row, on planted documents."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontam, mixing, quality
from millrace.llm.common import held_out

WORD = re.compile("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """120 documents of two sources, some with short benchmark passages, some mostly of them, some copies and near copies."""
    rng = random.Random(12)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    text = lambda n: ". ".join(" ".join(rng.choices(vocab, k=8)).capitalize() for _ in range(n // 8))
    items = [text(24) for _ in range(5)] + ["Too short an item"]
    docs = []
    for i in range(120):
        t = text(rng.choice([80, 160, 400]))
        if i % 10 == 1:
            t = t + " " + items[i // 10 % 5]
        if i % 10 == 2:
            t = text(400) + ", " + " ".join(items[i // 10 % 5].split()[:15]) + "; " + text(80)
        if i % 10 == 3:
            t = docs[i - 3][1]
        if i % 10 == 4:
            t = " ".join([*docs[i - 4][1].split()[:-2], "other", "ends"])
        docs.append((i, t, "en", "big" if i % 3 else "small", len(t)))
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 120, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, items


def plain_cut(text, items):
    """The text without its hit words, and whether it stays."""
    found = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in found]
    windows = set()
    for item in items:
        w = [x.lower() for x in WORD.findall(item)]
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))}
    hit = set()
    for w in windows:
        hit |= {j for i in range(len(words) - len(w) + 1) if tuple(words[i : i + len(w)]) == w for j in range(i, i + len(w))}
    spans = []
    for j in sorted(hit):
        if spans and spans[-1][1] == j:
            spans[-1] = (spans[-1][0], j + 1)
        else:
            spans.append((j, j + 1))
    return (decontam.cut(text, spans) if spans else text), not hit or 20 * len(hit) < len(words)


def test_benchmark_text_is_cut_out(spark, planted):
    folder, docs, items = planted
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    want = {i: plain_cut(t, items)[0] for i, t, *_ in docs if plain_cut(t, items)[1]}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert 0 < sum(want[i] != t for i, t, *_ in docs if i in want) and len(want) < len(docs)


def test_quality_keeps_what_the_classifier_predicts(spark, planted):
    folder, docs, _ = planted
    df = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, df, folder).collect()}
    feats = quality.with_features(df, ["doc_id"])
    model = quality.train(feats.where(~held_out(F.col("doc_id"))), spark.read.parquet(f"{folder}/labels.parquet"))
    want = {i for i, t, *_ in docs if quality.logistic(model.strength(quality.np.array([quality.features(t)])) - model.cut + quality.np.log(0.7 / 0.3))[0] >= 0.7 - 1e-9}
    assert kept == want


def test_copies_and_shards(spark, planted):
    """The mix's copies are what it takes of each document to the nearest whole one; every copy gets a place in one shard, without gaps."""
    folder, docs, _ = planted
    df = spark.read.parquet(f"{folder}/documents.parquet")
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(df).collect()}
    mixed = corpus_pipeline.mix(spark, df, folder)
    counts = Counter(r["doc_id"] for r in mixed.collect())
    # halves go up, as Spark rounds
    assert counts == {i: n for i, (t, s) in taken.items() if (n := int(t / s + 0.5) if s else 1)}
    rows = corpus_pipeline.to_shards(spark, mixed, folder).collect()
    assert Counter(r["doc_id"] for r in rows) == counts
    places = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    where = {}
    for r in rows:
        where.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_run_is_the_stages_in_order(spark, planted):
    folder, _, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
    # which of equally good shards a text goes to hangs on the order of rows
    key = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.collect())
    out = corpus_pipeline.run(spark, folder)
    assert key(out) == key(docs)
    assert all(plain_cut(r["text"], items) == (r["text"], True) for r in out.collect())
