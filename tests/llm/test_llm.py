"""Operators against brute force, and their defined cases, on small tables."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import ann, decontam, langid, lines, mixing, neardup, quality, queries, shards, warc
from millrace.llm.common import shared_dir

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, features string, shard int, c_0 int, size string"
VOCAB = [f"w{i}" for i in range(300)]


def some_text(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def odd_documents():
    rng = random.Random(1)
    rows = []
    base = [some_text(rng, 80) for _ in range(12)]
    for i in range(60):
        words = base[i % 12].split()
        if i >= 24:
            words[rng.randrange(80)] = "changed"
        text = " ".join(words) if i < 48 else [None, "", "  ", "...", "one two", base[0], "Äé ñ 漢字", some_text(rng, 30_000)][i % 8]
        rows.append((i, text, ["en", "de", None][i % 3], [None, "a", "b", "a"][i % 4], 5, "x", 1, "y", 7, 8, "z"))
    rows += [rows[0], rows[0], (None, None, None, None, None, None, None, None, None, None, None), (None, base[3], None, "a", 1, None, None, None, None, None, None)]
    return rows


def make(spark, path, docs, empty=False):
    s = str(path)
    n = 0 if empty else None
    spark.createDataFrame(docs[:n], DOCS).write.parquet(f"{s}/documents.parquet")
    bench = [(1, docs[0][1]), (2, None), (3, "..."), (None, "one two"), (4, "One, TWO"), (4, docs[1][1])]
    spark.createDataFrame(bench[:n], "item_id long, text string").write.parquet(f"{s}/benchmark.parquet")
    labels = [(i, i % 2, 0) for i in range(40)] + [(3, None, 0), (None, 1, 0), (5, 0, 0), (5, 0, 0)]
    spark.createDataFrame(labels[:n], "doc_id long, quality int, toxic int").write.parquet(f"{s}/labels.parquet")
    big = "<p>same</p><br>" + "x" * 1200
    pages = [(i, f"http://h{i % 2}/p", [big, None, "", f"<p>same</p>{i}"][i % 4]) for i in range(20)] + [(None, None, big), (0, "http://h0/p", big)]
    spark.createDataFrame(pages[:n], "page_id long, url string, html string").write.parquet(f"{s}/pages.parquet")
    chats = [(1, 0, "user", "a##b\\"), (1, 1, "assistant", None), (1, 1, None, "### x: </turn>"), (2, 0, "assistant", "####"), (None, None, "we:ird", ""), (1, 0, "user", "a##b\\")]
    spark.createDataFrame(chats[:n], "conv_id long, turn long, role string, text string").write.parquet(f"{s}/conversations.parquet")
    rng = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(200)] + [(20, [0.0] * 8, 0), (40, None, 0), (60, [1.0, float("nan")] + [0.0] * 6, 0), (80, [1.0], 0), (100, [1.0] * 8, 0), (101, [1.0] * 8, 0)]
    spark.createDataFrame(vecs[:n], "vec_id long, embedding array<float>, label int").write.parquet(f"{s}/embeddings.parquet")
    return s


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("odd"), odd_documents())


@pytest.fixture(scope="module")
def void(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("void"), odd_documents(), empty=True)


def sql_rows(d, sql, cols):
    con = duckdb.connect()
    for f in os.listdir(d):
        at = f"{d}/{f}" if os.path.isfile(f"{d}/{f}") else f"{d}/{f}/*.parquet"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{at}')")
    return sorted(map(str, con.execute(f"select {','.join(cols)} from ({sql})").fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(cols).collect()) == sql_rows(DATA, queries.ORACLES[name], cols)


@pytest.mark.parametrize("name", ["op1_warc", "op7_chat", "op9_lines"])
def test_sql_on_odd_rows(spark, odd, name):
    df = queries.QUERIES[name](spark, odd)
    cols = sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(cols).collect()) == sql_rows(odd, queries.ORACLES[name], cols)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, void, name):
    assert queries.QUERIES[name](spark, void).count() == (1 if name == "op7_chat" else 0)


def test_warc_odd_rows(spark, odd):
    rows = queries.QUERIES["op1_warc"](spark, odd).collect()
    assert len(rows) == 22
    big = [r for r in rows if r["payload_bytes"] > 1000]
    assert sum(r["record_type"] == "response" for r in big) == 1 and {r["refers_to"] for r in big if r["record_type"] == "revisit"} == {16}
    assert all(r["record_type"] == "response" for r in rows if r["payload_bytes"] < 1000)
    assert {r["payload_digest"] for r in rows if not r["payload_bytes"]} == {hashlib.sha1(b"").hexdigest()}


def test_warc_payloads_come_back(spark, odd):
    pages = spark.read.parquet(f"{odd}/pages.parquet").select("page_id", "url", F.col("html").alias("payload"))
    files, folder = warc.deduplicate(pages, limit=2000)
    got = {r["page_id"]: r["payload"] for r in warc.read_archives(files, folder).where("record_type = 'response'").collect()}
    assert got[16].endswith("x" * 1200) and got[3] == "<p>same</p>3" and got[1] == ""


def test_mix(spark, odd):
    rows = mixing.op2_mix(spark, odd).collect()
    again = mixing.op2_mix(spark, odd).collect()
    key = lambda x: sorted(str(tuple(r)) for r in x)
    assert key(rows) == key(again) and len(rows) == 64
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    size = {t: sum(r["size"] for r in rows if r["target"] == t) for t in {r["target"] for r in rows}}
    for t in size:
        assert abs(sum(r["taken"] for r in rows if r["target"] == t) - t) < 0.01 * t + 10
    assert abs(sum(size) - 1.5 * sum(size.values())) < 1


def test_mix_of_sources_below_a_block(spark):
    words = {"big": [1000] * 400, **{f"s{i:02}": [3 + i, 40 + 7 * i] for i in range(20)}}
    docs = [(i, "w " * n, s) for i, (s, n) in enumerate((s, n) for s in words for n in words[s])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = [(r["source"], r["size"], r["target"], r["taken"]) for r in mixing.mix(df, slots=100, keep=["source"]).select("source", "size", "target", "taken").collect()]
    assert sum(r[1] for r in rows) * 1.5 / 100 > mixing.LARGEST_BLOCK
    for s in words:
        assert sum(r[3] for r in rows if r[0] == s) == round(next(r[2] for r in rows if r[0] == s))
    assert all(taken == 2 * size for s, size, _, taken in rows if s != "big")


def test_decontamination(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect() if r["item_id"] is not None]
    want = sorted(map(str, decontam.brute_force(docs, bench)))
    assert sorted(str(tuple(r)) for r in decontam.op3_decontaminate(spark, odd).collect()) == want
    small = decontam.contamination(spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/benchmark.parquet"), shard_words=50, block_bytes=10, clean_col="clean")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in small.collect()) == sorted((str(d), n, h) for d, n, h, *_ in decontam.brute_force(docs, bench))


@pytest.mark.parametrize("seed", range(5))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 4, 400)
    index = decontam.FMIndex(text, 5)
    for n in (1, 2, 5):
        p = rng.integers(1, 4, (6, n))
        lo, hi = index.search(p, np.full(6, n))
        for k in range(6):
            want = [i for i in range(401 - n) if (text[i : i + n] == p[k]).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_cut_keeps_the_rest():
    assert decontam.cut("Aa bb, cc dd!", [(1, 3)]) == "Aa  dd!"


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op4_language"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n = got.count()
    assert got.where("lang = lang_pred").count() >= 0.97 * n


def test_language_odd_rows(spark, odd):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_language"](spark, odd).where("doc_id is not null").collect()}
    assert rows[48]["lang_pred"] == rows[51]["lang_pred"] == "und" and rows[0]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_nearest_few_and_ties(spark):
    """Fewer candidates than asked, equal vectors, and scores as they are."""
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.25, 9.0]), (None, [3.0, 3.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, row string, part int")
    got = sorted(map(tuple, ann.nearest(df).collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 3, 0.25), (0, 4, 20, 0.0), (20, 1, 3, 9.0), (20, 2, 1, 0.5), (20, 3, 2, 0.5), (20, 4, 0, 0.0)]


def test_nearest(spark, odd):
    rows = ann.op5_nearest(spark, odd).collect()
    assert {r["query_id"] for r in rows} == {0, 20, 40, 60, 80, 100, 120, 140, 160, 180}
    d = "/root/testdata/sf0.01"
    got = {}
    for r in ann.op5_nearest(spark, d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    hits = 0
    for q, mine in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        assert [r for r, _, _ in sorted(mine)] == list(range(1, 21))
        hits += len(best & {v for _, v, _ in mine})
    assert hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("folder", ["odd", "sf0.001", "sf0.01"])
def test_shards(spark, odd, folder):
    """Gapless slots, near-equal bytes, and no text in two shards unless its copies exceed one."""
    d = odd if folder == "odd" else DATA.replace("sf0.001", folder)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rows = shards.shard(docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit(None).cast("string")), keep=["text"]).collect() if folder == "odd" else shards.shard(spark.read.parquet(f"{d}/documents.parquet"), keep=["text"]).collect()
    assert len(rows) == docs.count()
    held, where, copies = {}, {}, {}
    for r in rows:
        held.setdefault(r["shard"], []).append((r["slot"], r["size"]))
        assert r["size"] == len((r["text"] or "").encode()) + 8 and 0 <= r["shard"] < 24
        if r["text"] is not None:
            where.setdefault(r["text"], set()).add(r["shard"])
            copies[r["text"]] = copies.get(r["text"], 0) + r["size"]
    mean = sum(r["size"] for r in rows) / 24
    assert all(sorted(x for x, _ in v) == list(range(len(v))) for v in held.values())
    assert all(len(v) == 1 for t, v in where.items() if copies[t] <= mean)
    if folder != "odd":  # there a single text of 30,000 words exceeds a shard
        sums = [sum(x for _, x in v) for v in held.values()]
        assert len(sums) == 24 and max(sums) < 1.03 * mean and min(sums) > 0.97 * mean


def test_kd_tree_cuts_at_medians(spark, tmp_path):
    """Every unit weighs the same, so the first cut is at the median of the wider dimension, as a local tree has it."""
    rng = random.Random(3)
    pts = [(i, 10, [rng.random() * 100, float(rng.randrange(10)), float(i) * 1e15]) for i in range(4000)]
    df = spark.createDataFrame(pts, "unit long, bytes long, x array<double>")
    got = {r["unit"]: r["shard"] for r in shards.kd_tree(df, 2, [1.0] * 4, f"file://{tmp_path}").collect()}
    assert all(sum(v == s for v in got.values()) in range(990, 1011) for s in range(4))
    left = [p for p in pts if got[p[0]] < 2]
    assert max(p[2][0] for p in left) <= min(p[2][0] for p in pts if got[p[0]] >= 2)


def test_room():
    where, held = shards.place_heavy([(1, 5), (2, 4), (3, 3), (4, 3)], 3)
    assert held == [5, 4, 6] or sorted(held) == [4, 5, 6]
    room = shards.room_left(held, 6)
    assert len({round(a + b, 9) for a, b in zip(held, room, strict=True)}) == 1 and abs(sum(room) - 6) < 1e-9 and len(where) == 4
    assert shards.room_left([10, 0, 0], 4) == [0, 2, 2]


def test_payloads_about_the_bound(spark):
    texts = ["x" * 999, "x" * 1000, "é" * 500, "y" * 2_000_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(t for t in texts for _ in range(2))], "page_id long, url string, payload string")
    files, folder = warc.deduplicate(pages.withColumn("file", F.lit("clash")).withColumn("digest", F.lit("clash")))
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(files, folder).collect()}
    assert got == {0: ("response", None, 999), 1: ("response", None, 999), 2: ("revisit", 3, 1000), 3: ("response", None, 1000), 4: ("revisit", 5, 1000), 5: ("response", None, 1000), 6: ("revisit", 7, 2_000_000), 7: ("response", None, 2_000_000)}


def test_archive_cut_short():
    import zlib

    whole = zlib.compress(b"a" * 100, 4, 31) + zlib.compress(b"b" * 5000, 4, 31)
    assert list(warc.members(whole)) == [b"a" * 100, b"b" * 5000]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(whole[:-3]))


def test_lines_of_odd_pages(spark):
    """A newline in the host, a page of very many lines, an unclosed script and clashing columns."""
    many = "".join(f"<p>line {i}</p>" for i in range(100_000))
    pages = [(i, "http://a\nb/x", "<p>c</p>") for i in range(12)] + [(20 + i, "http://a/x", "<p>b</p><p>c</p>") for i in range(12)]
    pages += [(40, "http://big/x", many), (41, "http://s/x", "<p>one</p><script><p>two</p>"), (42, "http://s/y", "<<<<<p>x</p>")]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, host string, row int")
    got = {r["page_id"]: (r["n_lines"], r["n_dropped"], r["host"]) for r in lines.drop_boilerplate(df).collect()}
    assert got[0] == (1, 1, "z") and got[20] == (2, 2, "z") and got[40] == (100_000, 0, "z") and got[41] == (1, 0, "z") and len(got) == 27


def test_forest_shortens_prefixes_by_crowding(spark, tmp_path):
    """A crowd of near copies is searched deeper than a lone pair, no deeper than recall allows."""
    rng = random.Random(9)
    base = some_text(rng, 150).split()
    docs = [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(150)] + [some_text(rng, 100) for _ in range(30)]
    docs.append(docs[-1] + " more words here")
    forest = neardup.Forest()
    rows = [(i, forest.labels(neardup.shingles(t))) for i, t in enumerate(docs)]
    nodes = spark.createDataFrame(rows, "node long, labels binary")
    _, depths = neardup.candidates(nodes, f"file://{tmp_path}", crowd=16)
    by: dict = {}
    for r in depths.collect():
        by.setdefault(r["node"], []).append(r["depth"])
    crowd, pair = [d for i in range(150) for d in by[i]], by[len(docs) - 1]
    assert set(pair) == {neardup.SHORTEST} and max(crowd) > neardup.SHORTEST
    for i in range(150):
        miss = np.prod([1 - 0.8**d for d in by[i]]) * (1 - 0.8**neardup.SHORTEST) ** (neardup.TREES - len(by[i]))
        assert 1 - miss >= neardup.RECALL
    got = neardup.similar(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), crowd=16).select("doc_id", "class_id", "n_links")
    assert sorted(map(tuple, got.collect())) == sorted(neardup.brute_force(list(enumerate(docs))))


def test_cells_across_ranges(spark, tmp_path):
    """With as many ranges as rows nearly, cells that edges cut are put together to the same edges."""
    rng = random.Random(4)
    base = [some_text(rng, 60) for _ in range(8)]
    rows = [(i, neardup.Forest().labels(neardup.shingles(base[i % 8] + (" x" if i % 3 else "")))) for i in range(64)]
    nodes = spark.createDataFrame(rows, "node long, labels binary")
    whole, _ = neardup.candidates(nodes, f"file://{tmp_path}/a", part_rows=1 << 20)
    cut, _ = neardup.candidates(nodes, f"file://{tmp_path}/b", part_rows=8)
    assert sorted(map(tuple, whole.distinct().collect())) == sorted(map(tuple, cut.distinct().collect()))


def test_recall_near_the_bound(spark):
    """Pairs of similarity 0.8 to 0.85: at least 0.99 of them are linked."""
    rng = random.Random(12)
    docs = []
    for _ in range(300):
        w = [f"u{rng.randrange(10**9)}" for _ in range(204)]
        docs += [w, w[: rng.randrange(165, 172)]]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    want = {r[0] for r in neardup.brute_force(rows[:200]) if r[2]}
    assert len(want) == 200
    got = neardup.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_links = 1").count() >= 0.99 * len(rows)


def test_mix_against_a_plain_schedule(spark):
    """The golden-ratio slots, ranks and blocks worked out row by row."""
    rng = random.Random(8)
    docs = [(i, "w " * rng.randrange(0, 40), [None, "a", "b", "c"][i % 4 if i % 5 else 1]) for i in range(200)]
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), slots=97).collect()}
    size = {d: len(t.split()) for d, t, _ in docs}
    names = ["a", "b", "c", None]
    words = {s: sum(size[d] for d, _, x in docs if x == s) for s in names}
    weight = dict(zip(names, (3, 1, 2, 3), strict=True))
    want, full = 1.5 * sum(words.values()), set()
    while True:
        unit = (want - sum(2 * words[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and unit * weight[s] >= 2 * words[s]}
        if not more:
            break
        full |= more
    target = {s: round(2 * words[s] if s in full else unit * weight[s]) for s in names}
    block = max(1, min(mixing.LARGEST_BLOCK, -(-(3 * sum(words.values())) // (2 * 97))))
    whole, lo, slots = sum(target.values()), 0, {s: 0 for s in names}
    stretch = []
    for s in names:
        stretch.append((lo / whole, (lo + target[s]) / whole, s))
        lo += target[s]
    for i in range(-(-3 * sum(words.values()) // 2 // block)):
        u = (i * float(mixing._PHI)) % 1
        slots[next(s for a, b, s in stretch if a <= u < b)] += 1
    need = {s: -(-target[s] // block) for s in names}  # ranks beyond the need stay empty, missing ones follow
    h = {r["doc_id"]: r["h"] for r in spark.createDataFrame(docs, "doc_id long, text string, source string").select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    cells = mixing.cells_for(len(docs), 512)
    for s in names:
        at = 0
        mine = sorted((d for d, _, x in docs if x == s and size[d]), key=lambda d: (((h[d] % (1 << 64)) >> 40) % cells, h[d], d))
        for d in mine:
            a, b = at, at + size[d]
            spans = [(a, b), (a + words[s], b + words[s])]
            assert got[d] == sum(max(0, min(z, target[s], need[s] * block) - y) for y, z in spans)
            at = b
    assert all(got[d] == 0 for d in size if not size[d])


def test_language_against_a_plain_profile(spark):
    """Profiles and cosines worked out letter group by letter group."""
    p = langid.Profiles()

    def plain(text):
        total = np.zeros(langid.DIM)
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            c = [0, *(p.code[ord(x)] for x in word), 0]
            for i in range(len(word)):
                total += p.first[c[i]].astype(float) * p.second[c[i + 1]] * p.third[c[i + 2]]
        return total / max(1e-9, np.linalg.norm(total))

    texts = ["Das ist ein Haus", "this is a house", "c'est une maison, là-bas", "x"]
    assert np.allclose(p.of(texts), [plain(t) for t in texts], atol=1e-5)
    learned = {"de": plain(texts[0]), "en": plain(texts[1])}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "12"])], "doc_id long, text string")
    for r in langid.predicted(df, learned, ["doc_id", "text"]).collect():
        cos = {k: float(plain(r["text"] or "") @ v) for k, v in learned.items()}
        best = max(cos, key=cos.get)
        assert (r["lang_pred"], round(r["score"], 4)) == (best, round(max(0, cos[best]), 4)) if any(c.isalpha() for c in r["text"] or "") else r["lang_pred"] == "und"


def test_quality_against_a_plain_fit(spark):
    """The weights are where the pairwise loss has no slope, and columns score as arrays do."""
    rng = np.random.default_rng(1)
    n = len(quality.NAMES)
    x, y = rng.normal(size=(400, n)), rng.integers(0, 2, 400)
    x[:, 2] += y
    m = quality.fit(x, y, max_pairs=5000)
    pick = np.random.default_rng(7)
    z = quality.expand((x - m.mean) / m.scale)
    d = z[pick.choice(np.flatnonzero(y == 1), 5000)] - z[pick.choice(np.flatnonzero(y == 0), 5000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 5e-4 * w @ w
    assert all(loss(m.weight) <= loss(m.weight + e) for e in 1e-3 * np.eye(2 * n))
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "doc_id long, features array<double>")
    for r in quality.scored(rows, m).collect():
        want = 1 / (1 + np.exp(-(m.strength(x[r["doc_id"]]) - m.cut + np.log(0.7 / 0.3))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (r["score"] >= 0.7)


def test_quality_learns_from_every_pair():
    """The weights are those of plain Newton steps over all pairs written down, none drawn."""
    rng = np.random.default_rng(2)
    for n, apart in ((400, 1.0), (90, 6.0)):
        x, y = rng.normal(size=(n, len(quality.NAMES))), rng.integers(0, 2, n)
        x[:, 2] += apart * y
        m = quality.fit(x, y)
        z = quality.expand((x - m.mean) / m.scale)
        d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-d @ w))
            w = w - np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ (p - 1) / len(d) + 1e-3 * w)
        assert np.abs(m.weight - w).max() < 1e-6


def test_quality_learns_from_every_row(spark):
    """More labelled rows than were once learned from: mean, scale, weights and threshold are those of all rows in memory, however they are dealt out."""
    rng = np.random.default_rng(3)
    n = 24_000
    x, y = rng.normal(size=(n, len(quality.NAMES))), rng.integers(0, 2, n)
    x[:, 2] += 0.5 * y
    x[::3] = x[0]  # equal strengths, at some quantiles too
    docs = spark.createDataFrame(pa.table({"doc_id": range(n), "features": x.tolist()}))
    # a label said twice counts once; one that contradicts itself, none and another value don't teach
    odd = [(1, int(y[1])), (3, 0), (3, 1), (4, None), (5, 2), (-1, 1)]
    said = [(i, int(v)) for i, v in enumerate(y) if i not in (3, 4, 5)] + odd
    labels = spark.createDataFrame(said, "doc_id long, quality int")
    ok = np.array([zlib.crc32(str(i).encode()) % 4 != 2 and i not in (3, 4, 5) for i in range(n)])
    want = quality.fit(x[ok], y[ok])
    for parts in (3, 7):
        got = quality.train(docs.repartition(parts), labels)
        assert np.allclose(got.mean, want.mean, atol=1e-9) and np.allclose(got.scale, want.scale, atol=1e-9)
        assert np.allclose(got.weight, want.weight, atol=1e-6) and abs(got.cut - want.cut) < 1e-5


@pytest.mark.parametrize("n", [2, 3, 40, 999, 1001, 2500])
def test_quality_threshold(spark, n):
    """Over ranks in tasks as over an array in memory, ties included."""
    rng = np.random.default_rng(n)
    x, y = np.round(rng.normal(size=(n, len(quality.NAMES))), 1), np.arange(n) % 2
    x[:, 0] += 0.3 * y
    w = np.zeros(2 * len(quality.NAMES))
    w[0] = 1.0
    m = quality.Model(np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)), w, 0.0)
    s = m.strength(x)
    grid = np.quantile(s, np.arange(1, 1000) / 1000)
    right = np.array([2 * (s[y == 1] >= t).mean() + (s[y == 0] < t).mean() for t in grid])
    taught = spark.createDataFrame(pa.table({"features": x.tolist(), "y": pa.array(y, pa.int32())})).repartition(3)
    cut = quality.threshold(taught, m, int(y.sum()), int(n - y.sum()), shared_dir(spark))
    assert abs(cut - quality.best_quantile(grid, right)) < 1e-9


def test_jaccard(spark, odd):
    rows = [tuple(r) for r in neardup.op8_jaccard(spark, odd).where("doc_id is not null").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    want = neardup.brute_force([(10**9 if d is None else d, t) for d, t in docs])
    assert sorted(rows) == sorted(x for x in want if x[0] != 10**9)


def test_jaccard_over_many_blocks(spark):
    rng = random.Random(5)
    base = some_text(rng, 200).split()
    docs = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(200)] = f"n{i}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = neardup.similar(df, block=7).select("doc_id", "class_id", "n_links")
    assert sorted(map(tuple, got.collect())) == sorted(neardup.brute_force(docs))


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("quality = predicted").count() >= 0.95 * got.count()


def test_quality_odd_rows(spark, odd):
    rows = queries.QUERIES["op10_quality"](spark, odd).collect()
    assert len(rows) == 64 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_pipeline(spark, odd, void):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    one = corpus_pipeline.drop_copies(spark, docs, odd)
    assert one.columns == docs.columns
    classes = {(r["doc_id"], r["class_id"]) for r in neardup.op8_jaccard(spark, odd).collect()}
    texts = one.where(F.col("text").rlike(neardup.WORD)).where("doc_id is not null").select("doc_id").collect()
    assert sorted(r[0] for r in texts) == sorted({c for _, c in classes if c is not None} - {48, 49, 50, 51, 56, 57, 58, 59})
    clean = corpus_pipeline.decontaminate(spark, docs, odd)
    assert clean.columns == docs.columns and clean.where("doc_id in (0, 1)").count() == 0
    assert corpus_pipeline.mix(spark, docs, odd).columns == docs.columns
    assert corpus_pipeline.keep_good(spark, docs, odd).columns == docs.columns
    assert corpus_pipeline.run(spark, void).count() == 0
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_pipeline_stage_by_stage(spark):
    """The rows of run() are those of the stages' decisions made in plain Python, one after another."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    good = {r["doc_id"] for r in queries.QUERIES["op10_quality"](spark, DATA).where("predicted = 1").collect()}
    left = sorted((d, docs[d]["text"]) for d in good)
    classes = neardup.brute_force(left)
    left = [(d, t) for (d, t), (_, c, _) in zip(left, classes, strict=True) if d == c or not decontam.words(t)]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = {r[0] for r in decontam.brute_force(left, bench) if r[-1]}
    left = [d for d, _ in left if d not in hit]
    out = corpus_pipeline.run(spark, DATA).collect()
    rows = {}
    for r in out:
        rows[r["doc_id"]] = rows.get(r["doc_id"], 0) + 1
    assert set(rows) <= set(left) and max(rows.values()) <= 2
    # the mix leaves out no source, and takes what its targets ask for
    taken = {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    assert set(taken) == {docs[d]["source"] for d in left}
