"""Whitening, pieces and codes against plain versions, and their defined cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, codes, common, langid, pieces, quality, whitening
from tests.llm.test_llm import DATA, VOCAB, make, odd_documents, sql_rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("odd3"), odd_documents())


def vectors(spark, rows, schema="vec_id long, embedding array<double>, label int, error string, x int, k0 string"):
    return spark.createDataFrame([(*r, "e", 1, "k")[:6] for r in rows], schema)


def some_vectors(n, d=8, seed=1):
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(7, d)) * 3
    return [(i, [float(x) for x in near[rng.integers(7)] + rng.normal(size=d) * rng.choice([0.01, 0.5])], int(rng.integers(3)) or None) for i in range(n)]


#: Rows of which none takes part: null, empty, null and non-finite components, another length.
LEFT_OUT = [(1, None, 1), (2, [], 1), (3, [1.0, None] * 4, 1), (4, [float("nan")] * 8, 2), (5, [float("inf")] + [0.0] * 7, None), (6, [1.0], 1)]


# nearest


def recalls(df, rows, k=20):
    """Share of the true nearest that each query found, the found ones in order and with their own products."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    out = []
    for q, mine in got.items():
        s = x @ x[ids == q][0]
        assert [r["rank"] for r in mine] == list(range(1, min(k, len(ids) - 1) + 1)) and [r["score"] for r in mine] == sorted((r["score"] for r in mine), reverse=True)
        assert all(abs(r["score"] - s[ids == r["vec_id"]][0]) <= 1e-12 * abs(r["score"]) for r in mine)
        s[ids == q] = -np.inf
        out.append(len({r["vec_id"] for r in mine} & set(ids[np.lexsort((ids, -s))[:k]].tolist())) / min(k, len(ids) - 1))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("deal", [{}, {"part_rows": 300, "block_rows": 30}])
def test_recall_of_nearest(spark, sf, deal):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    found = recalls(ann.nearest(df, **deal), [tuple(r) for r in df.collect()])
    assert np.mean(found) >= 0.97 and min(found) >= 0.8


def test_nearest_in_any_layout(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    key = lambda x: sorted(map(str, x.collect()))
    assert key(ann.nearest(df.coalesce(1), part_rows=700)) == key(ann.nearest(df.orderBy(F.desc("vec_id")).repartition(5), part_rows=700))


@pytest.mark.parametrize("large", [1e200, 1e150, 1e-200])
def test_nearest_beside_a_large_vector(spark, large):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=4)], 0) for i in range(1, 60)] + [(60, [large, 0.0, 0.0, 0.0], 0)]
    assert min(recalls(ann.nearest(vectors(spark, rows)), rows)) == 1.0


def test_nearest_of_copies(spark):
    """Equal rows are rows of their own, and only the asking one isn't a candidate; null ids take no part; infinite products come out so."""
    rows = [(20, [1.0, 0.0], 0)] * 3 + [(None, [9.0, 9.0], 0), (7, [0.5, 0.0], 0)]
    got = sorted(map(tuple, ann.nearest(vectors(spark, rows)).collect()))
    assert got == sorted([(20, 1, 20, 1.0), (20, 2, 20, 1.0), (20, 3, 7, 0.5)] * 3)
    rows = [(0, [1e200, 0.0], 0), (1, [1e200, 1.0], 0), (2, [-1e200, 0.0], 0), (3, [1.0, 1.0], 0)]
    assert [tuple(r)[1:] for r in ann.nearest(vectors(spark, rows)).orderBy("rank").collect()] == [(1, 1, float("inf")), (2, 3, 1e200), (3, 2, float("-inf"))]


def test_width_bounds_the_miss():
    """At the width that ends a search, a vector as near as the k-th collides often enough but for the share `miss`."""
    rng = np.random.default_rng(8)
    c = ann.reach(128, 77, 0.05)
    hits = (np.abs(rng.standard_normal((20_000, 128))) <= c).sum(1) >= 77
    assert 0.945 < hits.mean() < 0.955


# whitening


def plain_whitening(x, k):
    n = len(x)
    y = x - x.sum(0) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(values)[::-1][:k]
    return y @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum(), ((n * x - x.sum(0)) ** 2).sum(1)


@pytest.mark.parametrize("d", [DATA, "/root/testdata/sf0.01"])
def test_whitened_as_by_plain_algebra(spark, d):
    given = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in given], np.float64)).astype(np.int64) + 1_000_000
    want, share, deviation = plain_whitening(x, 32)
    rows = whitening.op11_whiten(spark, d).toPandas().sort_values(["vec_id", "component"])
    assert len(rows) == 32 * len(x) and set(rows.n) == {len(x)} and rows.identity_error.nunique() == 1 and rows.identity_error.max() < 1e-9
    got = rows.whitened.to_numpy().reshape(-1, 32)
    sign = np.sign((got * want).sum(0))
    assert np.abs(got * sign - want).max() < 1e-6
    assert np.allclose(rows.explained.to_numpy().reshape(-1, 32), share, rtol=1e-9)
    assert (rows.deviation.to_numpy().reshape(-1, 32) == deviation[:, None]).all()


def test_whitening_is_the_same_in_any_layout(spark):
    """The fit exactly, whitened entries to the last digits of a matrix product."""
    rows = some_vectors(500) + LEFT_OUT
    one = whitening.whiten(vectors(spark, rows).coalesce(1), ["vec_id", "label"]).toPandas().sort_values("vec_id")
    many = whitening.whiten(vectors(spark, rows[::-1]).repartition(13), ["vec_id", "label"]).toPandas().sort_values("vec_id")
    assert len(one) == 500 and [list(one[c]) for c in ("vec_id", "n", "deviation")] == [list(many[c]) for c in ("vec_id", "n", "deviation")]
    assert one.explained.map(tuple).tolist() == many.explained.map(tuple).tolist()
    assert np.abs(np.stack(one.whitened) - np.stack(many.whitened)).max() < 1e-12


def test_whitening_of_few_directions(spark):
    """Components without variance are left out; equal vectors alone give no row; repeated and null ids stay."""
    rows = [(i % 5 or None, [float(i), 2.0 * i, 7.0], 0) for i in range(20)]
    got = whitening.whiten(vectors(spark, rows), ["vec_id", "x", "k0", "label", "error"]).collect()
    assert len(got) == 20 and {len(r["whitened"]) for r in got} == {1} and sum(r["vec_id"] is None for r in got) == 4
    assert abs(got[0]["explained"][0] - 1) < 1e-12 and got[0]["identity_error"] < 1e-9 and {r["x"] for r in got} == {1}
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0)] * 3), ["vec_id"]).count() == 0
    assert whitening.whiten(vectors(spark, LEFT_OUT[:5]), ["vec_id"]).count() == 0


def test_whitening_of_large_entries(spark):
    rows = [(i, [3e9 * (i % 3), -2e9 * (i % 2)], 0) for i in range(12)]
    got = whitening.whiten(vectors(spark, rows), ["vec_id"]).collect()
    x = [[int(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == {i: sum((12 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}
    assert got[0]["identity_error"] < 1e-6
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e200, 1.0], 0), (2, [1.0, 1.0], 0)]), ["vec_id"])


def test_sums_by_tree(spark):
    """As many arrays as tasks are merged by fours; tasks without rows add nothing."""
    df = spark.range(1000).repartition(37).where("id > 10").select("id")
    assert common.tree_sum(df, lambda bs: sum((np.array([[b.num_rows, b["id"].to_numpy().sum()]]) for b in bs), np.zeros((1, 2), np.int64))).tolist() == [[989, 999 * 500 - 55]]
    assert common.tree_sum(df.where("id < 0"), lambda bs: None) is None


# pieces


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def voc(model):
    with open(model, "rb") as f:
        return pieces.Vocabulary(f.read())


def odd_texts():
    rng = random.Random(4)
    out = ["", " ", "   ", "a  b", " lead", "trail  ", "\t\n\r x", "▁▁ x ▁", "<s></s><unk><0x41>", "日本語と漢字", "Ünï cödé", "́a‍👩‍👩‍👧", "a\x00b", "�", "0123456789.50", "x" * 9000, " " * 3000, "ab" * 5000]
    letters = "abcdeth ing 12\n\t.,;▁é😀漢"
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)]
    return [*out, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(20_000)), " ".join(rng.choice(VOCAB) for _ in range(50_000))]


def test_pieces_as_the_library(voc):
    for t in odd_texts():
        ids = pieces.unpack(voc.encode(t))
        assert ids == voc.library.encode(t, add_bos=True, add_eos=True)
        assert voc.decode(ids) == voc.library.decode(ids)
        # the stretches on their own are what the whole text is in one, by the list and by the heap
        whole = "▁" + t.replace(" ", "▁")
        if t and len(t) < 3000:
            assert voc.short(whole) == voc.long(whole) == [x for s in voc.stretches(whole) for x in voc.short(s)]
    voc.check()


def test_whole_texts_as_the_library(spark, model, voc):
    rows = pieces.encode(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model, ["text"]).collect()
    assert [pieces.unpack(r["ids"]) for r in rows] == voc.library.encode([r["text"] for r in rows], add_bos=True, add_eos=True)


def test_any_ids_decode_as_by_the_library(voc):
    """Also bytes that aren't UTF-8, unknown and control ids, and spaces first."""
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(262), rng.randrange(259, 300)]) for _ in range(rng.randrange(12))]
        assert voc.decode(ids) == voc.library.decode(ids)


def test_few_stretches_are_remembered(voc, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    own = pieces.Vocabulary(voc.library.serialized_model_proto())
    texts = odd_texts()[:200]
    assert [own.encode(t) for t in texts] == [voc.encode(t) for t in texts] and len(own.new) <= 3 and len(own.old) <= 3


def test_vocabulary_without_bytes(voc):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(voc.library.serialized_model_proto())
    proto.trainer_spec.byte_fallback = False
    del proto.pieces[3:259]
    own = pieces.Vocabulary(proto.SerializeToString())
    for t in odd_texts()[:300]:
        ids = pieces.unpack(own.encode(t))
        assert ids == own.library.encode(t, add_bos=True, add_eos=True) and own.decode(ids) == own.library.decode(ids)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.Vocabulary(proto.SerializeToString())


def test_op12_on_odd_rows(spark, odd, voc):
    rows = pieces.op12_pieces(spark, odd).collect()
    want = []
    for doc in spark.read.parquet(f"{odd}/documents.parquet").collect():
        ids = voc.library.encode(doc["text"] or "", add_bos=True, add_eos=True)
        want.append((doc["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(voc.library.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)


def test_pieces_give_way_to_clashing_columns(spark, model):
    docs = spark.createDataFrame([(1, "one two", "a", "b"), (1, "one two", "a", "b"), (None, None, None, None)], "k1 int, text string, ids string, decoded string")
    got = pieces.decode(pieces.encode(docs, model, ["k1", "ids", "decoded", "text"]), model, ["k1", "text", "decoded"])
    assert got.columns == ["k1", "text", "decoded"] and sorted(map(str, (tuple(r) for r in got.collect()))) == ["(1, 'one two', 'one two')", "(1, 'one two', 'one two')", "(None, None, '')"]
    assert pieces.decode(got.select(F.lit(None).cast("binary").alias("ids")), model, []).first()["decoded"] is None
    assert pieces.decode(spark.sql("select cast('' as binary) as ids"), model, []).first()["decoded"] == ""


def test_a_wrong_agenda_is_found(spark, model, monkeypatch):
    """With a merge's score changed in the vocabulary's own table, the library's ids differ, and that is an error."""
    seen = []
    monkeypatch.setattr(pieces, "_mapped", lambda docs, keep, column, out, work: seen.append(work))
    pieces.encode(None, model, ["doc_id"])
    with open(model, "rb") as f:
        bad = pieces.Vocabulary(f.read())
    del bad.cost["▁the"]
    monkeypatch.setattr(pieces, "vocabulary", lambda raw: bad)
    with pytest.raises(ValueError, match="differ"):
        seen[0](pa.array(["then the hen"]))


# codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """By comparing every part with every entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64)
    cut = np.split(v, parts, axis=1)
    books = [p[:entries].copy() for p in cut]
    near = lambda p, b: ((p[:, None] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for p, b in zip(cut, books, strict=True):
            at = near(p, b).argmin(1)
            for e in set(at.tolist()):
                own = p[at == e]
                b[e] = [int(s) // len(own) for s in own.sum(0)]
    found = [near(p, b) for p, b in zip(cut, books, strict=True)]
    code = ["".join(f"{int(d[i].argmin()):02x}" for d in found) for i in range(len(v))]
    error = [int(sum(d[i].min() for d in found)) for i in range(len(v))]
    label = {k: sum(e for e, r in zip(error, rows, strict=True) if r[2] == k) for k in {r[2] for r in rows}}
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return sorted(str((r[0], c, e, label[r[2]], sha)) for r, c, e in zip(rows, code, error, strict=True))


def coded(spark, path, df):
    df.write.parquet(f"{path}/embeddings.parquet")
    return sorted(str(tuple(r)) for r in codes.op13_codes(spark, str(path)).collect())


@pytest.mark.parametrize("n", [1, 5, 257, 900])
def test_codes_as_by_comparing_all(spark, tmp_path, n):
    rows = some_vectors(n) + [(None, [0.5] * 8, None), (3, [0.5] * 8, 1), (3, [0.5] * 8, 1)]
    assert coded(spark, tmp_path, vectors(spark, rows + LEFT_OUT).repartition(5)) == plain_codes(rows)


def test_codes_sql_on_odd_rows(spark, tmp_path):
    rows = some_vectors(300) + [(None, [0.5] * 8, None), (3, [0.5] * 8, 1), (3, [0.5] * 8, 1)]
    got = coded(spark, tmp_path, vectors(spark, rows + LEFT_OUT))
    assert got == sql_rows(str(tmp_path), codes.OP13_SQL, ["vec_id", "code", "error", "label_error", "codebooks_sha256"])


@pytest.mark.parametrize("block_rows", [16384, 40])
def test_codes_of_any_blocks(spark, block_rows):
    rows = some_vectors(700)
    df, books = codes.compress(vectors(spark, rows).repartition(3), ["vec_id", "error"], block_rows=block_rows)
    want = {eval(r)[0]: eval(r)[1:3] for r in plain_codes(rows)}
    assert {r["vec_id"]: ("".join(f"{c:02x}" for c in r["codes"]), r["error"]) for r in df.collect()} == want


def test_subtrees_are_assigned_at_once():
    """Tight clusters far apart: whole subtrees go to one entry, and the sums are those of their points."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-9000, 9000, (16, 4))
    p = centres[rng.integers(16, size=4000)] + rng.integers(-3, 4, (4000, 4))
    tree = codes.Tree.over(p)
    at_once = sum(int((tree.starts[level][at + 1] - tree.starts[level][at]).sum()) for level, is_leaf, at, _, _ in tree.walk(centres) if not is_leaf)
    assert at_once > 2000
    again = codes.Tree.unpack(tree.pack())
    entry, far = again.assigned(centres)
    d = ((p[:, None] - centres[None]) ** 2).sum(2)
    assert (entry == d.argmin(1)).all() and (far == d.min(1)).all()
    want = np.array([[*p[entry == e].sum(0), (entry == e).sum()] for e in range(16)])
    assert (tree.totals(centres) == want).all()


@pytest.mark.parametrize("size", [1, 3, 1 << 20, 1 << 27])
def test_ties_and_large_components(size):
    """Equal entries, equal distances, and numbers beyond exact doubles."""
    rng = np.random.default_rng(size)
    p = rng.integers(-3, 4, (800, 4)) * size
    book = p[:50].copy()
    entry, far = codes.Tree.over(p, 5).assigned(book)
    d = ((p[:, None] - book[None]) ** 2).sum(2)
    assert (entry == d.argmin(1)).all() and (far == d.min(1)).all()


def test_codes_that_cannot_be(spark):
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(vectors(spark, [(1, [1.0, 2.0], 0)]), ["vec_id"])
    with pytest.raises(Exception, match="too large"):
        codes.compress(vectors(spark, [(1, [1e200, 2.0, 1.0, 1.0], 0)]), ["vec_id"])
    with pytest.raises(Exception, match="64 bits"):
        codes.compress(vectors(spark, [(1, [1e9, 2.0, 1.0, 1.0], 0)]), ["vec_id"])
    df, books = codes.compress(vectors(spark, LEFT_OUT[:5]), ["vec_id", "codes"])
    assert df.count() == 0 and books == []


# languages and quality


def test_letters_of_all_scripts_are_told_apart():
    """Texts of one script share few or no groups, and no two letters have one vector."""
    p = langid.Profiles()
    texts = ["日本語", "枕棜豎", "漢字仮名", "Ελληνικά", "русский язык", "українська мова", "𠀀𠀁𠀂", "العربية"]
    a = p.of(texts)
    assert np.allclose((a * a).sum(1), 1, atol=1e-5) and np.abs(a @ a.T - np.eye(len(texts))).max() < 0.25
    letters = np.array([c for c in range(0x250, 0x30000) if chr(c).isalpha()][::7])
    rows = p.drawn(letters)
    assert len(np.unique(np.packbits(rows > 0, axis=1), axis=0)) == len(letters) and abs(rows.mean()) < 0.01


def test_languages_beyond_latin_letters(spark):
    words = {"zh": "我们 的 语言 学习 中文 汉字 朋友", "el": "η γλώσσα μας είναι ελληνική καλημέρα", "ru": "наш язык русский доброе утро друг", "uk": "наша мова українська добрий ранок їжак"}
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(words[g].split(), k=12)), g) for i, g in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predicted(df, langid.prototypes(df), ["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def sent(spark, rows, parts):
    """Bytes that a pass of the slopes gives the driver."""
    tracker = spark.sparkContext.statusTracker()
    group = f"pass-{parts}"
    spark.sparkContext.setJobGroup(group, group)
    over = quality.passes(rows.repartition(parts))
    got = over(lambda x, y: {(int(k), int(c)): np.full((36, 14), float((y == k).sum())) for k in set(y.tolist()) for c in range(-3, 4)})
    last = max(tracker.getJobIdsForGroup(group))
    stages = tracker.getJobInfo(last).stageIds
    spark.sparkContext._jsc.clearJobGroup()
    return got, tracker.getStageInfo(max(stages)).numTasks


def test_the_driver_gets_no_more_of_many_tasks(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([([float(v) for v in x], int(i % 2)) for i, x in enumerate(rng.normal(size=(600, len(quality.NAMES))))], "features array<double>, y int")
    few, at_end = sent(spark, rows, 4)
    many, at_last = sent(spark, rows, 64)
    assert at_end <= 5 and at_last <= 5
    assert few.keys() == many.keys() and all(np.array_equal(few[k], many[k]) for k in few)
