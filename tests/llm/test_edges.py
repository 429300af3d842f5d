"""Edge cases of the training-data operators: repeated and null ids, number signs, unbroken texts, plain versions of fits."""

import math
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ostinato.llm import common, decontaminate, langid, licenses, queries, sentencepieces, setsketch_dedup, sharding, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


@pytest.mark.parametrize("hot_id", [None, 7])
def test_repeated_rows_under_one_id_are_spread(spark, hot_id):
    rows = [(100 + i, f"text {i} " * (i % 30 + 1)) for i in range(800)] + [(hot_id, "hot words here " * 20)] * 1200
    got = sharding.shard(rows_of(spark, rows).withColumnRenamed("n_chars", "size"), 8).toPandas()
    assert len(got) == 2000
    size = got.groupby("shard")["size"].sum()
    assert sorted(size.index) == list(range(8)) and size.max() - size.min() < 0.02 * size.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    cold = got[got.text_crc32 != zlib.crc32(("hot words here " * 20).encode())]
    assert (cold.groupby("text_crc32").shard.nunique() == 1).all()


def test_shards_of_a_target_size(spark):
    rows = rows_of(spark, [(i, "x" * (i % 100)) for i in range(1000)] + [(5000, "y" * 300_000)])
    got = sharding.shard(rows, target_bytes=10_000).toPandas()
    assert got.shard.nunique() >= 6 and len(got) == 1001
    size = got[got.doc_id != 5000].groupby("shard")["size"].sum()
    assert size.max() <= 12_000


def _words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**9, n)]


def test_texts_under_one_id_are_judged_apart(spark):
    rng = np.random.default_rng(3)
    a, b, c = (" ".join(_words(rng, 60)) for _ in range(3))
    near_b = b.split()
    near_b[30] = "edit"
    rows = [(3, a), (5, a), (5, b), (5, c), (5, c), (2, " ".join(near_b)), (None, a), (None, b), (6, None), (6, None), (8, a.upper()), (9, c), (9, c.upper())]
    kept = [(str(r.doc_id), r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, rows_of(spark, rows), SF).collect()]
    assert len(kept) == 6 and set(kept) == {("3", a), ("5", c), ("2", " ".join(near_b)), ("None", a), ("None", b), ("6", None)}
    # Components aren't joined by an id that two texts share.
    found = setsketch_dedup.near_duplicates(rows_of(spark, [(5, b), (5, c), (2, " ".join(near_b))]), percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(2, 2), (5, 2), (5, 5)]


def test_one_row_of_a_set_repeated_under_one_id_stays(spark):
    a = "one two three four five six seven"
    kept = corpus_pipeline.keep_one_of_each_group(spark, rows_of(spark, [(4, a), (4, a), (4, a.upper()), (5, "other words stand under this id")]), SF).collect()
    assert sorted(r.doc_id for r in kept) == [4, 5]


def test_contaminated_rows_go_whatever_their_id(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text)
    rows = [(None, "so " + item), (None, "clean words of nobody"), (1, item), (1, "clean words of somebody"), (2, None), (3, ""), (1, item)]
    kept = corpus_pipeline.keep_uncontaminated(spark, rows_of(spark, rows), SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", "clean words of somebody"), ("2", "None"), ("3", ""), ("None", "clean words of nobody")]
    assert corpus_pipeline.run.__doc__ and corpus_pipeline.keep_uncontaminated(spark, rows_of(spark, []), SF).count() == 0


def test_number_signs_are_no_letters(spark):
    texts = ["½ ² Ⅷ", "１２ ٣", "_ 7", "ª", "été²", "中文", None, ""]
    assert [langid.gram_counts(t) is not None for t in texts] == [any(ch.isalpha() for ch in t or "") for t in texts]
    m = langid.LanguageModel(["de", "en"], np.array([[1], [-1]]), np.zeros((langid.DIMS, 1), np.float32), np.zeros(1), np.ones(1))
    got = {r.doc_id: r for r in langid.identify(rows_of(spark, enumerate(texts)), m).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["und", "und", "und", "de", "de", "de", "und", "und"] and got[0].score == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    assert common.checkpoint_folder("hdfs:///x", "spark://host:7077") == "hdfs:///x"
    assert "ostinato-" in common.checkpoint_folder(None, "local[8]")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.checkpoint_folder(None, master)


def test_every_register_difference_that_can_link_is_looked_at():
    assert (setsketch_dedup.most_different(85), setsketch_dedup.most_different(80)) == (50, 61)


def test_main_members_needn_t_meet(spark):
    rows = [(1, i, i >= 10, 10.0, 90.0) for i in range(100)] + [(2, i, False, 5.0, 0.0) for i in range(200, 205)]
    d = spark.createDataFrame(rows, "key long, node long, is_main boolean, rest double, main double")
    got = common.in_blocks(d, ["key"], ["node"], 16, "rest", "main", "is_main").toPandas()
    pairs = set()
    for (_, bi, bj), g in got.groupby(["key", "bi", "bj"]):
        own = dict(zip(g.node, g.own, strict=True))
        pairs |= {(a, b) for a in own for b in own if a < b and (bi == bj or own[a] != own[b])}
    small = [(a, b) for a in range(10) for b in range(a + 1, 100)]
    assert pairs >= set(small) and pairs >= {(a, b) for a in range(200, 205) for b in range(a + 1, 205)}
    assert len(got[got.key == 1]) < 150 + 90  # those of main are sent once for each block of the rest


def test_long_unbroken_texts_equal_the_library(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepieces, "CHUNK", 64)
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    m = sentencepieces.PieceMatcher(sentencepieces.read_model())
    rng = np.random.default_rng(1)
    texts = ["a" * 500, "ab" * 300, "日本語" * 90, "".join(rng.choice([chr(c) for c in range(0x4E00, 0x4F00)], 700)), "".join(rng.choice(list("abcdefgh/.é1"), 900)), "x y " * 40 + "é" * 200]
    for t in texts:
        assert np.frombuffer(m.encode([t])[0], dtype=np.int32).tolist() == lib.encode(t)
        assert "".join(m.stretches(t)) == t
    assert len(m.stretches(texts[3])) > 5 and not any(len(s) > sentencepieces.KEPT for s in m.cache)


def test_relaxed_edges_give_the_encodings_of_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    pieces = sentencepieces.read_model()
    m = sentencepieces.PieceMatcher(pieces)
    assert m.valid.all() and (m.length[m.left[m.left >= 0]] + m.length[m.right[m.left >= 0]] == m.length[m.left >= 0]).all()
    rng = np.random.default_rng(5)
    words = [p.replace("▁", " ") for p, _, k in pieces if k == 1]
    texts = ["".join(rng.choice(words, rng.integers(1, 40))) for _ in range(600)]
    texts += ["".join(rng.choice(list("aab eeststhing  \n\0é漢🙂=-_"), rng.integers(1, 300))) for _ in range(400)]
    texts += [" " * n + "x" * (n % 3) for n in range(40)] + ["a" * 3000, "=" * 500, "ab" * 400, "\n" * 50, "🙂" * 120, "é" * 300]
    for t, got in zip(texts, m.encode(texts), strict=True):
        assert np.frombuffer(got, dtype=np.int32).tolist() == lib.encode(t), t[:60]


@pytest.mark.parametrize("make", [licenses.scan, sharding.shard, sentencepieces.encode_and_check])
def test_empty_tables_and_clashing_columns(spark, make):
    names = "doc_id long, text string, shard string, slot string, n_words string, labels string, ids string, row string, tie string, _text string"
    assert make(spark.createDataFrame([], names)).count() == 0
    long = "under the mit license " * 40_000
    rows = [(1, long, *"abcdefgh"), (1, long, *"abcdefgh"), (2, None, *"abcdefgh"), (None, "", *"abcdefgh")]
    got = make(spark.createDataFrame(rows, names)).collect()
    assert len(got) == 4 and sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]


def test_a_long_and_repeated_text_is_searched_whole(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    text = "filler words " * 200_000 + "alpha beta gamma delta epsilon zeta"
    got = decontaminate.find(rows_of(spark, [(1, text), (1, text), (2, "alpha beta gamma")]), bench).collect()
    assert [(r.doc_id, r.start, r.end, r.distance) for r in got] == [(1, 400_000, 400_006, 0)] * 2


def test_decoding_follows_the_plain_formula():
    rng = np.random.default_rng(4)
    code = langid.codewords(5, 9)
    m = langid.LanguageModel(list("abcde"), code, rng.normal(size=(6, 9)), rng.normal(size=9), rng.uniform(0.1, 0.5, 9))
    x = rng.normal(size=(40, 6))
    best, score, near = m.decode(x)
    for i in range(40):
        loss = []
        for k in range(5):
            margin = [min(4.0, max(-4.0, sum(x[i, d] * m.weights[d, b] for d in range(6)) + m.bias[b])) for b in range(9)]
            loss.append(sum(m.trust[b] * math.exp(-margin[b] * code[k, b]) for b in range(9)) / sum(m.trust))
        soft = [math.exp(-4 * v) for v in loss]
        assert best[i] == loss.index(min(loss)) and score[i] == pytest.approx(max(soft) / sum(soft))
        assert near[i] == (sorted(loss)[1] - min(loss) < 0.1)


def test_language_weights_solve_the_ridge_system(spark):
    rng = np.random.default_rng(5)
    words = {"xx": ["foo", "bar", "bax"], "yy": ["qui", "quo", "zed"], "zz": ["alm", "elm", "ulm"]}
    rows = [(i, " ".join(rng.choice(words[k], 12)), k, "s", 1) for i, k in enumerate(["xx", "yy", "zz"] * 20)]
    docs = spark.createDataFrame(rows, COLUMNS)
    m = langid.fit(docs, per_language=10**6)
    used = [(t, k) for i, t, k, _, _ in rows if zlib.crc32(str(i).encode()) % 5]
    x = np.stack([langid.features(t) for t, _ in used]).astype(float)
    code = langid.codewords(3, 15)[[m.languages.index(k) for _, k in used]].astype(float)
    n = np.array([sum(k == v for _, v in used) for _, k in used])
    w = 1 / n / (1 / n).sum() * 3
    mean, middle = (w[:, None] * x).sum(0) / 3, (w[:, None] * code).sum(0) / 3
    z = (x - mean) * np.sqrt(w / 1.0)[:, None]
    lam = 1e-2 * 3 / len(used)
    dense = np.flatnonzero(x.any(axis=0))
    a = np.linalg.solve(z[:, dense].T @ z[:, dense] + lam * np.eye(len(dense)), z[:, dense].T @ ((code - middle) * np.sqrt(w)[:, None]))
    assert np.allclose(m.weights[dense], a, atol=2e-3) and np.allclose(m.bias, middle - mean[dense] @ a, atol=2e-3)


def test_training_steps_down_the_plain_likelihood():
    bags = [[{b"bad", b"you"}, {b"fine"}], [{b"bad"}], [{b"bad", b"x"}], [{b"fine"}], [{b"you"}, {b"x"}], [{b"fine", b"x"}]] * 6
    y = np.array([1, 1, 1, 0, 0, 0] * 6)

    def loss(m):
        out = 0.0
        for bag, label in zip(bags, y, strict=True):
            p = toxicity.noisy_or(m.sentence_scores([(0, 0, list(s)) for s in bag]))
            out -= math.log(p if label else 1 - p)
        return out + 0.5 * 0.03 * sum(v * v for v in m.weights.values())

    m = toxicity._train(bags, y, 400, 0.03, 10)
    assert list(m.weights) == [b"bad"]
    best = loss(m)
    for dw, db in ((0.3, 0), (-0.3, 0), (0, 0.3), (0, -0.3)):
        assert loss(toxicity.ToxicityModel({b"bad": m.weights[b"bad"] + dw}, m.bias + db)) > best - 1e-3


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    rows = [dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall()]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[c] for c in columns) for r in rows), key=key)
