"""Toxicity, quality and language ID: held-out accuracy, odd rows and empty tables."""

import zlib

import numpy as np
import pytest

from ostinato.llm import common, langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "   \n"), (None, "plain words here."), (5, "word " * 60000), (5, "word " * 60000), (6, "!!! ??? 123 %%%")]
COLUMNS = "doc_id long, text string, score string, lang_pred int, predicted array<int>"


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 3, [1]) for i, t in ODD], COLUMNS)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = (y == 1).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(spark, query, label):
    got = queries.QUERIES[query](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    return got[got.held_out & got[label].notna()]


def test_folds_follow_the_crc_of_the_id(spark):
    for query, n, fold in (("op4_toxicity", 5, 0), ("op5_quality", 3, 1), ("op7_language_id", 5, 0)):
        got = queries.QUERIES[query](spark, "/root/testdata/sf0.001").toPandas()
        assert [zlib.crc32(str(i).encode()) % n == fold for i in got.doc_id] == got.held_out.tolist()
        assert got.doc_id.is_unique and len(got) == 200


def test_toxicity_on_held_out_documents(spark):
    got = held_out(spark, "op4_toxicity", "toxic")
    assert auc(got.toxic.to_numpy(), got.score.to_numpy()) > 0.85
    assert got[got.toxic == 0].predicted.mean() < 0.02
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_toxicity_locates_sentences(spark):
    m = toxicity.ToxicityModel({b"scum": 12.0, b"idiot": 12.0}, -8.0)
    text = "Élan is fine. You SCUM! Then, the end\nidiot%%%"
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), m).first()
    assert [text[x.start : x.end].strip() for x in got.offending] == ["You SCUM", "idiot%%%"]
    p = 1 / (1 + np.exp([8.0, -4.0, 8.0, -4.0]))
    assert got.score == pytest.approx(1 - np.prod(1 - p))


def test_long_sentences_are_cut_without_losing_words():
    words = [f"w{i}" for i in range(200)]
    said = toxicity.sentences(" ".join(words))
    assert [w.decode() for _, _, x in said for w in x] == words and max(len(x) for _, _, x in said) <= toxicity.MAX_WORDS


def test_quality_on_held_out_documents(spark):
    got = held_out(spark, "op5_quality", "quality")
    assert auc(got.quality.to_numpy(), got.score.to_numpy()) > 0.98
    assert got[got.quality == 1].predicted.mean() > 0.97


def test_quality_density_matches_the_plain_formula():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (80, 3)), rng.normal(1, 2, (60, 3))])
    y = np.repeat([0, 1], [80, 60])
    m = quality.train(x, y)
    z = (x - m.center) / m.scale
    dens = []
    for k in (0, 1):
        s = m.factors[k] @ m.factors[k].T
        d = z - m.means[k]
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.log(np.linalg.det(s)))
    want = 1 / (1 + np.exp(-(dens[1] - dens[0] + np.log(60 / 80))))
    assert np.allclose(m.score(x), want)


def test_languages_of_held_out_documents(spark):
    got = queries.QUERIES["op7_language_id"](spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    got = got.merge(lang, on="doc_id")
    got = got[got.held_out]
    assert (got.lang == got.lang_pred).mean() > 0.98


def test_grams_are_the_same_in_blocks(monkeypatch):
    text = "Ça va bien aujourd'hui, merci beaucoup " * 20
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "_BLOCK", 37)
    assert (langid.gram_counts(text) == whole).all()


def test_codewords_lie_apart():
    code = langid.codewords(6, 15)
    far = (code[:, None] != code[None]).sum(axis=2)
    assert far[~np.eye(6, dtype=bool)].min() >= 5
    assert langid.codewords(1, 15).shape == (1, 15)


def test_odd_rows_keep_their_number_and_ids(spark):
    rows = odd(spark)
    tox = toxicity.score(rows, toxicity.ToxicityModel({}, -20.0)).collect()
    good = quality.score(rows, None).collect()
    lang = langid.identify(rows, None).collect()
    for got in (tox, good, lang):
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    assert all(0 <= r.score < 1e-3 for r in tox) and all(r.score == 0.5 for r in good) and {r.lang_pred for r in lang} == {"und"}


def test_empty_and_unlabelled_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, None, None), (2, 7, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert quality.fit(odd(spark), labels) is None
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0


def test_learned_languages_leave_letterless_texts_undetermined(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the quick brown fox", "en"), ("le renard brun saute", "fr")] * 8)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd(spark), m).collect()}
    assert got[1] == got[2] == got[6] == "und" and got[5] in ("en", "fr")


def test_codewords_grow_with_the_languages():
    assert (langid.codewords(4) == langid.codewords(4, 15)).all() and langid.codewords(1).shape == (1, 15)
    for k in (30, 200):
        code = langid.codewords(k)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) == langid.distance(code) >= 5
        assert all(len(set(c)) == 2 for c in code.T)


def test_a_repeated_id_sends_few_rows_to_the_fits(spark):
    docs = spark.createDataFrame([(1, f"text {i % 50}") for i in range(500)] + [(i, "other") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", 5, 0, 100).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got}.get(1, 4) == 4 and all(r["count"] == 1 for r in got if r.doc_id != 1)
