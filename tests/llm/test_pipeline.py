"""The pipeline's stages against what each should keep."""

import numpy as np

import corpus_pipeline
from ostinato.llm import langid, toxicity
from ostinato.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_pass_on_documents_and_end_in_pieces(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(kept)
        gone = set(kept) - set(ids)
        if name == "toxicity":
            m = toxicity.fit(docs, table(spark, SF, "labels"))
            assert gone == {r.doc_id for r in toxicity.score(docs, m).filter("predicted = 1").collect()}
        elif name == "minhash_near_dedup":
            by_text = {}
            for i, t in kept.items():
                by_text.setdefault(" ".join(t.lower().split()), []).append(i)
            assert all(len(set(g) & set(ids)) <= 1 for g in by_text.values()) and gone
        elif name == "decontamination":
            items = [" ".join(r.text.split()) for r in table(spark, SF, "benchmark").collect()]
            assert gone >= {i for i, t in kept.items() if any(x in " ".join(t.split()) for x in items)}
        else:
            assert len(gone) <= 2
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
            kept, docs = {i: t for i, t in kept.items() if i not in gone}, out
        else:
            assert all(r.round_trip for r in out.collect())
    assert sorted(ids) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())


def test_odd_rows_pass_through(spark):
    rows = [(None, "le chat noir", "fr", "s", None), (1, None, None, None, 2), (2, "", "en", "s", 0), (3, "the black cat sat", "en", "s", 3), (3, "the black cat sat", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = corpus_pipeline.keep_languages(spark, docs, SF).collect()
    assert {r.text for r in known} <= {"le chat noir", "the black cat sat"} and langid.UNKNOWN == "und"
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in one) == ["1", "2", "3", "None"]
    assert corpus_pipeline.keep_uncontaminated(spark, docs, SF).count() == 5
    assert corpus_pipeline.keep_civil(spark, docs, SF).count() == 5


def test_near_copies_of_80_to_85_percent_go(spark):
    rng = np.random.default_rng(12)
    rows, shares = [], []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 154)]
        # 150 shingles, of which each edit far from the others takes 5: 130 of 170 after four, 135 of 165 after three.
        near, far = list(words), list(words)
        for at in (20, 60, 100):
            near[at] = "edit"
        for at in (20, 60, 100, 140):
            far[at] = "edit"
        rows += [(3 * k + i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, far)) if i < 2 or k % 2]
        sets = [{tuple(w[i : i + 5]) for i in range(150)} for w in (words, near)]
        shares.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert all(0.80 <= x < 0.85 for x in shares)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()}
    # ``near`` and ``far`` share 145 of 155 shingles, so ``far`` goes through the chain.
    assert kept == {3 * k for k in range(40)}


def test_pairs_below_80_percent_stay(spark):
    rng = np.random.default_rng(13)
    rows = []
    for k in range(20):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 154)]
        far = list(words)
        for at in (20, 60, 100, 140):
            far[at] = "edit"
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join(far), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.keep_one_of_each_group(spark, docs, SF).count() == 40
