"""Line dedup, whitening and cross-tokenizer alignment against plain versions, with edge cases."""

import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ostinato.llm import cross_tokenizer, line_dedup, queries, whitening

SF = "/root/testdata/sf0.001"
LONG = "A line that is long enough to be counted"


def plain_lines(rows):
    """(n_lines, n_dropped, text) of each (doc_id, text), by dictionaries over whole keys."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [[(x, x.strip(" \t\n\x0b\x0c\r").translate(lower)) for x in (t or "").split("\n")] for _, t in rows]
    docs, owner = Counter(), {}
    for (i, _), lines in zip(rows, split, strict=True):
        for k in {k for _, k in lines if len(k) >= 20}:
            docs[k] += 1
            owner[k] = i if owner.get(k) is None else owner[k] if i is None else max(i, owner[k])
    out = []
    for (i, _), lines in zip(rows, split, strict=True):
        kept = [x for x, k in lines if not (docs[k] >= 3 and owner[k] != i)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINE_ROWS = [
    *[(i, f"{LONG}\nunique line of document number {i}\n  {LONG.upper()}\t\n") for i in range(1, 40)],
    (40, None), (41, ""), (42, "\n\n"), (43, "short\nshort"), (44, "short"), (45, "short"),
    (46, "é" * 19), (47, "é" * 19), (48, "é" * 19), (49, "é" * 20), (50, "é" * 20), (51, "É" * 20), (52, "é" * 20 + "\n" + "é" * 20), (53, "é" * 20 + "\r"),
    (60, "a line under a repeated id"), (60, "a line under a repeated id"), (7, "a line under a repeated id\nx"),
    (None, f"{LONG}\nalone"), (None, "a line of nobody with an id"), (None, "a line of nobody with an id"), (None, "a line of nobody with an id"),
    (70, "two documents hold this line"), (71, "two documents hold this line"), (72, "y" * 300_000 + "\n" + LONG),
]


@pytest.mark.parametrize("upto", [line_dedup.BROADCAST_UPTO, 0])
def test_line_dedup_equals_plain_version(spark, upto, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "PROBES", 20)  # the common line's shard is dealt out
    docs = spark.createDataFrame([(i, t, j, "clash") for j, (i, t) in enumerate(LINE_ROWS)], "doc_id long, text string, h1 int, n_lines string")
    got = line_dedup.drop_repeated_lines(docs.repartition(3), broadcast_upto=upto, keep=["doc_id", "h1"]).collect()
    want = [(i, j, *x) for j, ((i, _), x) in enumerate(zip(LINE_ROWS, plain_lines(LINE_ROWS), strict=True))]
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert sum(r.n_dropped for r in got) > 80


@pytest.mark.parametrize("upto", [line_dedup.BROADCAST_UPTO, 0])
def test_line_dedup_of_documents(spark, upto):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(docs, broadcast_upto=upto).collect()}
    assert [got[i] for i, _ in rows] == plain_lines(rows)
    if upto:
        digest = {r.doc_id: r.kept_sha256 for r in queries.op11_line_dedup(spark, SF).collect()}
        assert digest == {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in got.items()}


def test_line_dedup_of_no_documents(spark):
    for upto in (1, 0):
        assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string"), broadcast_upto=upto).count() == 0


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, (20_000, 2)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h[1:50, 0] = h[0, 0]  # equal first words are told apart by the second
    sizes, words, slot = line_dedup.build_levels(h)
    assert sorted(slot) == list(range(len(h))) and sum(sizes) < 5 * len(h)
    order = np.argsort(slot)
    shard = {"shard": 0, "sizes": sizes.tobytes(), "words": words.tobytes(), "prints": h[order, 1].tobytes(), "counts": np.arange(len(h)).tobytes(), "owners": np.arange(len(h)).tobytes()}
    index = line_dedup.LineIndex(1, [shard])
    assert (index.find(h) == slot).all()
    assert (index.find(rng.integers(0, 2**63, (20_000, 2)).astype(np.uint64)) == -1).all()
    assert (line_dedup.LineIndex(3, []).find(h) == -1).all()


def plain_whitening(vectors):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s, strict=True)] for v in x])
    return n, deviation, centred, np.cov(centred.T, bias=True)


def test_whitening_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, deviation, centred, cov = plain_whitening([v for _, v in rows])
    values = np.linalg.eigvalsh(cov)[::-1]
    got = defaultdict(dict)
    for r in queries.op12_whitening(spark, SF).collect():
        assert r.n == n and r.identity_error < 1e-9
        assert r.deviation == deviation[[i for i, _ in rows].index(r.vec_id)]
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(cov), rel_tol=1e-9)
        got[r.vec_id][r.component] = r.whitened
    white = np.array([[got[i][k] for k in range(1, 9)] for i, _ in rows])
    assert np.abs(white.T @ white / n - np.eye(8)).max() < 1e-9
    # Each column is the projection on an eigenvector: cov @ v = e v, with v found from the column itself.
    for k in range(8):
        v = np.linalg.lstsq(centred, white[:, k] * np.sqrt(values[k]), rcond=None)[0]
        assert abs(v @ v - 1) < 1e-9 and np.abs(cov @ v - values[k] * v).max() < 1e-6 * values[0]


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, deviation string, part int"
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=4).round(3).tolist(), "x", 1) for i in range(30)]
    bad = [(90, None, "x", 1), (91, [1.0, None, 2.0, 3.0], "x", 1), (92, [1.0, float("nan"), 0.0, 0.0], "x", 1), (93, [float("inf"), 0.0, 0.0, 0.0], "x", 1), (94, [], "x", 1), (95, [1.0, 2.0], "x", 1), (96, [1e30, 0.0, 0.0, 0.0], "x", 1)]
    odd = [(None, good[0][1], "x", 1), (3, good[3][1], "x", 1), (3, good[4][1], "y", 2)]
    table = spark.createDataFrame(good + bad + odd, schema).repartition(3)
    model = whitening.fit(table)
    n, deviation, _, cov = plain_whitening([np.float32(v) for _, v, _, _ in good + odd])
    got = whitening.transform(table, model, keep=["vec_id", "part"]).collect()
    assert model.n == n == len(got) == 33 and len(model.values) == 4
    assert np.allclose(model.values, np.linalg.eigvalsh(cov)[::-1], rtol=1e-9)
    assert sorted(int(r.deviation) for r in got) == sorted(deviation)
    for rows in ([], good[:1], [(i, [1.0, 2.0], "x", 1) for i in range(5)], bad[:3]):
        t = spark.createDataFrame(rows, schema)
        m = whitening.fit(t)
        assert len(m.values) == 0 and [r.whitened for r in whitening.transform(t, m).collect()] == [[]] * m.n
    # One direction only: a second component has no variance.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "x", 1) for i in range(9)], schema)
    assert len(whitening.fit(line).values) == 1


def test_exact_deviations_beyond_64_bits():
    x = np.array([[2**50, -(2**50)], [5, 7]], dtype=np.int64)
    sums = [2**50 + 5, 7 - 2**50]
    want = [sum((2 * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert whitening.deviations(x, 2, sums) == want
    assert whitening.deviations(x, 2**40, [s * 2**39 for s in sums])[0] > 2**64


def plain_alignment(texts):
    """Rows by ids and byte ranges of the libraries, and all pairs of overlapping ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(cross_tokenizer.BYTE_LEVEL)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=cross_tokenizer.MODEL)
    chars = cross_tokenizer.byte_values()
    docs = []
    for t in texts:
        a = [(i, bytes(chars[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(t)] if t else []
        whole = (" " + t).encode() if t else b""
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, lo = [], 0
        for i, s, e in spans[0]:
            while lo < len(spans[1]) and spans[1][lo][2] <= s:
                lo += 1
            k = lo
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in spans))
            start = end
        docs.append((len(a), len(b), groups, links))
    count = Counter(p for d in docs for p in set(d[3]))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(na, nb, len(g), len(x), ";".join(g), sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x)) for na, nb, g, x in docs]


TEXTS = [
    None, "", " ", "a", "\n\n\n", "Hello world", "<|endoftext|> and <s> </s> <unk> <0x0A>", "naïve café über ½ ² 中文字符 🙂🙂 ‍", "mark ▁ inside", "\t tab\r\n", "x" * 3000,
    "the the the the", "the the the the", "    many     spaces   ", "\0 nul", "é combined", "12345 67,890.5", "don't I'll we've", "لغة עברית ไทย", "word " * 2000,
]


@pytest.mark.parametrize("hot", [cross_tokenizer.HOT_PAIRS, 25, 0])
def test_alignment_equals_plain_version(spark, hot):
    docs = spark.createDataFrame([(None if i == 3 else 5 if i in (4, 5) else i, t, i, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, place int, n_a string")
    aligned = cross_tokenizer.align(docs.repartition(3), keep=["doc_id", "place"]).cache()
    got = {r.place: r for r in cross_tokenizer.score_links(aligned, hot_pairs=hot).collect()}
    for i, want in enumerate(plain_alignment(TEXTS)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) == want, (i, TEXTS[i])
    assert got[8].n_a == 0 and got[5].n_links > 0 and len(got) == len(TEXTS)


def test_alignment_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op13_cross_tokenizer(spark, SF).collect()}
    for (i, _), (na, nb, ng, nl, groups, best, total) in zip(rows, plain_alignment([t for _, t in rows]), strict=True):
        r = got[i]
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (na, nb, ng, nl, best, total, sha)


def test_alignment_of_no_documents(spark):
    aligned = cross_tokenizer.align(spark.createDataFrame([], "doc_id long, text string"))
    assert cross_tokenizer.score_links(aligned).count() == 0
