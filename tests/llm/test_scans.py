"""Decontamination, license scans, token counts, SentencePiece and sharding against brute force."""

import random
import re
import time
import zlib

import numpy as np
import pytest

from ostinato.llm import decontaminate, licenses, queries, sentencepieces, sharding, token_counts

SMALL = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")


def edit_distance_anywhere(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance_matches_the_plain_one():
    rng = np.random.default_rng(5)
    for _ in range(300):
        p, t = rng.integers(0, 4, rng.integers(1, 90)).tolist(), rng.integers(0, 4, rng.integers(0, 120)).tolist()
        want = edit_distance_anywhere(p, t)
        got = decontaminate.best_match(p, t, len(p) - 1)
        assert (got is None and want == len(p)) or got[0] == want


def test_decontamination_finds_edited_copies(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(6, 40)))) for i in range(12)]
    rows = []
    for d in range(60):
        words = rng.choice(vocab, 80).tolist()
        item = items[d % 12][1].split()
        for _ in range(d % 6):
            k = rng.integers(0, len(item))
            item[k : k + 1] = [["edited"], [], ["more", "words"]][rng.integers(0, 3)]
        at = rng.integers(0, 80)
        rows.append((d, " ".join(words[:at]) + "\n" + ", ".join(item).upper() + "%% " + " ".join(words[at:])))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (None, "a b c d e f")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs(spark, [*rows, (99, None), (98, "")]), bench).collect()}
    want = {}
    for d, text in rows:
        words = decontaminate.words_of(text)
        for i, item in items:
            p = decontaminate.words_of(item)
            k = edit_distance_anywhere(p, words)
            if k <= int(len(p) * 0.2):
                want[d, i] = k
    assert {k: r.distance for k, r in got.items()} == want and len(want) > 20
    for (d, i), r in got.items():
        part = decontaminate.words_of(dict(rows)[d])[r.start : r.end]
        assert edit_distance_anywhere(decontaminate.words_of(dict(items)[i]), part) == r.distance


def test_decontamination_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs(spark, [(1, "a b")]), bench).count() == 0
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontaminate.find(docs(spark, []), bench).count() == 0


def test_every_leak_of_the_tables_is_found(spark):
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, SMALL).collect()}
    items = [(r.item_id, " ".join(r.text.split())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() for i, t in items if t in " ".join(r.text.split())}
    assert want and want <= got


def as_pattern(markup):
    """A template as a regular expression over words that are each followed by a space."""
    out, at = "", 0
    words = lambda s: "".join(re.escape(w.decode()) + " " for w in licenses.ascii_words(s))
    for m in re.finditer(r'<<beginOptional>>|<<endOptional>>|<<var;.*?match="\.\{(\d+),(\d+)\}">>', markup):
        out += words(markup[at : m.start()]) + ("(?:" if m[0].startswith("<<b") else ")?" if m[0].startswith("<<e") else "(?:[^ ]+ ){%s,%s}" % m.groups())
        at = m.end()
    return re.compile(out + words(markup[at:]))


def test_license_scan_matches_patterns(spark):
    texts = [
        "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.", "CC BY-NC", "licensed under CC by nc 4.0, and under the mit license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of our tool, to deal in the Software", None, "", "...",
        "This work is licensed under the GNU General Public License as published by the Free Software Foundation, either version 3", "the mit license",
        "To the extent possible under law, Jane Q. Doe has waived all copyright and related or neighboring rights", "É licensed under the MIT License" * 2,
        *(re.sub(r"<<beginOptional>>|<<endOptional>>|<<var.*?>>", " ", t) for _, t in licenses.TEMPLATES),
        *(re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", re.sub(r'<<var.*?original="(.*?)".*?>>', r"\1", t)) for _, t in licenses.TEMPLATES),
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, enumerate(texts))).collect()}
    rules = [*licenses.BASE_PHRASES, *licenses.TEMPLATES]
    for i, text in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for k, (label, markup) in enumerate(rules):
            p = as_pattern(markup)
            for j in range(len(words)):
                if p.match("".join(w + " " for w in words[j:])):
                    labels.add(label)
                    if k < len(licenses.BASE_PHRASES):
                        places.append((j, label))
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and r.labels == ",".join(sorted(labels))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


@pytest.mark.parametrize("bad", ["<<beginOptional>>x", "x<<endOptional>>", "<<beginOptional>>a<<endOptional>> b", 'a <<var;match="[0-9]">>'])
def test_bad_templates_are_refused(bad):
    with pytest.raises(ValueError):
        licenses.Automaton([("x", bad)])


def test_token_counts_against_the_library(spark):
    import tiktoken  # noqa: F401

    encode = token_counts._encoder(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN).encode_ordinary
    texts = [None, "", "a", "Hello world", "Hello world", "<|endoftext|>", "x" * 5000, "été 日本"]
    n = sorted(len(encode(t)) if t else 0 for t in texts)
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs(spark, enumerate(texts))))
    for r in sums.collect():
        x = r.length
        assert (r.n_docs, r.docs_le, r.docs_ge) == (n.count(x), sum(v <= x for v in n), sum(v >= x for v in n))
        assert (r.total_tokens, r.tokens_le, r.truncated_total) == (sum(n), sum(v for v in n if v <= x), sum(min(v, x) for v in n))
    limits = [0, 1, 2, 100, 10**6]
    for r in token_counts.at_limits(sums, limits).collect():
        assert (r.docs_over, r.truncated_total, r.total_tokens) == (sum(v > r.context for v in n), sum(min(v, r.context) for v in n), sum(n))
    got = {r.share: r.length for r in token_counts.quantiles(sums, [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: n[0], 0.5: n[-(-len(n) // 2) - 1], 1.0: n[-1]}
    assert token_counts.suffix_sums(token_counts.length_histogram(docs(spark, []))).count() == 0


def test_suffix_sums_over_many_blocks(spark):
    n = list(range(0, 30000, 7))
    h = spark.createDataFrame([(x, x % 5 + 1) for x in n], "length long, n_docs long")
    got = {r.length: r for r in token_counts.suffix_sums(h).collect()}
    for x in (0, 4095 // 7 * 7, 8197, n[-1]):
        assert got[x].truncated_total == sum(min(v, x) * (v % 5 + 1) for v in n)


def test_sentencepieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rng = np.random.default_rng(3)
    texts = [None, "", "  Hello  wörld\n\tx \0 é😀 ▁a", "a" * 300, "ab" * 400, "   ", "\n\n", "日本語テスト", *("".join(rng.choice(list("ab th.\n é1😀▁"), 200)) for _ in range(40))]
    rows = docs(spark, enumerate(texts))
    got = {r.doc_id: r for r in sentencepieces.encode_and_check(rows).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == lib.encode(t or "") and got[i].n_pieces == len(got[i].ids)
        assert got[i].round_trip == ("▁" not in (t or ""))
    back = {r.doc_id: r.text for r in sentencepieces.decode(sentencepieces.encode(rows)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    odd = spark.createDataFrame([(1, [1, 2, 99999, -1, None, 413]), (2, None), (3, [3 + 0xFF])], "doc_id long, ids array<int>")
    assert [r.text for r in sentencepieces.decode(odd).orderBy("doc_id").collect()] == [lib.id_to_piece(413).replace("▁", " ").removeprefix(" "), "", "�"]


def test_shards_follow_their_law(spark):
    rows = [(i, "hot " * 40) for i in range(400)] + [(1000 + i, f"text {i} " * (i % 50)) for i in range(1500)] + [(5000, None), (5001, ""), (None, "no id"), (7, "hot " * 40)]
    got = sharding.shard(docs(spark, rows), 8).toPandas()
    assert len(got) == len(rows)
    size = got.groupby("shard")["size"].sum()
    assert sorted(size.index) == list(range(8)) and size.max() - size.min() < 0.1 * size.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by_id = dict(rows)
    for r in got[got.doc_id.notna()].itertuples():
        raw = (by_id[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    hot = zlib.crc32(("hot " * 40).encode())
    spread = got[got.text_crc32 != hot].groupby("text_crc32").shard.nunique()
    assert (spread == 1).all() and got.law.eq("bytes").all() and got.grown_shard.isna().all()
    assert sharding.shard(docs(spark, []), 8).count() == 0


@pytest.mark.parametrize("gap", [0, 1, 39, 40, 41, 10_000])
def test_replaceable_regions_without_a_bound_take_any_number_of_words(gap):
    machine = licenses.Automaton([("one", 'alpha beta <<var;name="x";match=".+">> gamma delta'), ("none", 'alpha beta <<var;name="x";match=".*">> gamma delta')])
    words = licenses.ascii_words("so alpha beta " + "filler " * gap + "gamma delta end")
    want = [(0, 1, gap + 5)] if gap else []
    assert machine.find(words) == [*want, (1, 1, gap + 5)]


def test_many_starts_of_an_open_region_share_one_walk():
    machine = licenses.Automaton([("open", 'alpha <<var;name="x";match=".+">> omega'), ("tail", 'alpha <<var;name="x";match=".*">>')])
    n = 100_000
    began = time.time()
    found = machine.find([b"alpha"] * n + [b"omega"])
    assert time.time() - began < 20
    assert found[:2] == [(0, 0, n + 1), (1, 0, n + 1)] and len(found) == 2 * n - 1 and found[-1] == (1, n - 1, n + 1)
    assert licenses.covered([(0, 3), (1, 2), (2, 5), (7, 8)]) == 6


def test_walk_equals_regular_expressions_on_random_words():
    rng = random.Random(4)
    machine = licenses.Automaton([("t", 'a <<beginOptional>>b c<<endOptional>> d <<var;name="x";match=".+">> a <<beginOptional>>d<<endOptional>> b')])
    shape = re.compile(r"a (?:b c )?d (?:[a-d] )+a (?:d )?b ")
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(25)]
        want = []
        for i, w in enumerate(words):
            ends = [e for e in range(i + 1, 26) if w == "a" and shape.fullmatch(" ".join(words[i:e]) + " ")]
            want += [(0, i, max(ends))] if ends else []
        assert machine.find([w.encode() for w in words]) == want
