"""License scans by template markup compiled to automata over words.

Templates use the markup of public license lists: ``<<beginOptional>>...<<endOptional>>`` (may
nest) and ``<<var;name="..";original="..";match="..">>``. Wording outside these regions is mandatory.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ostinato.llm.common import ascii_words, map_texts

# Phrases and labels that always count.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Wordings of well-known licenses and of notices that name them.
TEMPLATES = [
    ("mit", 'Released under <<beginOptional>>the terms of <<endOptional>>the MIT License'),
    ("mit", 'Licensed under <<beginOptional>>the terms of <<endOptional>>the MIT License'),
    ("mit", 'SPDX-License-Identifier: MIT'),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of '
        '<<var;name="software";original="this software and associated documentation files (the Software)";match=".{1,16}">>, '
        'to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        'publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is '
        'furnished to do so, subject to the following conditions: The above copyright notice and this permission notice'
        '<<beginOptional>> (including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software',
    ),
    ("apache-2", 'Licensed under the Apache License, Version 2.0<<beginOptional>> (the "License"); you may not use this file except in compliance with the License<<endOptional>>'),
    ("apache-2", 'SPDX-License-Identifier: Apache-2.0'),
    ("gpl-3", 'licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either <<endOptional>>version 3'),
    ("gpl-2", 'licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either <<endOptional>>version 2'),
    ("gpl-3", 'it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License'),
    ("gpl-2", 'it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License'),
    ("lgpl", 'under the <<beginOptional>>terms of the <<endOptional>>GNU Lesser General Public License'),
    ("agpl-3", 'under the <<beginOptional>>terms of the <<endOptional>>GNU Affero General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either <<endOptional>>version 3'),
    ("mpl-2", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0'),
    ("cc-by", 'Licensed under <<beginOptional>>a <<endOptional>>CC BY 4.0'),
    ("cc-by", 'Licensed under <<beginOptional>>a <<endOptional>>CC BY 3.0'),
    ("cc-by", 'licensed under a Creative Commons Attribution <<var;name="version";original="4.0";match=".{2,2}">> International License'),
    ("cc-by-sa", 'Licensed under <<beginOptional>>a <<endOptional>>CC BY-SA'),
    ("cc-by-nc", 'Licensed under <<beginOptional>>a <<endOptional>>CC BY-NC<<beginOptional>> 4.0<<endOptional>>'),
    ("cc-by-nc", 'licensed under a Creative Commons Attribution-NonCommercial <<var;name="version";original="4.0";match=".{2,2}">> International License'),
    ("cc0", 'To the extent possible under law, <<var;name="holder";original="the author";match=".{1,12}">> has waived all copyright and related or neighboring rights'),
    (
        "bsd",
        'Redistribution and use <<beginOptional>>of this software <<endOptional>>in source and binary forms, with or without modification, '
        'are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the '
        'above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must '
        'reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials '
        'provided with the distribution',
    ),
    (
        "isc",
        'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby '
        'granted, provided that the above copyright notice and this permission notice appear in all copies',
    ),
    ("unlicense", 'This is free and unencumbered software released into the public domain'),
    ("zlib", 'This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software'),
]

_MARK = re.compile(r"<<(beginOptional)[^>]*>>|<<(endOptional)>>|<<var;(.*?)>>", re.S)
_SPAN = re.compile(r"\.\{(\d+),(\d+)\}")
KNOWN_MOVES = 100_000  # moves between sets of states that a worker remembers


def _parts(markup: str) -> list:
    """The template as nested lists: words, ("var", least, most; None without a bound) and ("opt", [...])."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        stack[-1] += ascii_words(markup[at : m.start()])
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        else:
            want = re.search(r'match="(.*?)"', m[3])
            want = want[1] if want else ".+"
            span = _SPAN.fullmatch(want)
            if not span and want not in (".+", ".*"):
                raise ValueError(f"replaceable region with a pattern that isn't supported: {want}")
            stack[-1].append(("var", *map(int, span.groups())) if span else ("var", int(want == ".+"), None))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + ascii_words(markup[at:])


class Automaton:
    """All templates in one automaton over words; its deterministic states are made as texts need them.

    A nondeterministic state is an index; ``step`` maps (state, word) to states, ``free`` marks states
    that take any word (of a replaceable region), ``skips`` are moves without a word.
    """

    def __init__(self, templates: list[tuple[str, str]]):
        self.step: list[dict[bytes, int]] = []
        self.free: list[int] = []
        self.skips: list[list[int]] = []
        self.ends: dict[int, int] = {}
        self.starts: dict[bytes, frozenset[int]] = {}
        self.labels = [label for label, _ in templates]
        self.known: set[bytes] = set()
        self.memo: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}
        first: dict[bytes, set[int]] = {}
        for i, (_, markup) in enumerate(templates):
            parts = _parts(markup)
            if not parts or not isinstance(parts[0], bytes):
                raise ValueError("a template must begin with a mandatory word")
            begin = self._state()
            self.ends[self._chain(begin, parts)] = i
            first.setdefault(parts[0], set()).add(begin)
        self.starts = {w: self._closed(s) for w, s in first.items()}

    def _state(self) -> int:
        self.step.append({})
        self.free.append(-1)
        self.skips.append([])
        return len(self.step) - 1

    def _chain(self, at: int, parts: list) -> int:
        for p in parts:
            if isinstance(p, bytes):
                self.known.add(p)
                at = self.step[at].setdefault(p, self._state())
            elif p[0] == "opt":
                out = self._state()
                self.skips[at].append(out)
                self.skips[self._chain(at if not self.step[at] else self._fork(at), p[1])].append(out)
                at = out
            else:
                out = self._state()
                at = self._fork(at)
                for k in range(p[1] if p[2] is None else p[2]):
                    if k >= p[1]:
                        self.skips[at].append(out)
                    self.free[at] = self._state()
                    at = self.free[at]
                if p[2] is None:
                    self.free[at] = at  # takes any word and stays
                self.skips[at].append(out)
                at = out
        return at

    def _fork(self, at: int) -> int:
        new = self._state()
        self.skips[at].append(new)
        return new

    def _closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _next(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        key = (states, word if word in self.known else b"")
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > KNOWN_MOVES:
                self.memo.clear()
            to = {self.step[s][word] for s in states if word in self.step[s]} | {self.free[s] for s in states if self.free[s] >= 0}
            got = self.memo[key] = self._closed(to)
        return got

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, end) of every start at which a template is accepted, with its longest end.

        Starts that have come to the same states share their further moves, so a text is walked once however many begin in it.
        A node is a start or a union of such groups; ends are noted at the group's node and handed down to its starts at last.
        """
        parent: list[int] = []
        ends: list[dict[int, int]] = []
        begin: dict[int, int] = {}
        groups: dict[frozenset[int], int] = {}

        def node() -> int:
            parent.append(-1)
            ends.append({})
            return len(parent) - 1

        def put(into: dict[frozenset[int], int], states: frozenset[int], k: int) -> None:
            other = into.get(states)
            if other is not None:
                parent[k] = parent[other] = k = node()
            into[states] = k

        for j, w in enumerate(words):
            if w in self.starts:
                k = node()
                begin[k] = j
                put(groups, self.starts[w], k)
            if groups:
                moved: dict[frozenset[int], int] = {}
                for states, k in groups.items():
                    to = self._next(states, w)
                    if to:
                        put(moved, to, k)
                groups = moved
                for states, k in groups.items():
                    for s in states & self.ends.keys():
                        ends[k][self.ends[s]] = j + 1
        out = []
        for k in range(len(parent) - 1, -1, -1):  # unions come after what they unite, and their ends later in the text
            if parent[k] >= 0:
                ends[k] = {**ends[k], **ends[parent[k]]}
            if k in begin:
                out += [(t, begin[k], end) for t, end in ends[k].items()]
        return sorted(out, key=lambda x: (x[1], x[0]))


def covered(spans: list[tuple[int, int]]) -> int:
    """How many words lie in one of the spans (start, end), which are sorted by their starts."""
    n = last = 0
    for i, j in spans:
        n += max(0, j - max(i, last))
        last = max(last, j)
    return n


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Licenses of every row of ``documents``.

    Returns doc_id, n_words, n_base (places of the base phrases), first_word and last_word (their
    smallest and largest start in words from 0; null without any), base_labels and labels
    (distinct, sorted, joined by commas; empty without any), score (the share of the text's words
    inside accepted wordings) and ``matches``, an array of (label, start, end) in words.

    Null and empty texts have no words and score 0. Overlapping places all count, repeated rows stay
    repeated, other columns are dropped. One map over the scan, no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast((BASE_PHRASES, TEMPLATES if templates is None else templates))

    def make():
        base, own = shared.value
        machine = Automaton([*base, *own])

        def one(text):
            words = ascii_words(text)
            found = machine.find(words) if not machine.starts.keys().isdisjoint(words) else []
            at = [i for t, i, _ in found if t < len(base)]
            labels = [{machine.labels[t] for t, _, _ in found if t < n} for n in (len(base), len(machine.labels))]
            places = [{"label": machine.labels[t], "start": i, "end": j} for t, i, j in found]
            share = covered([x[1:] for x in found]) / len(words) if words else 0.0
            return (len(words), len(at), min(at, default=None), max(at, default=None), *(",".join(sorted(x)) for x in labels), share, places)

        return lambda texts: list(zip(*map(one, texts), strict=True)) or [[]] * 8

    fields = (
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, matches array<struct<label:string,start:int,end:int>>"
    )
    return map_texts(documents, make, fields)
