"""Licence scan by a generalised suffix automaton over licence tokens.

All templates go into one automaton. Streaming a text through it gives matching statistics: for each word the
longest template substring that ends there. A match of two or more words never crosses a pair of words that is
adjacent in no template, so only runs of adjacent pairs are streamed that have MIN_MATCH words or a pair of a shorter
template; elsewhere the statistic is below MIN_MATCH and ends no whole template. Words are found by hash, then compared
byte by byte. Right-maximal matches of at least MIN_MATCH words (or a whole shorter template) are chained per template,
collinearly and over gaps of at most MAX_GAP words; a chain that covers COVER of its template is a span.

Null and empty texts have no words, count 0, null places, empty labels and score 0. Very long texts are scanned whole,
in time that grows with their length. Rows that repeat a doc_id
are scanned each. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import LOWER, MASK, PUNCT, Block, blocks, column, word_hash

MIN_MATCH, MAX_GAP, COVER = 5, 12, 0.6

#: Phrases whose places are counted, with their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Licence notices in their usual wording, with labels.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "Licensed under CC0 1.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def words_of(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().translate(LOWER))


class Automaton:
    """Generalised suffix automaton; each state knows where in the templates its strings end."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for t in templates:
            last = 0
            for c in t:
                last = self._extend(last, c)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, t in enumerate(templates):
            s = 0
            for i, c in enumerate(t):
                s = self.next[s][c]
                up = s
                while up > 0:
                    self.ends[up].append((k, i + 1))
                    up = self.link[up]
        #: Templates that are, as a whole, a suffix of a state's strings.
        self.whole: list[list[int]] = [[] for _ in self.next]
        sizes = [len(t) for t in templates]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.whole[s] = self.whole[self.link[s]] + [k for k, e in self.ends[s] if self.length[s] >= e == sizes[k] > self.length[self.link[s]]]

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # this prefix is known from another template
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def statistics(self, stream: list[int]) -> list[tuple[int, int]]:
        """State and length of the longest match that ends at each token."""
        s, n, out = 0, 0, []
        for c in stream:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            to = self.next[s].get(c)
            s, n = (to, n + 1) if to is not None else (0, 0)
            out.append((s, n))
        return out


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.labels = [x for x, _ in (*phrases, *notices)]
        texts = [words_of(t) for _, t in (*phrases, *notices)]
        self.n_phrases, self.sizes = len(phrases), [len(t) for t in texts]
        vocabulary = sorted({w for t in texts for w in t})
        hashes = np.array([word_hash(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        self.lengths = np.array([len(w) for w in vocabulary])
        width = -(-int(self.lengths.max()) // 8)
        self.letters = np.array([np.frombuffer(w.ljust(8 * width, b"\0"), "<u8") for w in vocabulary])
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
        ids = {w: k for k, w in enumerate(vocabulary)}
        templates = [[ids[w] for w in t] for t in texts]
        self.automaton = Automaton(templates)
        self.pair = np.zeros((len(ids), len(ids)), bool)
        self.short = np.zeros_like(self.pair)  # pairs of templates shorter than MIN_MATCH
        for t in templates:
            for a, b in zip(t, t[1:], strict=False):
                self.pair[a, b] = True
                self.short[a, b] |= len(t) < MIN_MATCH

    def numbers(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The template word that each word is, or -1."""
        h, out = block.hashes(starts, ends), np.full(len(starts), -1, np.int64)
        some = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[some]
        some, k = some[hit], self.number[k[hit]]
        n = ends[some] - starts[some]
        ok = n == self.lengths[k]
        for c in range(self.letters.shape[1]):
            at = np.minimum(starts[some] + 8 * c, len(block.bytes))
            ok &= (n <= 8 * c) | (block.heads(at) & MASK[np.clip(n - 8 * c, 0, 8)] == self.letters[k, c])
        out[some[ok]] = k[ok]
        return out

    def runs(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each run that can hold a long match or a whole short template."""
        if len(ids) < 2:
            return np.zeros(0, int), np.zeros(0, int)
        a, b = ids[:-1], ids[1:]
        both = (a >= 0) & (b >= 0) & (doc[:-1] == doc[1:])
        linked, short = np.zeros(len(a), bool), np.zeros(len(a), bool)
        linked[both] = self.pair[a[both], b[both]]
        short[both] = self.short[a[both], b[both]]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]
        has = np.concatenate([[0], np.cumsum(short)])
        use = (last - first + 1 >= MIN_MATCH) | (has[last] > has[first])
        return first[use], last[use]

    def scan(self, ids: list[int], at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Places (start, phrase) and long matches (template, start in text, start in template, length) of a run."""
        places, matches = [], []
        found = self.automaton.statistics(ids)
        for i, (s, n) in enumerate(found):
            if n < 2:
                continue
            for k in self.automaton.whole[s]:
                if (size := self.sizes[k]) <= n:
                    if k < self.n_phrases:
                        places.append((at + i + 1 - size, k))
                    matches.append((k, at + i + 1 - size, 0, size))
            if i + 1 == len(found) or found[i + 1][1] <= n:
                matches += [(k, at + i + 1 - n, e - n, n) for k, e in self.automaton.ends[s] if n >= MIN_MATCH and e >= n]
        return places, matches

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains as (template, first word, last word, words of the template covered)."""
        out = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, *m in matches:
            by.setdefault(k, []).append(tuple(m))
        for k, ms in by.items():
            ms.sort()
            ends: list[list[int]] = []  # chains: text end, template end, first, covered, template start of the last match
            near: list[list[int]] = []  # those that this match or a later one can still extend: a few, however long the text
            for d, t, n in ms:
                near = [c for c in near if d - c[0] <= MAX_GAP]
                best = max((c for c in near if 0 <= d + n - c[0] and 0 < t + n - c[1] and t - c[1] <= MAX_GAP and t >= c[4]), default=None, key=lambda c: (c[3], -c[2]))
                if best is None:
                    ends.append([d + n, t + n, d, n, t])
                    near.append(ends[-1])
                else:
                    best[3] += min(n, t + n - best[1])
                    best[0], best[1], best[4] = d + n, t + n, t
            out += [(k, c[2], c[0] - 1, c[3]) for c in ends]
        return out


SPANS = "array<struct<label:string,first:long,last:long,cover:double>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for block in blocks(batches, lower=True):
            starts, ends, first = block.words(PUNCT)
            doc = np.repeat(np.arange(len(block)), np.diff(first))
            ids = scanner.numbers(block, starts, ends)
            got: dict[int, tuple[list, list]] = {}
            for a, b in zip(*(x.tolist() for x in scanner.runs(ids, doc)), strict=True):
                places, matches = scanner.scan(ids[a : b + 1].tolist(), a - int(first[doc[a]]))
                if places or matches:
                    mine = got.setdefault(int(doc[a]), ([], []))
                    mine[0].extend(places)
                    mine[1].extend(matches)
            out: list[tuple] = []
            for k in range(len(block)):
                places, matches = got.get(k, ((), ()))
                chains = [(scanner.labels[t], a, b, min(1.0, n / scanner.sizes[t])) for t, a, b, n in scanner.chain(matches)]
                spans = sorted((c for c in chains if c[3] >= COVER), key=lambda c: (c[1], c[2], c[0]))
                at = [p for p, _ in places]
                base = {scanner.labels[t] for _, t in places}
                out.append((len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {c[0] for c in spans})), max([c[3] for c in chains] + [1.0] * bool(at), default=0.0), [{"label": c[0], "first": c[1], "last": c[2], "cover": c[3]} for c in spans]))
            cols = list(zip(*out, strict=True))
            span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            yield pa.record_batch([column(block.rows, "doc_id"), pa.array(np.diff(first)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}")
