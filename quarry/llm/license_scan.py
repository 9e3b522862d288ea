r"""Licence scan by a generalised suffix automaton.

The automaton holds the word sequences of licence templates and of the base phrases.
A text's words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (A-Z lower-cased) are streamed through
it; at each word the matching statistic is the length of the longest template substring
that ends there. Words outside the templates' vocabulary reset the stream, so only runs of
vocabulary words reach the automaton.

Base labels: a phrase stands wherever it is a suffix of the current match. The method's
labels: matches of ``min_match`` words or more are chained in template order, gaps of up to
``max_gap`` words allowed, and a template is found when a chain covers ``min_cover`` of it.
A match may stand at each place of its words in the template, and extends whichever open chain
covers most with it; the others stay open until the gap closes them. A match counts for the
templates that hold all of it, so of licences that share most words the closer one is found.
``score`` is the best template's coverage, or 0.5 at least where a base phrase stands.

Defined results: a null text has no words; texts of any length are scanned whole; repeated
rows are scanned each; an empty table gives an empty result; other columns are passed through,
those named as an added column replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_sql
from pyspark.sql.pandas.types import from_arrow_type

from . import text as T
from .shared import columns_of, small_batches

# fixed values: the base phrases and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# fixed values: licence wording as published, in words
TEMPLATES = {
    "text:mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "text:apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "text:gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "text:bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "text:mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "text:bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "text:isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "text:lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
    "text:agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
    "text:mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "text:unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "notice:mit": "released under the mit license",
    "notice:apache-2.0": "licensed under the apache license version 2 0",
    "notice:gpl-3": "this work is licensed under the gnu general public license version 3",
    "notice:cc-by-nc": "licensed under cc by nc 4 0",
}


class Automaton:
    """A suffix automaton over the word ids of all sequences, with each state's phrases and template places."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        sequences = [p.split() for p in phrases] + [t.split() for t in templates.values()]
        listed = sorted({w for s in sequences for w in s})
        self.vocabulary = {w: i for i, w in enumerate(listed)}
        data, offsets = T.buffers(pa.array(listed, pa.large_string()))
        h = T.hashes(data, offsets[:-1], offsets[1:], True)
        order = np.argsort(h)
        self.hashes, self.ids, self.words = h[order], order.astype(np.int64), [w.encode() for w in listed]
        self.labels, self.names, self.sizes = list(phrases.values()), list(templates), [len(t.split()) for t in templates.values()]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, set[int]]] = [{}]  # state -> template -> ends of all occurrences
        for n, sequence in enumerate(sequences):
            last = 0
            for k, w in enumerate(sequence):
                last = self._extend(last, self.vocabulary[w], ends)
                if n >= len(phrases):
                    ends[last].setdefault(n - len(phrases), set()).add(k + 1)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            for t, e in ends[v].items():
                ends[self.link[v]].setdefault(t, set()).update(e)
        self.ends = [{t: sorted(e) for t, e in x.items()} for x in ends]
        own: list[list[tuple[int, int]]] = [[] for _ in self.next]  # (phrase, words) spelt by a state
        for i, p in enumerate(phrases):
            v = 0
            for w in p.split():
                v = self.next[v][self.vocabulary[w]]
            own[v].append((i, len(p.split())))
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            self.phrases[v] = own[v] + self.phrases[self.link[v]]

    def _new(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, c: int, ends: list) -> int:
        """The state for (p's string + c), apart from longer strings that occur elsewhere."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, ends)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.next[last]:
            return self._split(last, c, ends)
        state, p = self._new(self.length[last] + 1, ends), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        self.link[state] = 0 if p == -1 else self._split(p, c, ends)
        return state

    def word_ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The vocabulary id of each word, or -1."""
        h = T.hashes(data, start, end, True)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == h, self.ids[at], -1)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        out[(out >= 0) & (sizes[out] != end - start)] = -1
        return out

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, match length) after each word."""
        v = n = 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if w in self.next[v]:
                v, n = self.next[v][w], n + 1
            yield v, n

    def scan(self, runs: list[tuple[int, list[int]]], min_match: int, max_gap: int) -> tuple[list[tuple[int, int]], list[float], list[tuple[int, int, int]]]:
        """(phrase places, each template's coverage, (template, first word, end) of chains) in one text."""
        places: list[tuple[int, int]] = []
        best, where = [0.0] * len(self.names), [(0, 0)] * len(self.names)
        chains: dict[int, list[tuple[int, int, int, int]]] = {}  # template -> open chains: first word, end, template end, covered
        for base, run in runs:
            stats = list(self.statistics(run))
            for i, (v, n) in enumerate(stats):
                places += [(base + i + 1 - k, p) for p, k in self.phrases[v] if k <= n]
                if n < min_match or i + 1 < len(stats) and stats[i + 1][1] == n + 1:
                    continue
                s, e = base + i + 1 - n, base + i + 1
                for t, t_ends in self.ends[v].items():
                    live = [c for c in chains.get(t, ()) if s - c[1] <= max_gap]
                    chains[t] = live.copy()
                    for te in t_ends:
                        top, since = n, s
                        for first, end, t_end, covered in live:
                            over = max(0, end - s, t_end - (te - n))
                            if te > t_end and over < n and (covered + n - over, -first) > (top, -since):
                                top, since = covered + n - over, first
                        chains[t].append((since, e, te, top))
                        if (c := top / self.sizes[t]) > best[t]:
                            best[t], where[t] = c, (since, e)
        return places, best, [(t, *w) for t, w in enumerate(where) if best[t]]


def license_scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, min_match: int = 4, max_gap: int = 20, min_cover: float = 0.8) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and template_spans (``name:first:end`` in words); see the module."""
    automaton = Automaton(phrases, templates)
    shared = small_batches(docs).sparkContext.broadcast(automaton)
    added = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("template_spans", pa.string())]
    docs = docs.drop(*(n for n, _ in added))
    names, at = docs.columns, docs.columns.index(text)
    docs = docs.select(*(c.alias(f"c{i}") for i, c in enumerate(columns_of(docs))))  # plain names, whatever the caller's hold
    text, others = f"c{at}", docs.columns
    fields = T_sql.StructType([*docs.schema.fields, *(T_sql.StructField(n, from_arrow_type(kind)) for n, kind in added)])
    least = min([min_match, *(len(p.split()) for p in phrases)])  # shorter runs hold neither a phrase nor a match

    def one(a: Automaton, runs: list[tuple[int, list[int]]], n_words: int) -> tuple:
        places, best, where = a.scan(runs, min_match, max_gap)
        base = sorted({a.labels[p] for _, p in places})
        found = [t for t, c in enumerate(best) if c >= min_cover]
        score = min(1.0, max([0.5 if places else 0.0, *(best[t] for t in range(len(best)) if best[t] >= min_cover or a.sizes[t] > 20)]))
        at = [s for s, _ in places]
        spans = ",".join(f"{a.names[t]}:{s}:{e}" for t, s, e in where if t in found)
        return n_words, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(a.names[t] for t in found)})), score, spans

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in batches:
            for lo, hi in T.slices(batch[text]):
                data, offsets = T.buffers(batch[text][lo:hi])
                row, start, end = T.spans(data, offsets, T.ALNUM)
                ids = a.word_ids(data, start, end)
                count = np.bincount(row, minlength=hi - lo)
                first = np.concatenate([[0], np.cumsum(count)])
                known = ids >= 0
                joined = known.copy()
                joined[1:] &= known[:-1] & (row[1:] == row[:-1])
                joined[:1] = False
                begin = np.flatnonzero(known & ~joined)  # runs of vocabulary words inside a row
                size = np.add.reduceat(known.astype(np.int64), begin) if len(begin) else begin
                runs: dict[int, list] = {}
                for b, n in zip(begin[size >= least].tolist(), size[size >= least].tolist()):
                    r = int(row[b])
                    runs.setdefault(r, []).append((b - int(first[r]), ids[b : b + n].tolist()))
                rows = [one(a, runs[r], int(count[r])) if r in runs else (int(count[r]), 0, None, None, "", "", 0.0, "") for r in range(hi - lo)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in others), *(pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), added))], [*others, *(n for n, _ in added)])

    return docs.mapInArrow(scanned, fields).select(*(F.col(c).alias(n) for c, n in zip(others, names)), *(n for n, _ in added))
