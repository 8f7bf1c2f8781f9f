"""Licence scans: set phrases with a generalised suffix automaton, notices by chains of common runs.

A text streams through the automaton of the phrases; a phrase ends wherever its state is on the suffix path of a long enough run.
Only pairs of words that some phrase holds can be inside a run, so a vectorised pair test picks the stretches it has to read.

For each notice all maximal runs of two or more words that it shares with the text are found from the places of common pairs.
They are chained in the order of the notice with small gaps, and dynamic programming gives the chain that covers most of it; a run
of one notice can't hide a shorter one of another. The places of chains long enough are the result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from skein.llm.common import ready

# Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences by which public licences are given.
NOTICES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "licensed under the apache license 2 0", "apache license version 2 0 january 2004",
                   "distributed under the apache license version 2 0",
                   "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
                   "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is "
                   "distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit": ["released under the mit license", "mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
            "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
            "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met",
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
            "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
            "the documentation and or other materials provided with the distribution"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "under the terms of the gnu general public license version 3",
                "gnu general public license version 3 29 june 2007",
                "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
                "either version 3 of the license"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "under the terms of the gnu general public license version 2",
                "gnu general public license version 2 june 1991",
                "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
                "either version 2 of the license"],
    "lgpl": ["gnu lesser general public license"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0"],
    "cc-by-4.0": ["licensed under cc by 4 0", "creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa"],
    "cc-by-nc": ["licensed under cc by nc"],
    "cc0": ["dedicated to the public domain", "cc0 1 0 universal"],
}
# Phrases that tell a label's notices from others of nearly the same words; where a notice holds one, a run must too.
TELLING = {"gpl-3.0": ["gnu general", "version 3"], "gpl-2.0": ["gnu general", "version 2"], "lgpl": ["lesser general"], "apache-2.0": ["2 0"],
           "mpl-2.0": ["2 0"], "cc-by-4.0": ["by 4 0", "attribution 4 0"], "cc-by-sa": ["by sa"], "cc-by-nc": ["by nc"]}
MAX_GAP = 6
MIN_COVER = 0.8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Suffix automaton of several word sequences; every state knows one end in each sequence that holds its words."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        self.final: list[int] = []
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, at)
            self.final.append(last)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            for number, at in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, at)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, before: int, word: int, state: int) -> int:
        copy = self._state(self.length[before] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = copy
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # an earlier sequence holds these words already
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            state = self.next[at][word]
            self.link[new] = state if self.length[state] == self.length[at] + 1 else self._split(at, word, state)
        return new

    def suffix_path(self, state: int) -> list[int]:
        path = []
        while state > 0:
            path.append(state)
            state = self.link[state]
        return path

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest run ending at each word."""
        state = length = 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield at, state, length


class Scanner:
    """The automaton of phrases and the pairs of notices, with what a text's matches mean."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, list[str]]):
        self.sets = [(p.encode().split(), label) for p, label in phrases.items()]
        self.notices = [(s.encode().split(), label) for label, texts in notices.items() for s in texts]
        self.vocabulary: dict[bytes, int] = {}
        coded, noted = [[[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for words, _ in group] for group in (self.sets, self.notices)]
        self.automaton = Automaton(coded)
        n = len(self.vocabulary) + 1  # the last number stands for all other words
        self.pairs, self.common = np.zeros((n, n), bool), np.zeros((n, n), bool)
        for words in coded:
            self.pairs[words[:-1], words[1:]] = True
        self.held: dict[tuple[int, int], list[tuple[int, int]]] = {}  # notices and places that hold a pair
        for number, words in enumerate(noted):
            self.common[words[:-1], words[1:]] = True
            for at, pair in enumerate(zip(words, words[1:])):
                self.held.setdefault(pair, []).append((number, at))
        self.telling = [[(at, at + len(p)) for p in (t.encode().split() for t in TELLING.get(label, []))
                         for at in range(len(words)) if words[at:at + len(p)] == p] for words, label in self.notices]
        bases = {state: i for i, state in enumerate(self.automaton.final)}
        self.phrases = [[bases[s] for s in self.automaton.suffix_path(state) if s in bases] for state in range(len(self.automaton.link))]

    def scan(self, text: str | None) -> tuple:
        words = _WORD.findall((text or "").encode().lower())
        other = len(self.vocabulary)
        get = self.vocabulary.get
        codes = np.fromiter((get(w, other) for w in words), np.int64, len(words))
        linked = np.flatnonzero(self.pairs[codes[:-1], codes[1:]]) if len(words) > 1 else np.empty(0, int)
        places: list[tuple[int, int]] = []
        for stretch in np.split(linked, np.flatnonzero(np.diff(linked) > 1) + 1) if len(linked) else []:
            first, end = int(stretch[0]), int(stretch[-1]) + 2
            self._read(codes[first:end].tolist(), first, places)
        cover, found = 0.0, {(at, at + len(self.sets[i][0]) - 1, self.sets[i][1]) for at, i in places}
        known = base = {self.sets[i][1] for _, i in places}
        for number, runs in self._runs(codes).items():
            best, chains = self._chains(number, runs)
            cover = max(cover, best / len(self.notices[number][0]))
            label = self.notices[number][1]
            found |= {(first, last, label) for first, last in chains}
            known = known | {label} if chains else known
        starts = [at for at, _ in places]
        return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(known)), 1.0 if places else cover, ",".join(f"{label}:{a}:{b}" for a, b, label in sorted(found)))

    def _read(self, codes: list[int], first: int, places: list) -> None:
        for at, state, length in self.automaton.statistics(codes):
            for i in self.phrases[state]:
                if length >= len(self.sets[i][0]):
                    places.append((first + at + 1 - len(self.sets[i][0]), i))

    def _runs(self, codes: np.ndarray) -> dict[int, list[list[int]]]:
        """For each notice its maximal runs [start in the text, start in the notice, words], by their starts."""
        runs: dict[int, list[list[int]]] = {}
        if len(codes) < 2:
            return runs
        open_runs: dict[tuple[int, int], list[int]] = {}
        before = -2
        linked = np.flatnonzero(self.common[codes[:-1], codes[1:]])
        for at, one, two in zip(linked.tolist(), codes[linked].tolist(), codes[linked + 1].tolist()):
            going: dict[tuple[int, int], list[int]] = {}
            for number, place in self.held[one, two]:
                run = open_runs.get((number, place - 1)) if at == before + 1 else None
                if run is None:
                    run = [at, place, 1]
                    runs.setdefault(number, []).append(run)
                run[2] += 1
                going[number, place] = run
            open_runs, before = going, at
        return runs

    def _chains(self, number: int, runs: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
        """The most words of a notice that one chain covers, and (first, last) word of all separate chains that are long enough."""
        size = len(self.notices[number][0])
        every = [(i, a, b) for i, (a, b) in enumerate(self.telling[number])]
        kept: list[dict[frozenset, tuple[int, int]]] = []  # for each run: telling phrases held so far -> (words covered, first word)
        ends = []
        for at, (start, place, length) in enumerate(runs):
            options = {frozenset(i for i, a, b in every if place <= a and b <= place + length): (length, start)}
            for back in range(at - 1, -1, -1):
                s, p, n = runs[back]
                if s < start - MAX_GAP - size:
                    break
                cut = max(0, s + n - start, p + n - place)  # words that both hold count once
                if start - s - n > MAX_GAP or cut >= length or p >= place:
                    continue
                own = frozenset(i for i, a, b in every if place + cut <= a and b <= place + length)
                for told, (covered, first) in kept[back].items():
                    options[told | own] = max(options.get(told | own, (0, 0)), (covered + length - cut, first))
            kept.append(options)
            covered, first = options.get(frozenset(i for i, _, _ in every), (0, 0))
            if covered >= MIN_COVER * size:
                ends.append((covered, first, start + length - 1))
        taken: list[tuple[int, int]] = []
        for _, first, last in sorted(ends, key=lambda e: (-e[0], e[2] - e[1], e[1])):
            at = bisect_left(taken, (first, last))  # taken ones are apart, so only the neighbours can overlap
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
                taken.insert(at, (first, last))
        return max((c for o in kept for c, _ in o.values()), default=0), taken


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(phrases), {label: list(texts) for label, texts in notices})


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
                 notices: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts all places of the phrases, ``first_word`` and ``last_word`` are their smallest and largest start.
    ``labels`` adds those notices of which at least ``MIN_COVER`` is covered; ``score`` is the best cover, 1 where a phrase
    stands. ``spans`` lists phrases and covered notices as label:first word:last word. Null and empty texts have no words, no labels and score 0.
    """
    key = tuple((phrases or PHRASES).items()), tuple((k, tuple(v)) for k, v in (notices or NOTICES).items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(*key)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = pd.DataFrame([scanner.scan(t) for t in batch["text"]], columns=names)
            rows[["first_word", "last_word"]] = rows[["first_word", "last_word"]].astype("Int64")
            yield rows.assign(doc_id=batch["doc_id"])[["doc_id", *names]]

    kind = dict(ready(docs).dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInPandas(
        run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
             "score double, spans string")
