"""License scans by template-markup matching.

A template is wording with regions: ``[words]`` may be left out, ``<m-n>`` stands for m to n words of
any kind, all other words are mandatory. Templates are compiled into token automata over the words of
a text; an automaton accepts only where the mandatory wording stands exactly, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridsight.llm.batches import Words, pieces

# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label and template; each begins with a mandatory word.
TEMPLATES = [
    ("mit-notice", "released under the [terms of the] mit license"),
    ("mit-notice", "licensed under the [terms of the] mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
                 "files [the software] to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-2.0", "licensed under the [terms of the] [gnu] general public license version 2 [only] [or any later version]"),
    ("gpl-3.0", "licensed under the [terms of the] [gnu] general public license version 3 [only] [or any later version]"),
    ("gpl-text", "under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-4.0", "licensed under [a] [the] cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under [a] [the] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [a] [the] cc by sa 4 0"),
    ("cc-named", "licensed under [a] [the] creative commons attribution <0-3> license"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                 "conditions are met"),
    ("isc-text", "permission to use copy modify [and] [or] distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("spdx", "spdx license identifier <1-3>"),
    ("rights-reserved", "copyright [c] <1-8> all rights reserved"),
]

FOUND = {"n_words": "bigint", "bases": "array<struct<label:string,first:bigint>>", "matches": "array<struct<label:string,first:bigint,last:bigint>>"}

_PARTS = re.compile(r"\[([^\]]*)\]|<(\d+)-(\d+)>|(\S+)")


class Automaton:
    """All templates as one automaton: ``steps[state]`` maps a word (None: any word) to states, ``skips`` cost no word."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.steps: list[dict] = []
        self.skips: list[list[int]] = []
        self.accepts: dict[int, str] = {}
        self.starts: dict[bytes, set[int]] = {}
        self.known: dict[frozenset, tuple[dict, set]] = {}
        for label, template in templates:
            state = begin = self._state()
            for optional, least, most, word in _PARTS.findall(template):
                if word:
                    state = self._word(state, word)
                elif most:
                    for number in range(int(most)):
                        ends = self._word(state, None)
                        if number >= int(least):
                            self.skips[state].append(ends)
                        state = ends
                else:
                    end = state
                    for part in optional.split():
                        end = self._word(end, part)
                    self.skips[state].append(end)
                    state = end
            self.accepts[state] = label
            for word, targets in self.steps[begin].items():
                self.starts.setdefault(word, set()).update(targets)

    def _state(self) -> int:
        self.steps.append({})
        self.skips.append([])
        return len(self.steps) - 1

    def _word(self, state: int, word: str | None) -> int:
        target = self._state()
        self.steps[state].setdefault(word.encode() if word else None, []).append(target)
        return target

    def _closed(self, states) -> frozenset:
        """The states and all that skips lead to."""
        found, waiting = set(states), list(states)
        while waiting:
            for target in self.skips[waiting.pop()]:
                if target not in found:
                    found.add(target)
                    waiting.append(target)
        return frozenset(found)

    def _next(self, states: frozenset, word: bytes) -> frozenset:
        named = {t for s in states for t in self.steps[s].get(word, ())}
        return self._closed(named | {t for s in states for t in self.steps[s].get(None, ())})

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """Label, first word and end of the longest accepted wording of each label from each word on."""
        found = []
        for first, word in enumerate(words):
            if word not in self.starts:
                continue
            states, at, longest = self._closed(self.starts[word]), first + 1, {}
            while states:
                for state in states:
                    if state in self.accepts:
                        longest[self.accepts[state]] = at
                if at == len(words):
                    break
                states, at = self._next(states, words[at]), at + 1
            found += [(label, first, end) for label, end in sorted(longest.items())]
        return found


def _phrases(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[str, int]]:
    return [(label, at) for at, word in enumerate(words) for phrase, label in phrases
            if word == phrase[0] and words[at:at + len(phrase)] == phrase]


def scan(documents: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Add ``n_words``, ``bases`` (phrase places) and ``matches`` (accepted templates, end excluded) to every row.

    Words are those of ``batches.Words``. Every phrase and template holds one of a few rare words;
    only texts with one of them are cut into words, which loses none. Null and empty texts have no
    words and empty lists; new columns replace others of their name.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    columns = [c for c in documents.columns if c not in FOUND]
    source = documents.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = source.drop("_text").withColumns({name: F.lit(None).cast(kind) for name, kind in FOUND.items()}).schema
    mandatory = [[w for *_, w in _PARTS.findall(t) if w] for _, t in templates] + [p.split() for p in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        parts = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        rare = {max(words, key=len).encode() for words in mandatory}
        for batch in batches:
            for piece in pieces(batch, column=len(columns)):
                words = Words(piece.column(len(columns)))
                bases, matches = [], []
                low = words.low.tobytes()
                # Where a rare word stands, by text; a text is looked at once.
                hits = {low_at for word in rare for low_at in _texts(low, word, words)}
                for row in range(piece.num_rows):
                    own = [low[a:b] for a, b in zip(words.starts[words.first[row]:words.first[row + 1]].tolist(),
                                                    words.ends[words.first[row]:words.first[row + 1]].tolist())] if row in hits else []
                    bases.append([{"label": n, "first": a} for n, a in _phrases(own, parts)])
                    matches.append([{"label": n, "first": a, "last": b} for n, a, b in automaton.matches(own)])
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:-1], pa.array(words.counts(), pa.int64()),
                     pa.array(bases, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))),
                     pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))],
                    [*columns, *FOUND])

    return source.mapInArrow(run, schema)


def _texts(low: bytes, word: bytes, words: Words) -> set[int]:
    """The texts in which a word stands."""
    found, at = [], low.find(word)
    while at >= 0:
        found.append(at)
        at = low.find(word, at + 1)
    index = np.searchsorted(words.starts, found, side="right") - 1
    return set((np.searchsorted(words.first, index, side="right") - 1).tolist())
