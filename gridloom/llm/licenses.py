"""License scans by template automata (operator 5).

A template is license wording with markup: ``<<opt>> ... <<end>>`` encloses words that may be left out
and ``<<var 0-6>>`` stands for a replaceable run of so many words (names, years, titles).  Each template
is compiled once into a small non-deterministic automaton over words; a document matches where the
automaton accepts a run of its words, that is where all mandatory wording stands exactly.  Automata are
entered only at words that can begin a template, so most words cost one look-up.

Base phrases are found beside the templates, at every place where their words stand consecutively.

Defined results: a null or empty text has no words, no labels, score 0 and null places; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.  Texts are
scanned whole, in one pass with memory in proportion to one Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrase -> label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label -> templates of that label.
TEMPLATES = {
    "mit-notice": [
        "released under the <<opt>> terms of the <<end>> mit license",
        "licensed under the <<opt>> terms of the <<end>> mit license",
        "distributed under the <<opt>> terms of the <<end>> mit license",
    ],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of <<var 1-8>> and associated"
        " documentation files <<opt>> the <<var 1-2>> <<end>> to deal in the <<var 1-2>> without restriction"
    ],
    "apache-2.0-notice": [
        "licensed under the apache license version 2 0 <<opt>> the license you may not use this file except in"
        " compliance with the license <<end>>"
    ],
    "gpl-3-notice": [
        "licensed under the <<opt>> terms of the <<end>> gnu general public license version 3 <<opt>> or <<opt>> at your option <<end>> any later version <<end>>",
        "redistribute it and or modify it under the terms of the gnu general public license as published by <<var 1-6>>"
        " either version 3 of the license",
    ],
    "gpl-2-notice": ["licensed under the <<opt>> terms of the <<end>> gnu general public license version 2 <<opt>> 0 <<end>>"],
    "lgpl-notice": ["licensed under the <<opt>> terms of the <<end>> gnu lesser general public license <<opt>> version <<var 1-2>> <<end>>"],
    "mpl-2.0-notice": ["subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license <<opt>> version <<end>> 2 0"],
    "bsd-notice": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met"
    ],
    "cc-by-nc-4.0": ["licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by nc 4 0 <<opt>> license <<end>>"],
    "cc-by-sa": ["licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by sa <<opt>> <<var 1-1>> 0 <<end>>"],
    "cc-by": ["licensed under a creative commons attribution <<opt>> <<var 1-3>> <<end>> international license"],
}

KINDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "n_templates": pa.int64(),
}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long,"
    " base_labels string, labels string, score double, n_templates long"
)


class Automaton:
    """Word automata of many templates: states are (word or None for any, next states, label at acceptance)."""

    def __init__(self, templates: dict[str, list[str]]):
        self.step: list[dict[bytes | None, set[int]]] = []  # word (None: any word) -> states, before empty moves
        self.skip: list[set[int]] = []  # empty moves
        self.accept: dict[int, str] = {}
        self.start: dict[bytes, set[int]] = {}  # first word -> states after it
        begins = []
        for label, forms in templates.items():
            for form in forms:
                first, last = self._sequence(form)
                self.accept[last] = label
                begins.append(first)
        self.closed = [self._closure({s}) for s in range(len(self.step))]
        for b in begins:
            for s in self.closed[b]:
                for word, to in self.step[s].items():
                    if word is None:
                        raise ValueError("a template must begin with mandatory words")
                    self.start.setdefault(word, set()).update(*(self.closed[t] for t in to))

    def _state(self) -> int:
        self.step.append({})
        self.skip.append(set())
        return len(self.step) - 1

    def _sequence(self, form: str) -> tuple[int, int]:
        first = at = self._state()
        open_: list[int] = []
        for part in re.findall(r"<<[^>]*>>|[^<\s]+", form):
            if part == "<<opt>>":
                open_.append(at)
            elif part == "<<end>>":
                begin, end = open_.pop(), self._state()
                self.skip[at].add(end)
                self.skip[begin].add(end)
                at = end
            elif m := re.fullmatch(r"<<var (\d+)-(\d+)>>", part):
                least, most = map(int, m.groups())
                after = self._state()
                for k in range(most + 1):
                    if k >= least:
                        self.skip[at].add(after)
                    if k < most:
                        nxt = self._state()
                        self.step[at].setdefault(None, set()).add(nxt)
                        at = nxt
                at = after
            else:
                nxt = self._state()
                self.step[at].setdefault(part.encode(), set()).add(nxt)
                at = nxt
        if open_:
            raise ValueError(f"unclosed optional region: {form}")
        return first, at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def matches(self, words: list[bytes], at: int) -> list[tuple[str, int, int]]:
        """(label, end, mandatory words) of the longest acceptance of each label that begins at word at."""
        live = {s: 1 for s in self.start.get(words[at], ())}
        best: dict[str, tuple[int, int]] = {}
        i = at + 1
        while live:
            for s, fixed in live.items():
                if s in self.accept:
                    best[self.accept[s]] = max(best.get(self.accept[s], (0, 0)), (i, fixed))
            if i == len(words):
                break
            word, nxt = words[i], {}
            for s, fixed in live.items():
                for key, gain in ((word, 1), (None, 0)):
                    for t in self.step[s].get(key, ()):
                        for u in self.closed[t]:
                            nxt[u] = max(nxt.get(u, 0), fixed + gain)
            live, i = nxt, i + 1
        return [(label, end, fixed) for label, (end, fixed) in best.items()]


def scan_text(text: str | None, machine: Automaton, base: dict[tuple[bytes, ...], str], first: frozenset[bytes]) -> tuple:
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    places: list[int] = []
    labels, base_labels, score, n = set(), set(), 0.0, 0
    for at in [i for i, w in enumerate(words) if w in first]:
        for phrase, label in base.items():
            if words[at] == phrase[0] and tuple(words[at : at + len(phrase)]) == phrase:
                places.append(at)
                base_labels.add(label)
                score = 1.0
        if words[at] in machine.start:
            for label, end, fixed in machine.matches(words, at):
                labels.add(label)
                n += 1
                score = max(score, fixed / (end - at))
    join = lambda x: ",".join(sorted(x))
    return (len(words), len(places), places[0] if places else None, places[-1] if places else None,
            join(base_labels), join(labels | base_labels), score, n)


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per document: word and place counts, labels and score (the best share of mandatory words in a match)."""
    phrases = {tuple(k.encode().split()): v for k, v in base.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(templates)
        first = frozenset(p[0] for p in phrases) | frozenset(machine.start)
        for b in batches:
            rows = [scan_text(t.as_py(), machine, phrases, first) for t in b.column(1)]
            columns = [[r[k] for r in rows] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, columns, KINDS.values())], names=["doc_id", *KINDS]
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
