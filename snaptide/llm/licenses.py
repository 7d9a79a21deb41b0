"""License scan: phrases, and templates with optional and replaceable regions compiled to token automata.

Markup of a template: ``<<optional>> ... <<end>>`` (may nest) is wording that a text may leave out,
``<<any LOW HIGH>>`` a region of LOW to HIGH words that may read as anything; everything else is mandatory
wording. Texts and templates are compared as words: A-Z lower-cased, runs of digits, letters a-z and
characters beyond ASCII. An automaton accepts a run of words if all mandatory wording is there, word for
word and in order, with nothing but the allowed regions in between.

Cases: a null or empty text has no words, null positions, empty labels and score 0. Whole texts are read.
Every row of the input gives one row, repeated ones too.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.llm.common import map_rows, read_table, texts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile(r"<<\s*(optional|end|any\s+\d+\s+\d+)\s*>>")

# Phrases with the label each gives.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Wording of public license notices, as templates.
TEMPLATES = (
    ("apache-2.0", "licensed under the Apache License <<optional>>,<<end>> Version 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "<<optional>>(subject to the limitations in the disclaimer below)<<end>> provided that the "
                     "following conditions are met"),
    ("cc-by-nc-4.0", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> <<optional>>Creative Commons<<end>> "
                     "CC BY-NC <<optional>>International<<end>> 4.0"),
    ("gpl-3.0", "licensed under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published "
                "by <<any 1 4>> Foundation<<end>> <<optional>>either<<end>> version 3"),
    ("gpl-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of <<any 1 8>> "
                  "<<optional>>(the <<any 1 2>>)<<end>> to deal in <<any 1 4>> without restriction"),
    ("mit-notice", "<<optional>>is<<end>> released under <<optional>>the<<end>> <<optional>>terms of the<<end>> MIT "
                   "License"),
)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class TokenAutomaton:
    """States are numbers; ``moves[s]`` lists (word or None for any word, next state), without empty moves."""

    def __init__(self, markup: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[set[int]] = [set()]
        self.mandatory: list[bytes] = []
        depth, opened, here = 0, [], 0
        for piece in MARK.split(markup):
            mark = piece.strip()
            if mark == "optional":
                opened.append(here)
                depth += 1
            elif mark == "end":
                if not opened:
                    raise ValueError("<<end>> without <<optional>>")
                self.skips[opened.pop()].add(here)
                depth -= 1
            elif re.fullmatch(r"any\s+\d+\s+\d+", mark):
                low, high = map(int, mark.split()[1:])
                entry = []
                for k in range(high):
                    if k >= low:
                        entry.append(here)
                    here = self._step(here, None)
                for state in entry:
                    self.skips[state].add(here)
            else:
                for word in words_of(piece.encode()):
                    here = self._step(here, word)
                    if not depth:
                        self.mandatory.append(word)
        if opened:
            raise ValueError("<<optional>> without <<end>>")
        if not self.mandatory:
            raise ValueError("a template needs mandatory wording")
        self.final = here
        self.start = self._closure({0})
        self.first = {w for s in self.start for w, _ in self.edges[s]}
        self.rarest = max(self.mandatory, key=len)

    def _step(self, state: int, word: bytes | None) -> int:
        self.edges.append([])
        self.skips.append(set())
        self.edges[state].append((word, len(self.edges) - 1))
        return len(self.edges) - 1

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.skips[todo.pop()] - seen:
                seen.add(nxt)
                todo.append(nxt)
        return frozenset(seen)

    def match_at(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted run that begins at ``at``, or None."""
        states, best = self.start, None
        while True:
            if self.final in states:
                best = at
            if at == len(words):
                return best
            word = words[at]
            moved = {n for s in states for w, n in self.edges[s] if w is None or w == word}
            if not moved:
                return best
            states, at = self._closure(moved), at + 1

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Accepted runs as (first word, end), left to right, none inside the one before."""
        out, end = [], 0
        starts = range(len(words)) if None in self.first else (i for i, w in enumerate(words) if w in self.first)
        for i in starts:
            if i >= end and (stop := self.match_at(words, i)) is not None:
                out.append((i, stop))
                end = stop
        return out


@lru_cache(maxsize=8)
def compiled(templates: tuple) -> tuple:
    return tuple((label, TokenAutomaton(markup)) for label, markup in templates)


def phrase_starts(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at:at + n] == phrase:
                out.append(at)
    except ValueError:
        return out


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (share of the words inside phrases or accepted templates), span_labels/span_starts/span_ends."""
    compiled(templates)  # a wrong template fails here, not in a task

    def make():
        automata = compiled(templates)
        wanted = [(phrase.encode().split(), label) for phrase, label in phrases]
        schema = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "span_labels",
                  "span_starts", "span_ends")

        def one(text: bytes) -> tuple:
            words = words_of(text)
            low = text.lower()
            starts, base, covered = [], set(), set()
            for phrase, label in wanted:
                if all(w in low for w in phrase):
                    found = phrase_starts(words, phrase)
                    if found:
                        base.add(label)
                        starts += found
                        covered.update(i + k for i in found for k in range(len(phrase)))
            spans = []
            for label, automaton in automata:
                if automaton.rarest in low and all(w in low for w in automaton.mandatory):
                    spans += [(label, a, b) for a, b in automaton.spans(words)]
            covered.update(i for _, a, b in spans for i in range(a, b))
            return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})),
                    len(covered) / len(words) if words else 0.0,
                    ",".join(s[0] for s in spans), [s[1] for s in spans], [s[2] for s in spans])

        def step(columns: list) -> dict:
            ids, bodies = columns
            return {"doc_id": ids} | dict(zip(schema, map(list, zip(*map(one, bodies)))))

        return step

    rows = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_rows(rows, make,
                    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                    "base_labels string, labels string, score double, span_labels string, "
                    "span_starts array<bigint>, span_ends array<bigint>")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
