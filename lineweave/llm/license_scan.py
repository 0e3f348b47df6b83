"""License scan: fuzzy search for short notices in whole texts.

A notice that may have k edits is cut into k + 1 seeds; at least one of them stands unchanged in any match
(pigeonhole), so exact search for the seeds finds every candidate window. Bounded-error matching of the regex
library then verifies the candidate and reports the span and the edits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WORD_PATTERN, prepare_python

# Base phrases and their labels (zero edits, whole words).
BASE_NOTICES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices that the fuzzy search adds, with their labels; the edits allowed follow from the length.
FUZZY_NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "creative commons attribution": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this work is in the public domain": "public-domain",
}
SHORT = 12
_WORD = regex.compile(WORD_PATTERN)


@dataclass(frozen=True)
class Match:
    label: str
    start: int  # in the word-joined text
    end: int
    edits: int


def allowed_edits(notice: str) -> int:
    """One edit for each ten characters, at most three; none below SHORT characters, where one edit makes another word."""
    return min(3, len(notice) // 10) if len(notice) >= SHORT else 0


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 parts of nearly equal length, with their offsets."""
    n, k = len(notice), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeScanner:
    def __init__(self, notices: dict[str, str]) -> None:
        self.rules = []
        places: dict[str, list[tuple[int, int]]] = {}
        for notice, label in sorted(notices.items()):
            edits = allowed_edits(notice)
            pattern = regex.compile(rf"(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}(?![^ ])", regex.BESTMATCH)
            for offset, seed in seeds(notice, edits):
                places.setdefault(seed, []).append((len(self.rules), offset))
            self.rules.append((notice, label, edits, pattern))
        self.automaton = ahocorasick.Automaton()
        for seed, where in places.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def search(self, joined: str) -> list[Match]:
        """Matches in a text of words joined by one space, leftmost first; matches of a notice do not overlap."""
        # a space before the text and one character more on both sides of a window: the pattern looks at the word's
        # edge, and takes no inserted character where a search starts
        spaced = f" {joined}"
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(joined):
            for rule, offset in where:
                notice, _, edits, _ = self.rules[rule]
                begin = last - size + 2 - offset
                window = [max(0, begin - edits - 1), min(len(spaced), begin + len(notice) + edits + 1)]
                held = windows.setdefault(rule, [])
                if held and window[0] <= held[-1][1]:
                    held[-1] = [min(held[-1][0], window[0]), max(held[-1][1], window[1])]
                else:
                    held.append(window)
        found = []
        for rule, held in windows.items():
            _, label, _, pattern = self.rules[rule]
            for begin, end in held:
                for m in pattern.finditer(spaced, begin, end):
                    if spaced[m.start() - 1 : m.start()] == " " and (m.end() == len(spaced) or spaced[m.end()] == " "):
                        found.append(Match(label, m.start() - 1, m.end() - 1, sum(m.fuzzy_counts)))
        return sorted(found, key=lambda m: (m.start, m.end, m.label))


def exact_places(joined: str, phrase: str) -> list[int]:
    """Where the phrase stands as whole words, overlaps included (offsets in the joined text)."""
    places, at = [], joined.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or joined[at - 1] == " ") and (end == len(joined) or joined[end] == " "):
            places.append(at)
        at = joined.find(phrase, at + 1)
    return places


def scan_text(text: str | None, scanner: NoticeScanner) -> dict:
    """What scan_licenses returns for one text."""
    words = _WORD.findall((text or "").translate(ASCII_LOWER))
    joined = " ".join(words)
    base = [(at, label) for phrase, label in BASE_NOTICES.items() for at in exact_places(joined, phrase)]
    fuzzy = scanner.search(joined)
    labels = sorted({label for _, label in base})
    best = max([1.0] * bool(base) + [1.0 - m.edits / (m.end - m.start) for m in fuzzy], default=0.0)
    if base or fuzzy:
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
    at_words = [bisect_left(starts, at) for at, _ in base]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(at_words, default=None), "last_word": max(at_words, default=None),
        "base_labels": ",".join(labels), "labels": ",".join(sorted({*labels, *(m.label for m in fuzzy)})), "score": float(best),
        "spans": [{"label": m.label, "word": bisect_left(starts, m.start), "n_words": joined.count(" ", m.start, m.end) + 1, "edits": m.edits, "text": joined[m.start : m.end]} for m in fuzzy],
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, word: long, n_words: long, edits: int, text: string>>"


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, counts and labels of the notices in every row of docs(doc_id, text, ...), and `spans` of the fuzzy matches.

    Null and empty texts have no words: zero counts, null positions, empty labels, score 0. Repeated rows give
    repeated results; other columns are ignored; no rows give no rows. score is 1 for a base phrase, else 1 less
    the share of edits of the best fuzzy match.
    """
    prepare_python(docs.sparkSession)
    notices = FUZZY_NOTICES if notices is None else notices

    @F.pandas_udf(SCHEMA)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = NoticeScanner(notices)
        for texts in batches:
            found = pd.DataFrame([scan_text(t, scanner) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scanned("text").alias("r")).select("doc_id", "r.*")
