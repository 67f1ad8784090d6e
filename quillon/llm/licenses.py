"""Fuzzy search for short license notices.

A notice with an error budget of e characters is split into e + 1 pieces; a text within the budget holds one of them
unchanged. All pieces are sought in one pass with an automaton; around every hit the regex library's bounded-error
matching verifies the notice and gives its span and edits. Overlapping matches keep the one with the fewest edits.
Exact base phrases are counted on words besides.

Edge cases: null and empty texts have no words and no labels; overlapping places of a phrase all count; repeated rows are
scanned alike; an empty table gives an empty result; texts are read whole, whatever their length.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import folded

#: Label by exact phrase.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, notice) sought with errors, in folded words.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "creative commons zero v1 0 universal"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("proprietary", "all rights reserved"),
)
#: One error for so many characters of a notice.
CHARS_PER_ERROR = 14
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, start long, end long, edits long>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
_TYPE = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPANS)])


class Scanner:
    """Finds notices in text already folded to words joined by single spaces."""

    def __init__(self, notices=NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> None:
        self.notices = [(label, text, len(text) // chars_per_error) for label, text in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={e}}}") if e else None for _, text, e in self.notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, e) in enumerate(self.notices):
            cuts = [len(text) * k // (e + 1) for k in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((i, a))
        self.seeds = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.seeds.add_word(piece, (len(piece), where))
        if pieces:
            self.seeds.make_automaton()

    def search(self, joined: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in characters, in order of place."""
        found, seen = [], set()
        for end, (size, where) in self.seeds.iter(joined) if len(self.seeds) else ():
            for i, offset in where:
                label, text, e = self.notices[i]
                start = end + 1 - size - offset
                if not e:
                    if joined.startswith(text, start) and start >= 0 and joined[start - 1 : start] in ("", " ") and joined[start + len(text) : start + len(text) + 1] in ("", " "):
                        found.append((0, -len(text), start, start + len(text), label))
                    continue
                if (i, start) in seen or any((i, start + d) in seen for d in range(-e, e + 1)):
                    continue  # a hit of another piece of the same place: its window has been matched
                low = max(0, start - e)
                if m := self.patterns[i].search(joined, low, min(len(joined), start + len(text) + e)):
                    found.append((sum(m.fuzzy_counts), -len(text), m.start(), m.end(), label))
                    seen.add((i, start))
        kept: list[tuple[str, int, int, int]] = []
        for edits, _, a, b, label in sorted(found):
            if all(b <= x or a >= y for _, x, y, _ in kept):
                kept.append((label, a, b, edits))
        return sorted(kept, key=lambda x: x[1])


def scan_text(text: str | None, scanner: Scanner, base: dict[str, str] = BASE) -> dict:
    words = folded(text)
    joined = b" ".join(words).decode("utf-8", "replace")
    padded, places, base_labels = f" {joined} ", [], set()
    for phrase, label in base.items():
        at, seen, words_before = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            words_before += padded.count(" ", seen, at)
            seen = at
            places.append(words_before)
            base_labels.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    spans = scanner.search(joined)
    exact = 1.0 if places else 0.0
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(base_labels | {s[0] for s in spans})),
        "score": max([exact, *(max(0.0, 1 - s[3] / max(1, s[2] - s[1])) for s in spans)]),
        "spans": [dict(zip(("label", "start", "end", "edits"), s, strict=True)) for s in spans],
    }


def scan(docs: DataFrame, notices=NOTICES, base: dict[str, str] = BASE, text: str = "text") -> DataFrame:
    """One row per document: doc_id and the fields of SCHEMA. Spans are in characters of the folded text."""
    made: list[Scanner] = []

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(notices))
        return pa.array([scan_text(t.as_py(), made[0], base) for t in texts], _TYPE)

    return docs.select("doc_id", F.arrow_udf(run, SCHEMA)(F.col(text)).alias("found")).select("doc_id", "found.*")
