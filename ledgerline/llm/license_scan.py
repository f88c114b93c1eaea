"""License scans: exact phrases, and short notices found with a bounded number of edits.

Texts are reduced to lower-case words joined by single spaces.  Phrases are looked up as whole words.  A notice with at
most k edits is cut into k + 1 pieces, of which every occurrence must hold one unchanged (pigeonhole); the pieces of all
notices form one Aho-Corasick automaton.  Around each piece that it meets, the regex library's bounded-error matching
verifies the notice; the match is widened or narrowed to whole words, which must match with no more edits, and gives the
span and its edits.  One pass, no shuffle; a task holds one batch of texts.

Defined results for odd input
* null text counts as empty: no words, no places, null positions, empty labels, score 0;
* a null id is carried through; repeated rows give repeated results; an empty table an empty result;
* other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels; fixed values of the scan's contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices and their labels, as words of the reduced text.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("all rights reserved", "reserved"),
    ("dedicated to the public domain", "public-domain"),
)

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

#: Upper case becomes lower case; bytes that belong to no word become blanks.
REDUCE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_char:int,end_char:int,first_word:int,edits:int>>"
)


def reduced(text: str | None) -> str:
    """Lower-case words joined by single spaces, with a space at either end."""
    return " " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(REDUCE).split()).decode("utf-8", "surrogatepass") + " "


def edits_allowed(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length with their offsets."""
    cuts = [i * len(notice) // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeFinder:
    """Automaton over all pieces, and a bounded-error pattern for each notice."""

    def __init__(self, notices: Iterable[tuple[str, str]] = NOTICES):
        import ahocorasick
        import regex

        self.notices = [(n, label, edits_allowed(n)) for n, label in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for n, _, k in self.notices]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for at, piece in seeds(n, k):
                found.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, first character, end, edits) of every verified place in a reduced text, leftmost first."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            start = end + 1 - size
            for i, at in places:
                n, _, k = self.notices[i]
                low, high = max(0, start - at - k), min(len(text), start - at + len(n) + k)
                mine = windows.setdefault(i, [])
                if mine and low <= mine[-1][1]:
                    mine[-1] = [min(low, mine[-1][0]), max(high, mine[-1][1])]
                else:
                    mine.append([low, high])
        out = []
        for i, mine in windows.items():
            for low, high in mine:
                at = low
                while m := self.patterns[i].search(text, at, high):
                    found = [(sum(x.fuzzy_counts), a - b, a, b) for a, b in whole_words(text, *m.span()) if (x := self.patterns[i].fullmatch(text, a, b))]
                    if found:
                        edits, _, a, b = min(found)
                        out.append((self.notices[i][1], a, b, edits))
                        at = max(b, m.start() + 1)
                    else:
                        at = m.start() + 1
        return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


def whole_words(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of whole words about [a, b): a word that an end lies in is wholly in or out.  No span begins or ends blank."""
    while a < b and text[a] == " ":
        a += 1
    while b > a and text[b - 1] == " ":
        b -= 1
    if a == b:
        return []
    first, last = text.rfind(" ", 0, a) + 1, (text.find(" ", b) + 1 or len(text) + 1) - 1
    starts = {first} | ({text.find(" ", a) + 1} if first < a else set())
    ends = {last} | ({text.rfind(" ", 0, b)} if last > b else set())
    return [(x, y) for x in starts for y in ends if x < y]


def places(text: str, phrase: str) -> list[int]:
    """Character offsets at which the phrase's words stand consecutively."""
    found, at, needle = [], 0, f" {phrase} "
    while (at := text.find(needle, at)) >= 0:
        found.append(at + 1)
        at += 1
    return found


def scan(text: str | None, finder: NoticeFinder, phrases=PHRASES) -> dict:
    """The scan's row for one text, without its id."""
    body = reduced(text)
    n_words = body.count(" ") - 1 if body != "  " else 0
    base, starts = set(), []
    for phrase, label in phrases:
        if at := places(body, phrase):
            base.add(label)
            starts += at
    spans = finder.spans(body)
    words = [body.count(" ", 0, at) - 1 for at in (min(starts), max(starts))] if starts else [None, None]
    best = max((1 - e / (1 + edits_allowed_in(label, finder)) for label, _, _, e in spans), default=0.0)
    return {
        "n_words": n_words,
        "n_base": len(starts),
        "first_word": words[0],
        "last_word": words[1],
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s[0] for s in spans})),
        "score": 1.0 if starts else best,
        "spans": [{"label": label, "first_char": a - 1, "end_char": b - 1, "first_word": body.count(" ", 0, a) - 1, "edits": e} for label, a, b, e in spans],
    }


def edits_allowed_in(label: str, finder: NoticeFinder) -> int:
    return max(k for _, name, k in finder.notices if name == label)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """One row per input row.  ``score`` is 1 where a phrase stands, else 1 less the share of allowed edits that the best
    notice needed, else 0.  ``spans`` are places in the reduced text, counted from 0 without its leading blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = NoticeFinder(notices)
        for batch in batches:
            rows = [{"doc_id": i} | scan(t, finder, phrases) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(run, SCHEMA)


ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first_char", pa.int32()), ("end_char", pa.int32()), ("first_word", pa.int32()), ("edits", pa.int32())])))]
)
