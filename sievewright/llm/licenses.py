"""License scans: exact phrases, and short notices found with a bounded number of edits.

A notice of n characters that occurs with at most e edits, cut into e + 1 pieces, has at least one piece in the text
unchanged (pigeonhole). All pieces of all notices form one automaton; a text without a piece is done after one pass.
The stretch that a notice could take up around a piece is read once more, for all notices together, by bit vectors of
their prefixes, one for each number of edits; that tells at which places a notice ends and with how few edits, so
neighbours can't hide each other. Each such place is handed to the regular-expression library by itself, whose
bounded-error matching confirms it and gives the span. Texts are matched in a normal form: words (ASCII letters and
digits in lower case, and all characters beyond ASCII) joined by one space; places and edits are counted in its
characters.

Some notices differ from others in a word that says it all ("by", "nc", "sa", "nd"). Edits may not touch these: such a
notice counts only where its own telling words stand in the span and no others of their kind do, there or right after;
where the closest place does not, the others around it are tried.

Defined cases: null or empty text has no words, no labels and score 0; repeated rows each get their row; where spans
overlap, the closest match counts, then the longer one, then the first by label; very long texts are scanned whole, in
time linear in their length and, but for a logarithm, in the number of notices found; other columns of the input play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")

# Exact phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices, in normal form, and their labels.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nc-nd", "licensed under cc by nc nd"),
    ("cc-by-nc-sa", "licensed under cc by nc sa"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("proprietary", "all rights reserved"),
)
# Words that tell notices apart, in kinds; "non commercial" and the like are put together first.
TELLING = (frozenset(("by", "nc", "nd", "sa")), frozenset(("noncommercial", "noderivatives", "sharealike")), frozenset(("lesser",)))
TOGETHER = {("non", "commercial"): "noncommercial", ("no", "derivatives"): "noderivatives", ("no", "derivs"): "noderivatives", ("share", "alike"): "sharealike"}
#: One edit for so many characters of a notice, five at most.
CHARS_PER_EDIT = 9
MAX_EDITS = 5


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int
    pieces: tuple[tuple[int, str], ...]
    telling: tuple[tuple[frozenset[str], frozenset[str]], ...]


def plan(label: str, text: str, chars_per_edit: int = CHARS_PER_EDIT, max_edits: int = MAX_EDITS) -> Notice:
    """How many edits a notice may have, its edits + 1 pieces with their places, and of each kind of telling words its own."""
    edits = min(max_edits, len(text) // chars_per_edit)
    cuts = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
    words = frozenset(text.split())
    own = tuple((kind, kind & words) for kind in TELLING if kind & words or "attribution" in words and "sharealike" in kind)
    return Notice(label, text, edits, tuple((a, text[a:b]) for a, b in zip(cuts, cuts[1:])), own)


Span = tuple[str, int, int, int]


class Prefixes:
    """Prefixes of all notices as bits, side by side: which end at a place of the text with up to 0, 1, 2 ... edits.

    What a shift carries from the last bit of one notice to the first of the next says that one character is matched
    with an edit, or may begin a match, which always holds.
    """

    def __init__(self, notices: list[Notice]):
        self.most = max((n.edits for n in notices), default=0)
        self.letters: dict[str, int] = {}
        self.start = [0] * (self.most + 1)  # prefixes of up to k characters go for k edits anywhere
        self.first, self.ends, self.owner, at = 0, [0] * (self.most + 1), {}, 0
        for i, n in enumerate(notices):
            for k, c in enumerate(n.text):
                self.letters[c] = self.letters.get(c, 0) | 1 << (at + k)
            self.first |= 1 << at
            for k in range(self.most + 1):
                self.start[k] |= ((1 << min(k, len(n.text))) - 1) << at
            at += len(n.text)
            for k in range(n.edits + 1):
                self.ends[k] |= 1 << (at - 1)
            self.owner[at - 1] = i

    def read(self, text: str, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """(notice, end, edits) for every place of text[low:high] where a notice ends within its edits, with the fewest."""
        rows, first, letters, start, ends = list(self.start), self.first, self.letters.get, self.start, self.ends
        levels = range(1, self.most + 1)
        for at in range(low, high):
            same = letters(text[at], 0)
            before = rows[0]
            now = rows[0] = (before << 1 | first) & same
            for k in levels:
                old = rows[k]
                # The character matches, is one too many, stands for another, or one is missing after it.
                now = rows[k] = (old << 1 & same) | before | (before | now) << 1 | start[k]
                before = old
            if now & ends[0]:
                yield from self._ended(rows, at + 1)

    def _ended(self, rows: list[int], end: int) -> Iterator[tuple[int, int, int]]:
        done = 0
        for k, row in enumerate(rows):
            hits = row & self.ends[k] & ~done
            done |= hits
            while hits:
                bit = hits & -hits
                yield self.owner[bit.bit_length() - 1], end, k
                hits ^= bit


class Scanner:
    """Finds notices in normal-form texts."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES):
        self.notices = [plan(*n) for n in notices]
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for n in self.notices:
            for place, piece in n.pieces:
                at.setdefault(piece, []).append((place + n.edits, len(n.text) + n.edits - place))
        for piece, uses in at.items():
            self.seeds.add_word(piece, (len(piece), max(x for x, _ in uses), max(x for _, x in uses)))
        self.seeds.make_automaton()
        self.prefixes = Prefixes(self.notices)
        self.patterns = [[regex.compile(rf"(?:{regex.escape(n.text)}){{e<={k}}}\Z") for k in range(n.edits + 1)] for n in self.notices]

    def matches(self, text: str) -> list[Span]:
        """(label, start, end, edits) of every notice found within its edits, before overlaps are looked at."""
        ranges = []
        for end, (length, left, right) in self.seeds.iter(text):
            start = end - length + 1
            ranges.append((max(0, start - left), min(len(text), start + right)))
        places: dict[int, list[tuple[int, int]]] = {}
        for low, high in _merged(ranges):
            for i, end, edits in self.prefixes.read(text, low, high):
                places.setdefault(i, []).append((end, edits))
        return [span for i, ends in places.items() for near in _runs(ends) for span in self._confirmed(text, i, near)]

    def _confirmed(self, text: str, i: int, near: list[tuple[int, int]]) -> Iterator[Span]:
        """The closest matches of a notice among ends that follow one another, no two of them nearer than half its length."""
        n = self.notices[i]
        taken: list[int] = []
        for edits, end in sorted((k, end) for end, k in near):
            if any(abs(end - x) < len(n.text) // 2 for x in taken) or not self._may_tell(text, n, end):
                continue
            m = self.patterns[i][edits].search(text, max(0, end - len(n.text) - edits), end) if edits else None
            start = m.start() if m else end - len(n.text)
            if (m or not edits) and self._tells(text, n, start, end):
                taken.append(end)
                yield n.label, start, end, edits

    @staticmethod
    def _may_tell(text: str, notice: Notice, end: int) -> bool:
        """Whether a notice's own telling words stand before an end at all; false spares a match."""
        return all(w in text[max(0, end - len(notice.text) - notice.edits) : end + 20] for _, own in notice.telling for w in own)

    @staticmethod
    def _tells(text: str, notice: Notice, start: int, end: int) -> bool:
        """Whether the span, widened to whole words, and the telling words right after it have just the notice's own."""
        if not notice.telling:
            return True
        start = text.rfind(" ", 0, start) + 1 if start else 0
        end = end if end < len(text) and text[end - 1 : end] == " " else (text.find(" ", end) if text.find(" ", end) >= 0 else len(text))
        words = text[start:end].split()
        for kind, own in notice.telling:
            has = {w for w in words if w in kind}
            at = end
            while (m := _WORD.match(text, at + (text[at : at + 1] == " "))) and m[0] in kind:
                has.add(m[0])
                at = m.end()
            if has != own:
                return False
        return True

    def spans(self, text: str) -> list[Span]:
        """The notices found; none overlap."""
        return _best(self.matches(text))


def _best(found: list[Span]) -> list[Span]:
    """Where spans overlap, the closest match speaks for the place; in order of place."""
    starts: list[int] = []
    chosen: dict[int, Span] = {}
    for s in sorted(set(found), key=lambda s: (s[3] / (s[2] - s[1] or 1), s[1] - s[2], s[0], s[1])):
        at = bisect_left(starts, s[1])
        before = chosen[starts[at - 1]] if at else None
        after = chosen[starts[at]] if at < len(starts) else None
        if s[1] not in chosen and (before is None or before[2] <= s[1]) and (after is None or s[2] <= after[1]):
            insort(starts, s[1])
            chosen[s[1]] = s
    return [chosen[x] for x in starts]


def _runs(ends: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Ends, in order, parted where a place between two of them is none."""
    run: list[tuple[int, int]] = []
    for x in ends:
        if run and x[0] > run[-1][0] + 1:
            yield run
            run = []
        run.append(x)
    if run:
        yield run


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def words_of(text: str | None) -> list[str]:
    text = text or ""
    if not text.isascii():
        return _WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    return _WORD.findall(text.lower())


class _Places:
    """Words joined by spaces, and which word holds a place; worked out only where somebody asks."""

    def __init__(self, words: list[str]):
        self.words, self.text, self.starts = words, " ".join(words), []

    def word_at(self, place: int) -> int:
        if not self.starts:
            at = 0
            for w in self.words:
                self.starts.append(at)
                at += len(w) + 1
        return max(0, bisect_right(self.starts, place) - 1)


def _together(words: list[str]) -> tuple[list[str], list[int]]:
    """The words with pairs of TOGETHER as one, and each one's first place among the words, their number last."""
    out, first, i = [], [], 0
    while i < len(words):
        one = TOGETHER.get((words[i], words[i + 1])) if i + 1 < len(words) else None
        first.append(i)
        out.append(one or words[i])
        i += 2 if one else 1
    return out, [*first, len(words)]


def scan(text: str | None, scanner: Scanner) -> dict:
    words = words_of(text)
    plain = _Places(words)
    starts, base = [], set()
    joined = f" {plain.text} "
    for phrase, label in PHRASES.items():
        at = joined.find(f" {phrase} ")
        while at >= 0:
            base.add(label)
            starts.append(plain.word_at(at))
            at = joined.find(f" {phrase} ", at + 1)
    first = None
    if any(" ".join(pair) in plain.text for pair in TOGETHER):
        glued, first = _together(words)
        plain = _Places(glued)
    spans = []
    for label, a, b, edits in scanner.spans(plain.text):
        low, high = plain.word_at(a), plain.word_at(max(a, b - 1))
        low, high = (first[low], first[high + 1] - 1) if first else (low, high)
        spans.append({"label": label, "first_word": low, "last_word": high, "edits": edits, "score": max(0.0, 1 - edits / max(1, b - a))})
    labels = base | {s["label"] for s in spans}
    score = 1.0 if base else max((s["score"] for s in spans), default=0.0)
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": float(score), "spans": spans,
    }


RESULT = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("score", pa.float64())])))]
)
RESULT_DDL = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
    "spans:array<struct<label:string,first_word:bigint,last_word:bigint,edits:bigint,score:double>>>"
)


def scan_licenses(docs: DataFrame, *, text_col: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Per document: doc_id and a struct ``licenses`` of counts, labels, score and the spans found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for b in batches:
            rows = [scan(t.as_py(), scanner) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, RESULT)], ["doc_id", "licenses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, licenses {RESULT_DDL}")
