"""Terms files: custom literals, patterns and allowed values, and the search for them.

A line is a literal, ``re:`` and a pattern, a section in brackets, or a comment.  Literals and
patterns become spans whose kind is their section's name; what stands under ``[ALLOW]`` is never
replaced, unless it is a secret.  Messages name lines, never contents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_SECTION = "TERM"
LEAST_CHARACTERS = 3
LONGEST_LINE = 1 << 20
SECTION = re.compile(r"[A-Z][A-Z0-9_]*\Z")
COMMENT = re.compile(r"(?:^|(?<=[ \t]))#.*", re.S)
_SPACE = re.compile(r"\s+")
#: Runs of ASCII white space that are not one blank already.
_BLANKS = re.compile(r"[ \t\n\f\r]{2,}|[\t\n\f\r]")


class TermsError(ValueError):
    """All problems of a terms file, one a line."""


@dataclass
class Terms:
    literals: dict[str, list[str]] = field(default_factory=dict)  # by section, in file order
    patterns: list[tuple[str, str]] = field(default_factory=list)  # (section, pattern)
    allow: set[str] = field(default_factory=set)

    @property
    def sections(self) -> set[str]:
        return set(self.literals) | {s for s, _ in self.patterns}

    @property
    def count(self) -> int:
        return sum(map(len, self.literals.values())) + len(self.patterns)


def parse(text: str, looks_secret: Callable[[str], bool] = lambda value: False) -> Terms:
    """Parse a terms file; ``looks_secret`` says which allowed values the detectors take for secrets."""
    terms, problems, section, seen = Terms(), [], DEFAULT_SECTION, set()
    allowing = False
    for number, raw in enumerate(text.removeprefix("﻿").split("\n"), 1):
        problem = None
        line = COMMENT.sub("", raw).strip()
        if len(raw.encode()) > LONGEST_LINE:
            problem = "line too long"
        elif not line:
            continue
        elif line[0] == "[" and line[-1] == "]":
            name = line[1:-1]
            if name == "ALLOW":
                allowing = True
            elif SECTION.match(name):
                allowing, section = False, name
            else:
                problem = "invalid section name"
        elif allowing:
            if line.startswith("re:"):
                problem = "regex not allowed in ALLOW"
            elif looks_secret(line):
                problem = "ALLOW entry looks like a password, token or key; secrets can never be allowed"
            else:
                terms.allow.add(line.lower())
        elif line.startswith("re:"):
            pattern = line[3:].strip()
            problem = pattern_problem(pattern)
            if not problem and (section, "re", pattern) not in seen:
                seen.add((section, "re", pattern))
                terms.patterns.append((section, pattern))
        elif len(line) < LEAST_CHARACTERS:
            problem = f"term shorter than {LEAST_CHARACTERS} characters"
        else:
            literal = _SPACE.sub(" ", line)
            if (section, literal.lower()) not in seen:
                seen.add((section, literal.lower()))
                terms.literals.setdefault(section, []).append(literal)
        if problem:
            problems.append(f"terms line {number}: {problem}")
    if problems:
        raise TermsError("\n".join(problems))
    return terms


def pattern_problem(pattern: str) -> str | None:
    if not pattern:
        return "empty regex"
    try:
        empty = pc.match_substring_regex(pa.array([""]), pattern)[0].as_py()
    except pa.ArrowInvalid:
        return "invalid regex"
    return "regex matches the empty string" if empty else None


def matches(texts: list[str | None], pattern: str) -> list[list[tuple[int, int]]]:
    """The places of a pattern in each text, leftmost and not overlapping, in time linear in the texts.

    Arrow marks the matches; the marks are code points that are no characters and that none of the
    texts holds.
    """
    held = "".join(t or "" for t in texts)
    begin, end = [c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in held][:2]
    marked = pc.replace_substring_regex(pa.array(texts, pa.string()), pattern=f"({pattern})", replacement=f"{begin}\\1{end}")
    out = []
    for text in marked.to_pylist():
        spans, at = [], 0
        first, *rest = (text or "").split(begin)
        at = len(first)
        for piece in rest:
            match, _, gap = piece.partition(end)
            spans.append((at, at + len(match)))
            at += len(match) + len(gap)
        out.append(spans)
    return out


def is_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd"


def whole_word(text: str, start: int, end: int) -> bool:
    glued = lambda a, b: is_word(text[a]) and is_word(text[b])
    return not (start > 0 and glued(start, start - 1) or end < len(text) and glued(end - 1, end))


def fold(text: str) -> str:
    """``text`` without case, a character for each."""
    if text.isascii():
        return text.lower()
    one = lambda c: x if len(x := c.casefold()) == 1 else x if len(x := c.lower()) == 1 else c
    known = {c: one(c) for c in set(text)}
    return "".join(map(known.__getitem__, text))


class Automaton:
    """All places of many strings in one pass over a text, overlaps included; a few are looked for one after another."""

    FEW = 4

    def __init__(self, strings: Iterable[str]):
        self.strings = set(strings)
        self.automaton = None
        try:
            import ahocorasick
        except ImportError:
            return
        if len(self.strings) > self.FEW:
            self.automaton = ahocorasick.Automaton()
            for s in self.strings:
                self.automaton.add_word(s, s)
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, str]]:
        if self.automaton is not None:
            for last, s in self.automaton.iter(text):
                yield last - len(s) + 1, last + 1, s
            return
        for s in self.strings:
            at = text.find(s)
            while at >= 0:
                yield at, at + len(s), s
                at = text.find(s, at + 1)


class Finder:
    """Finds terms: at each place the longest literal of a section that is a whole word there.

    Literals are looked for without case, and a blank in them stands for any run of blanks and
    line ends: both are evened out in the text before one automaton goes over it.  Patterns run
    in Arrow's engine, whose time grows with the text alone, over a batch of texts at once.
    """

    def __init__(self, terms: Terms):
        self.sections = {section: {fold(_SPACE.sub(" ", s)) for s in literals} for section, literals in terms.literals.items()}
        self.automaton = Automaton(s for literals in self.sections.values() for s in literals)
        self.patterns = terms.patterns

    def literals(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        even, places = text, None
        if self.automaton.strings and (_BLANKS.search(text)):
            pieces, places, at = [], [], 0
            for m in _BLANKS.finditer(text):
                pieces += [text[at : m.start()], " "]
                places += range(at, m.start() + 1)
                at = m.end()
            even = "".join([*pieces, text[at:]])
            places += range(at, len(text) + 1)
        longest: dict[str, dict[int, int]] = {}
        for s, e, literal in self.automaton.hits(fold(even)):
            start, end = (s, e) if places is None else (places[s], places[e - 1] + 1)
            if whole_word(text, start, end):
                for section, literals in self.sections.items():
                    if literal in literals:
                        ends = longest.setdefault(section, {})
                        ends[start] = max(end, ends.get(start, 0))
        for section, ends in longest.items():
            free = 0
            for start in sorted(ends):
                if start >= free:
                    free = ends[start]
                    yield start, free, section, "terms"

    def find_in(self, texts: list[str | None]) -> list[list[tuple[int, int, str, str]]]:
        """For each text (start, end, kind, rule) of every candidate."""
        found = [list(self.literals(t)) if t else [] for t in texts]
        for section, pattern in self.patterns:
            for spans, places in zip(found, matches(texts, pattern)):
                spans += [(s, e, section, "terms-re") for s, e in places]
        return found

    def __call__(self, text: str) -> list[tuple[int, int, str, str]]:
        return self.find_in([text])[0]


class Literals:
    """Finds given (kind, value) as plain text, case-sensitively and as whole words, overlaps included; of a value given twice the last kind counts."""

    LEAST = 4

    def __init__(self, values: list[tuple[str, str]]):
        self.kinds = {v: k for k, v in values if len(v) >= self.LEAST}
        self.automaton = Automaton(self.kinds)

    def hits(self, text: str) -> Iterator[tuple[int, int, str]]:
        return self.automaton.hits(text)

    def find_in(self, texts: list[str | None]) -> list[list[tuple[int, int, str, str]]]:
        return [[(s, e, self.kinds[v], "known") for s, e, v in self.hits(t) if whole_word(t, s, e)] if t else [] for t in texts]

    def __call__(self, text: str) -> list[tuple[int, int, str, str]]:
        return self.find_in([text])[0]
