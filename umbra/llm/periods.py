"""Periodic runs: maximal stretches of words that repeat with a period, by the runs theorem.

Every run has a root that is the longest Lyndon word at its place, under one order of the words
or the reverse one.  With the ranks of the suffixes (inverse suffix array) the longest Lyndon
word at i reaches to the next smaller rank under the one order and, where the run does not end
the text, to the next greater rank under the other.  So two next-value passes give all roots.
Each is extended to both sides by the common prefix of two suffixes, the least of the LCP array
between their ranks (sparse-table range minimum), forwards in the text and in its reverse.

Texts are handled together, a chunk of them as one array, whose suffixes never compare beyond
the end of their text: ranks come from sorting by doubled prefixes, of which only the suffixes
that still tie take part.  Work is n log n, memory n log n of a chunk or of the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, free_names

#: A run is as long as so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
_words = re.compile(WORD).findall


class Suffixes:
    """Suffixes of several sequences, laid end to end; ``owner`` numbers the sequence of each symbol, in order."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, levels: bool = False) -> None:
        n = len(symbols)
        self.n, self.levels = n, [] if levels else None
        ends = np.searchsorted(owner, owner, side="right")
        key = owner.astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols
        active = np.argsort(key)
        self.rank = np.empty(n, np.int64)
        active = self._place(active, key[active], np.zeros(n, np.int64))
        step = 1
        while len(active):
            if levels:
                self.levels.append(self.rank.astype(np.int32))
            beyond = active + step
            second = np.where(beyond < ends[active], self.rank[np.minimum(beyond, n - 1)] + 1, 0)
            key = self.rank[active] * (n + 1) + second
            order = np.argsort(key)
            active, key = active[order], key[order]
            active = self._place(active, key, key // (n + 1))
            step *= 2

    def _place(self, order: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Give new ranks to suffixes that lie in order of ``key`` within groups that begin at ``base``; returns those that still tie."""
        at = np.arange(len(order))
        first = np.concatenate([[True], key[1:] != key[:-1]])[: len(order)]
        group = np.concatenate([[True], base[1:] != base[:-1]])[: len(order)]
        start = np.maximum.accumulate(np.where(first, at, 0))
        self.rank[order] = base + start - np.maximum.accumulate(np.where(group, at, 0))
        last = np.concatenate([first[1:], [True]])[: len(order)]
        return order[~(first & last)]

    def prepare(self) -> None:
        """The LCP array, and its minima over 2, 4, 8, ... places."""
        order = np.empty(self.n, np.int64)
        order[self.rank] = np.arange(self.n)
        i, j = order[1:].copy(), order[:-1].copy()
        lcp = np.zeros(self.n, np.int32)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[level]
            same = (np.maximum(i, j) < self.n) & (ranks[np.minimum(i, self.n - 1)] == ranks[np.minimum(j, self.n - 1)])
            grown = same.astype(np.int64) << level
            lcp[1:] += grown.astype(np.int32)
            i += grown
            j += grown
        self.minima, width = [lcp], 1
        while 2 * width <= self.n:
            self.minima.append(np.minimum(self.minima[-1][:-width], self.minima[-1][width:]))
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j, which are different ones, have in common."""
        p, q = self.rank[i], self.rank[j]
        low, high = np.minimum(p, q) + 1, np.maximum(p, q) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k))])
        return out


def next_smaller(values: np.ndarray, most: int) -> np.ndarray:
    """For each place the next one with a smaller value, or one more than ``most`` places on; the last value is the least of all."""
    minima, width = [values], 1
    while 2 * width <= most:
        longer = np.full(len(values), values[-1])
        longer[:-width] = np.minimum(minima[-1][:-width], minima[-1][width:])
        minima.append(longer)
        width *= 2
    at = np.arange(1, len(values) + 1)
    for k in range(len(minima) - 1, -1, -1):
        inside = np.minimum(at, len(values) - 1)
        at += np.where(minima[k][inside] > values, 1 << k, 0)
    return at


def _roots(suffixes: Suffixes, owner: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of Lyndon words that may be the leftmost root of a run."""
    n, ends = len(owner), np.searchsorted(owner, owner, side="right")
    longest = int(np.bincount(owner).max(initial=0)) if n else 0
    most = max(1, longest // LEAST_PERIODS)
    at = np.arange(n) + owner  # with a place behind every sequence
    length = n + int(owner[-1]) + 1
    found = []
    for ranks in (suffixes.rank, n - suffixes.rank):
        values = np.full(length, -1, np.int64)
        values[at] = ranks
        found.append(next_smaller(values, most)[at] - at)
    i, p = np.concatenate([np.arange(n)] * 2), np.concatenate(found)
    for k in (LEAST_PERIODS - 1, 1, 2):  # from the leftmost root on a run goes on for three periods and more
        fits = i + k * p < ends[i]
        i, p = i[fits], p[fits]
        fits = symbols[i] == symbols[i + k * p]
        i, p = i[fits], p[fits]
    return i, p


def runs_of(sequences: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """Every run (start, length, period) of each sequence of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    owners = [k for k, words in enumerate(sequences) if len(words) >= LEAST_WORDS]
    if not owners:
        return out
    flat = [w for k in owners for w in sequences[k]]
    numbers = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    symbols = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    sizes = np.array([len(sequences[k]) for k in owners])
    owner = np.repeat(np.arange(len(owners)), sizes)
    i, p = _roots(Suffixes(symbols, owner), owner, symbols)
    if not len(i):
        return out
    # Only the texts with a candidate go on.
    asked = np.zeros(len(owners), bool)
    asked[owner[i]] = True
    inside = asked[owner]
    place = np.cumsum(inside) - 1
    number = np.cumsum(asked) - 1
    owners = [k for k, wanted in zip(owners, asked) if wanted]
    begins = np.concatenate([[0], np.cumsum(sizes[asked])])
    i, symbols, owner = place[i], symbols[inside], number[owner[inside]]
    n = len(symbols)
    ahead = Suffixes(symbols, owner, levels=True)
    ahead.prepare()
    end = i + p + ahead.common(i, i + p)
    longer = end - i > (LEAST_PERIODS - 1) * p
    i, p, end = i[longer], p[longer], end[longer]
    back = Suffixes(symbols[::-1], owner[-1] - owner[::-1], levels=True)
    back.prepare()
    inner = i > begins[owner[i]]
    start = i.copy()
    start[inner] -= back.common(n - i[inner], n - i[inner] - p[inner])
    fits = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
    start, end, p = start[fits], end[fits], p[fits]
    order = np.lexsort([p, end, start])  # of one stretch the smallest period is the run's
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(p), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[first], end[first], p[first]
    order = np.lexsort([p, start])
    mine = owner[start[order]]
    for k, s, e, q in zip(mine.tolist(), (start[order] - begins[mine]).tolist(), (end[order] - begins[mine]).tolist(), p[order].tolist()):
        out[owners[k]].append((s, e - s, q))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest exponent, of ties the first, then that of the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Without the words that any run repeats."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep)]


RUN = "struct<start:long,length:long,period:long>"


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs(text, ...)`` with n_words, runs (all, by start, then period), strongest, and collapsed: the text with each run cut to its first period.

    Words are what stands between blanks, tabs and line ends.  A null or blank text has no
    words and no run, and an empty collapsed text; repeated rows have equal results; texts are
    taken whole.  The columns of ``docs`` come along; result columns that they clash with get
    an underscore.
    """
    names = free_names(docs, "n_words", "runs", "strongest", "collapsed")
    n_words, every, best, kept = names
    rest = [c for c in docs.columns if c != "text"]

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for chunk in chunks:
            words = [_words(t or "") for t in chunk["text"]]
            runs = runs_of(words)
            struct = lambda r: {"start": r[0], "length": r[1], "period": r[2]}
            yield chunk | {
                n_words: [len(w) for w in words],
                every: [[struct(x) for x in r] for r in runs],
                best: [struct(strongest(r)) if r else None for r in runs],
                kept: [" ".join(collapsed(w, r) if r else w) for w, r in zip(words, runs)],
            }

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    schema = ", ".join(x for x in (fields, f"text string, `{n_words}` long, `{every}` array<{RUN}>, `{best}` {RUN}, `{kept}` string") if x)
    return arrow_pass(docs.select(*rest, "text"), rows, schema)


def stretched(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where h = crc32(doc_id) is a multiple of 10, the words from a on repeat the p words there, as the query's contract says.

    A null doc_id has no such number: its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"g": F.floor(h / 10), "words": chosen})
    n = F.size("words")
    held = held.withColumn("n", F.when(F.col("words").isNotNull(), n).otherwise(0)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    held = held.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    root = F.slice("words", F.col("a") + 1, F.col("p"))
    left = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    text: Column = F.when(F.col("n") > 0, F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), tail)).otherwise(F.col("text"))
    return held.select("doc_id", text.alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """Runs of the stretched documents: counts, the strongest run, and digests of all runs and of the collapsed text."""
    found = find_runs(stretched(docs)).drop("text")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
