"""Repeated passages: every byte that a string of 400 bytes covers which also starts elsewhere in the corpus.

Suffix arrays decide which strings of that length repeat, but no task could sort all suffixes
of a large corpus, so that first the places are found where it matters.

* Each window of 400 bytes has an anchor, the least of its grams of 250 bytes by hash; windows in
  a row with one anchor are a stretch.  Equal windows have equal anchors at equal places, so
  that they meet under the anchor's gram, whatever texts they stand in.
* Grams that occur once are dropped.  A stretch that as a whole occurs twice is repeated: its
  digest says so.  What is left are stretches that share their gram with different ones, at the
  edges of passages.
* These are sorted by gram; of all stretches of a gram, and of several grams that a task takes at
  once, one suffix array is made.  Windows that agree with a neighbour in it are repeated.  A gram that
  very many different stretches hold (a common passage shorter than a window) is split: stretches
  are cut by the place of the anchor in the window, and each cut is keyed by all bytes that its
  windows must share.  Cuts become finer until every key is small, at most until a cut is a window.

The suffix array is made by grouping (linear in the symbols but for sorting the members of a
group): suffixes are grouped by their longest Lyndon prefix.  Groups are taken in descending
order; each member points to the previous suffix of a smaller group, whose Lyndon prefix it
extends, and suffixes so extended, by how many members, move to groups of their own behind their
old group.  In the end the order within groups is emitted from the smallest suffix on: each
places, next in their groups, the suffixes whose Lyndon prefix ends where it begins.

Strings of a number of words may be looked for as well, however few bytes they have.  They are anchored
like windows of bytes, by the least of their grams of 16 words, and their stretches go the same
way; where different stretches meet under a gram, windows are told apart by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, materialise, own_worker
from .common import _arrow_schema as arrow_schema

LEAST = 400
#: Words of the strings that ``digest`` reports beside what is removed.
WORDS = 50
#: Windows that may share an anchor; fits into a byte.
MOST_WINDOWS = 151
#: Bytes that are searched for anchors at once; so few that they stay in a core's cache.
PIECE = 1 << 16
#: Stretches of one gram that are sorted together at most, and symbols after which a suffix array is made.
CROWD, SYMBOLS = 128, 1 << 13
#: Symbols that one task should sort.
TASK_SYMBOLS = 3_000_000
#: Words of the grams that anchor strings of words, at most.
GRAM_WORDS = 16
#: Set in the place of a stretch of words.
WORDS_FLAG = 1 << 62
_BASE = 0x9E3779B97F4A7C15
_PLACE_BITS = 24
_IN_WORD = np.ones(256, bool)
_IN_WORD[[*range(9, 14), 32]] = False


@dataclass(frozen=True)
class Shape:
    """The length of windows, of the grams that anchor them, and how many windows hold a gram."""

    least: int = LEAST

    @property
    def windows(self) -> int:
        return min(self.least, MOST_WINDOWS)

    @property
    def gram(self) -> int:
        return self.least - self.windows + 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` hashes in a row is, by doubling; a key holds its place."""
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key, span = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * span <= width:
        key, span = np.minimum(key[:-span], key[span:]), 2 * span
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    return (key & low).astype(np.int64)


def _within(ends: np.ndarray, lo: int, n: int, least: int) -> np.ndarray:
    """Which of ``n`` windows from ``lo`` on lie in one text."""
    inside = np.ones(n, bool)
    for end in ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, lo + n + least)].tolist():
        inside[max(0, end - least + 1 - lo) : max(0, end - lo)] = False
    return inside


def _joined(found: list[tuple]) -> tuple[np.ndarray, ...]:
    """The stretches of all pieces; one that goes on in the next piece is one."""
    if not found:
        return (np.zeros(0, np.int64),) * 4
    seed, place, first, last = (np.concatenate(c) for c in zip(*found))
    begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return seed[begins], place[begins], first[begins], last[np.concatenate([begins[1:] - 1, [len(last) - 1]])]


def anchors(data: bytes, ends: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of texts laid end to end: hash of the anchor's gram, its place, first and last window.

    Of equal hashes in a window the first is the anchor.
    """
    raw, width = np.frombuffer(data, np.uint8), shape.windows
    found = []
    for lo in range(0, max(0, len(raw) - shape.least + 1), PIECE):
        b = raw[lo : lo + PIECE + shape.least - 1].astype(np.uint64)
        n = len(b)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((b + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
            h = _mix((sums[shape.gram :] - sums[: -shape.gram]) * _powers(pow(_BASE, -1, 1 << 64), n - shape.gram + 1))
        at = _least_of(h, width)
        x = np.arange(len(at)) + lo
        inside = _within(ends, lo, len(at), shape.least)
        x, at = x[inside], at[inside]
        if len(x):
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.concatenate([first[1:] - 1, [len(x) - 1]])
            found.append((h[at[first]].view(np.int64), at[first] + lo, x[first], x[last]))
    return _joined(found)


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the one behind its last; words end at ASCII whitespace."""
    inside = _IN_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def word_anchors(data: bytes, starts: np.ndarray, stops: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``anchors``, of strings of ``words`` words: places count words, ``ends`` says with which a text ends."""
    gram = min(words, GRAM_WORDS)
    if len(starts) < words:
        return (np.zeros(0, np.int64),) * 4
    raw, inverse = np.frombuffer(data, np.uint8), pow(_BASE, -1, 1 << 64)
    up, down = (_powers(x, min(PIECE, len(raw))) for x in (_BASE, inverse))
    before, behind, back, total = (np.zeros(n, np.uint64) for n in (len(starts), len(stops), len(starts), 1))
    # Sums of all bytes before each word's ends, a piece of the bytes at a time.
    for lo in range(0, len(raw), PIECE):
        b = raw[lo : lo + PIECE].astype(np.uint64)
        with np.errstate(over="ignore"):
            sums = np.concatenate([total, total + np.cumsum((b + np.uint64(1)) * up[: len(b)] * np.uint64(pow(_BASE, lo, 1 << 64)), dtype=np.uint64)])
            i, j = np.searchsorted(starts, [lo, lo + len(b)])
            before[i:j] = sums[starts[i:j] - lo]
            back[i:j] = down[starts[i:j] - lo] * np.uint64(pow(inverse, lo, 1 << 64))
            i, j = np.searchsorted(stops, [lo + 1, lo + len(b) + 1])
            behind[i:j] = sums[stops[i:j] - lo]
        total = sums[-1:]
    with np.errstate(over="ignore"):
        # Other sums than those of bytes: grams of words and of bytes do not meet.
        h = _mix((behind[gram - 1 :] - before[: len(before) - gram + 1]) * back[: len(back) - gram + 1] ^ np.uint64(0xD6E8FEB86659FD93))
    found = []
    for lo in range(0, len(starts) - words + 1, PIECE):
        at = _least_of(h[lo : lo + PIECE + words - gram], words - gram + 1)
        x = np.arange(len(at)) + lo
        inside = _within(ends, lo, len(at), words)
        x, at = x[inside], at[inside] + lo
        if len(x):
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            found.append((h[at[first]].view(np.int64), at[first], x[first], np.concatenate([x[first[1:] - 1], x[-1:]])))
    return _joined(found)


def suffix_array(text: list[int]) -> list[int]:
    """The order of a sequence's suffixes, by grouping."""
    n = len(text)
    number: dict[int, int] = {}
    for c in text:
        number[c] = number.get(c, 0) + 1
    begin, at = {}, 0
    for c in sorted(number):
        begin[c] = at
        at += number[c]
    # A group is named by its first place; `members` lists the groups' suffixes, `place` says where.
    group = [begin[c] for c in text]
    members, place, size = [0] * n, [0] * n, [0] * n
    for c, b in begin.items():
        size[b] = number[c]
    for i, c in enumerate(text):
        members[begin[c]], place[i] = i, begin[c]
        begin[c] += 1
    previous = [-1] * n

    def move(p: int, to: int) -> None:
        k, other = place[p], members[to]
        members[k], place[other], members[to], place[p] = other, k, p, to

    top = n
    while top:
        g = group[members[top - 1]]
        if top - g == 1:
            i = members[g]
            p = i - 1
            while p >= 0 and group[p] > g:
                p = previous[p]
            previous[i] = p
            if p >= 0 and size[group[p]] > 1:
                q = group[p]
                size[q] -= 1
                to = q + size[q]
                move(p, to)
                size[to], group[p] = 1, to
        else:
            children: dict[int, int] = {}
            for i in sorted(members[g:top]):
                p = i - 1
                while p >= 0 and group[p] > g:
                    p = previous[p]
                if p >= 0 and group[p] == g:  # a neighbour in the group: both extend the same suffix
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    children[p] = children.get(p, 0) + 1
            moved, x = sorted((-k, group[p], p) for p, k in children.items()), 0
            while x < len(moved):
                k, q, _ = moved[x]
                end = to = q + size[q]
                while x < len(moved) and moved[x][:2] == (k, q):
                    to -= 1
                    move(moved[x][2], to)
                    x += 1
                if to > q:
                    size[q], size[to] = to - q, end - to
                    for p in members[to:end]:
                        group[p] = to
        top = g
    free, out = list(range(n)), [0] * n
    p = n - 1
    while p >= 0:  # their Lyndon prefixes end with the text
        k = free[group[p]]
        out[k], free[group[p]] = p, k + 1
        p = previous[p]
    for k in range(n):
        i = out[k]
        p, stop = i - 1, previous[i]
        while p != stop:
            j = free[group[p]]
            out[j], free[group[p]] = p, j + 1
            p = previous[p]
    return out


def repeated_windows(stretches: list[tuple[int, bytes, bytes, int]], shape: Shape = Shape()) -> list[np.ndarray]:
    """For each stretch (number of its gram, bytes before and behind the gram, windows) which of its windows another holds too.

    A gram is one symbol, so that a window is as many symbols as windows may share an anchor.
    """
    symbols, starts, sizes = [], [], []
    for number, left, right, windows in stretches:
        starts.append(len(symbols))
        sizes.append(windows)
        symbols.extend(c + 1 for c in left)
        symbols.append(257 + number)
        symbols.extend(c + 1 for c in right)
        symbols.append(0)
    order = np.array(suffix_array(symbols), np.int64)
    wanted = np.zeros(len(symbols), bool)
    sizes = np.array(sizes)
    begins = np.repeat(np.array(starts), sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    wanted[begins] = True
    order = order[wanted[order]]
    views = np.lib.stride_tricks.sliding_window_view(np.array(symbols, np.int32), shape.windows)
    same = np.zeros(len(order) + 1, bool)
    for lo in range(1, len(order), 4096):
        hi = min(len(order), lo + 4096)
        same[lo:hi] = (views[order[lo:hi]] == views[order[lo - 1 : hi - 1]]).all(axis=1)
    found = np.zeros(len(symbols), bool)
    found[order] = same[:-1] | same[1:]
    return [found[s : s + m] for s, m in zip(starts, sizes)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each row of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _pack(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """First window, number of windows less one, and how far the anchor lies behind the first, in a long."""
    return (first << 16) | ((last - first) << 8) | (place - first)


def unpack(at: int) -> tuple[int, int, int]:
    return (at & ~WORDS_FLAG) >> 16, ((at >> 8) & 255) + 1, at & 255


SCANNED = "doc_id long, digest binary, n_bytes long, n_words long, whole string, tid long, seed array<long>, span array<long>, at array<long>"


def _shortest(shape: Shape, words: int) -> int:
    """Bytes without which a text holds no window, of bytes or of words."""
    return min(shape.least, 2 * words - 1) if words else shape.least


def scan(docs: DataFrame, shape: Shape = Shape(), words: int = 0) -> DataFrame:
    """Per row: digests of the text (MD5, and SHA-256 in hex), its length in bytes and its stretches; tid numbers the texts that may have any.

    With ``words``, stretches of strings of so many words as well, and the texts' words (else null).

    A task lists the stretches of a text once; it remembers 300,000 texts, and lists copies of others again, which
    only costs time.
    """

    def add_words(out: dict[str, list], fresh: list[int], data: bytes, ends: np.ndarray) -> None:
        starts, stops = word_places(data)
        ends = np.searchsorted(starts, ends)
        seed, place, first, last = word_anchors(data, starts, stops, ends, words)
        spans = b"".join(hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts[first].tolist(), stops[last + words - 1].tolist()))
        span, begins = np.frombuffer(spans, np.int64), np.concatenate([[0], ends[:-1]])
        cuts = np.concatenate([np.searchsorted(first, begins), [len(first)]])
        for k, i in enumerate(fresh):
            mine = slice(cuts[k], cuts[k + 1])
            at = _pack(first[mine] - begins[k], last[mine] - begins[k], place[mine] - begins[k]) | WORDS_FLAG
            for c, v in (("seed", seed[mine]), ("span", span[mine]), ("at", at)):
                out[c][i] = np.concatenate([out[c][i], v])
            out["n_words"][i] = int(ends[k] - begins[k])

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        tid, seen, shortest = TaskContext.get().partitionId() << 34, set(), _shortest(shape, words)
        for chunk in chunks:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in chunk["text"]]
            n = len(raw)
            digests = [hashlib.md5(r).digest() for r in raw]
            out: dict[str, list] = {"doc_id": chunk["doc_id"], "digest": digests, "n_bytes": [len(r) for r in raw], "whole": [hashlib.sha256(r).hexdigest() for r in raw]}
            out |= {c: [None] * n for c in ("tid", "seed", "span", "at", "n_words")}
            fresh = []
            for i, r in enumerate(raw):
                if len(r) >= shortest and digests[i] not in seen:
                    if len(seen) < 300_000:
                        seen.add(digests[i])
                    fresh.append(i)
            if fresh:
                data, ends = b"".join(raw[i] for i in fresh), np.cumsum([len(raw[i]) for i in fresh])
                seed, place, first, last = anchors(data, ends, shape)
                # Eight bytes are enough: they only tell stretches of one gram apart.
                spans = b"".join(hashlib.blake2b(data[a : b + shape.least], digest_size=8).digest() for a, b in zip(first.tolist(), last.tolist()))
                span = np.frombuffer(spans, np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                cuts = np.concatenate([np.searchsorted(first, begins), [len(first)]])
                for k, i in enumerate(fresh):
                    mine = slice(cuts[k], cuts[k + 1])
                    out["tid"][i], tid = tid, tid + 1
                    out["seed"][i], out["span"][i] = seed[mine], span[mine]
                    out["at"][i] = _pack(first[mine] - begins[k], last[mine] - begins[k], place[mine] - begins[k])
                if words:
                    add_words(out, fresh, b"\n".join(raw[i] for i in fresh), ends + np.arange(len(ends)))
            yield out

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, SCANNED)


SLICED = "gram binary, tid long, first long, windows int, before int, left binary, right binary"


def slices(texts: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The stretches ``texts(tid, text, ats)`` asks for: digest of the gram, and the bytes before and behind it; before: windows begin so far before the gram at most."""

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        names = [f.split()[0] for f in SLICED.split(", ")]
        for chunk in chunks:
            out: dict[str, list] = {c: [] for c in names}
            for tid, text, ats in zip(chunk["tid"], chunk["text"], chunk["ats"]):
                data = text.encode("utf-8", "surrogatepass")
                for at in ats:
                    first, windows, before = unpack(at)
                    place = first + before
                    gram = hashlib.blake2b(data[place : place + shape.gram], digest_size=16).digest()
                    for c, v in zip(names, (gram, tid, first, windows, before, data[first:place], data[place + shape.gram : first + windows - 1 + shape.least])):
                        out[c].append(v)
            yield out

    return arrow_pass(texts, rows, SLICED)


def cut(stretches: DataFrame, width: int, shape: Shape = Shape()) -> DataFrame:
    """Stretches cut where the anchor's place in the window passes a multiple of ``width``; gram becomes the digest of it and of all bytes that a cut's windows must share."""

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        names = [f.split()[0] for f in SLICED.split(", ")]
        behind = shape.windows - 1
        for chunk in chunks:
            out: dict[str, list] = {c: [] for c in names}
            for gram, tid, first, windows, before, left, right in zip(*[chunk[c] for c in names]):
                for cell in range((before - windows + 1) // width, before // width + 1):
                    low, high = cell * width, min(cell * width + width, shape.windows) - 1
                    most, least = min(high, before), max(low, before - windows + 1)
                    shared = left[len(left) - low :] + b"|%d|%d|" % (width, cell) + right[: behind - high]
                    values = (hashlib.blake2b(gram + shared, digest_size=16).digest(), tid, first + before - most, most - least + 1, most, left[len(left) - most :], right[: behind - least])
                    for c, v in zip(names, values):
                        out[c].append(v)
            yield out

    return arrow_pass(stretches, rows, SLICED)


def sort_windows(stretches: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(tid, first, last): which windows of the stretches repeat among those of the same gram."""
    schema = arrow_schema("tid long, first long, last long")
    total = stretches.agg(F.sum(F.length("left") + F.length("right") + 2)).first()[0] or 0
    tasks = max(stretches.sparkSession.sparkContext.defaultParallelism, total // TASK_SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("umbra.llm.repeats.sort_windows")
        held: list[tuple] = []
        grams, symbols, last = 0, 0, None

        def settle() -> pa.RecordBatch:
            out: list[tuple] = []
            for (tid, first, *_), flags in zip(held, repeated_windows([h[2:] for h in held], shape)):
                out += [(tid, first + a, first + b) for a, b in _ranges(flags)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if r["gram"] != last:
                    if symbols >= SYMBOLS:
                        yield settle()
                        grams, symbols = 0, 0
                    grams, last = grams + 1, r["gram"]
                held.append((r["tid"], r["first"], grams, r["left"], r["right"], r["windows"]))
                symbols += len(r["left"]) + len(r["right"]) + 2
        if held:
            yield settle()

    dealt = stretches.select("gram", "tid", "first", "windows", "left", "right").repartition(tasks, "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "tid long, first long, last long")


def edges(stretches: DataFrame, shape: Shape = Shape(), crowd: int = CROWD) -> DataFrame:
    """(tid, first, last): the windows that repeat among different stretches of one gram, however many hold it."""
    width, found = shape.windows, []
    while True:
        sizes = stretches.groupBy("gram").count()
        crowded = materialise(sizes.where(F.col("count") > crowd).select("gram"))
        some = bool(crowded.limit(1).count())
        found.append(materialise(sort_windows(stretches.join(crowded, "gram", "left_anti") if some else stretches, shape)))
        if not some:
            break
        width = -(-width // 2)
        parts = materialise(cut(stretches.join(crowded, "gram"), width, shape))
        # As with whole stretches: equal ones are settled by number, one of each goes on where different ones meet.
        key = ["gram", "windows", "before", "left", "right"]
        equal = materialise(parts.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("tid", "first")).alias("one")))
        found.append(parts.join(equal.where("n > 1").select(*key), key).select("tid", "first", (F.col("first") + F.col("windows") - 1).alias("last")))
        meet = equal.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("gram")
        stretches = materialise(equal.join(materialise(meet), "gram").select("gram", F.col("one.tid").alias("tid"), F.col("one.first").alias("first"), "windows", "before", "left", "right"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def same_strings(texts: DataFrame, words: int) -> DataFrame:
    """(tid, first, last): the strings of ``words`` words that repeat among the stretches ``texts(tid, text, ats)`` asks for."""

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for chunk in chunks:
            out: dict[str, list] = {"digest": [], "tid": [], "first": []}
            for tid, text, ats in zip(chunk["tid"], chunk["text"], chunk["ats"]):
                data = text.encode("utf-8", "surrogatepass")
                starts, stops = word_places(data)
                at = sorted({i for first, n, _ in map(unpack, ats) for i in range(first, first + n)})
                found = b"".join(hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts[at].tolist(), stops[np.array(at) + words - 1].tolist()))
                out["digest"] += np.frombuffer(found, np.int64).tolist()
                out["tid"] += [tid] * len(at)
                out["first"] += at
            yield out

    each = materialise(arrow_pass(texts, rows, "digest long, tid long, first long"))
    twice = materialise(each.groupBy("digest").count().where("count > 1").select("digest"))
    return each.join(twice, "digest").select("tid", "first", F.col("first").alias("last"))


def removed(texts: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(tid, spans, kept): of ``texts(tid, text, marks)`` the byte spans that repeated windows cover, and the SHA-256 of the other bytes."""

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for chunk in chunks:
            out: dict[str, list] = {"tid": chunk["tid"], "spans": [], "kept": []}
            for text, marks in zip(chunk["text"], chunk["marks"]):
                data, kept, spans = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), []
                for first, last in sorted((m["first"], m["last"]) for m in marks):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + shape.least)
                    else:
                        spans.append([first, last + shape.least])
                at = 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["kept"].append(kept.hexdigest())
            yield out

    return arrow_pass(texts, rows, "tid long, spans array<struct<start:long,end:long>>, kept string")


def covered(strings: DataFrame, words: int) -> DataFrame:
    """(tid, n_repeated): how many words the strings of ``words`` words that begin with ``strings(tid, first, last)`` cover."""
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc, m):
        end = F.greatest(acc["end"], m["last"] + words)
        return F.struct((acc["n"] + end - F.greatest(acc["end"], m["first"])).alias("n"), end.alias("end"))

    lists = strings.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("marks"))
    return lists.select("tid", F.aggregate("marks", nothing, add, lambda acc: acc["n"]).alias("n_repeated"))


def passages(docs: DataFrame, least: int = LEAST, crowd: int = CROWD, words: int = 0) -> DataFrame:
    """Repeated passages of ``docs(doc_id, text)``: (doc_id, n_bytes, spans, kept_sha256), a row per document.

    spans are the byte ranges (end exclusive, apart from one another) that strings of ``least``
    bytes cover which also start at another place, in the same text or another; kept_sha256 is
    the digest of all other bytes.  A null text is empty; texts shorter than ``least`` lose
    nothing; of copies, and of repeated rows, every byte goes; null ids are kept.  Texts are
    taken whole, a few of them at a time; an empty table gives no rows, and further columns,
    whatever their names, are ignored.

    With ``words`` (at most 64), n_repeated_words follows: how many words of the document are covered by strings of
    so many words that also start at another place, in the same text or another, whatever their length in
    bytes.  Strings are equal if their bytes are, blanks between words included; they change nothing in what is removed.
    """
    shape = Shape(least)
    if not 0 <= words <= 64:
        raise ValueError("words must be from 0 to 64")
    scanned = materialise(scan(docs, shape, words))
    each = scanned.where("tid is not null").select("tid", F.explode(F.arrays_zip("seed", "span", "at")).alias("e")).select("tid", "e.*")
    shared = materialise(each.groupBy("seed").count().where("count > 1").select("seed"))
    # One number stands for a text, though several tasks may have met it.
    texts = materialise(scanned.where("n_bytes > 0").groupBy("digest").agg(F.min("tid").alias("tid"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.max("n_words").alias("n_words")))
    met = materialise(each.join(shared, "seed"))  # a table of its own, so that all stretches are shuffled once
    kept = materialise(met.join(texts.select("tid", "copies"), "tid"))

    by_span = materialise(kept.groupBy("seed", "span").agg(F.count("*").alias("n"), F.min(F.struct("tid", "at")).alias("one")))
    twice = by_span.where("n > 1").select("seed", "span")
    of_words, at = F.col("at") >= WORDS_FLAG, F.col("at").bitwiseAND(WORDS_FLAG - 1)
    first, windows = F.shiftright(at, 16), F.shiftright(at, 8).bitwiseAND(255)
    # Of a text that has a copy all goes anyway.
    settled = materialise(kept.where("copies = 1").join(twice, ["seed", "span"]).select("tid", of_words.alias("of_words"), first.alias("first"), (first + windows).alias("last")))
    marks, strings = (settled.where(c).drop("of_words") for c in ("not of_words", "of_words"))
    meet = by_span.groupBy("seed").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("seed")
    asked = by_span.join(materialise(meet), "seed").groupBy("one.tid").agg(F.collect_list("one.at").alias("ats"))
    wanted = materialise(marks.select("tid").distinct().join(asked, "tid", "full"))

    # The texts in question, each once; documents are joined by id and text, so that copies do not meet in one task.
    key = lambda doc_id, digest: F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), digest))
    holders = materialise(scanned.select("tid", key(F.col("doc_id"), F.lower(F.hex("digest"))).alias("key")).join(wanted, "tid"))
    keyed = docs.where(F.octet_length("text") >= _shortest(shape, words)).select(key(F.col("doc_id").cast("long"), F.md5("text")).alias("key"), "text")
    held = materialise(keyed.join(holders, "key").dropDuplicates(["key"]).select("tid", "text", "ats"))

    asks = lambda c: held.withColumn("ats", F.filter("ats", c)).where("size(ats) > 0")
    stretches = materialise(slices(asks(lambda a: a < WORDS_FLAG), shape))
    alone = texts.where("copies = 1").select("tid")
    marks = marks.union(edges(stretches, shape, crowd).join(alone, "tid", "left_semi"))
    listed = materialise(marks.groupBy("tid").agg(F.collect_set(F.struct("first", "last")).alias("marks")))
    cuts = removed(held.select("tid", "text").join(listed, "tid"), shape)
    goes, repeated = F.col("n_bytes") >= least, F.lit(None).cast("long")
    if words:
        strings = strings.union(same_strings(asks(lambda a: a >= WORDS_FLAG), words).join(alone, "tid", "left_semi"))
        cuts = cuts.join(covered(strings, words), "tid", "full")
        repeated = F.when(F.col("n_words") >= words, F.col("n_words"))
    else:
        cuts = cuts.withColumn("n_repeated", repeated)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= _shortest(shape, words))).select(
        "digest", F.when(goes, all_of_it).alias("spans"), F.when(goes, hashlib.sha256(b"").hexdigest()).alias("kept"), repeated.alias("n_repeated")
    )
    changed = materialise(texts.select("digest", "tid").join(cuts, "tid").select("digest", "spans", "kept", "n_repeated").union(whole))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = scanned.select("doc_id", "digest", "n_bytes", "whole").join(changed, "digest", "left")
    more = [F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated_words")] if words else []
    return out.select("doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept", "whole").alias("kept_sha256"), *more)


def digest(docs: DataFrame) -> DataFrame:
    """Per document what was removed, the digest of what is left, and the words of strings of 50 words that repeat, shorter ones than 400 bytes included."""
    lengths = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return passages(docs, words=WORDS).select("doc_id", "n_bytes", lengths.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_repeated_words")
