"""Packing by cutting-stock column generation.

Documents are tokenised once.  A document longer than the sequence length is cut into full
pieces and a remainder.  The remainders' lengths form a histogram of at most ``SEQ / UNIT``
size classes, whatever the corpus holds.  On that histogram the driver solves the
cutting-stock linear program by column generation: a revised simplex whose columns, patterns
of classes that fit one sequence, are priced by a knapsack dynamic program.  The patterns'
counts are rounded down and what is left is packed first-fit decreasing; the rounded patterns
are then assigned to the documents ranked within their class, in parallel.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, join_small, materialise, worker_cache

SEQ = 2048
#: Lengths are rounded up to this many tokens for the size classes.
UNIT = 8
#: Ranks within a class are counted in this many buckets, so that a hot class is split, be all of it one row repeated.
BUCKETS = 256
#: Closes each document.
END_ID = 1

# Fixed value: the words of the tokenizer's pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words in each of the two generations of the cache; a word that is met again moves to the younger one.
CACHE_WORDS = 450_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids as little-endian unsigned 32-bit bytes; each distinct word is encoded once.

    The tokenizer normalises a text and then encodes the words of its pattern by themselves, so
    that a text's ids are those of its words one after another.  What that does not hold for goes
    to the tokenizer as a whole text: strings of special tokens, letters whose lower case depends
    on others, and code points that this Python's Unicode has not assigned, which other libraries
    may take for letters, digits or marks.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.normalise = self.tokenizer.normalizer.normalize_str
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # The tokenizer's own pattern of words, and the characters met so far that do nothing to others.
        self.words = regex.compile(WORDS)
        self.simple: set[str] = set()
        # Texts of Latin-1 letters, digits, blanks and lone stops, of which far fewer distinct words have to be kept.
        marks = "".join(re.escape(chr(c)) for c in range(0x100) if not chr(c).isalnum() and chr(c) not in ".," and (not chr(c).isspace() or 0x1C <= c < 0x20))
        self.marks = re.compile(f"[{marks}]")

    def fill(self, words: list[str]) -> None:
        for w, enc in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.cache[w] = struct.pack(f"<{len(enc.ids)}I", *enc.ids)

    def fill_letters(self, words: list[str]) -> None:
        """As ``fill`` for words of letters in their normal form: they go through the vocabulary as one text, cut where a token ends a word."""
        (whole,) = self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.asarray(whole.ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return self.fill(words)
        data = ids.tobytes()
        ends *= 4
        self.cache.update(zip(words, map(data.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))

    def learn(self, words: set[str]) -> None:
        """Put new words in the cache, of which those of letters alone need neither be normalised nor split any more."""
        known = words.intersection(self.old)
        self.cache.update((w, self.old[w]) for w in known)
        words = words - known
        letters = list(filter(str.isalpha, words))
        if letters:
            self.fill_letters(letters)
        self.fill(list(words.difference(letters)))

    def words_of(self, text: str) -> list[str] | None:
        """The words of a text, None if it must be encoded as a whole.

        Normal forms differ between versions of Unicode in marks only, so that texts with marks
        are normalised by the tokenizer itself.
        """
        if "<|" in text:
            return None
        marks = False
        for c in set(text).difference(self.simple):
            kind = unicodedata.category(c)
            if kind == "Cn" or c in "\u03a3\u0130\u0307":
                return None
            if kind[0] == "M":
                marks = True
            else:
                self.simple.add(c)
        return self.words.findall(self.normalise(text) if marks else unicodedata.normalize("NFC", text).lower())

    def plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not (".." in text or ",," in text or ".," in text or ",." in text or self.marks.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.old, self.cache = self.cache, {}
        out: list[bytes | list[str]] = []
        met: set[str] = set()
        for text in texts:
            if self.plain(text):  # a stop is always a word of its own, and case is lost anyway
                words = text.lower().replace(",", " , ").replace(".", " . ").split()
            else:
                words = self.words_of(text)
            if words is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                met.update(words)
                out.append(words)
        if new := met.difference(self.cache):
            self.learn(new)
        of = self.cache.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(of, x)) for x in out]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: The piece's task and, of full pieces, which need no company, the number there (else null); a bucket that every task deals out in turn.
PLACE = "part long, nth long, bucket int"


def pieces(docs: DataFrame, tokenizer: str | None = None, seq: int = SEQ) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` and cut each document into pieces of at most ``seq`` tokens.

    Null text is empty text: a piece of the closing id alone.  No text is read twice.  Full
    pieces are numbered within their task (part, nth).
    """
    path = tokenizer or default_tokenizer()
    end = struct.pack("<I", END_ID)

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        loaded = worker_cache("word encoders")
        if path not in loaded:
            loaded[path] = WordEncoder(path)
        encoder = loaded[path]
        part, full, dealt = TaskContext.get().partitionId(), 0, 0
        for chunk in chunks:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "bucket")}
            for doc_id, ids in zip(chunk["doc_id"], encoder.encode([t or "" for t in chunk["text"]])):
                data = memoryview(ids + end)
                total = len(data) // 4
                for start in range(0, total, seq):
                    stop = min(start + seq, total)
                    place = (part, full if stop - start == seq else None, (part * 31 + dealt) % BUCKETS)
                    full, dealt = full + (stop - start == seq), dealt + 1
                    for name, value in zip(out, (doc_id, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), total, *place)):
                        out[name].append(value)
            yield out

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, f"{PIECES}, {PLACE}")


# ---- the linear program -------------------------------------------------------------------


@lru_cache(maxsize=4)
def _halves(capacity: int) -> np.ndarray:
    """For each room and each smaller half of it the larger half; where there is none, the place behind the last room."""
    room, small = np.arange(capacity + 1)[:, None], np.arange(capacity // 2 + 1)[None, :]
    return np.where(2 * small <= room, room - small, capacity + 1)


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within ``capacity``: (value, copies of each item).

    The dynamic program doubles the number of items: the best of at most 2n in each room are the
    best of at most n in two rooms that fill it, until twice as many are worth no more.
    """
    single = np.full(capacity + 1, -1)
    best = np.zeros(capacity + 1)
    for i in np.lexsort((values, sizes)):  # the most valuable of a size last
        if sizes[i] <= capacity and values[i] > best[sizes[i]]:
            best[sizes[i]], single[sizes[i]] = values[i], i
    # The best within a room, not just of its size.
    widest = np.maximum.accumulate(best)
    single = single[np.maximum.accumulate(np.where(best == widest, np.arange(capacity + 1), 0))]
    best, halves, splits = widest, _halves(capacity), []
    while True:
        both = best[None, : halves.shape[1]] + np.append(best, -np.inf)[halves]
        split = both.argmax(axis=1)
        twice = both[np.arange(capacity + 1), split]
        if not (twice > best + 1e-12).any():
            break
        best = twice
        splits.append(split)
    copies = np.zeros(len(sizes), int)
    rooms = [(capacity, len(splits))]
    while rooms:
        room, level = rooms.pop()
        if level:
            small = int(splits[level - 1][room])
            rooms += [(small, level - 1), (room - small, level - 1)]
        elif single[room] >= 0:
            copies[single[room]] += 1
    return float(best[capacity]), copies


def relax(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (one column each) and their fractional counts.

    Stops at an optimal basis, or once the objective is within ``gap`` of a bound of the optimum:
    the demand's whole size over the capacity, or the knapsack's (objective over best price).
    Rounding errors can only cost a little padding, as the caller never takes more of a class
    than there is.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = demand / np.diag(basis)
    enough = float(demand @ sizes) / capacity * (1 + gap)
    for _ in range(40 * m + 100):
        if x.sum() <= enough:
            break
        duals = inverse.sum(axis=0)
        price, copies = knapsack(duals, sizes, capacity)
        if price <= 1 + gap:
            break
        entering = np.einsum("ij,j->i", inverse, copies)  # no BLAS: its threads may not survive the JVM's launch
        rising = entering > 1e-9
        ratios = np.where(rising, x / np.where(rising, entering, 1), np.inf)
        out = int(ratios.argmin())
        theta = ratios[out]
        x = np.maximum(x - theta * entering, 0)
        x[out] = theta
        basis[:, out] = copies
        row = inverse[out] / entering[out]
        inverse -= np.outer(entering, row)
        inverse[out] = row
    return basis.astype(int), x


@dataclass
class Plan:
    """Which sequence and slot the item of each rank of each class takes.

    Per class, parallel arrays sorted by ``rank``: from that rank on, ``per`` items of the class
    go to each sequence from ``sequence`` on.
    """

    rank: list[np.ndarray]
    sequence: list[np.ndarray]
    per: list[np.ndarray]
    sequences: int

    def place(self, size_class: int, ranks: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.rank[size_class], ranks, "right") - 1
        return self.sequence[size_class][k] + (ranks - self.rank[size_class][k]) // self.per[size_class][k]


def solve(histogram: np.ndarray) -> Plan:
    """Plan sequences for ``histogram[c]`` items of size class c (index 0 is unused)."""
    capacity = len(histogram) - 1
    classes = np.flatnonzero(histogram)
    left = histogram.copy()
    runs: list[tuple[np.ndarray, int]] = []  # (copies of each class, sequences in a row)
    if len(classes):
        patterns, x = relax(classes, histogram[classes].astype(float), capacity)
        for p in np.argsort(-x, kind="stable"):
            used = patterns[:, p] > 0
            times = min(int(x[p] + 1e-6), int((left[classes][used] // patterns[used, p]).min()))
            if times > 0:
                copies = np.zeros(capacity + 1, int)
                copies[classes] = patterns[:, p]
                left -= copies * times
                runs.append((copies, times))
    while left.any():  # first-fit decreasing, many equal sequences at a time
        copies = np.zeros(capacity + 1, int)
        room = capacity
        for c in np.flatnonzero(left)[::-1]:
            copies[c] = min(room // c, left[c])
            room -= copies[c] * c
        used = copies > 0
        times = int((left[used] // copies[used]).min())
        left -= copies * times
        runs.append((copies, times))
    rank, sequence, per = ([[] for _ in range(capacity + 1)] for _ in range(3))
    taken, total = np.zeros(capacity + 1, int), 0
    for copies, times in runs:
        for c in np.flatnonzero(copies):
            rank[c].append(taken[c])
            sequence[c].append(total)
            per[c].append(copies[c])
        taken += copies * times
        total += times
    return Plan(*([np.array(v, np.int64) for v in x] for x in (rank, sequence, per)), sequences=total)


def pack(docs: DataFrame, tokenizer: str | None = None, seq: int = SEQ, unit: int = UNIT) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``seq`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  Every
    id of every row lies in exactly one piece; offsets in a sequence are gapless from 0.

    Nulls: null text is empty; null doc_id is kept.  Repeated rows are packed once each, ties in
    rank only swap equal pieces.  An empty table gives no rows.  Other columns are ignored.  A
    text of any length is cut into full pieces, which are sequences by themselves and are neither
    ranked nor shuffled, and a rest.
    """
    whole = materialise(pieces(docs, tokenizer, seq))
    cut = whole.where("nth is null").withColumn("size_class", F.ceil(F.col("length") / F.lit(unit)).cast("int"))
    # Bounded by seq / unit * BUCKETS rows, whatever the corpus.
    counted = cut.groupBy("size_class", "bucket").count().collect()
    counts = np.zeros((seq // unit + 1, BUCKETS), np.int64)
    for size_class, bucket, n in counted:
        counts[size_class, bucket] = n
    before = np.cumsum(counts, axis=1) - counts
    plan = solve(counts.sum(axis=1))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for chunk in chunks:
            classes, buckets = np.array(chunk["size_class"]), np.array(chunk["bucket"])
            ranks = before[classes, buckets] + np.array(chunk["rn"]) - 1
            placed = np.empty(len(ranks), np.int64)
            for c in np.unique(classes):
                mine = classes == c
                placed[mine] = plan.place(c, ranks[mine])
            yield {k: chunk[k] for k in names} | {"sequence_id": placed, "rank": ranks}

    ranked = cut.withColumn("rn", F.row_number().over(Window.partitionBy("size_class", "bucket").orderBy("doc_id", "start", "ids_crc32")))
    placed = arrow_pass(ranked, rows, PIECES + ", sequence_id long, rank long")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = placed.withColumn("offset", F.sum("length").over(within) - F.col("length")).select(*names, "sequence_id", "offset")
    # Full pieces follow the packed sequences, task by task: a row for each task is all that is ordered.
    full = whole.where("nth is not null")
    each = full.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = each.select("part", (before + plan.sequences).alias("begin"))
    alone = join_small(full, begins, "part").select(*names, (F.col("begin") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
