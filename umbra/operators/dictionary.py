"""Large dictionaries of literals: a join instead of an automaton, so that no worker holds them all.

A literal is looked for by a prefix of 4, 8, 16 or 32 characters, the longest that it has: the
prefix's rolling hash is its key.  In a text only places where a whole word can begin count; there
the hashes of as many characters are worked out by prefix sums.  Places whose hash is not in a
filter of fixed size are dropped where they are found; the others meet the literals by hash, as
any join of two large tables, and are verified in their text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PRIORITY
from ..sources.tables import written
from .terms import Literals, is_word, whole_word

PREFIXES = (32, 16, 8, 4)
#: Bits of the filter: 8 MB, whatever the dictionary.
FILTER_BITS = 26
_BASE = 0x9E3779B97F4A7C15
HIT = "struct<start:int,end:int,kind:string,rule:string,priority:int,ord:int>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hashes(points: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` code points at each place."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(points)), out=sums[1:])
        h = (sums[at + length] - sums[at]) * _powers(pow(_BASE, -1, 1 << 64), len(points) + 1)[at] + np.uint64(length)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _word_table() -> np.ndarray:
    """For each code point whether it is part of words; made once a worker."""
    if not _TABLE:
        _TABLE.append(np.fromiter((is_word(chr(c)) for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


_TABLE: list[np.ndarray] = []


def keyed(literals: DataFrame, value: str = "value", kind: str = "kind") -> DataFrame:
    """(hash, prefix, value, kind) of the literals, each once; of a value given twice the last kind by name counts, values below four characters do not."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for v in batch.to_pylist():
                prefix = next(p for p in PREFIXES if p <= len(v))
                out.append({"hash": int(_hashes(_points(v[:prefix]), np.zeros(1, np.int64), prefix)[0]), "prefix": prefix})
            yield pa.array(out, pa.struct([("hash", pa.int64()), ("prefix", pa.int32())]))

    once = literals.where(F.length(value) >= Literals.LEAST).groupBy(F.col(value).alias("value")).agg(F.max(kind).alias("kind"))
    return once.withColumn("h", F.arrow_udf(run, "struct<hash:long,prefix:int>")("value")).select("h.hash", "h.prefix", "value", "kind")


def _filter(table: DataFrame) -> np.ndarray:
    """The filter's words: a bit for each hash; at most 2^20 rows reach the driver, whatever the dictionary."""
    bit = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = table.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast((hash & {(1 << FILTER_BITS) - 1}) & 63 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def places(text: str, held: np.ndarray, prefixes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the places in a text that the filter lets through."""
    points = _points(text)
    word = _word_table()[points]
    begins = np.flatnonzero(~(word & np.concatenate(([False], word[:-1])))) if len(points) else np.zeros(0, np.int64)
    hashes, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for prefix in prefixes:
        at = begins[begins + prefix <= len(points)]
        h = _hashes(points, at, prefix)
        bit = h.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
        inside = (held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        hashes.append(h[inside])
        starts.append(at[inside])
    return np.concatenate(hashes), np.concatenate(starts)


def scanned(texts: pa.Array, held: np.ndarray, prefixes: Sequence[int]) -> pa.Array:
    """The places of each text as lists of (hash, start); one text at a time is a Python value, and places are plain numbers."""
    found = [places(t.as_py(), held, prefixes) if t.is_valid else (np.zeros(0, np.int64),) * 2 for t in texts]
    ends = np.cumsum([0, *(len(h) for h, _ in found)]).astype(np.int32)
    hashes, starts = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
    pairs = pa.StructArray.from_arrays([pa.array(hashes), pa.array(starts.astype(np.int32))], ["hash", "start"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def dictionary_hits(docs: DataFrame, literals: DataFrame, key: str, text: str = "text", value: str = "value", kind: str = "kind") -> DataFrame:
    """Where ``literals(value, kind)`` stand in texts as whole words, overlapping ones too: (key, hits), only texts with any.

    The same places as ``Literals`` finds, as candidate spans in order of place and end.  ``key``
    must tell the rows of ``docs`` apart; null texts have no places.
    """
    table = written(keyed(literals, value, kind))
    prefixes = sorted(r["prefix"] for r in table.select("prefix").distinct().collect())  # four rows at most
    shared = docs.sparkSession.sparkContext.broadcast(_filter(table))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield scanned(batch, shared.value, prefixes)

    found = docs.select(F.col(key).alias("key"), F.explode(F.arrow_udf(scan, "array<struct<hash:long,start:int>>")(F.col(text))).alias("p"))
    # Places that share a hash of no literal end here; a hash that very many places have is split by the join.
    met = written(found.select("key", "p.hash", "p.start")).join(table, "hash").select("key", "start", "value", "kind")
    asked = written(met.groupBy("key").agg(F.collect_list(F.struct("start", "value", "kind")).alias("asked")))

    def verify(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("ord", pa.int32())]))
        for texts, sets in batches:
            out = []
            for text, candidates in zip(texts, sets):
                t, true = text.as_py(), []
                for c in candidates.as_py():
                    start, end = c["start"], c["start"] + len(c["value"])
                    if t.startswith(c["value"], start) and whole_word(t, start, end):
                        true.append({"start": start, "end": end, "kind": c["kind"], "rule": "known", "priority": PRIORITY["literal"], "ord": 300})
                out.append(sorted(true, key=lambda x: (x["start"], x["end"])))
            yield pa.array(out, shape)

    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(asked, "key")
    checked = joined.select(F.col("key").alias(key), F.arrow_udf(verify, f"array<{HIT}>")("text", "asked").alias("hits"))
    return checked.where(F.size("hits") > 0)
