"""Language identification by language-bitmask n-gram filters.

Training counts the character n-grams of a bounded sample of labelled rows and keeps each
language's most frequent ones.  They go into bit-sliced Bloom filters: one array of positions,
each holding a bit for every language, so that the AND over an n-gram's probes returns at once
all languages that contain it.  A text's n-grams are looked up, the languages' bits counted,
and each count is corrected for the filter's own false positives; the best share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, small_batches

#: Labelled documents of each language that training reads, at most; picked by a hash.
SAMPLE_DOCS = 3000
#: N-grams kept of each language, the most frequent first; they must be in this many documents, unless the language has none such.
GRAMS, LEAST_DOCS = 20_000, 3
SIZES = (2, 3, 4)
#: Bloom filter: positions (a power of two) and probes.  8 bytes a position for every 64 languages.
POSITIONS, PROBES, WORD_LANGUAGES = 1 << 20, 3, 64
UNDETERMINED = "und"
#: Characters of a text that are looked at together.
PART = 1 << 18

_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 for all that is no letter."""
    if not _TABLES:
        lower = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(lower)
    return _TABLES[0]


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of all words, each word padded by one space on either side."""
    return np.concatenate(list(gram_parts(text)))


def gram_parts(text: str, part: int = PART) -> Iterator[np.ndarray]:
    """The n-grams of a text of any length, in parts of ``part`` characters: together the same as in one.

    A part begins with what the one before has left of unfinished n-grams, so that no word is
    cut.
    """
    carry = np.zeros(0, np.uint64)
    for at in range(0, max(1, len(text)), part):
        raw = np.frombuffer(text[at : at + part].encode("utf-32-le", "surrogatepass"), "<u4")
        c = _letters()[raw]
        # Runs of other characters count as one space, which is 1 from here on; letters are above.
        blank = not at or carry[-1] == 1
        keep = (c > 0) | np.concatenate(([not blank], c[:-1] > 0))[: len(c)]
        edge = [np.ones(1, np.uint64)] * (at == 0)
        last = [np.ones(1, np.uint64)] * (at + part >= len(text))
        c = np.concatenate([carry, *edge, c[keep].astype(np.uint64) + np.uint64(1), *last])
        yield _grams(c, len(carry))
        carry = c[1 - max(SIZES) :]


def _grams(c: np.ndarray, done: int) -> np.ndarray:
    """Those of the n-grams that end behind the first ``done`` characters."""
    out = []
    with np.errstate(over="ignore"):
        h = c
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
            if n in SIZES:
                inner = np.ones(len(h), bool)
                inner[: max(0, done - n + 1)] = False
                for k in range(1, n - 1):  # no n-gram spans two words
                    inner &= c[k : k + len(h)] != 1
                if n == 2:
                    inner &= (c[: len(h)] != 1) | (c[1 : 1 + len(h)] != 1)
                x = h[inner] ^ np.uint64(n)
                x ^= x >> np.uint64(30)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(27)
                x *= np.uint64(0x94D049BB133111EB)
                out.append(x ^ (x >> np.uint64(31)))
    return np.concatenate(out)


def _probes(hashes: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        step = (hashes >> np.uint64(40)) | np.uint64(1)
        return [((hashes + np.uint64(k) * step) & np.uint64(POSITIONS - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray  # POSITIONS, bit l: language l
    more: tuple[np.ndarray, ...] = ()  # as masks, for each further 64 languages

    @property
    def words(self) -> tuple[np.ndarray, ...]:
        return (self.masks, *self.more)

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray]) -> "Model":
        languages = sorted(by_language)
        words = [np.zeros(POSITIONS, np.uint64) for _ in range(max(1, -(-len(languages) // WORD_LANGUAGES)))]
        for i, lang in enumerate(languages):
            word, bit = divmod(i, WORD_LANGUAGES)
            for at in _probes(by_language[lang]):
                words[word][at] |= np.uint64(1 << bit)
        return cls(languages, words[0], tuple(words[1:]))

    def false_rates(self) -> np.ndarray:
        places = (divmod(i, WORD_LANGUAGES) for i in range(len(self.languages)))
        fill = np.array([np.count_nonzero(self.words[word] & np.uint64(1 << bit)) for word, bit in places]) / POSITIONS
        return fill**PROBES

    def predict(self, text: str | None, rates: np.ndarray) -> tuple[str, float]:
        total, counts = 0, np.zeros(len(self.languages))
        for hashes in gram_parts(text or ""):
            total += len(hashes)
            probes = _probes(hashes)
            for first, masks in zip(range(0, len(counts), WORD_LANGUAGES), self.words):
                found = np.full(len(hashes), ~np.uint64(0))
                for probe in probes:
                    found &= masks[probe]
                for bit in range(min(WORD_LANGUAGES, len(counts) - first)):
                    counts[first + bit] += np.count_nonzero(found & np.uint64(1 << bit))
        if not total or not len(counts):
            return UNDETERMINED, 0.0
        share = np.clip((counts / total - rates) / (1 - rates), 0, 1)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on the rows of ``docs(doc_id, text, lang)`` that have a language and a text.

    At most about ``sample_docs`` rows of each language are read, chosen by a hash of the text.
    Every language with letters in its rows is learned, however many there are and however few
    rows one has.  Repeated rows are drawn together and count each; of n-grams that tie at the last
    place kept those with the least hash stay, so that no language keeps more than ``GRAMS``; rows without a language or a text teach nothing; an empty
    table gives a model that knows no language.  Long texts are read whole; other columns,
    whatever their names, are ignored.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    # One row a language reaches the driver.
    per_lang = [(r["lang"], r["count"]) for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not per_lang:
        return Model([], np.zeros(POSITIONS, np.uint64))
    share = F.create_map(*[F.lit(x) for lang, n in per_lang for x in (lang, min(1.0, sample_docs / n))])
    drawn = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1_000_000)) / 1e6
    sample = labelled.where(drawn < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for chunk in chunks:
            parts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(chunk["text"], chunk["lang"]):
                parts.setdefault(lang, []).append(np.unique(np.concatenate([np.unique(p) for p in gram_parts(text)])))
            out: dict[str, list] = {"lang": [], "gram": [], "docs": []}
            for lang, lists in parts.items():
                gram, n = np.unique(np.concatenate(lists), return_counts=True)
                out["lang"] += [lang] * len(gram)
                out["gram"] += gram.view(np.int64).tolist()
                out["docs"] += n.tolist()
            yield out

    counted = arrow_pass(sample, rows, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    # The most frequent n-grams by their count's histogram: no sort of a language's n-grams in one task.
    counted = counted.persist()
    histogram: dict[str, list[tuple[int, int]]] = {}
    for lang, n, c in counted.groupBy("lang", "docs").count().orderBy(F.desc("docs")).collect():  # at most sample_docs rows a language
        histogram.setdefault(lang, []).append((n, c))
    least, rest = {}, {}
    for lang, steps in histogram.items():
        # A language of few or short documents, no n-gram of which is in as many, keeps what it has.
        enough = LEAST_DOCS if steps[0][0] >= LEAST_DOCS else 1
        total = 0
        for n, c in steps:
            if n < enough or total == GRAMS:
                break
            least[lang] = n
            if total + c > GRAMS:
                rest[lang] = (n, GRAMS - total)
                break
            total += c
    if not least:
        return Model(sorted(lang for lang, _ in per_lang), np.zeros(POSITIONS, np.uint64))
    bound = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))
    fits = F.col("docs") >= bound(least)
    if rest:
        cuts = _least_hashes(counted, rest)
        ties = F.coalesce(F.col("docs") == bound({lang: n for lang, (n, _) in rest.items()}), F.lit(False))
        fits = fits & (~ties | (F.col("gram") <= bound(cuts)))
    kept = counted.where(fits).select("lang", "gram").toPandas()  # at most GRAMS rows a language
    counted.unpersist()
    return Model.build({lang: g.to_numpy(np.int64).view(np.uint64) for lang, g in kept.groupby("lang")["gram"]})


def _least_hashes(counted: DataFrame, rest: dict[str, tuple[int, int]]) -> dict[str, int]:
    """For each language of ``rest`` (number of documents, how many) the hash up to which so many of its n-grams with that number lie.

    Twelve bits of the hashes are told apart at a time, from the highest on, so that no more than
    4096 counts of a language reach the driver in a round.
    """
    low, bits = {lang: (0, many) for lang, (_, many) in rest.items()}, 64
    order = F.col("gram").bitwiseXOR(F.lit(-(2**63)))  # as unsigned numbers, in the order of signed ones
    bound = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))
    signed = lambda u: u - 2**64 if u >= 2**63 else u
    ties = counted.where(F.col("docs") == bound({lang: n for lang, (n, _) in rest.items()}))
    found = {}
    while low and bits > 0:
        step = min(12, bits)
        held = ties.where(F.lit(True) if bits == 64 else F.shiftrightunsigned(order, bits) == bound({lang: p for lang, (p, _) in low.items()}))
        bits -= step
        counts: dict[str, dict[int, int]] = {}
        for r in held.groupBy("lang", F.shiftrightunsigned(order, bits).alias("prefix")).count().collect():
            counts.setdefault(r["lang"], {})[r["prefix"] % 2**64] = r["count"]
        for lang, (_, many) in list(low.items()):
            for prefix in sorted(counts[lang]):
                if counts[lang][prefix] >= many:
                    break
                many -= counts[lang][prefix]
            if counts[lang][prefix] == many or bits == 0:
                found[lang] = signed((((prefix + 1) << bits) - 1) ^ 2**63)
                del low[lang]
            else:
                low[lang] = (prefix if prefix < 2**63 else prefix - 2**64, many)
    return found


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` of every whole text.

    Null text, and text without letters, is undetermined with score 0.  Of languages that tie
    the first by name is told; repeated rows are told alike; a text of any length is read whole,
    in parts; an empty table gives no rows, and other columns than ``keep`` and text are ignored.
    The model has 8 MB for every 64 languages and travels as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.select(*keep).schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        m = shared.value
        rates = m.false_rates()
        for chunk in chunks:
            got = [m.predict(t, rates) for t in chunk["text"]]
            yield {k: chunk[k] for k in keep} | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    small_batches(docs.sparkSession)
    return arrow_pass(docs.select(*keep, "text"), rows, ddl)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2 (null ids never)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
