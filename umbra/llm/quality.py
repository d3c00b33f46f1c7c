"""Quality rules: base counts of a text, and its fertility under public vocabularies.

Two vocabularies are laid on a text, one of pieces with byte fallback and one of bytes for many
languages.  Under each, characters per token and the share of tokens that are single bytes say
how well it fits; the entropy of the token distribution says how the first is used.  Each
language (a document without one: each script) has its own bands.  They follow from all its
documents' quartiles: a text is rejected that lies more than ``REACH`` interquartile ranges
outside those of a vocabulary's characters per token, above that of its byte share, or below that
of the entropy.  The spread counts as ``LEAST_SPREAD`` at least, so that uniform groups don't
lose ordinary texts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, join_small, materialise, worker_cache

# A word, the counted symbols, the base limits.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

REACH = 3.0
#: The measures' bins.
GRID = 0.001
#: Short texts scatter more: the distances grow by sqrt(1 + SHORT / tokens).
SHORT = 300
#: Of characters per token, byte share and entropy; and which side of the quartiles is judged.
LEAST_SPREAD = {"chars_per_token": 0.05, "byte_share": 0.03, "entropy": 0.25, "multi_chars_per_token": 0.05, "multi_byte_share": 0.03}
SIDES = {"chars_per_token": ("below", "above"), "byte_share": ("above",), "entropy": ("below",), "multi_chars_per_token": ("below", "above"), "multi_byte_share": ("above",)}
#: Upper bounds of the code points of some scripts, in order; other characters count as "other".
SCRIPTS = ((0x02B0, "latin"), (0x0370, None), (0x0400, "greek"), (0x0530, "cyrillic"), (0x0590, "armenian"), (0x0600, "hebrew"), (0x0780, "arabic"), (0x0900, None), (0x0980, "devanagari"), (0x0E00, "indic"), (0x0E80, "thai"), (0x1100, None), (0x1200, "hangul"), (0x1E00, None), (0x2000, "latin"), (0x3040, None), (0x3100, "kana"), (0x4E00, None), (0xA000, "han"), (0xAC00, None), (0xD7B0, "hangul"), (0x110000, None))


def default_vocabularies() -> tuple[str, str, str]:
    """Files of the vocabulary of pieces and of that of bytes, and the latter's pattern of words."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def load_vocabularies(pieces: str, ranks: str, pattern: str):
    """The two encoders, and which of their ids are single bytes."""
    import tiktoken
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces)
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    single = np.zeros(max(table.values()) + 1, bool)
    single[[rank for token, rank in table.items() if len(token) == 1]] = True
    encoding = tiktoken.Encoding("multi", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())]), encoding, single


def repeated_words(words: list[str]) -> int:
    """How many words stand in a window of three that is found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(twice) + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """The script of most letters."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    points = points[(points > 0x40) & ((points < 0x5B) | (points > 0x60))]
    counts = np.bincount(np.searchsorted([b for b, _ in SCRIPTS], points, "right"), minlength=len(SCRIPTS))
    total: dict[str, int] = {}
    for (_, name), n in zip(SCRIPTS, counts):
        total[name or "other"] = total.get(name or "other", 0) + int(n)
    return max(sorted(total), key=lambda k: total[k]) if counts.any() else "other"


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, multi_chars_per_token double, multi_byte_share double, script string"


def measure(docs: DataFrame, keep: list[str], vocabularies: tuple[str, str, str] | None = None) -> DataFrame:
    """``keep`` columns and the measures of every whole text; null text has no words and no tokens."""
    files = vocabularies or default_vocabularies()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + ", " + MEASURES
    names = [part.split()[0] for part in MEASURES.split(", ")]

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        loaded = worker_cache("vocabularies")
        if files not in loaded:
            loaded[files] = load_vocabularies(*files)
        model, is_byte, encoding, single = loaded[files]
        for chunk in chunks:
            out: dict[str, list] = {k: chunk[k] for k in keep} | {k: [] for k in names}
            texts = [t or "" for t in chunk["text"]]
            for text, ids in zip(texts, model.encode(texts, num_threads=1)):
                words = WORD.findall(text)
                ids, other = np.asarray(ids, np.int64), np.asarray(encoding.encode_ordinary(text), np.int64)
                n, m = len(ids), len(other)
                p = np.unique(ids, return_counts=True)[1] / max(1, n)
                found = (
                    len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words),
                    n, len(text) / n if n else None, float(is_byte[ids].mean()) if n else None, float(-(p * np.log2(p)).sum()) if n else None,
                    len(text) / m if m else None, float(single[other].mean()) if m else None, script(text),
                )
                for name, value in zip(names, found):
                    out[name].append(value)
            yield out

    return arrow_pass(docs.select(*dict.fromkeys([*keep, "text"])), rows, ddl)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def quartiles(rows: DataFrame, group: str) -> DataFrame:
    """For each measure c of each group the columns c_low and c_high, its quartiles to ``GRID``, and c_far, how far a band reaches.

    Counted in bins, so that the result does not depend on the order of rows; bins of a group
    are few, whatever the number of documents.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.round(F.col(c) / GRID).cast("long").alias("bin")) for c in LEAST_SPREAD])).alias("x")
    counts = rows.select(group, each).where("x.bin is not null").groupBy(group, "x.c", "x.bin").count()
    own = Window.partitionBy(group, "c")
    below = F.sum("count").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("below", below).withColumn("all", F.sum("count").over(own))
    at = ranked.groupBy(group, "c").agg(*[F.min(F.when(F.col("below") >= q * F.col("all"), F.col("bin"))).alias(k) for k, q in (("low", 0.25), ("high", 0.75))])
    out = []
    for c, least in LEAST_SPREAD.items():
        low, high = (F.max(F.when(F.col("c") == c, F.col(k) * GRID)) for k in ("low", "high"))
        out += [low.alias(f"{c}_low"), high.alias(f"{c}_high"), (F.greatest(high - low, F.lit(least)) * REACH).alias(f"{c}_far")]
    return at.groupBy(group).agg(*out)


def judge(measured: DataFrame, group: Column) -> DataFrame:
    """``measured`` with base_failed and kept: the bands of each group come from all its rows that pass the base rules."""
    own = "__umbra_group"
    rows = measured.withColumn("base_failed", base_failed()).withColumn(own, F.coalesce(group.cast("string"), F.concat(F.lit("script "), F.col("script"))))
    bands = materialise(quartiles(rows.where(~F.col("base_failed")), own))
    joined = join_small(rows, bands, own, "left")
    wider = F.sqrt(1 + SHORT / F.greatest("n_tokens", F.lit(1)))
    sides = {"below": lambda c: F.col(c) >= F.col(f"{c}_low") - F.col(f"{c}_far") * wider, "above": lambda c: F.col(c) <= F.col(f"{c}_high") + F.col(f"{c}_far") * wider}
    fits = reduce(lambda a, b: a & b, [sides[side](c) for c, judged in SIDES.items() for side in judged])
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False))).drop(own, *[f"{c}_{e}" for c in LEAST_SPREAD for e in ("low", "high", "far")])


def rules(docs: DataFrame, vocabularies: tuple[str, str, str] | None = None) -> DataFrame:
    """Verdicts on ``docs(doc_id, text, lang)``, a row for each row.

    Null text fails the base rules; a null language is judged with its script; a null doc_id is
    kept; repeated rows are judged alike, and so are texts that tie; a text of any length is
    measured whole; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    measured = materialise(measure(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), ["doc_id", "lang"], vocabularies))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(measured, F.col("lang")).select(*first, "n_tokens", *LEAST_SPREAD)


def keep_good(docs: DataFrame, vocabularies: tuple[str, str, str] | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns; nulls, ties, repeated rows and long texts as in ``rules``.

    The measures are written beside the rows, which are then filtered by their group's bands:
    texts are read and measured once and never shuffled.
    """
    names = {c: "text" if c == "text" else f"__umbra_{i}" for i, c in enumerate(docs.columns)}  # own names can't clash with the measures'
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    measured = materialise(measure(rows, list(names.values()), vocabularies))
    return judge(measured, F.col(names["lang"])).where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
