"""Spans as arrays: find them, resolve overlaps, splice replacements, put values back.

A span is ``struct<start, end, kind, rule, priority, ord>``: code points, end exclusive; ``ord``
is the rule's place in the order of rules and breaks the last ties.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import PLACEHOLDER, SECRET_KINDS, Rule

SPAN = "struct<start:int,end:int,kind:string,rule:string,priority:int,ord:int>"
NONE = f"array<{SPAN}>"


#: Code points that are no characters: the marks around matches, and what stands for them in texts.
_MARKS, _NO_MARK = ("\ufdd0", "\ufdd1", "\ufdd2"), "\ufdd3"


def no_spans() -> Column:
    return F.array().cast(NONE)


def _marked(text: Column, pattern: str, group: bool = False) -> Column:
    """``text`` with every match between marks: the match, its value behind another mark, and the end mark.

    Marks are code points that are no characters; a text that holds them has them exchanged for
    another such before.
    """
    begin, inner, end = _MARKS
    return F.regexp_replace(F.translate(text, "".join(_MARKS), _NO_MARK * len(_MARKS)), pattern, f"{begin}$0{inner}${int(group)}{end}")


def _places(marked: Column, tail: Column) -> Column:
    """The matches of a marked text as ``array<struct<start, end, value>>``: between the marks lie the pieces, so that positions are prefix sums of lengths."""
    begin, inner, end = _MARKS
    pieces = F.split(marked, begin)
    start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        head = F.substring_index(piece, end, 1)
        value, match = F.substring_index(head, inner, -1), F.length(F.substring_index(head, inner, 1))
        stop = acc["at"] + match - tail
        found = F.struct((stop - F.length(value)).alias("start"), stop.alias("end"), value.alias("value"))
        gap = F.length(piece) - F.length(head) - 1
        return F.struct((acc["at"] + match + gap).alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    return F.aggregate(F.slice(pieces, 2, 2**31 - 2), start, step, lambda acc: acc["out"])


def find_all(text: Column, pattern: str, group: bool = False, tail: int = 0) -> Column:
    """All matches as ``array<struct<start, end, value>>``, by one pass of the pattern, which must not match the empty string."""
    return _places(_marked(text, pattern, group), F.lit(tail))


def candidates(text: Column, rules: list[tuple[int, Rule]], keep) -> Column:
    """The spans of rules with their places in the order; ``keep(span with value)`` may refuse some.

    Only texts with a hint are searched, and only where the pattern is found are matches marked.
    What follows from the marks is one expression for all rules.
    """

    def searched(order: int, rule: Rule) -> Column:
        gate = text.rlike(rule.java)
        if rule.hint:
            gate = reduce(lambda a, b: a | b, [text.contains(h) for h in rule.hint]) & gate
        facts = f"'{rule.kind}' as kind, '{rule.name}' as rule, {rule.priority} as priority, {order} as ord, {rule.tail} as tail"
        return F.struct(F.expr(f"struct({facts})").alias("r"), F.when(gate, _marked(text, rule.java, rule.group)).alias("marked"))

    found = F.filter(F.array(*[searched(order, rule) for order, rule in rules]), lambda x: x["marked"].isNotNull())
    fields = ("kind", "rule", "priority", "ord")
    spans = F.flatten(F.transform(found, lambda x: F.transform(_places(x["marked"], x["r"]["tail"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), *[x["r"][c].alias(c) for c in fields], m["value"].alias("value")))))
    kept = F.filter(spans, keep)
    return F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", *fields)]))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Candidates of one text up to which the fold stays in the JVM, where each step copies what is taken so far.
FEW = 64


def resolve(candidates: Column) -> Column:
    """Non-overlapping spans in order of start.

    Candidates are taken by priority, then length, then start, then rule order, unless they
    overlap one already taken.  A known secret takes the place of smaller spans wholly inside
    it, but never of a placeholder.  Placeholders themselves are not returned.  Texts with few
    candidates are resolved by a fold, others by ``resolve_many``, in time that grows with them.
    """
    real = F.filter(candidates, lambda c: c["start"] < c["end"])
    many = F.size(candidates) > FEW
    return F.when(F.size(candidates) == 0, no_spans()).when(many, resolve_many(F.when(many, candidates))).when(~many, _fold(real))


def _fold(real: Column) -> Column:
    def order(a: Column, b: Column) -> Column:
        keys = ((a["priority"], b["priority"]), (b["end"] - b["start"], a["end"] - a["start"]), (a["start"], b["start"]), (a["ord"], b["ord"]))
        out = F.lit(0)
        for x, y in reversed(keys):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    def step(taken: Column, c: Column) -> Column:
        hit = F.filter(taken, lambda t: (t["start"] < c["end"]) & (t["end"] > c["start"]))
        inside = ~F.exists(hit, lambda t: (t["start"] < c["start"]) | (t["end"] > c["end"]) | (t["kind"] == ""))
        covers = (c["rule"] == "known") & c["kind"].isin(*SECRET_KINDS) & inside
        rest = F.filter(taken, lambda t: (t["start"] >= c["end"]) | (t["end"] <= c["start"]))
        return F.when(F.size(hit) == 0, F.concat(taken, F.array(c))).when(covers, F.concat(rest, F.array(c))).otherwise(taken)

    folded = F.aggregate(F.array_sort(real, order), no_spans(), step)
    return F.array_sort(F.filter(folded, lambda t: t["kind"] != ""))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("ord", pa.int32())]))
#: Width of the cells in which spans are found again.
_CELL = 64


def settle(candidates: list[dict]) -> list[dict]:
    """As ``resolve``.  What is taken stands in every cell of the text that it touches, so that a candidate meets its neighbours alone."""
    secret, cells, taken = set(SECRET_KINDS), defaultdict(dict), {}
    real = [c for c in candidates if c["start"] < c["end"]]
    for i, c in enumerate(sorted(real, key=lambda c: (c["priority"], c["start"] - c["end"], c["start"], c["ord"]))):
        touched = range(c["start"] // _CELL, (c["end"] - 1) // _CELL + 1)
        hit = {k: t for cell in touched if cell in cells for k, t in cells[cell].items() if t["start"] < c["end"] and t["end"] > c["start"]}
        if hit:
            replaces = c["rule"] == "known" and c["kind"] in secret
            if not replaces or any(t["start"] < c["start"] or t["end"] > c["end"] or t["kind"] == "" for t in hit.values()):
                continue
            for k, t in hit.items():
                del taken[k]
                for cell in range(t["start"] // _CELL, (t["end"] - 1) // _CELL + 1):
                    del cells[cell][k]
        taken[i] = c
        for cell in touched:
            cells[cell][i] = c
    return sorted((t for t in taken.values() if t["kind"] != ""), key=lambda t: t["start"])


def resolve_many(candidates: Column) -> Column:
    """``resolve`` for texts with many candidates; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if c is None else settle(c) for c in batch.to_pylist()], _SPANS)

    return F.arrow_udf(run, NONE)(candidates)


def drop_allowed(text: Column, spans: Column, allow: list[str]) -> Column:
    """Without the spans whose text is allowed; secrets can't be.  Done after ``resolve``, so that what is allowed still shields its text."""
    if not allow:
        return spans
    allowed = [a.lower() for a in allow]
    return F.filter(spans, lambda s: s["kind"].isin(*SECRET_KINDS) | ~F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"])).isin(allowed))


def value_of(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def substitute(text: Column, spans: Column, replacement) -> Column:
    """``text`` with ``replacement(span)`` for every span; spans in order, not overlapping."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, replacement(s)).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, 2**31 - 1))))


def restore(text: Column, vault: Column) -> Column:
    """``text`` with the placeholders that ``vault`` (a map from placeholder to value) holds replaced; others stay."""
    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    gaps = F.split(text, PLACEHOLDER, -1)
    put = F.transform(found, lambda p: F.coalesce(F.try_element_at(vault, p), p))
    pieces = F.zip_with(gaps, put, lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return F.when(text.contains("[REDACTED_"), F.array_join(pieces, "")).otherwise(text)


def line_and_column(text: Column, start: Column) -> tuple[Column, Column]:
    """1-based line and column of a position, the column in code points."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1, F.length(F.substring_index(before, "\n", -1)) + 1
