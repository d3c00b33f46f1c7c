"""Detection: candidates of all rules, resolved to spans that do not overlap.

Rules that one pattern says are column expressions in the JVM; the rescanning rules and custom
terms run in one Arrow pass beside them.  Both give arrays of candidates for the same fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rescans, scalars
from ..functions.spans import NONE, candidates, drop_allowed, no_spans, resolve
from ..sources.tables import settled
from .terms import Finder, Literals, Terms

#: Rules that the Arrow pass emits come after the column rules in order.
FIRST_SCAN = 100


def keeps(rules: Sequence[str], text: Column, tlds: Sequence[str] | None):
    """What else the rules ask of their matches, as one predicate on a span with its value."""
    after = lambda e: F.substring(text, e + 1, 1)
    before = lambda s: F.when(s > 0, F.substring(text, s, 1)).otherwise("")
    free_before = lambda s: ~before(s).rlike(r"[0-9A-Za-z_./\\@#$%+=:-]")
    free_after = lambda e: ~after(e).rlike("[0-9A-Za-z_@/-]") & ~F.substring(text, e + 1, 2).rlike(r"^\.[0-9A-Za-z]")

    def province_near(s: Column) -> Column:
        """On the same line or the one before."""
        return F.substring_index(F.substring(text, F.lit(1), s), "\n", -2).rlike(f"{P.B}(?:{'|'.join(P.PROVINCES)}){P.E}")

    asked = {
        "keyword": lambda s, e, v: ~v.rlike(P.VARIABLE),
        "entropy": lambda s, e, v: scalars.high_entropy(v),
        "email": lambda s, e, v: scalars.is_tld(F.element_at(F.split(v, r"\."), -1), tlds),
        "ipv4": lambda s, e, v: scalars.is_ipv4(v),
        "domain": lambda s, e, v: scalars.is_domain(text, s, v, tlds),
        "home-path": lambda s, e, v: ~F.lower(v).isin(*P.HOME_SKIP) & ~((F.lower(v) == "all") & (F.lower(F.substring(text, e + 1, 6)) == " users")),
        "address/us-city-line": lambda s, e, v: scalars.among(F.regexp_extract(v, r",[ \t]+([A-Z]{2})[ \t]", 1), P.US_STATES) & free_before(s),
        "address/uk-postcode": lambda s, e, v: scalars.among(F.regexp_extract(v, "^[A-Z]+", 0), P.UK_AREAS) & ~v.rlike("(?:[CIKMOV].|[CIKMOV])$") & free_before(s) & free_after(e),
        "address/ca-postcode": lambda s, e, v: (v.rlike(r"[ \t]") | province_near(s)) & free_before(s) & free_after(e),
    }

    def keep(span: Column) -> Column:
        out = F.lit(True)
        for rule, holds in asked.items():
            if rule in rules:
                out = F.when(span["rule"] == rule, holds(span["start"], span["end"], span["value"])).otherwise(out)
        return out

    return keep


def pattern_candidates(text: Column, rules: Sequence[str] | None = None, tlds: Sequence[str] | None = None, more: Sequence[P.Rule] = ()) -> Column:
    """Candidates of the column rules (all, or those named), and of ``more``, which come after them in order."""
    wanted = [(i, r) for i, r in enumerate(P.RULES) if rules is None or r.name in rules] + [(len(P.RULES) + i, r) for i, r in enumerate(more)]
    return candidates(text, wanted, keeps([r.name for _, r in wanted], text, tlds))


def with_scans(docs: DataFrame, column: str, out: str, terms: Terms | None = None, literals: list[tuple[str, str]] | None = None, rules: bool = True) -> DataFrame:
    """``docs`` with candidates of the rescanning rules, terms and literals in ``out``; of the table only the texts that may hold some go to Python."""
    order = {name: FIRST_SCAN + i for i, (name, *_) in enumerate(rescans.SCANS)} | {"terms": 200, "terms-re": 201, "known": 300}
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("ord", pa.int32())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finders = [(Finder(terms), P.PRIORITY["term"])] if terms else []
        if literals:
            finders.append((Literals(literals), P.PRIORITY["literal"]))
        for batch in batches:
            texts = batch.to_pylist()
            found = [list(rescans.scan(t)) if t and rules else [] for t in texts]
            for finder, priority in finders:
                for spans, more in zip(found, finder.find_in(texts)):
                    spans += [(*x, priority) for x in more]
            yield pa.array([[{"start": s, "end": e, "kind": k, "rule": r, "priority": p, "ord": order[r]} for s, e, k, r, p in spans] for spans in found], kind)

    scan = F.arrow_udf(run, NONE)
    text = F.col(column)
    # Terms and literals may stand in any text, the rules' findings only in those with a hint.
    return docs.withColumn(out, scan(text if terms or literals else F.when(rescans.worth_scanning(text), text)))


def detect(docs: DataFrame, text: str = "text", out: str = "spans", terms: Terms | None = None, allow: Sequence[str] = (), tlds: Sequence[str] | None = None, candidates: str | None = None, more: Sequence[P.Rule] = ()) -> DataFrame:
    """``docs`` with the resolved spans of every text in ``out``, by all rules and those of ``more``.

    ``candidates`` names a column to keep the unresolved candidates in, for a second pass.
    Null text has no spans.  ``allow`` and the terms' own list are compared without case.
    """
    held = candidates or "__candidates"
    scanned = with_scans(docs, text, "__scanned", terms)
    allowed = sorted({a.lower() for a in allow} | (terms.allow if terms else set()))
    # Settled, so that the pass that resolves many candidates has a column to read: with the scan inside its argument Spark leaves it where it can't run.
    both = settled(scanned.withColumn(held, F.coalesce(F.concat(pattern_candidates(F.col(text), tlds=tlds, more=more), F.col("__scanned")), no_spans())).drop("__scanned"))
    done = settled(both.withColumn(out, F.coalesce(drop_allowed(F.col(text), resolve(F.col(held)), allowed), no_spans())))
    return done if candidates else done.drop(held)


def detect_rules(docs: DataFrame, rules: Sequence[str], text: str = "text", out: str = "spans", tlds: Sequence[str] | None = None) -> DataFrame:
    """As ``detect`` with some of the column rules only: nothing leaves the JVM."""
    held = docs.withColumn("__candidates", pattern_candidates(F.col(text), rules, tlds))
    return settled(held.withColumn(out, F.coalesce(resolve(F.col("__candidates")), no_spans())).drop("__candidates"))
