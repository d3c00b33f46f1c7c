"""Vaults as relations: values numbered by first appearance, looked for everywhere, put back.

A vault row is (scope, value, kind, n, placeholder).  A value keeps the kind with which it was
first seen; numbers count per scope and kind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.tables import running, settled, written
from .terms import Literals
from ..functions.spans import FEW, SPAN, let, resolve, restore, substitute, value_of

LEAST_LITERAL = 4


def appearances(docs: DataFrame, scope: Sequence[str], order: Sequence[str], text: str = "text", spans: str = "spans") -> DataFrame:
    """A row for each span: scope, ``order`` columns, start, kind, value."""
    each = docs.select(*scope, *order, text, F.explode(spans).alias("s"))
    return each.select(*scope, *order, F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), value_of(F.col(text), F.col("s")).alias("value"))


def number(found: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The vault of ``appearances``.  Values are reduced map-side before they are ordered; only a scope's distinct values meet."""
    first = found.groupBy(*scope, "value").agg(F.min(F.struct(*order, "start", "kind")).alias("f"))
    n = F.row_number().over(Window.partitionBy(*scope, "f.kind").orderBy(*[f"f.{c}" for c in order], "f.start", "value"))
    rows = first.select(*scope, "value", F.col("f.kind").alias("kind"), n.alias("n"))
    return rows.withColumn("placeholder", F.format_string("[REDACTED_%s_%d]", "kind", "n"))


def number_all(found: DataFrame, order: Sequence[str]) -> DataFrame:
    """One vault for everything (a run over many files): numbers by range partitions, without one task for all values.

    Values are ranged by first appearance; each range counts its kinds, and the ranges' sums,
    a row for each range and kind, give the numbers to start from.
    """
    first = found.groupBy("value").agg(F.min(F.struct(*order, "start", "kind")).alias("f"))
    ranged = first.repartitionByRange("f").withColumn("part", F.spark_partition_id())
    ranged = written(ranged)  # so that both uses see the same ranges
    counts = ranged.groupBy("part", "f.kind").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("part").alias("p"), F.col("kind").alias("k"), before.alias("before"))
    n = F.row_number().over(Window.partitionBy("part", "f.kind").orderBy("f", "value"))
    rows = ranged.withColumn("rn", n).join(starts, (F.col("part") == F.col("p")) & (F.col("f.kind") == F.col("k")))
    out = rows.select("value", F.col("f.kind").alias("kind"), (F.col("rn") + F.col("before")).cast("int").alias("n"))
    return out.withColumn("placeholder", F.format_string("[REDACTED_%s_%d]", "kind", "n"))


def vault_maps(vault: DataFrame, scope: Sequence[str]) -> DataFrame:
    """A row a scope: maps from value to placeholder and back."""
    pairs = vault.groupBy(*scope).agg(F.collect_list(F.struct("value", "placeholder")).alias("v"))
    return pairs.select(*scope, F.map_from_entries("v").alias("by_value"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["placeholder"], x["value"]))).alias("by_placeholder"))


def redact(docs: DataFrame, vault: DataFrame, scope: Sequence[str], text: str = "text", spans: str = "spans", out: str = "redacted") -> DataFrame:
    """``docs`` with every span of a text replaced by its value's placeholder."""
    joined = docs.join(vault_maps(vault, scope).select(*scope, "by_value"), list(scope), "left")
    put = substitute(F.col(text), F.col(spans), lambda s: F.try_element_at(F.col("by_value"), value_of(F.col(text), s)))
    return joined.withColumn(out, put).drop("by_value")


def redact_row(text: Column, spans: Column) -> Column:
    """A text redacted with a vault of its own: numbers are worked out within the row.

    Rows with few spans stay in the JVM; those with many are folded by ``redact_many``.
    """
    many = F.size(spans) > FEW
    values = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), value_of(text, s).alias("value")))

    def named(firsts: Column) -> Column:
        """The vault: each value with its place among the values of its kind."""
        place = lambda x, i: F.size(F.filter(F.slice(firsts, F.lit(1), i + 1), lambda y: y["kind"] == x["kind"]))
        return F.transform(firsts, lambda x, i: F.struct(x["value"].alias("value"), F.format_string("[REDACTED_%s_%d]", x["kind"], place(x, i)).alias("put")))

    def placeholders(seen: Column) -> Column:
        firsts = F.filter(seen, lambda v, i: ~F.exists(F.slice(seen, F.lit(1), i), lambda u: u["value"] == v["value"]))
        vault = lambda rows: F.transform(seen, lambda v: F.get(F.filter(rows, lambda r: r["value"] == v["value"]), F.lit(0))["put"])
        return let(firsts, lambda f: let(named(f), vault))

    put = F.zip_with(spans, let(values, placeholders), lambda s, p: F.struct(s["start"].alias("start"), s["end"].alias("end"), p.alias("put")))
    return F.when(F.size(spans) == 0, text).when(many, redact_many(F.when(many, text), F.when(many, spans))).when(~many, substitute(text, put, lambda s: s["put"]))


def redact_many(text: Column, spans: Column) -> Column:
    """``redact_row`` in one pass over the spans, which carries the values met so far and a counter for each kind; null stays null."""

    def redacted(t: str, found: list[dict]) -> str:
        vault, counts, pieces, at = {}, Counter(), [], 0
        for s in found:
            value = t[s["start"] : s["end"]]
            if value not in vault:
                counts[s["kind"]] += 1
                vault[value] = f"[REDACTED_{s['kind']}_{counts[s['kind']]}]"
            pieces += (t[at : s["start"]], vault[value])
            at = s["end"]
        return "".join([*pieces, t[at:]])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sets in batches:
            yield pa.array([None if t is None or s is None else redacted(t, s) for t, s in zip(texts.to_pylist(), sets.to_pylist())], pa.string())

    return F.arrow_udf(run, "string")(text, spans)


def scope_values(vault: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, known_values): the values of each scope's vault that are long enough to be looked for."""
    values = vault.where(F.length("value") >= LEAST_LITERAL)
    return values.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("value", "kind"))).alias("known_values"))


def _known(text: Column, values: Column) -> Column:
    """Where the values stand in a text as whole words, overlapping places too, as candidate spans; one automaton for each set of values."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("ord", pa.int32())]))
        held, finder = None, None
        for texts, sets in batches:
            out = []
            for text, values in zip(texts, sets):  # a set is large and comes again with every text of its scope
                t, pairs = text.as_py(), values.as_py()
                if not t or not pairs:
                    out.append([])
                    continue
                if pairs != held:  # texts of a scope follow one another
                    held, finder = pairs, Literals([(p["kind"], p["value"]) for p in pairs])
                out.append([{"start": s, "end": e, "kind": k, "rule": r, "priority": P.PRIORITY["literal"], "ord": 300} for s, e, k, r in finder(t)])
            yield pa.array(out, kind)

    return F.arrow_udf(run, f"array<{SPAN}>")(text, values)


def literal_hits(docs: DataFrame, vault: DataFrame, scope: Sequence[str], key: Sequence[str], text: str = "text") -> DataFrame:
    """Where values of a scope's vault stand as plain text: (key, known), known an array of candidate spans; only texts with any.

    All places count, overlapping ones too, if they are whole words.
    """
    joined = docs.select(*scope, *[k for k in key if k not in scope], text).join(scope_values(vault, scope), list(scope))
    return joined.select(*key, _known(F.col(text), F.col("known_values")).alias("known")).where(F.size("known") > 0)


def second_pass(docs: DataFrame, vault: DataFrame, scope: Sequence[str], text: str = "text", candidates: str = "candidates", spans: str = "spans") -> DataFrame:
    """``docs`` with spans resolved anew from the candidates and the vault's literals; texts meet their scope's values once."""
    joined = docs.join(scope_values(vault, scope), list(scope), "left")
    found = settled(joined.withColumn("__known", _known(F.col(text), F.col("known_values"))).drop("known_values"))  # as in ``detect``
    return settled(found.withColumn(spans, F.when(F.size("__known") == 0, F.col(spans)).otherwise(resolve(F.concat(candidates, "__known")))).drop("__known"))


def redact_all(docs: DataFrame, vault: DataFrame, key: Sequence[str], text: str = "text", spans: str = "spans", out: str = "redacted") -> DataFrame:
    """``docs`` redacted with one vault for everything, however large.

    Spans meet the vault by value, a row each, and go back to their document as a list of
    placeholders in order; neither the vault nor a scope of it is gathered anywhere.
    """
    each = docs.select(*key, text, F.posexplode(spans).alias("__n", "__s")).select(*key, "__n", value_of(F.col(text), F.col("__s")).alias("value"))
    placed = each.join(vault.select("value", "placeholder"), "value").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__n", "placeholder"))).alias("__p"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key]
    joined = docs.alias("d").join(placed.alias("p"), same, "left").select("d.*", "p.__p")
    pairs = F.transform(F.zip_with(F.col(spans), F.col("__p"), lambda s, p: F.struct(s["start"].alias("start"), s["end"].alias("end"), p["placeholder"].alias("put"))), lambda x: x)
    return joined.withColumn(out, F.when(F.col("__p").isNull(), F.col(text)).otherwise(substitute(F.col(text), pairs, lambda s: s["put"]))).drop("__p")


def number_chains(found: DataFrame, links: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """Vaults that continue along chains: for each request the values that are new in it, (key, root, value, kind, n, placeholder).

    ``links(key, parent)`` says which request's vault a request continues (null: none), ``found``
    are the requests' appearances (key, order..., start, kind, value).  A request's vault is
    what is new in it and in the requests before it; its numbers go on from theirs, and two
    requests that continue the same one count on independently.

    Conversations are trees, walked around once (``tree_order``): a value is new where no request
    with it has been entered and not yet left, which the latest leaving so far tells, and what the
    requests before have numbered is a running sum, added on entering and taken back on leaving.
    Both run over range partitions, so that one long conversation is spread like many short ones.
    """
    from .state import tree_order

    tree = written(tree_order(links.select(F.col(key).alias("id"), F.col("parent"))))
    first = found.groupBy(key, "value").agg(F.min(F.struct(*order, "start", "kind")).alias("f")).withColumnRenamed(key, "id")
    seen = first.join(tree, "id").select("*", F.col("leave").alias("covered"))
    # Of earlier requests with the value one is an ancestor if and only if it is left later.
    marked = running(seen, ["tree", "value"], ["enter"], {"covered": F.max})
    fresh = written(marked.where("covered is null or covered < leave").select("id", "root", "tree", "enter", "leave", "value", F.col("f.kind").alias("kind"), F.struct(*[f"f.{c}" for c in order], "f.start", "value").alias("at")))
    place = F.row_number().over(Window.partitionBy("id", "kind").orderBy("at"))
    counts = fresh.groupBy("tree", "kind", "id", "enter", "leave").agg(F.count("*").alias("n"))
    steps = counts.select("tree", "kind", "id", F.inline(F.array(F.struct(F.col("enter").alias("t"), F.col("n").alias("n")), F.struct(F.col("leave").alias("t"), (-F.col("n")).alias("n")))))
    entered = F.col("t").alias("enter")
    before = running(steps, ["tree", "kind"], ["t"], {"n": F.sum}).select("id", "kind", entered, F.coalesce("n", F.lit(0)).alias("before"))
    made = fresh.withColumn("place", place).join(written(before), ["id", "kind", "enter"])
    out = made.select(F.col("id").alias(key), "root", "value", "kind", (F.col("place") + F.col("before")).cast("int").alias("n"))
    return out.withColumn("placeholder", F.format_string("[REDACTED_%s_%d]", "kind", "n"))


def restored(docs: DataFrame, vault: DataFrame, scope: Sequence[str], text: str = "redacted", out: str = "restored") -> DataFrame:
    joined = docs.join(vault_maps(vault, scope).select(*scope, "by_placeholder"), list(scope), "left")
    empty = F.create_map().cast("map<string,string>")
    return joined.withColumn(out, restore(F.col(text), F.coalesce("by_placeholder", empty))).drop("by_placeholder")


def found(appeared: DataFrame, scope: Sequence[str], order: Sequence[str], sections: Sequence[str] = ()) -> DataFrame:
    """The values worth remembering: distinct, with the latest kind, of kinds that context found."""
    latest = appeared.where(F.col("kind").isin(*P.REMEMBERED_KINDS, *sections)).groupBy(*scope, "value")
    return latest.agg(F.max_by("kind", F.struct(*order, "start")).alias("kind"))
