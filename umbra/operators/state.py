"""State over time as relations: remembered values, response chains, all by the times of events."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.tables import extended, written

# The bounds of the stores.
MOST_VALUES, MOST_BYTES = 4096, 1 << 20
IDLE = "INTERVAL 1 HOUR"
CHAIN_TTL = "INTERVAL 1 HOUR"
MOST_CHAINS = 10_000
#: A node that has failed is passed over for so long.
DOWN = "INTERVAL 10 SECONDS"


def alive_spans(adds: DataFrame, scope: Sequence[str], ts: str = "ts", idle: str = IDLE) -> DataFrame:
    """Lives of each scope's set: (scope, life, began, last_add, expires).

    A set expires ``idle`` after the last addition; an addition exactly then finds it expired.
    """
    order = Window.partitionBy(*scope).orderBy(ts)
    fresh = F.lag(ts).over(order).isNull() | (F.col(ts) >= F.lag(ts).over(order) + F.expr(idle))
    lives = adds.withColumn("life", F.sum(fresh.cast("int")).over(order))
    return lives.groupBy(*scope, "life").agg(F.min(ts).alias("began"), F.max(ts).alias("last_add"), (F.max(ts) + F.expr(idle)).alias("expires"))


def live_values(adds: DataFrame, scope: Sequence[str], at: Column, ts: str = "ts", value: str = "value", kind: str = "kind", idle: str = IDLE, most_values: int = MOST_VALUES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """What each scope's set holds at a time: (scope, value, kind, last_seen, rank).

    Only additions of the life that is current count; of them the most recent that fit both
    bounds stay, as the least recent are dropped first.
    """
    before = adds.where(F.col(ts) <= at)
    last = alive_spans(before, scope, ts, idle).groupBy(*scope).agg(F.max(F.struct("life", "began", "expires")).alias("l")).where(at < F.col("l.expires"))
    current = before.join(last, list(scope)).where(F.col(ts) >= F.col("l.began"))
    seen = current.groupBy(*scope, value).agg(F.max(ts).alias("last_seen"), F.max_by(kind, ts).alias(kind))
    recent = Window.partitionBy(*scope).orderBy(F.desc("last_seen"), value)
    ranked = seen.withColumn("rank", F.row_number().over(recent)).withColumn("bytes", F.sum(F.octet_length(value)).over(recent.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Bytes grow with the rank, so that what fits is a prefix of the order.
    return ranked.where((F.col("rank") <= most_values) & (F.col("bytes") <= most_bytes)).drop("bytes")


def live_values_at(adds: DataFrame, requests: DataFrame, scope: Sequence[str], request: str, ts: str = "ts", value: str = "value", kind: str = "kind", idle: str = IDLE, most_values: int = MOST_VALUES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """What the sets hold at the time of each request: (request, value, kind, last_seen, rank).

    ``requests(scope, request, ts)`` see the additions up to their time, of the life that is then
    current; a value longer than ``most_bytes`` is not kept, but keeps the set alive.  Additions and
    requests lie in one order of time, dealt to range partitions.  Of each partition only the
    values that fit both bounds at its end, and the first that does not, are carried on; then each
    is run through from what the ones before it have left.  No more pairs of requests and values
    are made than come out, and a scope is as many rows of work as others.
    """
    held = Window.partitionBy("__part", *scope)
    own, recent = held.orderBy("__at"), held.orderBy(F.desc("__seen"), "__value")
    # Equal times of one value are one addition.
    added = adds.groupBy(*scope, F.col(ts).alias("__at"), F.when(F.octet_length(value) <= most_bytes, F.col(value)).alias("__value")).agg(F.max(kind).alias("__kind"), F.lit(0).alias("__asks"))
    asked = requests.select(*scope, F.col(ts).alias("__at"), F.col(request).alias("__request"), F.lit(1).alias("__asks"))
    rows = added.unionByName(asked, allowMissingColumns=True).dropna(subset=[*scope, "__at"])
    ranged = written(rows.repartitionByRange(*scope, "__at").withColumn("__part", F.spark_partition_id()))

    fresh = F.coalesce(F.col("__at") >= F.lag("__at").over(own) + F.expr(idle), F.lit(False))
    lived = ranged.where("__asks = 0").withColumn("__life", F.sum(fresh.cast("int")).over(own)).withColumn("__lives", F.max("__life").over(held))
    ends = lived.groupBy("__part", *scope).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), (F.max("__life") > 0).alias("__anew"))
    seen = lived.where("__life = __lives and __value is not null").groupBy("__part", *scope, "__value").agg(F.max("__at").alias("__seen"), F.max_by("__kind", "__at").alias("__kind"))
    above = F.coalesce(F.sum(F.octet_length("__value")).over(recent.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = seen.withColumns({"__rank": F.row_number().over(recent), "__above": above}).where((F.col("__rank") <= most_values + 1) & (F.col("__above") <= most_bytes))
    lists = kept.groupBy("__part", *scope).agg(F.sort_array(F.collect_list(F.struct("__rank", "__value", "__kind", "__seen"))).alias("__held"))
    left = ends.join(lists, ["__part", *scope], "left").select(*scope, "__part", "__first", "__last", "__anew", F.transform("__held", lambda x: F.struct(x["__value"].alias("value"), x["__kind"].alias("kind"), x["__seen"].alias("seen"))).alias("__held"))
    left = left.repartition(*scope).sortWithinPartitions(*scope, "__part")
    idle_us = adds.sparkSession.range(1).select(F.expr(idle)).first()[0] // timedelta(microseconds=1)

    def micros(time: datetime) -> int:
        return (time - datetime(1970, 1, 1, tzinfo=time.tzinfo and timezone.utc)) // timedelta(microseconds=1)

    def fitting(values: Iterator[tuple]) -> Iterator[tuple]:
        """Of (value, kind, seen), the most recent first, those that fit, and the first that does not."""
        n = size = 0
        for x in values:
            yield x
            n, size = n + 1, size + len(x[0].encode())
            if n > most_values or size > most_bytes:
                return

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is left when each partition of a scope begins: the time of the last addition, and its values."""
        at, last, values = None, None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at != (at := tuple(row[c] for c in scope)):
                    last, values = None, []
                if last is not None:
                    out.append({**{c: row[c] for c in scope}, "__part": row["__part"], "__at": last, "__asks": -1, "__held": [dict(zip(("value", "kind", "seen"), v)) for v in values]})
                mine = [(x["value"], x["kind"], x["seen"]) for x in row["__held"] or ()]
                if last is not None and not row["__anew"] and micros(row["__first"]) < micros(last) + idle_us:
                    again = {x[0] for x in mine}
                    mine = [*fitting(x for x in (*mine, *(v for v in values if v[0] not in again)))]
                last, values = row["__last"], mine
            yield pa.RecordBatch.from_pylist(out, carried_schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, values, grown = None, None, {}, 0
        for batch in batches:
            out: list[tuple] = []
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns["__at"] = columns["__at"].cast(pa.int64())
            keys = zip(columns["__part"].to_pylist(), *[columns[c].to_pylist() for c in scope])
            for k, t, asks, v, kd, r, carried in zip(keys, *[columns[c].to_pylist() for c in ("__at", "__asks", "__value", "__kind", "__request", "__held")]):
                if k != key:
                    key, last, values, grown = k, None, {}, 0
                if asks < 0:
                    last, values = t, {x["value"]: (x["kind"], micros(x["seen"])) for x in reversed(carried)}
                elif asks == 0:
                    if last is not None and t >= last + idle_us:
                        values, grown = {}, 0
                    last = t
                    if v is not None:
                        values.pop(v, None)
                        values[v] = (kd, t)
                        grown += len(v) + 64
                        if grown > 4 * most_bytes + 256 * most_values:  # what does not fit any more is dropped now and then
                            values, grown = {x[0]: x[1:] for x in reversed([*fitting((v, *values[v]) for v in reversed(values))])}, 0
                elif last is not None and t < last + idle_us:
                    size = 0
                    for n, v in enumerate(reversed(values), 1):
                        size += len(v.encode())
                        if n > most_values or size > most_bytes:
                            break
                        out.append((r, v, *values[v], n))
                    if len(out) > 100_000:
                        yield answered(out)
                        out = []
            yield answered(out)

    def answered(out: list[tuple]) -> pa.RecordBatch:
        r, v, kd, t, n = zip(*out) if out else ([],) * 5
        return pa.RecordBatch.from_arrays([pa.array(r, out_schema.field(0).type), pa.array(v, pa.string()), pa.array(kd, pa.string()), pa.array(t, pa.int64()).cast(out_schema.field(3).type), pa.array(n, pa.int32())], schema=out_schema)

    types = {f.name: f.dataType for f in ranged.schema.fields}
    when = types["__at"].simpleString()
    carried_type = StructType([*[f for f in left.schema.fields if f.name in (*scope, "__part")], *StructType.fromDDL(f"__at {when}, __asks int, __held array<struct<value:string,kind:string,seen:{when}>>").fields])
    out_type = StructType([ranged.schema["__request"], *StructType.fromDDL(f"value string, kind string, last_seen {when}, rank int").fields])
    carried_schema, out_schema = to_arrow_schema(carried_type), to_arrow_schema(out_type)
    both = ranged.unionByName(left.mapInArrow(carry, carried_type), allowMissingColumns=True)
    dealt = both.repartition("__part", *scope).sortWithinPartitions("__part", *scope, "__at", "__asks", F.desc("__value"))
    return dealt.mapInArrow(answer, out_type).toDF(request, value, kind, "last_seen", "rank")


def chain_hits(gets: DataFrame, puts: DataFrame, scope: Sequence[str], id: str = "response_id", ts: str = "ts", ttl: str = CHAIN_TTL) -> DataFrame:
    """``gets(scope, id, ts)`` with ``put_ts`` of the latest put before it that is still valid; null is a miss.

    Puts and gets of an entry lie in one order of time, in which each get looks back at the last
    put: no pairs are made.
    """
    held = [*gets.columns]
    asked = gets.select(*scope, id, F.col(ts).alias("__at"), F.lit(1).alias("__get"), F.struct(*held).alias("__row"))
    put = puts.select(*scope, id, F.col(ts).alias("__at"), F.lit(0).alias("__get"), F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"))
    before = Window.partitionBy(*scope, id).orderBy("__at", "__get").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("__get") == 0, F.col("__at")), ignorenulls=True).over(before)
    seen = asked.unionByName(put).withColumn("put_ts", last).where("__get = 1")
    return seen.select("__row.*", F.when(F.col("__at") < F.col("put_ts") + F.expr(ttl), F.col("put_ts")).alias("put_ts"))


def chain_misses(gets: DataFrame, puts: DataFrame, scope: Sequence[str], id: str = "response_id", ts: str = "ts", ttl: str = CHAIN_TTL) -> DataFrame:
    """The gets that no valid put answers."""
    return chain_hits(gets, puts, scope, id, ts, ttl).where("put_ts is null").drop("put_ts")


def kept_chains(puts: DataFrame, by: Sequence[str] = (), ts: str = "ts", most: int = MOST_CHAINS) -> DataFrame:
    """The most recent ``most`` entries of a store, with their rank."""
    order = [F.desc(ts), *[c for c in puts.columns if c != ts]]
    # One store for all: each task keeps its most recent, and only those meet.
    recent = puts if by else puts.orderBy(*order).limit(most)
    return recent.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def chain_roots(links: DataFrame, child: str = "id", parent: str = "parent", rounds: int = 32) -> DataFrame:
    """(id, root, depth): the chain's first response for each, by pointer jumping; every round doubles the reach."""
    at = written(links.select(F.col(child).alias("id"), F.coalesce(F.col(parent), F.col(child)).alias("root"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(rounds):
        up = at.select(F.col("id").alias("u"), F.col("root").alias("next"), F.col("depth").alias("more"))
        stepped = at.join(up, F.col("root") == F.col("u"), "left")
        moved = F.coalesce(F.col("next") != F.col("root"), F.lit(False)).alias("moved")
        # Tables of their own on both sides: many may hang on one root, and the join can be split there.
        at = written(stepped.select("id", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.when(F.col("next") != F.col("root"), F.col("more")).otherwise(0)).alias("depth"), moved))
        if not at.where("moved").limit(1).count():
            break
        at = at.drop("moved")
    return at.select("id", "root", "depth")


#: Nodes of a tree that one task walks around; the walk around a larger one is a list, placed by doubling.
WALKED = 50_000


def tree_order(links: DataFrame, id: str = "id", parent: str = "parent", rounds: int = 64, walked: int = WALKED) -> DataFrame:
    """(id, root, tree, enter, leave): the places at which a walk around each tree of ``links``, named by its top, enters and leaves a node.

    One node is an ancestor of another if it is entered before and left after it.  Pointer jumping
    finds each node's top; trees of up to ``walked`` nodes are then walked around whole, many in a
    task.  The walk around a larger one is a list, of which each element knows the next; its
    places are found by doubling, every round over all elements, so that a tree, however deep or
    wide, is spread over all tasks.  A parent that has no row of its own is the root of its
    children, but they are trees by themselves.
    """
    kind = links.schema[id].dataType
    nodes = written(links.select(F.col(id).alias("id"), F.col(parent).alias("parent")))
    ids = nodes.select(F.col("id").alias("held"))
    nodes = written(nodes.join(ids, nodes["parent"] == ids["held"], "left").withColumn("root", F.when(F.col("held").isNull(), F.coalesce("parent", "id").cast(kind))))
    tops = chain_roots(nodes, "id", "held").select(F.col("id").alias("of"), F.col("root").alias("tree"))
    sizes = tops.groupBy("tree").count()
    large = written(sizes.where(F.col("count") > walked).select("tree"))
    some = bool(large.limit(1).count())
    rest = tops.join(large, "tree", "left_anti") if some else tops
    both = nodes.join(rest, nodes["id"] == rest["of"]).select("id", "held", "root", "tree")
    schema = extended(StructType([both.schema["id"], both.schema["root"], both.schema["tree"]]), "enter long, leave long")
    arrow = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        tree, top, under, n = None, None, {}, 0

        def around() -> None:
            """The tree that is held; children in order."""
            if top is None:
                return
            (first, root), at, entered = top, 1 - 2 * n, {}
            path = [(first, False)]
            while path:
                node, done = path.pop()
                if done:
                    out.append((node, root, tree, entered[node], at))
                else:
                    entered[node] = at
                    path.append((node, True))
                    path += [(c, False) for c in sorted(under.get(node, ()), reverse=True)]
                at += 1

        def told() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for node, held, root, of in zip(*[batch.column(c).to_pylist() for c in ("id", "held", "root", "tree")]):
                if of != tree:
                    around()
                    tree, top, under, n = of, None, {}, 0
                n += 1
                if held is None:
                    top = (node, root)
                else:
                    under.setdefault(held, []).append(node)
            if len(out) > 10_000:
                yield told()
        around()
        yield told()

    small = both.repartition("tree").sortWithinPartitions("tree").mapInArrow(walk, schema)
    if not some:
        return small
    of_large = tops.join(large, "tree").select("of")
    return small.union(_toured(written(nodes.join(of_large, nodes["id"] == of_large["of"]).select("id", "held", "root")), rounds))


def _toured(nodes: DataFrame, rounds: int) -> DataFrame:
    """``tree_order`` of whole trees of ``nodes(id, held, root)`` by doubling."""
    # Children are chained in ranges: a parent may have very many.
    under = nodes.where("held is not null").select("id", "held").repartitionByRange("held", "id").withColumn("part", F.spark_partition_id())
    under = written(under)
    following = F.lead("id").over(Window.partitionBy("part", "held").orderBy("id"))
    firsts = under.groupBy("held", "part").agg(F.min("id").alias("first"))
    beyond = firsts.select("held", "part", F.lead("first").over(Window.partitionBy("held").orderBy("part")).alias("beyond"))
    chained = under.withColumn("following", following).join(beyond, ["held", "part"]).select("id", "held", F.coalesce("following", "beyond").alias("following"))
    first = under.groupBy("held").agg(F.min("id").alias("child")).select(F.col("held").alias("of"), "child")
    enter = nodes.join(first, nodes["id"] == first["of"], "left").select("id", F.lit(0).alias("side"), F.coalesce("child", "id").alias("next"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("next_side"), F.lit(1).cast("long").alias("far"))
    exits = chained.select("id", F.lit(1).alias("side"), F.coalesce("following", "held").alias("next"), F.when(F.col("following").isNull(), 1).otherwise(0).alias("next_side"), F.lit(1).cast("long").alias("far"))
    ends = nodes.where("held is null").select("id", F.lit(1).alias("side"), F.col("id").alias("next"), F.lit(1).alias("next_side"), F.lit(0).cast("long").alias("far"))
    at = written(enter.union(exits).union(ends))
    for _ in range(rounds):
        up = at.select(F.col("id").alias("u"), F.col("side").alias("u_side"), F.col("next").alias("then"), F.col("next_side").alias("then_side"), F.col("far").alias("more"))
        stepped = at.join(up, (F.col("next") == F.col("u")) & (F.col("next_side") == F.col("u_side")))
        at = written(stepped.select("id", "side", F.col("then").alias("next"), F.col("then_side").alias("next_side"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved")))
        moved = at.where("moved").limit(1).count()
        at = at.drop("moved")
        if not moved:
            break
    roots = nodes.where("held is null").select(F.col("id").alias("next"), "root")
    placed = at.groupBy("id", "next").agg(F.min(F.when(F.col("side") == 0, -F.col("far"))).alias("enter"), F.min(F.when(F.col("side") == 1, -F.col("far"))).alias("leave"))
    return placed.join(roots, "next").select("id", "root", F.col("next").alias("tree"), "enter", "leave")


def authenticate(requests: DataFrame, tokens: DataFrame, token: str = "token") -> DataFrame:
    """``requests`` with the client whose token's digest matches (null: status 401); an empty token is nobody's."""
    digest = F.when(F.coalesce(F.col(token), F.lit("")) != "", F.sha2(token, 256))
    joined = requests.withColumn("__hash", digest).join(tokens.select(F.col("name").alias("client"), F.lower("hash").alias("__hash")), "__hash", "left").drop("__hash")
    return joined.withColumn("status", F.when(F.col("client").isNull(), 401).otherwise(200))


def down_spans(failures: DataFrame, node: str = "node", ts: str = "ts", down: str = DOWN, piece: str = "INTERVAL 1 HOUR") -> DataFrame:
    """(node, began, until) in which a node is passed over: ``down`` from a failure on; failures meanwhile prolong nothing.

    Whether a failure counts depends on the span before it, and so on all before it.  Time is cut
    into pieces.  A piece is a function from the time until which the node is down on entering it
    to that on leaving it; it only depends on the first failure not before the entry, which lies
    at the piece's begin or is the first behind.  Along a node these functions alone are composed,
    a few numbers for each piece; then each piece is walked from its own entry.  Failures without
    node or time are ignored, repeated ones count once.
    """
    kind = failures.schema[node].dataType.simpleString()
    length, size = failures.sparkSession.range(1).select(*[F.expr(f"unix_micros(timestamp_micros(0) + {x})") for x in (down, piece)]).first()
    if size <= length:
        raise ValueError("a piece must be longer than the time a node is down")
    times = failures.select(F.col(node).alias("node"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("node is not null and t is not null").distinct()
    pieces = written(times.withColumn("piece", F.floor(F.col("t") / size)))

    def chain(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each failure as the begin of a span: which failure begins the next one, and the end of the last span in the piece."""
        after = np.searchsorted(t, t + length)
        last = np.append(after, len(t))  # by doubling: the last span's begin, then its end
        jump = np.where(last < len(t), last, np.arange(len(t) + 1))
        while True:
            further = jump[jump]
            if (further == jump).all():
                return after, t[jump[: len(t)]] + length
            jump = further

    def function(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        t = np.sort(group.column("t").to_numpy())
        starts = int(np.searchsorted(t, key[1].as_py() * size + length)) + 1
        leaving = chain(t)[1]
        return pa.table({"node": [key[0].as_py()], "piece": [key[1].as_py()], "starts": [t[:starts]], "leaving": [leaving[:starts]]}, functions)

    def compose(group: pa.Table) -> pa.Table:
        rows, until, out = sorted(group.to_pylist(), key=lambda r: r["piece"]), None, []
        for r in rows:
            k = 0 if until is None else bisect_left(r["starts"], until)
            if k < len(r["starts"]):
                out.append((r["node"], r["piece"], r["starts"][k]))
                until = r["leaving"][k]
        return pa.table({c: [x[i] for x in out] for i, c in enumerate(("node", "piece", "entry"))}, entries)

    def walk(group: pa.Table) -> pa.Table:
        t = np.sort(group.column("t").to_numpy())
        after, _ = chain(t)
        k, began = int(np.searchsorted(t, group.column("entry")[0].as_py())), []
        while k < len(t):
            began.append(int(t[k]))
            k = after[k]
        return pa.table({"node": [group.column("node")[0].as_py()] * len(began), "t": began}, spans)

    functions, entries, spans = (to_arrow_schema(StructType.fromDDL(f"node {kind}, {x}")) for x in ("piece long, starts array<long>, leaving array<long>", "piece long, entry long", "t long"))
    found = pieces.groupBy("node", "piece").applyInArrow(function, f"node {kind}, piece long, starts array<long>, leaving array<long>")
    entered = written(found.groupBy("node").applyInArrow(compose, f"node {kind}, piece long, entry long"))
    made = pieces.join(entered, ["node", "piece"]).groupBy("node", "piece").applyInArrow(walk, f"node {kind}, t long")
    return made.select(F.col("node").alias(node), F.timestamp_micros("t").alias("began"), (F.timestamp_micros("t") + F.expr(down)).alias("until"))


def owners_up(requests: DataFrame, nodes: Sequence[str], downs: DataFrame, parts: Sequence[str] = ("client", "route"), ts: str = "ts", out: str = "owner") -> DataFrame:
    """As ``owners`` at each request's time, minus the nodes that are then down (``downs(node, began, until)``).

    Requests and spans meet by the minute; spans are seconds long.
    """
    minute = lambda c: F.date_trunc("minute", c)
    every = F.expr("explode(sequence(date_trunc('minute', began), date_trunc('minute', until), interval 1 minute))")
    spans = downs.select(F.col("node").alias("__node"), "began", "until", every.alias("__minute"))
    met = requests.withColumn("__minute", minute(F.col(ts)))
    met = met.join(spans.groupBy("__minute").agg(F.collect_list(F.struct("__node", "began", "until")).alias("__down")), "__minute", "left")
    out_now = F.transform(F.filter(F.coalesce("__down", F.array().cast("array<struct<__node:string,began:timestamp,until:timestamp>>")), lambda d: (d["began"] <= F.col(ts)) & (F.col(ts) < d["until"])), lambda d: d["__node"])
    return owners(met.withColumn("__out", out_now), nodes, parts, out, "__out").drop("__minute", "__down", "__out")


def owners(keys: DataFrame, nodes: Sequence[str], parts: Sequence[str] = ("client", "route"), out: str = "owner", without: str | None = None) -> DataFrame:
    """Rendezvous placement: the node with the greatest digest of node and key, the first of equals.

    The nodes are the members of a cluster, a short list, so that each key weighs them in its own
    row and nothing is shuffled.  ``without`` names a column with nodes to pass over.
    """
    key = F.concat_ws("\0", *parts)
    weigh = lambda n: F.struct(F.substring(F.sha2(F.concat(F.lit(n + "\0"), key).cast("binary"), 256), 1, 16).alias("w"), F.lit(n).alias("node"))
    weighed = F.array(*[weigh(n) for n in sorted(set(nodes))])
    if without:
        weighed = F.filter(weighed, lambda w: ~F.array_contains(without, w["node"]))
    best = F.aggregate(F.slice(weighed, 2, max(1, len(set(nodes)))), F.get(weighed, F.lit(0)), lambda a, b: F.when(b["w"] > a["w"], b).otherwise(a))
    return keys.withColumn(out, best["node"])
