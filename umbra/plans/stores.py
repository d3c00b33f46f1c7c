"""Queries over what is kept between requests, who serves them, and what is told of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detect, metrics, state, vault
from ..sources import files
from ..sources.tables import shared_path, table
from ..streaming import reload
from ..streaming import stores as streams
from .catalogue import LOG_SQL, NODES, log, query


@query("""
with e as (select event_id, user_id, ts, 'v' || (event_id % 7) as value, (['EMAIL', 'SECRET', 'USER'])[event_id % 3 + 1] as kind from events),
f as (select *, row_number() over (partition by user_id, value order by ts, event_id) as seen, first_value(event_id) over (partition by user_id order by ts, event_id) as root from e)
select event_id, root, value, kind, row_number() over (partition by user_id, kind order by ts, event_id)::int as n from f where seen = 1
""")
def chain_vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a conversation: each request's vault goes on from the one before."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    links = events.select("event_id", F.lag("event_id").over(order).alias("parent"))
    kind = F.get(F.array(*map(F.lit, ("EMAIL", "SECRET", "USER"))), (F.col("event_id") % 3).cast("int"))
    found = events.select("event_id", F.lit(0).alias("start"), kind.alias("kind"), F.concat(F.lit("v"), F.col("event_id") % 7).alias("value"))
    return vault.number_chains(found, links, "event_id").select("event_id", "root", "value", "kind", "n")


@query("""
with a as (select user_id % 50 as client, ts, 'value' || user_id as value from events where event_type != 'error'),
r as (select event_id, user_id % 50 as client, ts from events where event_type = 'error'),
last as (select r.event_id, a.value, max(a.ts) as last_seen, r.ts from r join a on a.client = r.client and a.ts <= r.ts
  and not exists (select 1 from (select client, ts as t, lead(ts) over (partition by client order by ts) as nxt from a) g
    where g.client = r.client and g.t >= a.ts and g.t < r.ts and g.t + interval 1 hour <= least(coalesce(case when g.nxt <= r.ts then g.nxt end, r.ts), r.ts)) group by all),
k as (select *, row_number() over w as n, sum(strlen(value)) over (partition by event_id order by last_seen desc, value rows unbounded preceding) as b from last window w as (partition by event_id order by last_seen desc, value))
select event_id, count(*) as n_values, sum(strlen(value))::bigint as n_bytes, max(last_seen) as last_seen from k where n <= 4 and b <= 30 group by event_id
""")
def known_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each client's set holds when a request comes: the current life's values, the most recent that fit both bounds."""
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("client"), "ts", F.concat(F.lit("value"), "user_id").alias("value"), F.lit("SECRET").alias("kind"), "event_type")
    held = state.live_values_at(events.where("event_type != 'error'"), events.where("event_type = 'error'").select("event_id", "client", "ts"), ["client"], "event_id", most_values=4, most_bytes=30)
    return held.groupBy("event_id").agg(F.count("*").alias("n_values"), F.sum(F.octet_length("value")).cast("long").alias("n_bytes"), F.max("last_seen").alias("last_seen"))


_LATE = "2 hours"


def _late(rows: DataFrame, key: str) -> DataFrame:
    """Rows that arrive up to almost two hours after their time, not in its order."""
    lag = F.make_interval(secs=F.pmod(F.xxhash64(key), F.lit(7000)))
    return rows.withColumn("arrived", F.col("ts") + lag)


@query("""
with a as (select user_id % 50 as client, ts, 'value' || user_id as value from events where event_type != 'error'),
r as (select event_id, user_id % 50 as client, ts from events where event_type = 'error'),
last as (select r.event_id, a.value, max(a.ts) as last_seen, r.ts from r join a on a.client = r.client and a.ts <= r.ts
  and not exists (select 1 from (select client, ts as t, lead(ts) over (partition by client order by ts) as nxt from a) g
    where g.client = r.client and g.t >= a.ts and g.t < r.ts and g.t + interval 1 hour <= least(coalesce(case when g.nxt <= r.ts then g.nxt end, r.ts), r.ts)) group by all),
k as (select *, row_number() over w as n, sum(strlen(value)) over (partition by event_id order by last_seen desc, value rows unbounded preceding) as b from last window w as (partition by event_id order by last_seen desc, value))
select event_id, n::int as rank, value from k where n <= 4 and b <= 30
""")
def known_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sets kept as state by a streaming query, whose rows come late and which is started several times."""
    events = table(spark, sf_dir, "events")
    add = F.col("event_type") != "error"
    rows = events.select("event_id", (F.col("user_id") % 50).cast("string").alias("client"), F.lit("/").alias("route"), "ts", F.when(add, F.concat(F.lit("value"), "user_id")).alias("value"), F.when(add, "SECRET").alias("kind"), F.when(~add, F.col("event_id")).alias("request"))
    out = streams.replay(_late(rows, "event_id").drop("event_id"), lambda s: streams.known_values(s, _LATE, most_values=4, most_bytes=30))
    return out.select(F.col("request").alias("event_id"), "rank", "value")


@query("""
with e as (select event_id, user_id % 20 as client, 'r' || (user_id % 40) as response_id, ts, event_type from events),
g as (select * from e where event_type = 'view'), p as (select * from e where event_type = 'purchase')
select g.event_id, max('vault' || p.event_id) filter (p.ts = (select max(q.ts) from p q where q.client = g.client and q.response_id = g.response_id and q.ts <= g.ts)) as vault
from g left join p on g.client = p.client and g.response_id = p.response_id and p.ts <= g.ts and g.ts < p.ts + interval 1 hour group by g.event_id
""")
def chains_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of response chains kept as state by a streaming query, whose rows come late and which is started several times."""
    events = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    put = F.col("event_type") == "purchase"
    rows = events.select("event_id", (F.col("user_id") % 20).cast("string").alias("client"), F.lit("/").alias("route"), F.concat(F.lit("r"), F.col("user_id") % 40).alias("response_id"), "ts", F.when(put, F.concat(F.lit("vault"), "event_id")).alias("vault"), F.when(~put, F.col("event_id")).alias("request"))
    out = streams.replay(_late(rows, "event_id").drop("event_id"), lambda s: streams.chain_vaults(s, _LATE))
    return out.select(F.col("request").alias("event_id"), "vault")


#: The spans of a node, one after another: each begins with the first failure that is not before the end of the last.
SPANS_SQL = """
f as (select distinct '10.0.0.' || (user_id % 5 + 1) as node, ts from events where event_type = 'error'),
spans as (select node, min(ts) as began from f group by node union all
  select s.node, (select min(f.ts) from f where f.node = s.node and f.ts >= s.began + interval {down}) from spans s where s.began is not null)
"""


def node_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where("event_type = 'error'")
    return failed.select(F.concat(F.lit("10.0.0."), F.col("user_id") % 5 + 1).alias("node"), "ts")


@query(f"with recursive {SPANS_SQL.format(down='40 minute')} select node, began, began + interval 40 minute as until from spans where began is not null")
def nodes_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When nodes are passed over, for forty minutes from a failure on."""
    return state.down_spans(node_failures(spark, sf_dir), down="INTERVAL 40 MINUTES")


@query(f"""
with recursive {SPANS_SQL.format(down='10 second')},
d as (select node, began, began + interval 10 second as until from spans where began is not null),
n as (select unnest({NODES}) as node),
r as (select event_id, 'c' || user_id as client, event_type as route, ts from events where event_type != 'error'),
up as (select r.*, n.node from r, n where not exists (select 1 from d where d.node = n.node and d.began <= r.ts and r.ts < d.until))
select event_id, arg_max(node, sha256(node || chr(0) || client || chr(0) || route)[1:16]) as owner from up group by event_id
""")
def owners_without_down_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who serves a request while nodes that have failed are passed over."""
    requests = table(spark, sf_dir, "events").where("event_type != 'error'").select("event_id", F.concat(F.lit("c"), "user_id").alias("client"), F.col("event_type").alias("route"), "ts")
    return state.owners_up(requests, NODES, state.down_spans(node_failures(spark, sf_dir))).select("event_id", "owner")


@query(f"with {LOG_SQL} select time_bucket(interval 1 hour, ts) as window_start, route, count(*) as n, round(count(*) / 3600, 9) as per_second from log where status = '503' group by 1, 2")
def failures_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server errors by hour and route."""
    return metrics.failure_rate(log(spark, sf_dir), "1 hour", ["route"]).withColumn("per_second", F.round("per_second", 9))


@query("""
select event_id, '{"client":"c' || user_id || '","route":"/' || event_type || '","method":"POST","path":"/v1/messages","status":' || case event_id % 3 when 0 then 200 when 1 then 404 else 503 end || ',"dur":' || event_id % 7
  || case when user_id % 4 > 0 then ',"redacted":{"EMAIL":' || user_id % 4 || case when user_id % 3 > 0 then ',"TOKEN":' || user_id % 3 else '' end || '}' when user_id % 3 > 0 then ',"redacted":{"TOKEN":' || user_id % 3 || '}' else '' end || '}' as line
from events
""")
def structured_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each request: who, where, how long, and how much of each kind, never what."""
    events = table(spark, sf_dir, "events")
    status = F.get(F.array(*map(F.lit, (0, 404, 503))), (F.col("event_id") % 3).cast("int"))
    rows = events.select("event_id", F.concat(F.lit("c"), "user_id").alias("client"), F.concat(F.lit("/"), "event_type").alias("route"), F.lit("POST").alias("method"), F.lit("/v1/messages").alias("path"), status.alias("status"), (F.col("event_id") % 7).alias("seconds"))
    pairs = F.array(F.struct(F.lit("EMAIL").alias("kind"), (F.col("user_id") % 4).alias("n")), F.struct(F.lit("TOKEN").alias("kind"), (F.col("user_id") % 3).alias("n")))
    counts = events.select("event_id", F.inline(pairs))
    return metrics.log_lines(rows, counts, "event_id")


@query("""
select c_custkey as k, (c_custkey % 2)::int as batch, (c_custkey % 2 + 1)::int as version, (case when c_custkey % 2 = 1 or n_nationkey % 5 = 0 then 1 else 0 end)::int as n_spans
from customer join nation on c_nationkey = n_nationkey
""")
def reloaded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in two parts through a stream of detection, whose terms file changes between them.

    The first file has the names of every fifth nation, the second those of all; a file in between
    that cannot be parsed changes nothing.
    """
    root = shared_path(spark)
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customers.select(F.col("c_custkey").alias("k"), F.concat("c_name", F.lit(" lives in "), F.lower("n_name"), F.lit(".")).alias("text"))

    def put(lines: DataFrame) -> None:
        """The terms file anew, in one part."""
        lines.agg(F.array_join(F.sort_array(F.collect_set("n_name")), "\n").alias("value")).coalesce(1).write.mode("overwrite").text(f"{root}/terms")

    put(nations.where("n_nationkey % 5 = 0"))
    held = files.Reloaded(spark, f"{root}/terms/part-*", lambda p: files.read_terms(spark, p))
    for part in (0, 1):
        rows.where(F.col("k") % 2 == part).write.parquet(f"{root}/in/{part}")
        source = spark.readStream.schema(rows.schema).parquet(f"{root}/in/*")
        found = lambda batch, content: detect.detect(batch, terms=content).select("k", F.size(F.filter("spans", lambda s: s["kind"] == "TERM")).alias("n_spans"))
        reload.with_versions(source, held, found, f"{root}/out", f"{root}/progress", once=True).awaitTermination()
        put(nations.withColumn("n_name", F.lit("x")))  # too short a term: the last good file stays
        held.get()
        put(nations)
    return spark.read.schema("k long, n_spans int, version int, batch int").parquet(f"{root}/out").select("k", "batch", "version", "n_spans")
