"""Interval overlap join: pairs of intervals of one client that share a slot, by Allen's relation.

Intervals are (client, first slot, last slot), an open end being a null last slot, which is
infinite.  Two intervals of a client with the same slots behave alike towards all others, so that
they are one row with sums: what is joined does not grow with the events of a client, only with
the slots of the calendar.  Each interval is replicated into the coarse buckets of slots that it
covers, an open end as far as the client's horizon, the last slot in which any interval of the
client starts.  Buckets are joined by client and bucket; a pair that meets in several buckets
is kept in the bucket of the later start alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Microseconds of a slot and of the gap that ends a session.
SLOT, GAP = 6 * 3600 * 1_000_000, 15 * 60 * 1_000_000
#: Slots of a bucket: a week.
BUCKET_SLOTS = 28
_BEFORE, _SAME, _AFTER = ("overlaps", "finished_by", "contains"), ("starts", "equals", "started_by"), ("during", "finishes", "overlapped_by")


def micros(df: DataFrame, column: str) -> Column:
    """Whole microseconds since 1970 of a timestamp; one without a zone is taken as UTC, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column).cast("timestamp"))


def slot(us: Column) -> Column:
    """Floor of a time to its slot, times before 1970 too."""
    return ((us - F.pmod(us, F.lit(SLOT))) / F.lit(SLOT)).cast("long")


def sessions(clicks: DataFrame) -> DataFrame:
    """(client_id, first, last, open) of ``clicks(client_id, ts, kind)``, times in microseconds.

    Clicks of a client within one aligned quarter of an hour are always of one session, so they
    are reduced to its first and last time before anything is ordered: a window holds a row for
    each quarter of an hour of the calendar at most, whatever a client clicks.  Of several
    clicks at a session's last time one error is enough for it to be open.  Clicks without a
    client or time are ignored; repeated ones change nothing.
    """
    each = clicks.select("client_id", micros(clicks, "ts").alias("us"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("error"))
    each = each.where("client_id is not null and us is not null")
    quarter = (F.col("us") - F.pmod("us", F.lit(GAP))).alias("quarter")
    held = each.groupBy("client_id", quarter).agg(F.min("us").alias("first"), F.max(F.struct("us", "error")).alias("end"))
    ordered = Window.partitionBy("client_id").orderBy("quarter")
    begins = F.coalesce(F.col("first") - F.lag("end.us").over(ordered) > GAP, F.lit(True))
    numbered = held.withColumn("begins", begins.cast("long")).withColumn("session", F.sum("begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    made = numbered.groupBy("client_id", "session").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return made.select("client_id", "first", F.col("end.us").alias("last"), F.col("end.error").alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, client_id, first, last, open) of sales: from the sale to the latest of it and its lines' shipping.

    Sales without a client or time are ignored, and so are lines without a sale or shipping
    time; a sale without an id has no lines.
    """
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("us")).where("sale_id is not null and us is not null").groupBy("sale_id").agg(F.max("us").alias("shipped"))
    sold = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open"))
    both = sold.where("client_id is not null and first is not null").join(shipped, "sale_id", "left")
    return both.select("sale_id", "client_id", "first", F.greatest("first", "shipped").alias("last"), "open")


def slotted(intervals: DataFrame) -> DataFrame:
    """With ``a`` and ``b``, the first and last slot; b is null where the end is open."""
    return intervals.withColumns({"a": slot(F.col("first")), "b": F.when(~F.col("open"), slot(F.col("last")))})


def replicated(kinds: DataFrame, horizon: DataFrame, width: int = BUCKET_SLOTS) -> DataFrame:
    """A row for each bucket that an interval covers; open ends reach to the client's horizon."""
    clipped = kinds.join(horizon, "client_id").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.coalesce("b", "horizon") / width))))
    return clipped.drop("horizon")


def relation(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of [a, b] to [c, d]; null ends are infinite, hence equal."""
    far = F.lit(2**62)
    end, other = F.coalesce(b, far), F.coalesce(d, far)

    def by_end(names: tuple[str, str, str]) -> Column:
        return F.when(end < other, names[0]).when(end == other, names[1]).otherwise(names[2])

    return F.when(a < c, by_end(_BEFORE)).when(a == c, by_end(_SAME)).otherwise(by_end(_AFTER))


def overlap_join(left: DataFrame, right: DataFrame, width: int = BUCKET_SLOTS) -> DataFrame:
    """Pairs of ``left(client_id, a, b)`` and ``right(client_id, a, b, n, total)`` that share a slot, summed by left interval and relation.

    Gives (client_id, a, b, relation, n_pairs, overlap_slots, total) for each distinct interval of
    left: n is how many things a row of right stands for, total a sum over them.  overlap_slots
    is null where both ends are open.  Both sides should hold each interval once.
    """
    starts = left.select("client_id", "a").union(right.select("client_id", "a"))
    horizon = materialise(starts.groupBy("client_id").agg(F.max("a").alias("horizon")))
    x, y = replicated(left.select("client_id", "a", "b"), horizon, width).alias("x"), replicated(right, horizon, width).alias("y")
    later = F.greatest("x.a", "y.a")
    shares = (F.coalesce(F.col("x.b") >= F.col("y.a"), F.lit(True))) & (F.coalesce(F.col("y.b") >= F.col("x.a"), F.lit(True)))
    meet = (F.col("x.client_id") == F.col("y.client_id")) & (F.col("x.bucket") == F.col("y.bucket")) & shares & (F.floor(later / width) == F.col("x.bucket"))
    shared = F.least("x.b", "y.b") - later + 1  # null ends are passed over; null where both are open
    pairs = x.join(y, meet).select("x.client_id", "x.a", "x.b", relation(F.col("x.a"), F.col("x.b"), F.col("y.a"), F.col("y.b")).alias("relation"), "y.n", (shared * F.col("y.n")).alias("slots"), "y.total")
    return pairs.groupBy("client_id", "a", "b", "relation").agg(F.sum("n").alias("n_pairs"), F.sum("slots").alias("overlap_slots"), F.sum("total").alias("total"))


def sales_with_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """Per sale and relation the sessions of its client that share a slot: (sale_id, relation, n_pairs, overlap_slots, sessions_crc).

    Each row of sales counts for itself; rows of one sale_id are summed, those without an id
    too.  Empty tables give no rows; further columns are ignored, whatever their names.
    """
    sold = materialise(slotted(sale_intervals(sales, lines)).select("sale_id", "client_id", "a", "b"))
    seen = slotted(sessions(clicks)).select("client_id", "a", "b", F.crc32(F.col("first").cast("string").cast("binary")).alias("crc"))
    left = materialise(sold.select("client_id", "a", "b").distinct())
    right = materialise(seen.groupBy("client_id", "a", "b").agg(F.count("*").alias("n"), F.sum("crc").alias("total")))
    found = materialise(overlap_join(left, right))
    same = (F.col("s.client_id") == F.col("f.client_id")) & (F.col("s.a") == F.col("f.a")) & F.col("s.b").eqNullSafe(F.col("f.b"))
    joined = sold.alias("s").join(found.alias("f"), same).select("s.sale_id", "f.relation", "f.n_pairs", "f.overlap_slots", "f.total")
    return joined.groupBy("sale_id", "relation").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("overlap_slots").alias("overlap_slots"), F.sum("total").alias("sessions_crc"))


def join_tables(spark, sf_dir: str) -> DataFrame:
    return sales_with_sessions(*[table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clicks")])


def oracle() -> str:
    """The same in DuckDB, pair by pair; CRC-32 is worked out byte by byte with a table of its 256 remainders."""
    step = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    steps = ", ".join(f"t{i + 1} AS (SELECT i, {step.format(c='x')} AS x FROM t{i})" for i in range(8))
    return f"""
WITH t0 AS (SELECT range AS i, range AS x FROM range(256)), {steps},
crcs AS (SELECT list(x ORDER BY i) AS tbl FROM t8),
c AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'error', false) AS error FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, sum(begins) OVER (PARTITION BY client_id ORDER BY us, error ROWS UNBOUNDED PRECEDING) AS session FROM
  (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us, error) <= {GAP} THEN 0 ELSE 1 END AS begins FROM c)),
e AS (SELECT client_id, min(us) AS first, max(us) AS last, arg_max(error, (us, error)) AS open FROM n GROUP BY client_id, session),
y AS (SELECT client_id, first // {SLOT} AS c, CASE WHEN NOT open THEN last // {SLOT} END AS d, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(first::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda acc, ch: xor(tbl[(xor(acc, ch) & 255) + 1], acc >> 8)), 4294967295) AS crc FROM e, crcs),
l AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped FROM sale_lines GROUP BY sale_id),
x AS (SELECT sale_id, client_id, epoch_us(sold_at) // {SLOT} AS a, CASE WHEN coalesce(status = 'open', false) THEN NULL ELSE greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))) // {SLOT} END AS b
  FROM sales LEFT JOIN l USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT sale_id, a, coalesce(b, 1000000000000) AS b, c, coalesce(d, 1000000000000) AS d, crc FROM x JOIN y USING (client_id))
SELECT sale_id, CASE WHEN a < c THEN CASE WHEN b < d THEN 'overlaps' WHEN b = d THEN 'finished_by' ELSE 'contains' END
  WHEN a = c THEN CASE WHEN b < d THEN 'starts' WHEN b = d THEN 'equals' ELSE 'started_by' END
  ELSE CASE WHEN b < d THEN 'during' WHEN b = d THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
  count(*) AS n_pairs, sum(CASE WHEN least(b, d) < 1000000000000 THEN least(b, d) - greatest(a, c) + 1 END)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc
FROM p WHERE a <= d AND c <= b GROUP BY ALL
"""
