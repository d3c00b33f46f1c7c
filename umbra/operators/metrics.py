"""Request and redaction metrics as aggregates over the request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import escape_label, shortest

# Methods with series of their own, and the histogram's bounds in seconds.
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "CONNECT", "TRACE")
BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def labelled(log: DataFrame) -> DataFrame:
    """``log(route, method, status, forwarded)`` with the labels of its series in place."""
    status = F.when(F.coalesce("status", F.lit(0)) == 0, 200).otherwise(F.col("status"))
    return (
        log.withColumn("route", F.when(F.col("route") == "-", "unmatched").otherwise(F.col("route")))
        .withColumn("method", F.when(F.col("method").isin(*METHODS), F.col("method")).otherwise("OTHER"))
        .withColumn("status", F.when(status.between(100, 599), status.cast("string")).otherwise("OTHER"))
        .withColumn("handling", F.when(F.col("forwarded"), "forwarded").otherwise("local"))
    )


def requests_total(log: DataFrame) -> DataFrame:
    return labelled(log).groupBy("route", "method", "status", "handling").agg(F.count("*").alias("n"))


def redactions_total(redactions: DataFrame, by: Sequence[str] = ("route", "kind")) -> DataFrame:
    return redactions.groupBy(*by).agg(F.sum("n").alias("n")).where("n > 0")


def exact_sum(seconds: Column) -> Column:
    """A sum in whole nanoseconds, which is the same in whatever order tasks add."""
    return F.sum(seconds.cast("decimal(28,9)")).cast("double")


def duration_histogram(log: DataFrame, by: Sequence[str] = ("route", "handling"), seconds: str = "seconds") -> DataFrame:
    """Cumulative buckets in one aggregate: (by, le, count), ``le`` as text up to +Inf, with the sum and count of all."""
    wide = labelled(log).groupBy(*by).agg(*[F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)], F.count("*").alias("total"), exact_sum(F.col(seconds)).alias("sum"))
    rows = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("count")) for i, b in enumerate(BOUNDS)], F.struct(F.lit("+Inf").alias("le"), F.lit(float("inf")).alias("bound"), F.col("total").alias("count")))
    return wide.select(*by, "sum", "total", F.inline(rows))


def quantile(histogram: DataFrame, by: Sequence[str], q: float = 0.95) -> DataFrame:
    """(by, quantile): linear within the bucket that holds the rank; the greatest finite bound above it."""
    summed = histogram.groupBy(*by, "bound").agg(F.sum("count").alias("count"))
    order = Window.partitionBy(*by).orderBy("bound")
    rows = summed.withColumn("low", F.coalesce(F.lag("bound").over(order), F.lit(0.0))).withColumn("under", F.coalesce(F.lag("count").over(order), F.lit(0)))
    rows = rows.withColumn("rank", q * F.max("count").over(Window.partitionBy(*by)))
    hit = rows.where((F.col("count") >= F.col("rank")) & (F.col("rank") > 0)).groupBy(*by).agg(F.min_by(F.struct("low", "bound", "under", "count", "rank"), "bound").alias("h"))
    inside = F.col("h.low") + (F.col("h.bound") - F.col("h.low")) * (F.col("h.rank") - F.col("h.under")) / (F.col("h.count") - F.col("h.under"))
    return hit.select(*by, F.when(F.col("h.bound") == float("inf"), F.col("h.low")).otherwise(inside).alias("quantile"))


def in_flight(log: DataFrame, by: Sequence[str] = (), start: str = "ts", seconds: str = "seconds") -> DataFrame:
    """(by, t, in_flight) after each beginning and end; at one time ends come first.

    Without ``by`` one series counts everything: times are cut into hours that run in parallel,
    and only the hours' sums are added up in order.
    """
    end = F.col(start) + F.make_dt_interval(secs=F.round(seconds, 6).cast("decimal(18,6)"))
    steps = log.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*by, "x.t", "x.d")
    steps = steps.groupBy(*by, "t").agg(F.sum("d").alias("d")).withColumn("hour", F.date_trunc("hour", "t"))
    hours = steps.groupBy(*by, "hour").agg(F.sum("d").alias("net"))
    before = F.coalesce(F.sum("net").over(Window.partitionBy(*by).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select(*by, "hour", before.alias("before"))
    running = F.sum("d").over(Window.partitionBy(*by, "hour").orderBy("t"))
    return steps.withColumn("running", running).join(hours, [*by, "hour"]).select(*by, "t", (F.col("running") + F.col("before")).alias("in_flight"))


def rate(log: DataFrame, width: str, by: Sequence[str] = (), ts: str = "ts", value: Column | None = None) -> DataFrame:
    """(window_start, by, n, per_second) in tumbling windows."""
    n = F.count("*") if value is None else F.sum(value)
    rows = log.groupBy(F.window(ts, width).alias("w"), *by).agg(n.alias("n"))
    long = F.unix_seconds(F.col("w.end").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))
    return rows.select(F.col("w.start").alias("window_start"), *by, "n", (F.col("n") / long).alias("per_second"))


def failure_rate(log: DataFrame, width: str, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """As ``rate``, of the requests that were answered with a server error."""
    return rate(labelled(log).where(F.col("status").rlike("^5..$")), width, by, ts)


def log_lines(log: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, line): a JSON line for each request, with its redactions by kind in order, and no value of any text.

    ``log(key, client, route, method, path, status, seconds)``, ``counts(key, kind, n)``; a
    request without redactions says nothing of them.
    """
    redacted = counts.where("n > 0").groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("redacted"))
    line = F.to_json(F.struct("client", "route", "method", "path", F.when(F.coalesce("status", F.lit(0)) == 0, 200).otherwise(F.col("status")).alias("status"), F.col("seconds").alias("dur"), "redacted"))
    return log.join(redacted, key, "left").select(key, line.alias("line"))


def by_kind_and_route(redactions: DataFrame) -> DataFrame:
    """Redactions in all, by kind, and by kind and route, in one pass: (level, kind, route, n)."""
    kind, route = F.col("kind"), F.col("route")
    return redactions.groupingSets([[], [kind], [kind, route]], kind, route).agg(F.grouping_id(kind, route).alias("level"), F.sum("n").alias("n")).select("level", "kind", "route", "n")


# What the families of the text format are, in the order in which they are told.
FAMILIES = (
    ("http_requests_in_flight", "gauge", "Requests that are being handled."),
    ("http_requests_total", "counter", "Requests that have been handled, rejected and failed ones too."),
    ("http_request_duration_seconds", "histogram", "Time from a request to the end of its response."),
    ("redactions_total", "counter", "Values replaced in requests."),
)


def exposition(requests: DataFrame, histogram: DataFrame, redactions: DataFrame, flying: DataFrame, prefix: str = "umbra") -> DataFrame:
    """(family, key, place, line): everything as lines of the text format, in the order of the first three columns.

    ``flying(n)`` is the number of requests in flight, a row.  Each family begins with two lines
    that say what it is; a histogram's series are its buckets, then its sum and its count.  A row
    for each series and bound is all that meets.
    """
    label = lambda name: F.concat(F.lit(f'{name}="'), escape_label(F.col(name)), F.lit('"'))
    own = lambda k, end="": f"{prefix}_{FAMILIES[k][0]}{end}"
    series = lambda name, labels, value: F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *labels), F.lit("} "), value.cast("string"))
    rows = lambda df, k, key, place, line: df.select(F.lit(k).alias("family"), F.concat_ws("\0", *key).alias("key"), (place if isinstance(place, Column) else F.lit(place)).cast("int").alias("place"), line.alias("line"))
    named = ("route", "method", "status", "handling")
    at = [label("route"), label("handling")]
    spark = requests.sparkSession
    heads = [(k, None, i, text) for k, (name, kind, says) in enumerate(FAMILIES) for i, text in enumerate((f"# HELP {prefix}_{name} {says}", f"# TYPE {prefix}_{name} {kind}"))]
    out = spark.createDataFrame(heads, "family int, key string, place int, line string")
    out = out.union(rows(flying, 0, [F.lit("")], 0, F.concat(F.lit(own(0) + " "), F.col("n").cast("string"))))
    out = out.union(rows(requests, 1, named, 0, series(own(1), [label(k) for k in named], F.col("n"))))
    buckets = histogram.withColumn("__place", F.array_position(F.array(*[F.lit(f"{b:g}") for b in BOUNDS], F.lit("+Inf")), F.col("le")))
    out = out.union(rows(buckets, 2, ["route", "handling"], F.col("__place"), series(own(2, "_bucket"), [*at, label("le")], F.col("count"))))
    ends = histogram.where("le = '+Inf'")
    out = out.union(rows(ends, 2, ["route", "handling"], len(BOUNDS) + 2, series(own(2, "_sum"), at, shortest(F.col("sum")))))
    out = out.union(rows(ends, 2, ["route", "handling"], len(BOUNDS) + 3, series(own(2, "_count"), at, F.col("total"))))
    out = out.union(rows(redactions, 3, ["route", "kind"], 0, series(own(3), [label("route"), label("kind")], F.col("n"))))
    return out.orderBy(F.asc_nulls_first("family"), F.asc_nulls_first("key"), "place")


def snapshot(log: DataFrame, at: Column, ts: str = "ts", seconds: str = "seconds", prefix: str = "umbra") -> DataFrame:
    """The exposition as of a time: what has ended by then is counted, what has begun and not ended is in flight.

    ``log(route, method, status, forwarded, ts, seconds, kind, n)``: requests with one kind of
    redactions each; these count when a request begins, as they are made on the way in.
    """
    end = F.col(ts) + F.make_dt_interval(secs=F.round(seconds, 6).cast("decimal(18,6)"))
    begun = log.where(F.col(ts) <= at)
    done = begun.where(end <= at)
    flying = begun.agg(F.count_if(end > at).alias("n"))
    return exposition(requests_total(done), duration_histogram(done, seconds=seconds), redactions_total(labelled(begun)), flying, prefix)
