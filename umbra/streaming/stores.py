"""What is kept between requests, as keyed state in Structured Streaming.

The batch forms are ``operators.state.live_values_at`` and ``chain_hits``.  Both stores need the
RocksDB state store.  Rows may come in order of time, and are then handled as they come; or, with
``delay``, late by that much: each key's rows wait in its state until the watermark has passed
them, a timer of event time handles them in order, and another one drops what has expired.
``replay`` runs a table through such a query.
"""

from __future__ import annotations

import datetime as dt
import json
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import MOST_BYTES, MOST_VALUES
from ..sources.tables import shared_path

IDLE = dt.timedelta(hours=1)
#: Rows of a key that wait as one value of its state.
PACK = 2000
_MICRO = dt.timedelta(microseconds=1)


class InOrder(StatefulProcessor):
    """Handles each key's rows in order of ``us``, microseconds; of one time those without a request come first.

    ``waiting`` names the columns that are kept of a row that waits; ``step`` handles a row and
    gives output rows, ``expires`` tells when what is held has expired.
    """

    waiting: str
    columns: list[str]

    def __init__(self, late: bool):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = [f.split()[0] for f in self.waiting.split(", ")]
        if self.late:
            # Rows wait in packs in order of time: state is read and written a pack, not a row, at a time.
            self.rows = handle.getListState("rows", "first long, last long, packed string")
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))[self.fields]
        # Whole numbers with nulls among them come as floating point ones.
        whole = {c for c in self.fields if self.waiting.startswith(f"{c} long") or f", {c} long" in self.waiting}
        columns = [[None if gone else int(v) if c in whole else v for v, gone in zip(arrived[c].tolist(), arrived[c].isna().tolist())] for c in self.fields]
        came = list(zip(*columns))
        if not self.late:
            yield from self.handled(came)
            return
        packs = self._packs(came)
        self.rows.appendList(packs)
        self.handle.registerTimer(self._due(packs[0][0]))
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(p) for p in self.rows.get()] if self.rows.exists() else []
        at, opened = self.fields.index("us"), [r for first, _, packed in held if first <= passed for r in json.loads(packed)]
        due = [r for r in opened if r[at] <= passed]
        if due:
            yield from self.handled(due)
            rest = [p for p in held if p[0] > passed] + self._packs([r for r in opened if r[at] > passed])
            if rest:
                self.rows.put(rest)
                self.handle.registerTimer(self._due(min(p[0] for p in rest)))
            else:
                self.rows.clear()
        end = self.expires()
        if end is not None and end <= passed:
            self.drop()
        elif end is not None:
            self.handle.registerTimer(self._due(end))

    def _packs(self, rows: list[tuple]) -> list[tuple[int, int, str]]:
        """Rows in order of time, ``PACK`` of them together: the times of the first and the last, and all of them."""
        at = self.fields.index("us")
        rows = sorted(rows, key=lambda r: r[at])
        parts = [rows[k : k + PACK] for k in range(0, len(rows), PACK)]
        return [(p[0][at], p[-1][at], json.dumps(p)) for p in parts]

    @staticmethod
    def _due(us: int) -> int:
        """The first whole millisecond that is not before a time."""
        return -(-us // 1000)

    def handled(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        at, asked = self.fields.index("us"), self.fields.index("request")
        self.load()
        out: list[tuple] = []
        for r in sorted(rows, key=lambda r: (r[at], r[asked] is not None, r[asked] or 0)):
            out += self.step(dict(zip(self.fields, r)))
        self.save()
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class KnownStore(InOrder):
    """A set of remembered values for each client and route, the least recent first; it is bounded, so that it is one state value."""

    waiting = "us long, value string, kind string, request long"
    columns = ["request", "value", "kind", "rank"]

    def __init__(self, late: bool = False, idle: dt.timedelta = IDLE, most_values: int = MOST_VALUES, most_bytes: int = MOST_BYTES):
        super().__init__(late)
        self.idle, self.most_values, self.most_bytes = idle // _MICRO, most_values, most_bytes

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "last_add long, items array<string>, kinds array<string>")

    def load(self) -> None:
        self.last, items, kinds = self.held.get() if self.held.exists() else (None, [], [])
        self.known = OrderedDict(zip(items, kinds))
        self.size = sum(len(v.encode()) for v in self.known)

    def save(self) -> None:
        if self.last is None:
            self.held.clear()
        else:
            self.held.update((self.last, list(self.known), list(self.known.values())))

    def expires(self) -> int | None:
        return self.held.get()[0] + self.idle if self.held.exists() else None

    def drop(self) -> None:
        self.held.clear()

    def step(self, row: dict) -> list[tuple]:
        if self.last is not None and row["us"] >= self.last + self.idle:
            self.last, self.size = None, 0
            self.known.clear()
        if row["request"] is not None:
            return [(row["request"], v, k, rank) for rank, (v, k) in enumerate(reversed(self.known.items()), 1)]
        self.last, value = row["us"], row["value"]
        if len(value.encode()) <= self.most_bytes:
            self.size += 0 if value in self.known else len(value.encode())
            self.known[value] = row["kind"]
            self.known.move_to_end(value)
            while len(self.known) > self.most_values or self.size > self.most_bytes:
                self.size -= len(self.known.popitem(last=False)[0].encode())
        return []


class ChainStore(InOrder):
    """The latest entry for each client, route and response id, for as long as it is valid."""

    waiting = "us long, vault string, request long"
    columns = ["request", "vault", "hit"]

    def __init__(self, late: bool = False, valid: dt.timedelta = IDLE):
        super().__init__(late)
        self.valid = valid // _MICRO

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "put_us long, vault string")

    def load(self) -> None:
        self.put_us, self.vault = self.entry.get() if self.entry.exists() else (None, None)

    def save(self) -> None:
        if self.put_us is not None:
            self.entry.update((self.put_us, self.vault))

    def expires(self) -> int | None:
        return self.entry.get()[0] + self.valid if self.entry.exists() else None

    def drop(self) -> None:
        self.entry.clear()

    def step(self, row: dict) -> list[tuple]:
        if row["request"] is None:
            self.put_us, self.vault = row["us"], row["vault"]
            return []
        hit = self.put_us is not None and row["us"] < self.put_us + self.valid
        return [(row["request"], self.vault if hit else None, hit)]


def _kept(rows: DataFrame, by: list[str], store: Callable[..., InOrder], schema: str, delay: str | None, bounds: dict) -> DataFrame:
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = rows.withWatermark("ts", delay) if delay else rows
    keyed = timed.withColumn("us", F.unix_micros("ts")).groupBy(*by)
    return keyed.transformWithStateInPandas(store(late=bool(delay), **bounds), schema, outputMode="Append", timeMode="EventTime" if delay else "None")


def known_values(rows: DataFrame, delay: str | None = None, **bounds) -> DataFrame:
    """A streaming ``rows(client, route, ts, value, kind, request)``, additions (request null) and requests: (request, value, kind, rank)."""
    return _kept(rows, ["client", "route"], KnownStore, "request long, value string, kind string, rank int", delay, bounds)


def chain_vaults(rows: DataFrame, delay: str | None = None, **bounds) -> DataFrame:
    """A streaming ``rows(client, route, response_id, ts, vault, request)``, puts (request null) and gets: (request, vault, hit)."""
    return _kept(rows, ["client", "route", "response_id"], ChainStore, "request long, vault string, hit boolean", delay, bounds)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(rows: DataFrame, run: Callable[[DataFrame], DataFrame], arrived: str = "arrived", batches: int = 3) -> DataFrame:
    """What the streaming query ``run`` puts out for ``rows`` that come in order of ``arrived``, in so many parts.

    After each part the query is started anew on its checkpoint and goes on from there.  A row
    far in the future, with nulls beside its ``ts``, comes last, so that the watermark passes all
    others.  Rows, progress and output lie in the shared folder.
    """
    spark, root = rows.sparkSession, shared_path(rows.sparkSession)
    columns = [c for c in rows.columns if c != arrived]
    time = F.col(arrived).cast("timestamp").cast("double")
    bounds = sorted(set(rows.agg(F.percentile_approx(time, [k / batches for k in range(1, batches)])).first()[0] or []))
    place = sum(((time > b).cast("int") for b in bounds), F.lit(0))
    end = spark.range(1).select(*[F.expr("timestamp'2200-01-01 00:00:00'").cast(t).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.select(*columns).dtypes])
    parts = [rows.where(place == k).select(*columns) for k in range(len(bounds) + 1)] + [end]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        for k, part in enumerate(parts):
            part.write.parquet(f"{root}/in/{k:03}")
            out = run(spark.readStream.schema(part.schema).parquet(f"{root}/in/*"))
            started = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start()
            started.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{root}/out")
