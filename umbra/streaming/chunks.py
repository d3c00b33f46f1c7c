"""Restoring placeholders in text that arrives in chunks.

A placeholder may be cut anywhere, so that the end of what has arrived is held back as long as it
could still become one.  The state of a stream is that short text.  In batch the chunks of a
stream are folded in order; in Structured Streaming the state is kept by key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.walk import restore_text
from ..sources.tables import extended, written

PREFIX = "[REDACTED_"
#: Longer texts are no placeholder in the making.
LONGEST = 64
#: Chunks of a stream that are folded together.
SEGMENT = 1 << 16
#: Segments of long streams whose ends, and vaults, may be broadcast.
BROADCAST_SEGMENTS = 2000
_STARTED = re.compile(re.escape(PREFIX) + r"(?:[A-Z][A-Z0-9_]*)?\Z")


def cut(text: str) -> int:
    """Where the end that must wait begins; the length of ``text`` if nothing must."""
    at = text.rfind("[")
    if at < 0 or len(text) - at > LONGEST:
        return len(text)
    end = text[at:]
    return at if PREFIX.startswith(end) or _STARTED.match(end) else len(text)


def feed(pending: str, chunk: str, values: dict[str, str], escaped: bool = False) -> tuple[str, str]:
    """What can be put out now, restored, and what waits."""
    text = pending + chunk
    at = cut(text)
    return restore_text(text[:at], values, escaped), text[at:]


def flush(pending: str, values: dict[str, str], escaped: bool = False) -> str:
    return restore_text(pending, values, escaped)


#: Characters of a pack, about.
PACK_CHARS = 1 << 20


def packed(chunks: DataFrame, stream: str = "stream", seq: str = "seq", text: str = "text", values: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """``chunks`` with those that follow one another in a stream, and in the table, as one row: (stream, __first, __text, __lengths, values).

    A pack has the number of its first chunk, the texts end to end (null: empty) and their lengths, and the vault that came
    with its chunks, so that a chunk is shuffled as little more than its text.  It lies in one segment.
    """
    held = chunks.select(stream, F.col(seq).cast("long").alias("__first"), F.coalesce(text, F.lit("")).alias("__text"), *([values] if values else []))
    schema = extended(held.schema, "__lengths array<int>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            streams, numbers, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.large_string())
            lengths = pc.utf8_length(texts).cast(pa.int32()).to_numpy(zero_copy_only=False)
            at, known = numbers.fill_null(0).to_numpy(zero_copy_only=False), numbers.is_valid().to_numpy(zero_copy_only=False)
            begins = np.ones(n, bool)
            begins[1:] = ~pc.equal(streams[1:], streams[:-1]).fill_null(False).to_numpy(zero_copy_only=False) | ~known[1:] | ~known[:-1] | (at[1:] != at[:-1] + 1) | (at[1:] % segment == 0)
            if values:
                there = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
                begins[1:] |= there[1:] & ~there[:-1]
            ends = np.cumsum(lengths, dtype=np.int64)
            begins[1:] |= ends[1:] // PACK_CHARS != ends[:-1] // PACK_CHARS
            starts = np.flatnonzero(begins)
            # The texts of a batch lie end to end already.
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
            joined = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(offsets[starts], offsets[n]).tobytes()), texts.buffers()[2] or pa.py_buffer(b"")).cast(pa.string())
            sizes = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pa.array(lengths, pa.int32()))
            columns = [streams.take(pa.array(starts)), numbers.take(pa.array(starts)), joined]
            if values:
                columns.append(batch.column(3).take(pa.array(starts)))
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(columns, arrow)], sizes.cast(arrow.field("__lengths").type)], schema=arrow)

    return held.mapInArrow(run, schema)


def gathered(chunks: DataFrame, stream: str = "stream", seq: str = "seq", text: str = "text") -> DataFrame:
    """(stream, text): all chunks of a stream in order as one text."""
    packs = F.sort_array(F.collect_list(F.struct("__first", "__text")))
    return packed(chunks, stream, seq, text).groupBy(stream).agg(F.array_join(packs["__text"], "").alias("text"))


def restore_batch(chunks: DataFrame, stream: str = "stream", seq: str = "seq", text: str = "text", values: str = "values", segment: int = SEGMENT) -> DataFrame:
    """(stream, seq, out) for ``chunks`` that carry their vault as a map; what is left at the end goes with the last chunk.

    A stream is cut into segments by ``seq``, whole numbers of which none comes twice, so that a
    long one is many rows.  What waits when a segment begins is the end of all text before it, of
    which no more than 64 characters can matter: the segments' ends alone are put together in
    order, then each segment is folded by itself.  Rows without a number come first, in a segment
    of their own.  Chunks are shuffled in packs (``packed``).
    """

    def fold(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for parts, vaults, befores, lasts in batches:
            done = []
            for packs, held, before, last in zip(parts, vaults.to_pylist(), befores.to_pylist(), lasts.to_pylist()):
                known, pending, out = dict(held or ()), before[cut(before) :], []
                for pack in packs:
                    whole, at = pack["__text"].as_py(), 0
                    for n in pack["__lengths"].values.to_pylist():
                        piece = whole[at : at + n]
                        at += n
                        if pending or "[" in piece:
                            piece, pending = feed(pending, piece, known)
                        out.append(piece)
                if last:
                    out[-1] += flush(pending, known)
                done.append(out)
            yield pa.array(done, pa.list_(pa.string()))

    rows = packed(chunks, stream, seq, text, values, segment)
    ordered = F.sort_array(F.collect_list(F.struct("__first", "__text", "__lengths")))
    if chunks.where((F.col(seq) >= segment) | (F.col(seq) < 0)).limit(1).count():
        joined = _carried(rows, stream, F.floor(F.col("__first") / segment), ordered, values)
    else:  # no stream has a second segment
        whole = rows.groupBy(stream).agg(ordered.alias("__parts"), F.any_value(values, True).alias("__vault"))
        joined = whole.withColumns({"__before": F.lit(""), "__last": F.lit(True)})
    folded = joined.withColumn("__out", F.arrow_udf(fold, "array<string>")(F.col("__parts"), F.col("__vault"), F.col("__before"), F.col("__last")))
    numbers = F.flatten(F.transform("__parts", lambda p: F.transform(p["__lengths"], lambda _, i: p["__first"] + i)))
    kind = chunks.schema[seq].dataType
    return folded.select(stream, F.inline(F.arrays_zip(numbers.alias("seq"), F.col("__out").alias("out")))).toDF(stream, seq, "out").withColumn(seq, F.col(seq).cast(kind))


def _carried(packs: DataFrame, stream: str, place, ordered, values: str) -> DataFrame:
    """A row for each segment, with the text before it that can matter, its stream's vault, and whether it is the last."""
    rows = written(packs.groupBy(stream, place.alias("__segment")).agg(ordered.alias("__parts"), F.any_value(values, True).alias("__values")))
    ends = rows.select(stream, "__segment", F.right(F.array_join(F.col("__parts")["__text"], ""), F.lit(LONGEST)).alias("__end"), "__values")
    # A stream's segments in order; of those with text the last 64 have all that can wait.
    texted = Window.partitionBy(stream, F.col("__end") != "").orderBy("__segment").rowsBetween(1 - LONGEST, 0)
    ends = ends.withColumn("__ends", F.when(F.col("__end") != "", F.right(F.array_join(F.collect_list("__end").over(texted), ""), F.lit(LONGEST))))
    along, every = Window.partitionBy(stream).orderBy("__segment"), Window.partitionBy(stream)
    before = F.coalesce(F.last("__ends", True).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")).alias("__earlier")
    vault = F.first("__values", True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__held")
    last = (F.row_number().over(along) == F.count("*").over(every)).alias("__ends_here")
    # Only streams of several segments have something to carry.
    carried = ends.select(F.col(stream).alias("__stream"), F.col("__segment").alias("__at"), before, vault, last, F.count("*").over(every).alias("__n")).where("__n > 1")
    carried = written(carried.drop("__n"))
    few = carried.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS
    joined = rows.join(F.broadcast(carried) if few else carried, F.col(stream).eqNullSafe(F.col("__stream")) & F.col("__segment").eqNullSafe(F.col("__at")), "left")
    return joined.select(stream, "__parts", F.coalesce("__held", "__values").alias("__vault"), F.coalesce("__earlier", F.lit("")).alias("__before"), F.coalesce("__ends_here", F.lit(True)).alias("__last"))


class Restorer(StatefulProcessor):
    """Keyed state of a stream: the text that waits.  Rows: stream, seq, text, last, values (pairs)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("seq", kind="stable")
        pending = self.pending.get()[0] if self.pending.exists() else ""
        out = []
        for row in arrived.itertuples():
            values = json.loads(row.values_json or "{}")
            done, pending = feed(pending, row.text or "", values)
            if row.last:
                done, pending = done + flush(pending, values), ""
            out.append((key[0], row.seq, done))
        if pending:
            self.pending.update((pending,))
        elif self.pending.exists():
            self.pending.clear()
        yield pd.DataFrame(out, columns=["stream", "seq", "out"])

    def close(self) -> None:
        pass


def restore_stream(chunks: DataFrame) -> DataFrame:
    """A streaming ``chunks(stream string, seq long, text string, last boolean, values_json string)`` restored: (stream, seq, out).

    Needs the RocksDB state store.  State is dropped when a stream's last chunk has come.
    """
    return chunks.groupBy("stream").transformWithStateInPandas(Restorer(), "stream string, seq long, out string", outputMode="Append", timeMode="None")
