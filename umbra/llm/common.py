"""Helpers shared by the corpus operators: tables, the shared folder, Arrow passes."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python pass holds at once beside the Arrow batch itself.
CHUNK_CHARS = 1 << 20
#: Rows in an Arrow batch: texts are long, so far fewer than Spark's own 10,000.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, which driver and executors share.

    Only where that is unset (a local session, tests) a temporary folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="umbra-")
    return f"{root.rstrip('/')}/umbra-{uuid.uuid4().hex}"


def materialise(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_pass(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` over columns as Python lists.

    ``rows`` gets an iterator of ``{column: values}`` in chunks of about ``CHUNK_CHARS``
    characters of the column ``text`` and yields chunks of output columns.
    """
    small_batches(df.sparkSession)
    out_schema = _arrow_schema(schema)
    owner = f"{rows.__module__}.{rows.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker(owner)
        for out in rows(_chunks(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        columns = batch.to_pydict()
        texts = columns.get("text")
        if texts is None:
            yield columns
            continue
        start = held = 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held >= CHUNK_CHARS or i + 1 == len(texts):
                yield {k: v[start : i + 1] for k, v in columns.items()}
                start, held = i + 1, 0


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    # Parsed on the driver; what the executors get is the Arrow schema.
    return to_arrow_schema(StructType.fromDDL(ddl))


def _worker() -> dict:
    return sys.modules.setdefault("umbra_worker_cache", types.ModuleType("umbra_worker_cache")).__dict__


def own_worker(owner: str) -> None:
    """A Python worker serves one pass after another: what another pass has cached goes, and its memory with it."""
    state = _worker()
    if state.get("owner") != owner:
        held = state.pop("caches", None)
        state["owner"] = owner
        if held:
            held.clear()
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass


def worker_cache(name: str) -> dict:
    """A dictionary that later tasks of the same pass find again in the same Python worker."""
    return _worker().setdefault("caches", {}).setdefault(name, {})


#: A table up to this many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 20_000


def join_small(rows: DataFrame, table: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small: broadcast after its size has been checked, shuffled otherwise."""
    small = table.limit(most + 1).count() <= most
    return rows.join(F.broadcast(table) if small else table, on, how)
