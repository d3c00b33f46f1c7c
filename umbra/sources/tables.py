"""Tables of a run: the standard Parquet tables, and intermediate ones in a shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, columns: int = 1) -> DataFrame:
    """``df`` over all cores before costly work, where it comes in fewer partitions (a single small file)."""
    spark = df.sparkSession
    least = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out once: what filters or explodes them later is not pushed below and works them out anew.

    The node that observes the rows stops the optimizer there.
    """
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))


def shared_path(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="umbra-")
    return f"{root.rstrip('/')}/umbra-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], steps: dict[str, Callable[[], Column]]) -> DataFrame:
    """``df`` with running aggregates of the rows before each, by groups in order, without one task for a group.

    ``steps`` maps a result column to an aggregate of a column named alike (``{"n": F.sum}``), which
    must be associative: rows are dealt to range partitions, each of which aggregates its own, and
    only the partitions' results are run through in order.  A partition begins inside one group at
    most, so that what is carried is a row a partition.  Where nothing comes before, the result is null.
    Rows of a group that tie in ``order`` come one after another in any order.
    """
    ranged = written(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part", *by).agg(*[step(c).alias(c) for c, step in steps.items()])
    carried = sums.select("__part", *by, *[step(c).over(earlier).alias(f"__carried_{c}") for c, step in steps.items()], F.count("*").over(earlier).alias("__parts")).where("__parts > 0")
    local = ranged.select("*", *[step(c).over(before).alias(f"__own_{c}") for c, step in steps.items()])
    same = [local[c].eqNullSafe(carried[c]) for c in ("__part", *by)]
    both = local.join(F.broadcast(carried), same, "left").select(*[local[c] for c in df.columns if c not in steps], *[_pair(step, F.col(f"__carried_{c}"), F.col(f"__own_{c}")).alias(c) for c, step in steps.items()])
    return both


def _pair(step: Callable, a: Column, b: Column) -> Column:
    """Two results of an aggregate as one; null is no result."""
    two = {"sum": lambda: a + b, "max": lambda: F.greatest(a, b), "min": lambda: F.least(a, b)}[step.__name__]()
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(two)


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with more fields behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
