"""Temperature mixing of sources.

A source's weight is its share of the tokens to the power of an exponent between 0 and 1.  The
exponent is found by bisection, several halvings a pass over the table of sources: the largest
that reaches a target entropy, or the smallest that keeps any source from being repeated more
than a limit times as often as another.  The weights are realised on whole documents: each
source lays its documents out in a permutation for each epoch, by a hash, and takes its budget
from the front.  Positions are prefix sums in hash buckets, so that a hot source is counted in
parallel.  A document's block follows from its position and its source's quota of a block.  The
mixed rows lie in order of their blocks, and permuted within each, in every file: files that are
read side by side give one block after another, each with the sources in their weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, join_small, materialise

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
#: Documents that a hash bucket should hold, and the least number of buckets.
BUCKET_DOCS, BUCKETS_LOG2 = 1 << 14, 12
#: Bisection: halvings in one pass (their 2^n - 1 points at once) and passes.
HALVINGS, PASSES = 5, 8
SEED = 20


def words(text: Column) -> Column:
    pieces = F.split(text, r"\s+")
    return F.size(pieces) - F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)


def bisect(shares: DataFrame, reached, rising: bool) -> float:
    """The exponent in [0, 1] at which ``reached`` (a column over z, zl, low, high, a) turns.

    ``rising``: it holds from some exponent on, and the smallest is sought; else the largest up
    to which it holds.  An end of the interval stands for a target that is met everywhere or nowhere.
    z and zl are the sums of p^a and p^a ln p over the sources' shares p; low and high the least
    and largest share.
    """
    low, high = 0.0, 1.0
    parts = 2**HALVINGS
    for _ in range(PASSES):
        points = [low + (high - low) * i / parts for i in range(parts + 1)]
        each = shares.select("p", F.explode(F.array(*map(F.lit, points))).alias("a"))
        power = F.pow("p", F.col("a"))
        sums = each.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("zl"), F.min("p").alias("low"), F.max("p").alias("high"))
        holds = {r["a"]: r["ok"] for r in sums.select("a", reached.alias("ok")).collect()}  # a row a point
        flags = [bool(holds.get(a, False)) for a in points]
        if rising:
            k = flags.index(True) if True in flags else parts
            low, high = points[max(0, k - 1)], points[k]
        else:
            k = max((i for i, f in enumerate(flags) if f), default=0)
            low, high = points[k], points[min(parts, k + 1)]
        if low == high:
            break
    return high if rising else low


def entropy() -> Column:
    """Of the weights p^a / z, in nats."""
    return F.log("z") - F.col("a") * F.col("zl") / F.col("z")


def weights(counts: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """``counts(source, tokens)`` with share p, weight, quota (tokens to take) and the exponent.

    ``target_entropy`` is a share of the largest possible entropy; with ``max_repeats`` as well,
    the limit on repetition prevails.  Without a ``budget`` the smallest is taken that holds each
    document once.  Sources without tokens have no weight.
    """
    counts = materialise(counts)
    total, n = counts.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        return counts.select("source", "tokens", *[F.lit(0.0).alias(k) for k in ("p", "weight", "quota")], F.lit(1.0).alias("exponent"))
    shares = counts.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(total))
    exponent = 1.0
    if target_entropy is not None and n > 1:
        exponent = bisect(shares, entropy() >= target_entropy * math.log(n) - 1e-12, rising=False)
    if max_repeats is not None:
        limit = bisect(shares, F.pow(F.col("high") / F.col("low"), 1 - F.col("a")) <= max_repeats + 1e-12, rising=True)
        exponent = limit if target_entropy is None else max(limit, exponent)
    raised = shares.withColumn("raised", F.pow("p", F.lit(exponent)))
    z, worst = raised.agg(F.sum("raised"), F.max(F.col("tokens") / F.col("raised"))).first()
    # tokens / weight is largest for the source that the budget must just hold.
    whole = budget if budget is not None else worst * z
    weighted = raised.select("source", "tokens", "p", (F.col("raised") / z).alias("weight"), (F.col("raised") / z * whole).alias("quota"), F.lit(exponent).alias("exponent"))
    none = counts.where("tokens <= 0").select("source", "tokens", *[F.lit(0.0).alias(k) for k in ("p", "weight", "quota")], F.lit(exponent).alias("exponent"))
    return materialise(weighted.union(none))


def units(docs: DataFrame, tokens=words) -> DataFrame:
    """Rows that agree in id, source and text, as one: (key, doc_id, source, n_tokens of one, n_rows)."""
    key = unit_key()
    own = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), tokens(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"))
    return materialise(own.groupBy("key", "doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")))


def unit_key() -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("null"))))


def plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, block: int = BLOCK_TOKENS, tokens=words) -> DataFrame:
    """Which documents of ``docs(doc_id, source, text)`` are taken, and where: a row for each document and epoch.

    key, doc_id, source, n_tokens, n_rows, epoch, position (tokens before it in its source's
    stream), block, weight.  A document is taken whole if its position in the epoch is below
    what the quota still asks for.

    Nulls: a null source is the source ""; null text has no tokens and is taken once; a null
    doc_id is kept.  Repeated rows are one unit, taken together.  Ties of the hash are ordered
    by key.  A text of any length is taken whole, though it may exceed its source's share of a
    block.  An empty table gives no rows.  Other columns, whatever their names, are ignored.
    """
    rows = units(docs, tokens)
    bits = max(BUCKETS_LOG2, math.ceil(math.log2(max(1, rows.count()) / BUCKET_DOCS)))
    mass = (F.col("n_tokens") * F.col("n_rows")).alias("mass")
    table = weights(rows.groupBy("source").agg(F.sum(mass).alias("tokens")), target_entropy, max_repeats, budget)
    table = table.select(F.col("source").alias("s"), F.col("tokens").alias("held"), "weight", "quota")
    taken = join_small(rows, table, F.col("source") == F.col("s")).drop("s")
    # A hair of rounding must not open another epoch.
    epochs = F.when(F.col("held") > 0, F.greatest(F.lit(1), F.ceil(F.col("quota") / F.col("held") - 1e-9).cast("int"))).otherwise(F.lit(1))
    laid = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    laid = laid.withColumn("h", F.xxhash64("key", "epoch", F.lit(SEED))).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits)).withColumn("mass", mass)
    sums = laid.groupBy("source", "epoch", "bucket").agg(F.sum("mass").alias("in_bucket"))
    # A row for each bucket of a source and epoch meets here.
    before = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.join(offsets, ["source", "epoch", "bucket"]).withColumn("position", F.col("epoch") * F.col("held") + F.col("offset") + F.coalesce(F.sum("mass").over(inside), F.lit(0)))
    quota_of_block = F.greatest(F.lit(1.0), F.col("weight") * block)
    kept = placed.where((F.col("position") < F.col("quota") - 1e-6 * F.greatest(F.lit(1.0), F.col("quota"))) | ((F.col("epoch") == 0) & (F.col("n_tokens") == 0)) | ((F.col("epoch") == 0) & (F.lit(budget is None))))
    return kept.select("key", "doc_id", "source", "n_tokens", "n_rows", F.col("epoch").cast("int").alias("epoch"), F.col("position").cast("long").alias("position"), F.floor(F.col("position") / quota_of_block).cast("long").alias("block"), F.round("weight", 9).alias("weight"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the plan takes them, with the same columns, in order of block; texts are shuffled once.

    Nulls, ties, repeated rows, long texts and empty tables as in ``plan``; every column of a row
    comes along unchanged.
    """
    own, block, order = free_names(docs, "__umbra_row", "__umbra_block", "__umbra_order")
    taken = plan(docs, **how).select(F.col("key").alias(own), F.col("block").alias(block), F.xxhash64("key", "epoch", F.lit(SEED + 1)).alias(order))
    rows = docs.withColumn(own, unit_key()).join(taken, own)
    return rows.sortWithinPartitions(block, order).select(*docs.columns)
