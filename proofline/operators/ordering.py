"""Order at scale: dense numbers and exact quantiles by range partitions and prefix sums over their totals; no task sees all rows of anything.

Both follow one plan. Rows are range-partitioned by what orders them, each partition's total is one row, prefix sums over these rows tell what lies
before a partition, and only rows of the partitions that matter are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.storage import written

#: monotonically_increasing_id: the partition above these bits, the row's place in it below.
PLACE_BITS = 33


def _before(total: str, *keys: str) -> Column:
    """The sum of the totals of all earlier partitions."""
    return F.coalesce(F.sum(total).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, *order: str, name: str = "number", start: int = 0) -> DataFrame:
    """df with a dense number in the order of some columns: start, start + 1, ... Rows equal in all of them stand in any order; nulls come first."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    fixed = written(sorted_, "ordered").withColumn("_part", F.shiftright("_id", PLACE_BITS))
    # One row for each partition: as many as spark.sql.shuffle.partitions says, so this table is small whatever the input.
    totals = fixed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (_before("_n") + start).alias("_first"))
    place = F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)
    return fixed.join(F.broadcast(totals), "_part").withColumn(name, F.col("_first") + place).drop("_part", "_id", "_first")


def reached(counted: DataFrame, keys: tuple[str, ...], value: str, weight: str, targets: DataFrame, target: str) -> DataFrame:
    """targets (keys, `target`, above 0) with the least value at which the running weight reaches the target.

    counted: keys, value, weight, one row for each distinct value of a group, so that no row is too heavy to lie in one partition.
    """
    spread = counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id())
    fixed = written(spread, "counted")
    totals = fixed.groupBy(*keys, "_part").agg(F.sum(weight).alias("_total"))
    totals = totals.withColumn("_first", _before("_total", *keys))
    inside = lambda low, high: (low < F.col(target)) & (F.col(target) <= high)
    # The one partition of each target; the others' rows are not read into any window.
    pairs = targets.join(totals, list(keys)) if keys else targets.crossJoin(totals)  # without keys: a few targets, a row for each partition
    where = pairs.where(inside(F.col("_first"), F.col("_first") + F.col("_total")))
    part = fixed.join(where.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi")
    running = F.sum(weight).over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    sums = part.withColumn("_to", running).withColumn("_from", F.col("_to") - F.col(weight))
    found = where.join(sums, [*keys, "_part"]).where(inside(F.col("_first") + F.col("_from"), F.col("_first") + F.col("_to")))
    return found.select(*targets.columns, value)


def counted_values(samples: DataFrame, keys: tuple[str, ...], value: str, weight: Column | None = None) -> DataFrame:
    """keys, value, `_w`: how often (or with what weight) each value occurs; equal values are one row before they move."""
    return samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("_w"))


def quantiles(samples: DataFrame, value: str, wanted: dict[str, float], *keys: str) -> DataFrame:
    """keys and a column for each wanted quantile, linear between the two ranks beside it (R-7), n (values), total (their sum). Nulls don't count; a group of nulls has no row."""
    counted = counted_values(samples, keys, value)
    sizes = counted.groupBy(*keys).agg(F.sum("_w").alias("n"), F.sum(F.col(value) * F.col("_w")).alias("total"))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * q).alias("at")) for name, q in wanted.items()))
    each = sizes.select(*keys, "n", F.explode(asked).alias("q")).select(*keys, "q.name", "q.at", "n")
    low = F.floor("at").cast("long")
    sides = F.array(F.struct((low + 1).alias("nth"), F.lit(0).alias("side")), F.struct(F.least(low + 2, F.col("n")).alias("nth"), F.lit(1).alias("side")))
    ranks = each.select(*keys, "name", "at", F.explode(sides).alias("s")).select(*keys, "name", "at", "s.nth", "s.side")
    found = reached(counted, keys, value, "_w", ranks, "nth")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col(value)))
    part = F.col("at") - F.floor("at")
    between = found.groupBy(*keys, "name", "at").agg(side(0).alias("a"), side(1).alias("b")).withColumn("v", F.col("a") * (1 - part) + F.col("b") * part)
    flat = between.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted))
    return sizes.join(flat, list(keys)) if keys else sizes.crossJoin(flat)  # without keys both are one row


def weighted_median(samples: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """The least value at which half of all weight is reached. Rows without a value or with no weight don't count. Weights are summed exactly, fractions to ten places."""
    fraction = samples.schema[weight].dataType.typeName() in ("float", "double")
    own = F.col(weight).cast("decimal(28,10)") if fraction else F.col(weight)
    counted = counted_values(samples.where(F.col(weight) > 0), keys, value, own)
    halves = counted.groupBy(*keys).agg((F.sum("_w") / 2).alias("_half"))
    return reached(counted, keys, value, "_w", halves, "_half").select(*keys, F.col(value).alias("weighted_median"))
