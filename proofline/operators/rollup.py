"""From checks to verdicts: roll-up, disclosure of what was not checked, triage order, histograms, benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.text import field_label, named
from proofline.operators import ordering


def _any(statuses: Column, status: str) -> Column:
    return F.array_contains(statuses, status)


def overall(statuses: Column) -> Column:
    """FAIL before REVIEW before PASS; otherwise NOT_EVALUATED."""
    return F.when(_any(statuses, K.FAIL), K.FAIL).when(_any(statuses, K.REVIEW), K.REVIEW).when(_any(statuses, K.PASS), K.PASS).otherwise(K.NOT_EVALUATED)


def batch_status(checks: Column, statuses: Column, error: Column) -> Column:
    """A label's status in a batch: an error, or a check that was not made, leaves a pass unearned."""
    whole, all_ = overall(statuses), F.array(*(F.lit(c) for c in K.CHECKS))
    return F.when(error.isNotNull(), K.NOT_EVALUATED).when(whole.isin(K.FAIL, K.REVIEW), whole).when(F.size(F.array_except(all_, checks)) > 0, K.NOT_EVALUATED).otherwise(whole)


def severity(status: Column, error: Column) -> Column:
    """Rank in the triage queue; errors stand with failures."""
    ranks = F.create_map(*(F.lit(x) for pair in K.SEVERITY.items() for x in pair))
    return F.when(error.isNotNull(), K.SEVERITY[K.FAIL]).otherwise(ranks[status])


def disclosure(checks: Column, statuses: Column, error: Column) -> Column:
    """Which checks could not be run: known ones in their order, missing ones too, then unknown ones."""
    fixed = F.array(*(F.lit(c) for c in K.CHECKS))
    pairs = F.arrays_zip(checks.alias("c"), statuses.alias("s"))
    undone = F.transform(F.filter(pairs, lambda p: p["s"] == K.NOT_EVALUATED), lambda p: p["c"])
    made = F.struct(checks.alias("checks"), undone.alias("undone"), error.alias("error"))

    def names(x: Column) -> Column:
        known = F.filter(fixed, lambda c: ~F.array_contains(x["checks"], c) | F.array_contains(x["undone"], c))
        return F.when(x["error"].isNotNull() | x["checks"].isNull(), fixed).otherwise(F.concat(known, F.filter(x["undone"], lambda c: ~F.array_contains(fixed, c))))

    def said(names: Column) -> Column:
        n = F.size(names)
        return F.when(n == 0, "").otherwise(F.concat(n.cast("string"), F.when(n == 1, " check").otherwise(" checks"), F.lit(" could not be run — "), F.array_join(F.transform(names, field_label), "; ")))

    # Named, as what a function for an array's elements refers to is evaluated for each of them.
    return named(named(made, names), said)


def rolled_up(results: DataFrame, *keys: str) -> DataFrame:
    """One row for each label: its checks and statuses in order, overall and batch status, rank, disclosure. results: keys, position, check, status, and error (or none)."""
    error = F.first("error", ignorenulls=True) if "error" in results.columns else F.lit(None).cast("string")
    made = F.array_sort(F.collect_list(F.when(F.col("check").isNotNull(), F.struct("position", "check", "status"))))
    grouped = results.groupBy(*keys).agg(made.alias("_m"), error.alias("error"))
    grouped = grouped.withColumn("checks", F.transform("_m", lambda x: x["check"])).withColumn("statuses", F.transform("_m", lambda x: x["status"])).drop("_m")
    status = batch_status(F.col("checks"), F.col("statuses"), F.col("error"))
    out = grouped.withColumn("overall", overall(F.col("statuses"))).withColumn("status", status)
    return out.withColumn("rank", severity(F.col("status"), F.col("error"))).withColumn("disclosure", disclosure(F.col("checks"), F.col("statuses"), F.col("error")))


def triaged(results: DataFrame, order: str = "order") -> DataFrame:
    """Most urgent first; ties in input order."""
    return results.orderBy("rank", order)


def histogram(results: DataFrame) -> DataFrame:
    """Number of labels by status; errors apart."""
    kind = F.when(F.col("error").isNotNull(), "ERROR").otherwise(F.col("status"))
    return results.groupBy(kind.alias("verdict")).agg(F.count("*").alias("n_labels"))


def field_accuracy(results: DataFrame, *keys: str) -> DataFrame:
    """Passed checks of the six application fields, by group and check."""
    return results.where(F.col("check").isin(*K.APPLICATION_FIELDS)).groupBy(*keys, "check").agg(F.count_if(F.col("status") == K.PASS).alias("n_correct"), F.count("*").alias("n_samples"))


def timing(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """Linear (R-7) 50th and 95th percentile, mean and number of samples, found by range partitions (`ordering`)."""
    found = ordering.quantiles(samples, value, {"p50": 0.5, "p95": 0.95}, *keys)
    return found.withColumn("mean", F.col("total") / F.col("n")).select(*keys, "p50", "p95", "mean", "n")


def weighted_median(samples: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """The least value at which half of all weight is reached."""
    return ordering.weighted_median(samples, value, weight, *keys)
