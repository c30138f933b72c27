"""One batch: manifest and uploads reconciled, matched labels verified, and every input accounted for exactly once, in triage order.

A result is a row with a file name and either its checks or an error, never both or neither. What has no partner is an error row from the start; a matched label
for which the verifier gives nothing back is one, too. Input order is a dense number: manifest rows first, in theirs, then uploads without a row,
in theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.text import SPACE, case_folded
from proofline.operators import rollup
from proofline.operators.ordering import numbered
from proofline.operators.reconcile import BatchInputError, reconciled

#: Checks of matched labels: takes the reconciled rows without an error, gives `filename`, `position`, `check`, `status` and what else the checks say, a row for each check.
Verifier = Callable[[DataFrame], DataFrame]
RESULT = "position int, check string, status string, expected string, extracted string, confidence double, detail string"


def checked_manifest(manifest: DataFrame) -> DataFrame:
    """The manifest, whose file names must differ in more than case. A repeated name is one partial count away."""
    twice = manifest.groupBy(case_folded("filename").alias("key")).agg(F.count("*").alias("n"), F.max_by("filename", "order").alias("filename"), F.max("order").alias("order")).where("n > 1")
    if (first := twice.orderBy("order").first()) is not None:
        raise BatchInputError(f"The application CSV repeats filename {first['filename']!r} when letter case is ignored.")
    return manifest


def verified(matched: DataFrame, verify: Verifier) -> DataFrame:
    """Matched labels with `checks`, an array of the verifier's results in their order, null where it has none."""
    results = verify(matched)
    given = {f.name for f in results.schema}
    fields = [f.split(" ") for f in RESULT.split(", ")]
    entry = F.struct(*((F.col(n) if n in given else F.lit(None)).cast(kind).alias(n) for n, kind in fields))
    made = results.where(F.col("check").isNotNull()).groupBy("filename").agg(F.array_sort(F.collect_list(entry)).alias("checks"))  # some eleven a label
    fields = [c for c in K.MANIFEST_COLUMNS[1:] if c in matched.columns]
    return matched.select("filename", "order", *fields).join(made, "filename", "left")


def results(manifest: DataFrame, uploads: DataFrame, verify: Verifier) -> DataFrame:
    """filename, order (dense, from 0), checks or error, application (null for an upload without a row), status, rank, of every input once.

    manifest: filename, order and the application's fields; uploads: filename, order and whatever the verifier needs. Fields that both have are the manifest's.
    """
    fields = [c for c in K.MANIFEST_COLUMNS[1:] if c in manifest.columns]
    every = numbered(reconciled(manifest, uploads.select("filename", "order")), "order", name="_number").drop("order").withColumnRenamed("_number", "order")
    # What was uploaded joins those that have a partner, and only on its way to the verifier.
    evidence = uploads.select(case_folded("filename").alias("_key"), *(c for c in uploads.columns if c not in ("filename", "order", *manifest.columns)))
    matched = every.where("error IS NULL").withColumn("_key", case_folded("filename")).join(evidence, "_key").drop("_key", "error")
    application = F.when(F.col("error").isNull() | (F.col("error") != K.MISSING_MANIFEST), F.struct(*fields)).alias("application")
    checks = verified(matched, verify)
    no_checks = F.lit(None).cast(checks.schema["checks"].dataType).alias("checks")
    unpaired = every.where("error IS NOT NULL").select("filename", "order", no_checks, "error", application)
    paired = checks.withColumn("error", F.when(F.col("checks").isNull(), K.PROCESSING_ERROR)).select("filename", "order", "checks", "error", F.struct(*fields).alias("application"))
    return judged(unpaired.unionByName(paired))


def judged(batch: DataFrame) -> DataFrame:
    """Results with status and rank in the triage queue."""
    names, statuses = F.transform("checks", lambda x: x["check"]), F.transform("checks", lambda x: x["status"])
    status = rollup.batch_status(names, statuses, F.col("error"))
    return batch.withColumn("status", status).withColumn("rank", rollup.severity(F.col("status"), F.col("error")))


def _blank(name: Column) -> Column:
    return F.coalesce(F.regexp_replace(name, rf"^(?:{SPACE})+", "") == "", F.lit(True))


def violations(batch: DataFrame) -> DataFrame:
    """Results that can't be: filename, order and problem of those without a name, or with both checks and an error, or with neither."""
    both = F.col("checks").isNull() == F.col("error").isNull()
    problem = F.when(_blank(F.col("filename")), "filename must not be blank").when(both, "a batch result must contain exactly one of report or error")
    return batch.select("filename", "order", problem.alias("problem")).where("problem IS NOT NULL")


def stopped(batch: DataFrame, finished: DataFrame) -> DataFrame:
    """A batch that was stopped: matched labels that aren't among the finished (filename) are errors, all else stays."""
    done = finished.select("filename").distinct().withColumn("_done", F.lit(True))
    known = batch.join(done, "filename", "left")
    lost = F.col("_done").isNull() & F.col("error").isNull()
    kept = known.withColumn("error", F.when(lost, K.CANCELLED).otherwise(F.col("error"))).withColumn("checks", F.when(~lost, F.col("checks")))
    return judged(kept.drop("_done", "status", "rank"))
