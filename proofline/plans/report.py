"""Reports: the wide frame of one row for each input (59 columns), the long form of one label, and their CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.operators import rollup

COLUMNS = ("Filename", "Overall result", "Checks that could not be run", "Problem", *(f"{label} — {suffix}" for label in K.CHECKS.values() for suffix in K.REPORT_SUFFIXES))


def _shown(status: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in K.STATUS_TEXT.items() for x in pair))[status]


PARTS = ("status", "expected", "extracted", "confidence", "detail")


def pivoted(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """inputs (filename, ...) with `check_<name>` for each check, null if it was not made, and `others`: (check, status) of checks that aren't known.

    results: filename, check, status, expected, extracted, confidence, detail. The one pivot that reports need: verdicts come from its columns.
    """
    known = F.col("check").isin(*K.CHECKS)
    made = {check: F.first(F.when(F.col("check") == check, F.struct(*PARTS)), ignorenulls=True) for check in K.CHECKS}
    columns = results.groupBy("filename").agg(*(v.alias(f"check_{k}") for k, v in made.items()), F.array_sort(F.collect_list(F.when(~known, F.struct("check", "status")))).alias("others"))
    return inputs.join(columns, "filename", "left")


def verdicts(frame: DataFrame) -> DataFrame:
    """frame (check_<name> columns, error) with the batch's `status`, `rank` and `disclosure`."""
    pair = lambda check, status: F.struct(check.alias("check"), status.alias("status"))
    known = F.array(*(F.when(F.col(f"check_{c}").isNotNull(), pair(F.lit(c), F.col(f"check_{c}.status"))) for c in K.CHECKS))
    every = F.concat(known, F.coalesce("others", F.array().cast("array<struct<check:string,status:string>>"))) if "others" in frame.columns else known
    frame = frame.withColumn("_made", F.filter(every, lambda x: x.isNotNull()))
    names, statuses = F.transform("_made", lambda x: x["check"]), F.transform("_made", lambda x: x["status"])
    frame = frame.withColumn("status", rollup.batch_status(names, statuses, F.col("error")))
    return frame.withColumn("rank", rollup.severity(F.col("status"), F.col("error"))).withColumn("disclosure", rollup.disclosure(names, statuses, F.col("error"))).drop("_made")


def wide(frame: DataFrame) -> DataFrame:
    """The batch report, one row for each input, most urgent first, ties by order.

    frame: filename, order, error, `check_<name>` columns (as `rules.evaluated` or `pivoted` makes them) and, where known, the application fields, which stand in for the
    expected value of a check that was not made.
    """
    frame = verdicts(frame)
    columns = [F.col("filename").alias(COLUMNS[0]), _shown(F.col("status")).alias(COLUMNS[1]), F.col("disclosure").alias(COLUMNS[2]), F.col("error").alias(COLUMNS[3])]
    for check, label in K.CHECKS.items():
        r = F.col(f"check_{check}")
        known = F.col(check) if check in K.APPLICATION_FIELDS and check in frame.columns else F.lit(None).cast("string")
        values = (
            F.when(r.isNull(), K.STATUS_TEXT[K.NOT_EVALUATED]).otherwise(_shown(r["status"])),
            F.when(r.isNull(), known).otherwise(r["expected"]),
            r["extracted"],
            r["confidence"],
            F.when(r.isNull(), K.SAYS["not_completed"]).otherwise(r["detail"]),
        )
        columns += [v.alias(f"{label} — {s}") for v, s in zip(values, K.REPORT_SUFFIXES, strict=True)]
    # A sort reads its input twice, for its bounds and for its rows: the rows are moved first, so that the checks behind them are made once.
    urgency = F.struct("rank", "order").alias("_urgency")
    return frame.select(urgency, *columns).repartition(F.col("_urgency")).orderBy("_urgency").drop("_urgency")


def single(results: DataFrame, *keys: str) -> DataFrame:
    """The long form of one label, or of each label named by keys: every check in its order, those missing from the report disclosed."""
    made = F.struct("status", "expected", "extracted", "detail")
    grouped = results.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("check", made))).alias("_made"))
    each = grouped.select(*keys, "_made", F.posexplode(F.array(*map(F.lit, K.CHECKS))).alias("_position", "_check"))
    names = F.create_map(*(F.lit(x) for pair in K.CHECKS.items() for x in pair))
    return each.withColumn("_m", F.try_element_at("_made", "_check")).orderBy(*keys, "_position").select(
        *keys,
        names[F.col("_check")].alias("Check"),
        F.when(F.col("_m.status").isNull(), K.STATUS_TEXT[K.NOT_EVALUATED]).otherwise(_shown(F.col("_m.status"))).alias("Result"),
        shown_value(F.col("_m.expected"), "Not provided").alias("Application value"),
        shown_value(F.col("_m.extracted"), "Nothing readable was found").alias("We read this as"),
        F.coalesce("_m.detail", F.lit(K.SAYS["not_completed"])).alias("Details"),
    )


def shown_value(value: Column, otherwise: str) -> Column:
    return F.when(value.isNull() | (F.trim(value) == ""), otherwise).otherwise(value)


def write_csv(frame: DataFrame, path: str) -> None:
    """A folder of CSV parts, UTF-8, \\n line ends, nulls as empty fields, each with a header. A sorted frame's parts follow each other by name."""
    frame.write.mode("overwrite").csv(path, header=True, lineSep="\n", nullValue="", emptyValue="", quote='"', escape='"')
