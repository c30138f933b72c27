"""Manifest and uploads matched one to one by case-folded file name; what has no partner becomes an error row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions.text import case_folded


class BatchInputError(ValueError):
    """Uploads or manifest rows that can't be told apart."""


def reconciled(manifest: DataFrame, uploads: DataFrame) -> DataFrame:
    """Full outer join of manifest (filename, order, ...) and uploads (filename, order, ...): file's name, error or null, and order.

    Uploads without a manifest row follow all manifest rows, in upload order: a number, or a path.
    """
    m = manifest.withColumn("_key", case_folded("filename")).withColumnRenamed("filename", "_m_name").withColumnRenamed("order", "_m_order")
    u = uploads.withColumn("_key", case_folded("filename")).withColumnRenamed("filename", "_u_name").withColumnRenamed("order", "_u_order")
    joined = m.join(u, "_key", "full_outer")
    error = F.when(F.col("_u_name").isNull(), K.MISSING_IMAGE).when(F.col("_m_name").isNull(), K.MISSING_MANIFEST)
    # Two-part order: matched rows need no number of manifest rows, so nothing is counted first.
    named = uploads.schema["order"].dataType.typeName() == "string"
    place, path = (F.col("_m_order"), F.when(F.col("_m_order").isNull(), F.col("_u_order"))) if named else (F.coalesce("_m_order", "_u_order"), F.lit(None))
    order = F.struct(F.col("_m_order").isNull().cast("int").alias("part"), place.cast("long").alias("place"), path.cast("string").alias("path"))
    return joined.withColumns({"filename": F.coalesce("_m_name", "_u_name"), "error": error, "order": order}).drop("_key", "_m_name", "_u_name", "_m_order", "_u_order")


def duplicates(files: DataFrame) -> DataFrame:
    """Names that occur more than once when case is ignored, with the first spelling of the first repeat."""
    w = Window.partitionBy("_key").orderBy("order")
    seen = files.withColumn("_key", case_folded("filename")).withColumn("_n", F.row_number().over(w))
    return seen.where("_n = 2").select("filename", "order")


def checked_uploads(files: DataFrame) -> DataFrame:
    """Uploads with trimmed names; blank or repeated names are refused."""
    from proofline.functions.text import SPACE

    named = files.withColumn("filename", F.regexp_replace("filename", rf"^(?:{SPACE})+|(?:{SPACE})+$", ""))
    if not named.where("filename IS NULL OR filename = ''").isEmpty():
        raise BatchInputError("Every uploaded image needs a filename.")
    if (twice := duplicates(named).orderBy("order").first()) is not None:
        raise BatchInputError(f"More than one uploaded image is named {twice['filename']!r} when letter case is ignored.")
    return named


def cancelled(work: DataFrame, finished: DataFrame) -> DataFrame:
    """Work that a stopped batch did not reach, as error rows."""
    return work.join(finished.select("filename"), "filename", "left_anti").withColumn("error", F.lit(K.CANCELLED))
