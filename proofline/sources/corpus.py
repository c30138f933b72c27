"""What is kept of a registry: records and manifest as two tables that change together, a summary, addresses, and the texts of the law that constants are held against.

Both tables are written under a name of their own, then one file that names them is put in place of the one before by a single rename. A reader sees the old pair or the new one,
whenever a writer dies.
"""

from __future__ import annotations

import re
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.sources.registry import manifest_rows
from proofline.storage import written

TRUTH = ("filename", "brand_name", "fanciful_name", "class_type", "origin_code", "origin_country", "bottler", "source_url")
CURRENT = "CURRENT"
#: An item of a list of sizes.
ITEM = re.compile(r"\(\d+\) ([\d.]+) (Liters?|liters?|mL|milliliters)\.")


def decoded_html(body: Column) -> Column:
    """Bytes as UTF-8, what is not valid replaced."""
    return F.make_valid_utf8(body.cast("string"))


def detail_url(base: str, action: str, identity: Column) -> Column:
    return F.concat(F.lit(f"{base}?action={action}&ttbid="), F.url_encode(identity))


def ground_truth(records: DataFrame) -> DataFrame:
    """One row for each usable record, under its image's name."""
    name = F.concat(F.col("page_id").cast("string"), F.lit(".jpg"))
    return records.where("error IS NULL").select(name.alias("filename"), *(c for c in TRUTH[1:-1]), F.col("url").alias("source_url"))


def summary(records: DataFrame) -> DataFrame:
    """kept, skipped, with_origin_country: numbers of records."""
    kept = F.col("error").isNull()
    return records.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"), F.count_if(kept & (F.col("origin_country") != "")).alias("with_origin_country"))


def _truth_table(records: DataFrame, path: str) -> None:
    ground_truth(records).write.json(path)


def _manifest_table(records: DataFrame, path: str) -> None:
    manifest_rows(records).select(*K.MANIFEST_COLUMNS).write.csv(path, header=True, lineSep="\n", emptyValue="", nullValue="", quote='"', escape='"')


def _context(spark: SparkSession, folder: str):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    return fs, fs.FileContext.getFileContext(fs.Path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def write_metadata(records: DataFrame, folder: str) -> str:
    """Both tables under a version of their own, then the pointer; the version's name. Versions that nothing names are removed afterwards."""
    spark, version = records.sparkSession, uuid.uuid4().hex
    records = written(records, "records")  # pages are parsed once: a filter on what was parsed would parse them anew, for each table
    _truth_table(records, f"{folder}/{version}/ground_truth")
    _manifest_table(records, f"{folder}/{version}/manifest")
    fs, context = _context(spark, folder)
    pointer, new = fs.Path(f"{folder}/{CURRENT}"), fs.Path(f"{folder}/.{version}")
    store = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, pointer, options)
    for status in store.listStatus(fs.Path(folder)):
        if status.isDirectory() and status.getPath().getName() != version:
            store.delete(status.getPath(), True)
    return version


def read_metadata(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """Ground truth and manifest of the last version that was finished; None if there is none."""
    fs, _ = _context(spark, folder)
    pointer = fs.Path(f"{folder}/{CURRENT}")
    if not pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(pointer):
        return None
    version = spark.read.text(f"{folder}/{CURRENT}").first()["value"]
    truth = spark.read.schema(", ".join(f"{c} string" for c in TRUTH)).json(f"{folder}/{version}/ground_truth")
    return truth, spark.read.schema(", ".join(f"{c} string" for c in K.MANIFEST_COLUMNS)).csv(f"{folder}/{version}/manifest", header=True, quote='"', escape='"', emptyValue="")


def payload(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text of the law (`value`): those that are neither empty nor comments."""
    return spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')")


def listed_sizes(lines: DataFrame) -> set[Decimal]:
    """The sizes in mL that a text's list of items names: a few dozen."""
    found = (ITEM.fullmatch(r["value"].strip()) for r in lines.where("value RLIKE '^ *[(][0-9]+[)] [0-9.]+ '").collect())
    return {Decimal(m[1]) * (1000 if m[2].lower().startswith("l") else 1) for m in found if m}
