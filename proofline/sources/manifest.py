"""The application manifest: a strict seven-column CSV that is taken whole or refused with a reason.

The file is read as lines, in splits that know nothing of each other, though a quoted value may hold line ends. What a line does to a reader depends on one thing
only, whether it begins inside a quoted value; so each line is a function of that one bit, found by a fold over its quotes. Functions are composed within a split,
one row a split carries the composition and the records that begin in it, and a prefix scan over these rows tells every split the bit it begins with and
the number of its first record. Records keep their true numbers, lines with nothing on them included, and no task reads more than its split.

A folder of parts is one manifest, its files taken by name.
"""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from proofline import constants as K
from proofline.functions.text import SPACE, case_folded, named
from proofline.storage import written

# ---- Fixed values: what is said of a manifest that can't be used ----
UNREADABLE = "The application CSV could not be read."
NO_HEADER = "The application CSV needs a header row."
WRONG_HEADER = f"The application CSV columns must appear in exactly this order: {', '.join(K.MANIFEST_COLUMNS)}."
WRONG_SIZE, MISSING = f" must contain {len(K.MANIFEST_COLUMNS)} values.", " is missing required values: "
REPEATS, UNIQUE = " repeats filename ", ". Filenames must be unique even when letter case differs."

#: Characters of the longest value that a reader takes, and of the longest record that is put together from several lines.
LONGEST, LONGEST_RECORD = 131_072, 1_200_000
#: Windows-1252 is Latin-1 but for these, those of its bytes from 0x80 to 0x9F that it defines.
LATIN = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
WINDOWS = LATIN.encode("latin-1").decode("cp1252")
#: Where a reader is: at a value's beginning, in a plain value, in a quoted one, after a quote inside it, at an error.
FRESH, PLAIN, QUOTED, CLOSING, ERROR = range(5)


class ManifestError(ValueError):
    """Why a manifest can't be used."""


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line (increasing in its split) and the bytes between line feeds."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("bytes"))


def encoding_of(raw: DataFrame) -> str:
    """UTF-8 (with or without mark), else Windows-1252, else Latin-1, which takes anything."""
    utf8, windows = F.is_valid_utf8(F.col("bytes").cast("string")), ~F.decode("bytes", "ISO-8859-1").rlike("[\\x81\\x8d\\x8f\\x90\\x9d]")
    found = raw.agg(F.bool_and(utf8).alias("utf8"), F.bool_and(utf8 | windows).alias("windows")).first()
    return "UTF-8" if found["utf8"] is not False else "windows-1252" if found["windows"] else "ISO-8859-1"


def _after_text(state: Column, text: Column) -> Column:
    """Where a reader is after text without quotes."""
    outside = F.when(text.endswith(","), FRESH).otherwise(PLAIN)
    closed = F.when(text.startswith(","), outside).otherwise(ERROR)
    return F.when((text == "") | state.isin(QUOTED, ERROR), state).when(state == CLOSING, closed).otherwise(outside)


def _after_quote(state: Column) -> Column:
    """A quote opens a value at its beginning only; inside, two of them are one."""
    return F.when(state.isin(FRESH, CLOSING), QUOTED).when(state == QUOTED, CLOSING).otherwise(state)


def _ends(text: Column, begin: int) -> Column:
    """Where a reader is after a line that it begins in this state."""
    pieces = F.split(F.regexp_replace(text, "\\r\\z", ""), '"', -1)
    fold = lambda p: F.aggregate(F.slice(p, 2, F.size(p)), _after_text(F.lit(begin), F.get(p, F.lit(0))), lambda s, t: _after_text(_after_quote(s), t))
    return F.when(text.contains('"'), named(pieces, fold)).otherwise(_after_text(F.lit(begin), F.regexp_replace(text, "\\r\\z", "")))


def _split(raw: DataFrame, encoding: str) -> DataFrame:
    """Lines as text, also parted at carriage returns that no line feed follows: file, block, line, part, text, more (whether the line goes on)."""
    text = F.decode("bytes", "UTF-8" if encoding == "UTF-8" else "ISO-8859-1")
    text = F.translate(text, LATIN, WINDOWS) if encoding == "windows-1252" else text
    each = raw.select("file", "block", "line", F.posexplode(F.split(text, "(?<=\\r)(?!\\z)", -1)).alias("part", "text"))
    # A mark belongs to the file, not to its first value; those of later parts of a folder go too.
    first = (F.col("block") == 0) & (F.col("part") == 0) & F.col("text").startswith("﻿") & (F.row_number().over(_within()) == 1) if encoding == "UTF-8" else F.lit(False)
    return each.withColumn("text", F.when(first, F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text")))


def _within(*to) -> Window:
    w = Window.partitionBy("file", "block").orderBy("line", "part")
    return w.rowsBetween(Window.unboundedPreceding, 0) if to else w


def _composed(df: DataFrame, so_far, name: str, out: str, inside: str) -> DataFrame:
    """df with <name>0 and <name>1: the bit after all rows so far, if it was 0 or 1 before. A row that forgets the bit fixes it; others keep or turn it."""
    fixed, turns = F.when(F.col(out) == F.col(inside), F.col(out)), F.sum(F.when((F.col(out) == 1) & (F.col(inside) == 0), 1).otherwise(0)).over(so_far)
    df = df.withColumn("_turns", turns)
    df = df.withColumn("_last", F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("bit"), F.col("_turns").alias("turns"))), ignorenulls=True).over(so_far))
    after = lambda begin: F.when(F.col("_last").isNull(), F.col("_turns") + begin).otherwise(F.col("_last.bit") + F.col("_turns") - F.col("_last.turns")) % 2
    return df.withColumns({f"{name}{b}": after(b).cast("int") for b in (0, 1)}).drop("_turns", "_last")


def _placed(lines: DataFrame) -> DataFrame:
    """lines with the record that each belongs to (from 1), whether it begins and whether it ends it, and whether it breaks the format."""
    df = lines.withColumns({"_out": _ends(F.col("text"), FRESH), "_in": _ends(F.col("text"), QUOTED)})
    bit = lambda c: (F.col(c) == QUOTED).cast("int")
    df = _composed(df.withColumns({"_o": bit("_out"), "_i": bit("_in")}), _within(1), "_after", "_o", "_i")
    df = df.withColumns({f"_was{b}": F.coalesce(F.lag(f"_after{b}").over(_within()), F.lit(b)) for b in (0, 1)})
    df = df.withColumns({f"_n{b}": F.sum((F.col(f"_was{b}") == 0).cast("int")).over(_within(1)) for b in (0, 1)})
    place = F.struct("line", "part")
    splits = df.groupBy("file", "block").agg(*(F.max_by(f"_{c}{b}", place).alias(f"{c}{b}") for c in ("after", "n") for b in (0, 1)))
    # One row for each split of the input, some 128 MB: small enough for one sort.
    in_order = Window.orderBy("file", "block")
    splits = _composed(splits, in_order.rowsBetween(Window.unboundedPreceding, 0), "_end", "after0", "after1")
    splits = splits.withColumn("begins", F.coalesce(F.lag("_end0").over(in_order), F.lit(0)))
    splits = splits.withColumn("_n", F.when(F.col("begins") == 0, F.col("n0")).otherwise(F.col("n1")))
    splits = splits.withColumn("first", F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.join(splits.select("file", "block", "begins", "first"), ["file", "block"])
    which = lambda a, b: F.when(F.col("begins") == 0, F.col(a)).otherwise(F.col(b))
    was = which("_was0", "_was1")
    bad = F.when(was == 0, F.col("_out")).otherwise(F.col("_in")) == ERROR
    return df.select("file", "block", "line", "part", "text", (F.col("first") + which("_n0", "_n1")).alias("row"), (was == 0).alias("begins"), (which("_after0", "_after1") == 0).alias("ends"), bad.alias("bad"))


@F.pandas_udf(ArrayType(StringType()))
def _read(records: pd.Series) -> pd.Series:
    """The values of records with quotes; null for one that is no record."""

    def values(text: str | None) -> list[str] | None:
        try:
            return None if text is None else next(csv.reader([text], strict=True), [])
        except csv.Error:
            return None

    return records.map(values)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """row (from 1, the header) and the values of every record, trimmed; null values if it can't be read."""
    raw = _raw(spark, path)
    # Several ways lead from these lines and from these records: both are tables, so that the scan is made once.
    placed = written(_placed(_split(raw, encoding_of(raw))), "lines")
    alone = F.col("begins") & F.col("ends")
    single = placed.where(alone).select("row", F.when(~F.col("bad"), F.col("text")).alias("text"))
    several = placed.where(~alone)
    sizes = several.groupBy("row").agg(F.sum(F.length("text") + 1).alias("_size"), F.bool_or("bad").alias("_bad"), F.bool_or("ends").alias("_ends"))
    usable = (F.col("_size") <= LONGEST_RECORD) & ~F.col("_bad") & F.col("_ends")
    # Lines of a record that is too long or never ends are left out before they meet in a group.
    kept = several.join(sizes.where(usable).select("row"), "row", "left_semi")
    line = F.struct("file", "block", "line", "part", "text")
    joined = kept.groupBy("row").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    # A part that a carriage return ends has it as its last character; lines had a line feed.
    pieces = named(F.col("ls"), lambda ls: F.transform(ls, lambda x, i: F.concat(F.when((i == 0) | (F.get(ls, i - 1)["line"] == x["line"]), "").otherwise("\n"), x["text"])))
    whole = single.unionByName(joined.select("row", F.array_join(pieces, "").alias("text"))).unionByName(sizes.where(~usable).select("row", F.lit(None).cast("string").alias("text")))
    quoted = F.when(F.col("text").contains('"'), F.col("text"))
    read = whole.withColumn("_quoted", _read(quoted))
    plain = F.split(F.regexp_replace("text", "\\r\\z", ""), ",", -1)
    cells = F.when(F.col("text").isNull(), None).when(F.col("text").contains('"'), F.col("_quoted")).otherwise(plain)
    cells = F.when(~F.exists(cells, lambda c: F.length(c) > LONGEST), F.transform(cells, lambda c: F.regexp_replace(c, rf"^(?:{SPACE})+|(?:{SPACE})+$", "")))
    return written(read.select("row", cells.alias("cells")), "records")


def _shown(name: Column) -> Column:
    """A name in quotes, as a reader of messages knows them."""
    double = name.contains("'") & ~name.contains('"')
    inner = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    return F.when(double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))


def problems(records: DataFrame) -> DataFrame:
    """row and problem of every record that breaks a rule; a repeated name is one after its first good use."""
    n = len(K.MANIFEST_COLUMNS)
    header = F.when(F.col("cells").isNull(), UNREADABLE).when(F.array_join(F.transform("cells", F.lower), "\x00") != "\x00".join(K.MANIFEST_COLUMNS), WRONG_HEADER)
    body = records.where("row > 1").where(F.col("cells").isNull() | F.exists("cells", lambda c: c != ""))
    names = F.array(*map(F.lit, K.MANIFEST_COLUMNS[:-1]))
    missing = F.array_join(F.filter(names, lambda c: F.get("cells", F.array_position(names, c).cast("int") - 1) == ""), ", ")
    own = F.when(F.col("cells").isNull(), UNREADABLE).when(F.size("cells") != n, F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(WRONG_SIZE))).when(missing != "", F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(MISSING), missing, F.lit(".")))
    judged = body.withColumn("problem", own)
    good = judged.where("problem IS NULL").select("row", F.get("cells", F.lit(0)).alias("filename")).withColumn("key", case_folded("filename"))
    # A name that occurs once is gone before the join; one that many rows share is split by the engine, as both sides are plain shuffles.
    twice = good.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    again = good.join(twice, "key").where("row > first").select("row", F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(REPEATS), _shown(F.col("filename")), F.lit(UNIQUE)).alias("problem"))
    return records.where("row = 1").select("row", header.alias("problem")).unionByName(judged.select("row", "problem")).where("problem IS NOT NULL").unionByName(again)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """row and problem of every record of the manifest at a path that a rule forbids."""
    return problems(_records(spark, path))


def rows_of(records: DataFrame) -> DataFrame:
    """Good records' seven columns (a blank origin is null) and row, their record's number."""
    kept = records.where("row > 1").where(F.exists("cells", lambda c: c != ""))
    cell = lambda i: F.get("cells", F.lit(i))
    last = len(K.MANIFEST_COLUMNS) - 1
    return kept.select(*(F.nullif(cell(i), F.lit("")).alias(c) if i == last else cell(i).alias(c) for i, c in enumerate(K.MANIFEST_COLUMNS)), "row")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The manifest at a path that Spark can read: its seven columns and order, which is a row's record number less two (increasing, with gaps at blank records)."""
    records = _records(spark, path)
    first = problems(records).agg(F.min_by("problem", "row").alias("problem")).first()["problem"]
    if first is not None:
        raise ManifestError(first)
    if records.limit(1).isEmpty():
        raise ManifestError(NO_HEADER)
    return rows_of(records).withColumn("order", F.col("row") - 2).drop("row")


def sample(spark: SparkSession, path: str, filename: str) -> DataFrame:
    """The first row with a file name."""
    return read(spark, path).where(F.col("filename") == filename).orderBy("order").limit(1)
