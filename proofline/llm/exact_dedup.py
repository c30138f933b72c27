"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one document of each.

Null text counts as empty, so all null and empty texts are copies of each other. The document that stays is
the one with the largest (or smallest) id; where only null ids occur, the null id. Rows that repeat both an id and a
text are one document given twice: each is reported, and in `deduplicated` one of them stays. Extra columns
are carried by `deduplicated` and ignored by `exact_dedup`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import checked, table, text_of, written

NAME = "op8_exact_dedup"


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.md5(text.cast("binary"))


def exact_dedup(docs: DataFrame, keep: str = "largest", content_hash=content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Groups move as (hash, count, id) rows that are summed before the shuffle. Texts move only for groups
    of two and more, as a minimum and a maximum summed before the shuffle as well: they are equal if and only
    if all texts of the group are. Groups where they differ (hash collisions) are grouped by the text itself.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    text = text_of(docs)
    slim = docs.select("doc_id", content_hash(text).alias("_h"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    full = docs.select("doc_id", content_hash(text).alias("_h"), text.alias("_t"))
    groups = slim.groupBy("_h").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    several = checked(written(groups.where("group_size > 1"), "several"))
    differ = full.join(several.select("_h"), "_h", "left_semi").groupBy("_h").agg(F.min("_t").alias("a"), F.max("_t").alias("b"))
    differ = written(differ.where("a <> b").select("_h"), "collided")
    # A text that occurs once needs no partner: only the groups of several are joined.
    stays = lambda found: found.join(several, "_h", "left").withColumn("keep_id", F.coalesce("keep_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    columns = ("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    if differ.isEmpty():
        return stays(slim).select(*columns)
    apart = full.join(differ, "_h", "left_semi")
    per_text = apart.groupBy("_t").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    clean = stays(slim.join(differ, "_h", "left_anti"))
    split = apart.join(per_text, "_t").withColumn("text_sha256", F.sha2(F.col("_t").cast("binary"), 256))
    return clean.select(*columns).unionByName(split.select(*columns))


def deduplicated(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts."""
    found = exact_dedup(docs, keep)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    dropped = checked(written(dropped, "dropped"))
    rest = docs.join(dropped, "doc_id", "left_anti")
    # Ids that are null or given twice do not name one row; only then texts are shuffled.
    unclear = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    return rest if unclear.isEmpty() else _one_of_each(docs, keep)


def _one_of_each(docs: DataFrame, keep: str) -> DataFrame:
    """One row of each text, chosen among those with the id that stays, without relying on ids to name rows."""
    best = {"largest": F.max_by, "smallest": F.min_by}[keep]
    least = F.lit(-(2**63) if keep == "largest" else 2**63 - 1)
    columns = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    whole = docs.select(text_of(docs).alias("_t"), F.struct(*columns).alias("_row"), F.coalesce(docs["doc_id"], least).alias("_id"))
    one = whole.groupBy("_t").agg(best("_row", "_id").alias("_row"))
    return one.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
