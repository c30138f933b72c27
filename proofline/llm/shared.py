"""What several corpus operators need: shared storage, checked broadcasts, word arrays."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as Parquet) of a key table up to which it is broadcast; beyond either, the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session whose tasks run in this process may go without: it gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="proofline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    freed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def freed(spark: SparkSession) -> None:
    """Shuffle files of what nobody refers to any more go now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        at, store = _place(df.sparkSession, df._written_at)
        store.delete(at, True)


def checked(keys: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """keys (a written table), marked for broadcast if it is small enough in rows and bytes; else as it is, and joins shuffle."""
    at, store = _place(keys.sparkSession, keys._written_at)
    return F.broadcast(keys) if store.getContentSummary(at).getLength() <= most and keys.limit(rows + 1).count() <= rows else keys


def tidy(batches):
    """A batch function that gives a worker's memory back at its task's end: the worker lives on, and other operators need it."""

    @functools.wraps(batches)
    def run(source):
        try:
            yield from batches(source)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def unused(docs: DataFrame, name: str) -> str:
    """name, or with underscores before it as long as docs has such a column (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(docs: DataFrame) -> Column:
    """The whole text, null as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) on uint64 values, wrapping."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def list_parts(x: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the flat values of a list array without nulls."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    offsets = x.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], x.values.slice(offsets[0], offsets[-1] - offsets[0])


def strings(column: pa.Array) -> pa.Array:
    """A string column with 64-bit offsets, nulls as empty: any number of very long texts fits."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words (runs without Unicode white space) of each text, lower-cased: offsets and a 64-bit hash of each."""
    import xxhash

    offsets, flat = list_parts(pc.utf8_split_whitespace(pc.utf8_lower(strings(texts))))
    # A text with white space at an end yields empty pieces, which are no words.
    encoded = flat.dictionary_encode()
    uniques = encoded.dictionary.to_numpy(zero_copy_only=False)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, uniques), np.uint64, len(uniques))
    real = pc.binary_length(encoded.dictionary).to_numpy(zero_copy_only=False) > 0
    codes = encoded.indices.to_numpy()
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[offsets], hashed[codes[keep]]


def shingle_hashes(offsets: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `size` consecutive words of each text. A text with fewer words, but some, has one shingle of them all."""
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - offsets[rows]
    left = n[rows] - place
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):  # what lies past the text's end adds nothing: only its one short shingle has such
            ahead = np.zeros(len(words), np.uint64)
            ahead[: max(0, len(words) - k)] = words[k:]
            ahead[left <= k] = 0
            out = mix(out + ahead, k)
    keep = (left >= size) | ((n[rows] < size) & (place == 0))
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    return np.concatenate([[0], np.cumsum(counts)]), out[keep]


def row_slices(table_: pa.RecordBatch, column: str, most_bytes: int = 4_000_000):
    """Slices of a batch with about `most_bytes` of text each, so that memory holds whatever the texts' lengths are."""
    size = pc.fill_null(pc.binary_length(table_.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, n = 0, table_.num_rows
    total = np.cumsum(size)
    while start < n:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
        yield table_.slice(start, stop - start)
        start = stop


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else os.fspath(path)


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """doc_id and text, for operators that speak of documents by id: rows without an id are left out, and of rows that
    repeat an id the greatest text counts. Texts are shuffled only if ids do repeat."""
    named = docs.where(docs["doc_id"].isNotNull()).select("doc_id", text_of(docs).alias("text"))
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        return named
    return named.groupBy("doc_id").agg(F.max("text").alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """node and class_id (the component's smallest node) of every node of the edges a, b, by alternating large and small stars.

    Every round is a few joins over the edges, written in the shared folder; nothing is collected.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("class_id"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("class_id")).distinct())
