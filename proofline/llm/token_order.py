"""Token-ID output in training order: a keyed Feistel permutation gives every sequence a global slot; range partitions hold fixed-stride shards.

Documents are tokenised (the BPE encoder of this subpackage), end with an end id and, task by task, form a stream that is cut into
sequences of LENGTH ids of two bytes; a task's last sequence is filled up with the end id. Sequences are numbered without gaps by
their task and place (so which texts share a sequence follows the split of the input into tasks); a Feistel network over the next power of four, walked until it falls below their number, permutes
the numbers. Slot s lies in shard s // SLOTS at byte (s % SLOTS) * 2 * LENGTH, so a reader resumes at any slot by
seeking, and another key gives another epoch's order.

Null text counts as empty: only the end id. Null ids, repeated rows and texts of any length are taken like others; extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.bpe import FILE, encoder
from proofline.llm.shared import BROADCAST_ROWS, mix, row_slices, table, tidy, written

NAME = "op2_token_order"
ORACLE_SQL = None

LENGTH, END, SLOTS, KEY, FEISTEL_ROUNDS = 2048, 50256, 2048, 20260101, 6


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of numbers (0 <= number < n) in the permutation of 0..n-1 that the key picks."""
    half = np.uint64(max((max(n - 1, 1).bit_length() + 1) // 2, 1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in range(FEISTEL_ROUNDS):
            left, right = right, left ^ (mix(right ^ np.uint64(key), k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, name: str = FILE, length: int = LENGTH, end: int = END) -> DataFrame:
    """task, number (within the task), n_tokens (without what fills up) and ids (2 * length bytes, little-endian) of every sequence."""
    names = ["task", "number", "n_tokens", "ids"]

    def batches(source):
        task, number, rest = TaskContext.get().partitionId(), 0, np.zeros(0, "<u2")

        def cut(stream: np.ndarray):
            n = len(stream) // length
            ends = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * np.int32(2 * length)).tobytes())
            each = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(stream[: n * length].tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, task)), pa.array(np.arange(number, number + n)), pa.array(np.full(n, length)), each], names)

        for batch in source:
            for part in row_slices(batch, "text"):
                offsets, ids = encoder(name)(part.column("text"))
                # Behind the last ids and a gap for each text's end id.
                stream = np.full(len(rest) + len(ids) + len(offsets) - 1, end, "<u2")
                stream[: len(rest)] = rest
                stream[len(rest) + np.arange(len(ids)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = ids
                out = cut(stream)
                rest = stream[out.num_rows * length :]
                number += out.num_rows
                yield out
        if len(rest):
            data = np.concatenate([rest, np.full(length - len(rest), end, "<u2")]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([number]), pa.array([len(rest)]), pa.array([data], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(batches), "task long, number long, n_tokens long, ids binary")


def in_training_order(docs: DataFrame, key: int = KEY, slots: int = SLOTS, **options) -> DataFrame:
    """One row for each slot: slot, shard, offset (bytes within the shard), n_tokens, ids. Each partition is one shard in slot order.

    Tokens are written once, so that the numbers of sequences by task, all that reaches the driver, and the shards come from the same ones.
    """
    spark = docs.sparkSession
    made = written(sequences(docs, **options), "sequences", compression="zstd")
    counts = made.groupBy("task").count().orderBy("task").collect()
    before = np.concatenate([[0], np.cumsum([r["count"] for r in counts])]).astype(np.int64)
    n = int(before[-1])
    first = spark.createDataFrame([(r["task"], int(b)) for r, b in zip(counts, before, strict=False)], "task long, first long")
    first = F.broadcast(first) if len(counts) <= BROADCAST_ROWS else first

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, key))

    placed = made.join(first, "task").withColumn("slot", slot(F.col("first") + F.col("number")))
    shard = F.floor(F.col("slot") / slots)
    dealt = placed.repartitionById(max(1, -(-n // slots)), shard.cast("int")).sortWithinPartitions("slot")
    return dealt.select("slot", shard.alias("shard"), (F.pmod("slot", F.lit(slots)) * F.length("ids")).alias("offset"), "n_tokens", "ids")


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Writes every shard as one file of back-to-back ids in `folder` (a path or URI that all executors reach); returns shard, file, first slot, slots.

    A shard appears under its name only when complete, so a task that runs again or twice does no harm.
    """

    def batches(source):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        open_, first, n, shard = None, 0, 0, None
        attempt = TaskContext.get().taskAttemptId()

        def closed():
            open_.close()
            store.move(f"{base}/.{shard:06d}-{attempt}", f"{base}/{shard:06d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([f"{folder}/{shard:06d}.bin"]), pa.array([first]), pa.array([n])], ["shard", "file", "first_slot", "slots"])

        for batch in source:
            for s, k, ids in zip(batch.column("shard").to_pylist(), batch.column("slot").to_pylist(), batch.column("ids"), strict=True):
                if s != shard:
                    if open_ is not None:
                        yield closed()
                    open_, first, n, shard = store.open_output_stream(f"{base}/.{s:06d}-{attempt}"), k, 0, s
                open_.write(ids.as_buffer())
                n += 1
        if open_ is not None:
            yield closed()

    return ordered.select("slot", "shard", "ids").mapInArrow(batches, "shard long, file string, first_slot long, slots long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_training_order(table(spark, sf_dir, "documents"))
