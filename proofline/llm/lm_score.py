"""LM scoring: stupid-backoff scores from n-gram count tables partitioned by hash, joined to each document's own n-grams and summed.

The corpus is dealt into slices of about SLICE bytes by a hash of the row. Each slice sends its distinct n-grams with their counts,
sorted by hash and cut at the borders of the hash partitions, to those partitions; there the counts of all slices are
summed (the count tables) and each slice gets back the totals of what it has sent, in the order in which it sent them. With
these the slice scores its documents. So every n-gram moves once for each slice that has it, however common it is, and no
task holds more than a slice or a hash partition.

A document is scored by what the others say: its own counts are taken off. For word w after v with counts c:
S = c(vw) / c(v) if c(vw) > 0, else BACKOFF * c(w) / N if c(w) > 0, else BACKOFF * BACKOFF / N; the score is the mean natural logarithm. A text's first word
follows an opening mark, whose count is the number of texts with words.

The tables are exchanged as sorted arrays for each pair of slice and hash partition, not as a row for each n-gram: with a row for
each (n-gram, document) the exchange alone exceeds four times the input's disk (figures in the README), and so do trigrams in this form.

Words are lower-cased runs without white space. Null and empty texts have no words and a null score; in a corpus of one document every
word is unseen. Null ids and repeated rows are scored like others, each as one of its copies; extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd  # noqa: F401  (Arrow groups need it installed)
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import mix, table, text_of, tidy, word_hashes, written

NAME = "op5_lm_score"
ORACLE_SQL = None

BACKOFF = 0.4
SLICE = 8_000_000
OPENING = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the texts' words, and the hashes of each word and of each pair of a word with its left neighbour (at a text's start, an opening mark)."""
    offsets, words = word_hashes(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    left = np.concatenate([[OPENING], words[:-1]]) if len(words) else words
    left[offsets[:-1][np.diff(offsets) > 0]] = OPENING
    with np.errstate(over="ignore"):
        return offsets, mix(words, 1), mix(mix(left, 2) + words, 3)


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of words and pairs together, each place's index among them, and their counts."""
    return np.unique(np.concatenate([one, two]), return_inverse=True, return_counts=True)


def borders(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash partition begins among sorted hashes."""
    at = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(at, np.uint64)), [len(keys)]])


def packed(keys: np.ndarray) -> bytes:
    """Sorted hashes as their first and the steps between them, in six bytes where these suffice."""
    steps = np.diff(keys, prepend=np.uint64(0))
    wide = len(steps) > 1 and int(steps[1:].max()) >> 48
    rest = steps[1:].astype("<u8").tobytes() if wide else steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return bytes([bool(wide)]) + int(steps[0]).to_bytes(8, "little") + rest


def unpacked(data: bytes) -> np.ndarray:
    size = 8 if data[0] else 6
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, size)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :size] = rest
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts, most of which are small, as deflated 64-bit numbers."""
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def _squeezed(batches):
    """Texts travel compressed: they cross the network twice."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        z = pa.array([squeeze(t.as_buffer()) for t in batch.column("text").cast(pa.large_binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), z, batch.column("slice")], ["doc_id", "z", "slice"])


def _texts(column: pa.ChunkedArray) -> pa.Array:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return pa.array([open_(z.as_buffer()).decode("utf-8") for z in column], pa.large_string())


def _sent(parts: int):
    def per_slice(part: pa.Table) -> pa.Table:
        offsets, one, two = grams(_texts(part.column("z")))
        keys, _, counts = distinct(one, two)
        cut = borders(keys, parts)
        some = np.flatnonzero(np.diff(cut))
        number = part.column("slice")[0].as_py()
        return pa.table(
            {
                "slice": pa.array(np.full(len(some), number, np.int64)),
                "part": pa.array(some.astype(np.int64)),
                "grams": pa.array([packed(keys[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                "counts": pa.array([_small(counts[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
            }
        )

    return per_slice


def _totals(part: pa.Table) -> pa.Table:
    """The partition's count table, joined back to what each slice has sent."""
    keys = [unpacked(x) for x in part.column("grams").to_pylist()]
    counts = [_large(x) for x in part.column("counts").to_pylist()]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts)).astype("<i8")
    ends = np.cumsum([len(k) for k in keys])
    back = [_small(total[x]) for x in np.split(back, ends[:-1])]
    return pa.table({"slice": part.column("slice"), "part": part.column("part"), "totals": pa.array(back, pa.binary())})


def mean_logs(offsets: np.ndarray, one: np.ndarray, two: np.ndarray, totals: np.ndarray, words: int, texts: int) -> np.ndarray:
    """Mean log score of each text; totals: counts of distinct(one, two) in the whole corpus of so many words and texts with words."""
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    _, index, _ = distinct(one, two)
    w, pair = index[: len(one)], index[len(one) :]
    own = lambda x: _within(text, x)
    c_w, c_pair = totals[w] - own(w), totals[pair] - own(pair)
    # The context's count: that of the word before; at a text's start, the other texts.
    first = np.zeros(len(one), bool)
    first[offsets[:-1][n > 0]] = True
    c_before = np.concatenate([[0], c_w[:-1]])
    rest = (words - n[text]).astype(np.float64)
    c_before = np.where(first, texts - 1, c_before)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(c_pair > 0, np.log(c_pair) - np.log(np.maximum(c_before, 1)), np.where(c_w > 0, np.log(BACKOFF) + np.log(np.maximum(c_w, 1)) - np.log(np.maximum(rest, 1)), 2 * np.log(BACKOFF) - np.log(np.maximum(rest, 1))))
    return np.where(n > 0, np.bincount(text, logs, len(n)) / np.maximum(n, 1), np.nan)


def _within(text: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How often each place's entry occurs in its own text."""
    _, back, counts = np.unique(text.astype(np.int64) << 32 | x.astype(np.int64), return_inverse=True, return_counts=True)
    return counts[back]


def _scored(words: int, texts: int):
    def per_slice(docs: pa.Table, totals: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        offsets, one, two = grams(_texts(docs.column("z")))
        ordered = totals.sort_by("part").column("totals").to_pylist()
        scores = mean_logs(offsets, one, two, np.concatenate([np.zeros(0, np.int64), *map(_large, ordered)]), words, texts)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(np.diff(offsets)), "score": pa.array(scores, pa.float64(), from_pandas=True)})

    return per_slice


def _words_in(batches):
    for batch in batches:
        offsets, _ = word_hashes(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([int(offsets[-1])]), pa.array([int((np.diff(offsets) > 0).sum())])], ["n", "texts"])


def lm_score(docs: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, n_words and score of every document; higher is likelier."""
    text = text_of(docs)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    # Distinct n-grams of a hash partition are about as many as a slice's, so there are as many partitions as slices.
    dealt = docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(slices)).alias("slice"))
    dealt = dealt.mapInArrow(tidy(_squeezed), "doc_id long, z binary, slice long")
    said = docs.select(text.alias("text")).mapInArrow(tidy(_words_in), "n long, texts long").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).first()
    words, texts = said["n"] or 0, said["texts"] or 0
    sent = dealt.groupBy("slice").applyInArrow(_sent(slices), "slice long, part long, grams binary, counts binary")
    back = written(sent.groupBy("part").applyInArrow(_totals, "slice long, part long, totals binary"), "totals", compression="zstd")
    return dealt.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(_scored(words, texts), "doc_id long, n_words long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
