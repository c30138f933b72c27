"""Language identification: a bit-sliced Bloom filter tells all languages that contain an n-gram, popcounts decide.

A text's n-grams are all windows of four bytes of its lower-cased letters and marks, with one space for whatever stands between (and at both ends); a
text with fewer bytes has one. A language contains an n-gram if at least two of its sampled documents do and if its share of documents with it is at
least a tenth of the largest such share of any language, so that quotations in another language don't count.

All languages' filters share one array of slots: bit l of a slot belongs to language l, and the AND of an n-gram's slots is the set of all
languages that (perhaps) contain it, whatever their number. A language's number of n-grams in a text is a popcount of its bit. A filter whose share f of
slots is set says yes to a foreign n-gram with probability p = f^HASHES; so of n windows with c hits, (c - n p) / (n (1 - p)) are the
language's by expectation. The largest such share decides, and is the score (0 to 1); equal ones go to the more frequent, then the smaller language.

The filter is fitted on at most about ROWS documents of each language, sampled by a hash of the id; the array's size is bounded by SLOTS and
grows with the n-grams found. Its documents must have an id that learning may use (`learnable`), a text and a language.

Null texts and ones without a letter are `und` with score 0, and so is every text if there is nothing to learn from. A text without any known n-gram (by the filters) gets
the most frequent language with score 0. Null ids and repeated rows are answered like others but never learnt from (null) or learnt from each time.
Extra columns are kept; ones named lang_pred or score are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.shared import dropped, mix, row_slices, strings, table, tidy, written

NAME = "op11_language_id"
ORACLE_SQL = None

#: Bound of the sample, for each language.
ROWS = 2_000
#: Bytes in an n-gram, least number of documents with it, least share of the largest share.
GRAM, DOCUMENTS, SHARE = 4, 2, 0.1
#: Slots of an n-gram; slots for each n-gram of the largest language; most slots (a power of two).
HASHES, ROOM, SLOTS = 4, 10, 1 << 22
#: Languages in a word of the array.
WORD = 32
#: Bytes of text taken at once, divided among the words of languages.
SLICE = 2_000_000
UNKNOWN = "und"


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text: offsets, and the windows' bytes as numbers."""
    plain = pc.replace_substring_regex(pc.utf8_lower(strings(texts)), r"[^\p{L}\p{M}]+", " ")
    plain = pc.utf8_trim(plain, characters=" ")
    spaced = pc.binary_join_element_wise(*(pa.scalar(s, pa.large_string()) if s is not None else plain for s in ("", None, "", " ")))
    spaced = pc.if_else(pc.equal(plain, ""), pa.scalar("", pa.large_string()), spaced)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy(zero_copy_only=False))]).astype(np.int64)
    first = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset] if len(spaced) else 0
    data = spaced.buffers()[2] if len(spaced) else None
    flat = np.frombuffer(data, np.uint8)[first : first + ends[-1]] if data is not None else np.zeros(0, np.uint8)
    n = np.diff(ends)
    left = np.repeat(ends[1:], n) - np.arange(len(flat))
    window = np.zeros(len(flat), np.uint32)
    for k in range(GRAM):
        ahead = np.zeros(len(flat), np.uint32)
        ahead[: max(0, len(flat) - k)] = flat[k:]
        ahead[left <= k] = 0
        window |= ahead << np.uint32(8 * k)
    keep = (left >= GRAM) | ((np.repeat(n, n) < GRAM) & (left == np.repeat(n, n)))
    counts = np.where(n >= GRAM, n - GRAM + 1, (n > 0).astype(np.int64))
    return np.concatenate([[0], np.cumsum(counts)]), window[keep]


def slots_of(grams: np.ndarray, size: int) -> list[np.ndarray]:
    """The slots of each n-gram among `size`, a power of two."""
    mixed = mix(grams.astype(np.uint64), 3)
    at, step = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
    return [((at + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """The languages' filters as one array of slots: (words, slots), a bit for each language."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots
        kind = np.uint8 if len(languages) <= 8 else np.uint32
        self.slots = slots.astype(kind)
        bits = self.bits(self.slots.T)
        filled = bits.mean(axis=0, dtype=np.float64) if len(bits) else np.zeros(len(languages))
        self.wrong = np.minimum(filled, 0.999) ** HASHES

    def bits(self, words: np.ndarray) -> np.ndarray:
        """Words of languages (rows, words) as rows of single bits, one for each language."""
        flat = np.ascontiguousarray(words.astype(words.dtype.newbyteorder("<"))).view(np.uint8).reshape(len(words), -1)
        return np.unpackbits(flat, axis=1, bitorder="little")[:, : len(self.languages)]

    def shares(self, texts: pa.Array) -> np.ndarray:
        """The corrected share of each text's n-grams that each language contains (may be negative): (texts, languages)."""
        ends, grams = grams_of(texts)
        n = np.diff(ends)
        # Every distinct slot tuple is looked up as it comes: the AND over an n-gram's slots is its set of languages.
        sets = None
        for at in slots_of(grams, self.slots.shape[1]):
            own = self.slots[:, at]
            sets = own if sets is None else sets & own
        hits = np.zeros((len(n), len(self.languages)), np.int64)
        some = np.flatnonzero(n > 0)
        if len(some):
            hits[some] = np.add.reduceat(self.bits(sets.T), ends[:-1][some], axis=0, dtype=np.int64)
        total = np.maximum(n, 1)[:, None]
        return (hits - n[:, None] * self.wrong) / (total * (1 - self.wrong))

    def decided(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Language and score of each text."""
        shares = self.shares(texts)
        best = np.argmax(np.round(shares, 12), axis=1)
        score = np.clip(shares[np.arange(len(best)), best], 0, 1)
        best = np.where(score > 0, best, 0)  # the most frequent language comes first
        return pa.array(self.languages, pa.string()).take(pa.array(best)), score


def _document_grams(batches):
    """(language, n-gram, documents) of each slice of sampled texts."""
    for batch in batches:
        for part in row_slices(batch, "text", SLICE):
            ends, grams = grams_of(part.column("text"))
            row = np.repeat(np.arange(part.num_rows), np.diff(ends)).astype(np.uint64)
            each = np.unique(row << np.uint64(32) | grams.astype(np.uint64))
            language = part.column("language").to_numpy()[(each >> np.uint64(32)).astype(np.int64)].astype(np.uint64)
            seen, n = np.unique(language << np.uint64(32) | (each & np.uint64(0xFFFFFFFF)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((seen >> np.uint64(32)).astype(np.int32)), pa.array((seen & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["language", "gram", "n"])


def train(docs: DataFrame, learnable: Column | None = None) -> Filters | None:
    """Filters fitted on the documents (doc_id, text, lang) that `learnable` holds for. Only the bounded array of slots reaches the driver."""
    spark = docs.sparkSession
    may = ~held_out() if learnable is None else learnable
    known = docs.where(may & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    numbers = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not numbers:
        return None
    languages = sorted(numbers, key=lambda x: (-numbers[x], x))
    names = spark.createDataFrame([(x, i, ROWS / numbers[x]) for i, x in enumerate(languages)], "lang string, language int, share double")
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    # One small row for each language.
    sample = known.join(F.broadcast(names), "lang").where(place < F.col("share")).select("language", "doc_id", "text")
    sample = written(sample, "languages")
    sampled = {r["language"]: r["count"] for r in sample.groupBy("language").count().collect()}
    of = F.element_at(F.create_map(*(F.lit(x) for pair in (sampled or {0: 1}).items() for x in pair)), F.col("language"))
    counted = sample.select("language", "text").mapInArrow(tidy(_document_grams), "language int, gram long, n long").groupBy("gram", "language").agg((F.sum("n")).alias("n"))
    shared = counted.withColumn("of_all", F.col("n") / of).withColumn("most", F.max("of_all").over(Window.partitionBy("gram")))
    held = written(shared.where((F.col("n") >= DOCUMENTS) & (F.col("of_all") >= SHARE * F.col("most"))).select("gram", "language"), "grams")
    dropped(sample)
    most = max([r["count"] for r in held.groupBy("language").count().collect()], default=0)
    words = -(-len(languages) // WORD)
    bound = SLOTS // (1 << (words - 1).bit_length())  # the whole array is bounded, however many languages there are
    size = max(64, min(bound, 1 << (max(most * ROOM, 1) - 1).bit_length()))

    def slots(batches):
        for batch in batches:
            grams, language = batch.column("gram").to_numpy().astype(np.uint32), batch.column("language").to_numpy()
            for at in slots_of(grams, size):
                yield pa.RecordBatch.from_arrays([pa.array(language // WORD), pa.array(at), pa.array(1 << (language % WORD).astype(np.int64))], ["word", "slot", "bits"])

    filled = held.mapInArrow(tidy(slots), "word int, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    array = np.zeros((words, size), np.uint32)
    array[filled.column("word").to_numpy(), filled.column("slot").to_numpy()] = filled.column("bits").to_numpy()
    dropped(held)
    return Filters(languages, array)


def identified(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """docs' columns with lang_pred and score beside; one pass over the texts, no shuffle."""
    taken = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    text = F.col("text").cast("string")
    if filters is None:
        return docs.select(*taken, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by SLOTS
    most = max(50_000, SLICE // len(filters.slots))

    def run(batches):
        for batch in batches:
            for part in row_slices(batch, "_text", most):
                found, score = sent.value.decided(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("_row"), found, pa.array(score)], ["_row", "lang_pred", "score"])

    # The row travels as one struct, so its columns' names don't matter.
    row = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(taken)), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    packed = docs.select(text.alias("_text"), row.alias("_row"))
    found = packed.mapInArrow(tidy(run), f"_row {packed.schema['_row'].dataType.simpleString()}, lang_pred string, score double")
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    lettered = F.col("_row.lettered")
    return found.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)), F.when(lettered, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(lettered, F.col("score")).otherwise(0.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = train(docs)
    return identified(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
