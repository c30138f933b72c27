"""Ranked lexical search: the documents that score highest for each item, in exact integers.

Terms are maximal runs of digits, ASCII letters (A-Z lower-cased) and code points from U+0080. With N documents that have a term, L terms
in all of them, n terms in one, df documents holding a term and tf of its occurrences in one, a term weighs
w = floor(1000 ln((2N + 2) / (2df + 1))), a document's length is m = 25 + (75 n N) div L hundredths of the mean, and a document's score for an
item is the sum of w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included.

Items are taken in blocks of bounded size. One pass over the texts keeps, for each document, its length and the counts of the block's terms
(a table in the shared folder); N, L and every df are summed from it. The second pass accumulates by sorting: for a slice of documents, the items of every matched term
are written after each other as packed keys (item, document) with their impacts, the keys are radix-sorted, and sums at their borders (`reduceat`) are the
scores. A document lies in one task, so keys are parted by ranges of documents and no impact is ever shuffled. Each task
heap-selects its best of every item; these few rows meet in two steps, in salted parts and then by item.

Null and empty texts have no terms. Items and documents without an id can't be named and are left out; of rows that repeat an id the greatest text counts.
Items without a term of any document, and all if there are no documents, have no rows. Equal scores are ranked by doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.shared import dropped, freed, list_parts, one_text_per_id, row_slices, strings, table, text_of, tidy, written

NAME = "op12_lexical_search"
TOP = 10
#: Bytes of item text in a block: what is broadcast, and how many items a task keeps heaps for, are bounded by it.
BLOCK = 2_000_000
#: Bytes of text, and (item, document, impact) entries, taken at once.
SLICE, ENTRIES = 4_000_000, 2_000_000
#: Parts in which an item's rows from all tasks first meet.
SALTS = 64

ORACLE_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT doc_id, len(terms) AS n FROM lowered WHERE len(terms) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
asked AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
posted AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM lowered) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posted, corpus GROUP BY term),
scored AS (
  SELECT item_id, p.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM posted p JOIN weighed USING (term) JOIN asked USING (term) JOIN sized USING (doc_id), corpus GROUP BY item_id, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

#: What becomes of each byte: those of terms stay, A-Z lower-cased, all others are spaces. Bytes from 0x80 belong to code points from U+0080.
_BYTES = np.array([b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The terms of each text: offsets, and the terms themselves as a dictionary."""
    whole = strings(texts)
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = whole.buffers()[2]
    plain = _BYTES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    spaced = pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(plain))
    starts, flat = list_parts(pc.ascii_split_whitespace(spaced))
    real = pc.not_equal(pc.binary_length(flat), 0)  # a space at either end makes an empty piece
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return before[starts], flat.filter(real).dictionary_encode()


class Block:
    """A block's items: their ids, the distinct terms, and the items that have each term, with the number of times."""

    def __init__(self, rows: pa.Table):
        item, term, times = (rows.column(c) for c in ("item_id", "term", "times"))
        self.items, place = np.unique(item.to_numpy(), return_inverse=True)
        coded = term.combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.terms = coded.dictionary.cast(pa.large_string())
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.item, self.times = place[order].astype(np.int64), times.to_numpy()[order]
        self.first = np.searchsorted(code[order], np.arange(len(self.terms) + 1))


def _item_terms(batches):
    for batch in batches:
        for part in row_slices(batch, "text", SLICE):
            offsets, terms = terms_of(part.column("text"))
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            width = max(len(terms.dictionary), 1)
            seen, times = np.unique(row * width + terms.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(seen // width)), terms.dictionary.take(pa.array(seen % width)).cast(pa.string()), pa.array(times)], ["item_id", "term", "times"])


def _postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """doc_id, number of terms, and the block's terms in the document (places in the block) with their counts, of every document that has a term."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        wanted = sent.value
        for batch in batches:
            for part in row_slices(batch, "text", SLICE):
                offsets, found = terms_of(part.column("text"))
                n, width = np.diff(offsets), max(len(wanted), 1)
                code = pc.fill_null(pc.index_in(found.dictionary, wanted), -1).to_numpy(zero_copy_only=False)[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(n)), n)
                seen, tf = np.unique((row * width + code)[code >= 0], return_counts=True)
                ends = np.searchsorted(seen // width, np.arange(len(n) + 1)).astype(np.int32)
                listed = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (seen % width, tf)]
                kept = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([x.filter(kept) for x in (part.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), *listed)], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, terms array<int>, tfs array<int>")


def _document_counts(batches):
    """Rows of postings to (term, documents holding it), one row a term and batch; term -1 counts documents, -2 their terms."""
    for batch in batches:
        flat = list_parts(batch.column("terms"))[1].to_numpy()
        df = np.bincount(flat) if len(flat) else np.zeros(0, np.int64)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([df[held], [batch.num_rows, batch.column("n").to_numpy().sum()]]).astype(np.int64))], ["term", "df"])


def radix_sorted(key: np.ndarray, bits: int) -> np.ndarray:
    """The order that sorts keys of so many bits, 16 bits a pass from the lowest: equal keys stay as they stand."""
    order = None
    for shift in range(0, max(bits, 1), 16):
        digit = ((key if order is None else key[order]) >> shift).astype(np.uint16)
        place = np.argsort(digit, kind="stable")  # numpy's stable sort of 16-bit numbers is a radix sort
        order = place if order is None else order[place]
    return order


def accumulated(block: Block, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of a slice, ordered by item and document. ends: where each document's terms begin in `terms`; impact: of each of these."""
    n = (block.first[1:] - block.first[:-1])[terms]
    at = np.repeat(block.first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    doc = np.repeat(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), n)
    # Packed keys: the document's digits are the lower ones, and entries come by document, so that their passes are done.
    low = max(int(len(ends) - 2).bit_length(), 1)
    key, worth = block.item[at] << low | doc, np.repeat(impact, n) * block.times[at]
    order = radix_sorted(key >> low, len(block.items).bit_length())
    key, worth = key[order], worth[order]
    if not len(key):
        return key, key, worth
    border = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[border] >> low, key[border] & ((1 << low) - 1), np.add.reduceat(worth, border)


class Best:
    """The best documents of each item so far, a heap each: higher scores first, then smaller ids."""

    def __init__(self, items: int, top: int):
        self.top, self.heaps, self.least = top, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        may = score >= self.least[item]  # a full heap's least score: most fall short of it
        item, doc, score = item[may], doc[may], score[may]
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.searchsorted(item, item)
        few = np.arange(len(item)) - first < self.top
        for i, d, s in zip(item[few].tolist(), doc[few].tolist(), score[few].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, (s, -d))
            else:
                heapq.heappushpop(heap, (s, -d))
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def batch(self, items: np.ndarray) -> pa.RecordBatch:
        rows = [(i, -d, s) for i, heap in zip(items.tolist(), self.heaps, strict=True) for s, d in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item_id", "doc_id", "score"])


def _ranked(posted: DataFrame, block: Block, weights: np.ndarray, documents: int, terms_: int, top: int) -> DataFrame:
    sent = posted.sparkSession.sparkContext.broadcast((block, weights))
    fan = np.diff(block.first)

    def run(batches):
        block, weights = sent.value
        best = Best(len(block.items), top)
        for batch in batches:
            ends, terms = list_parts(batch.column("terms"))
            terms, tf = terms.to_numpy(), list_parts(batch.column("tfs"))[1].to_numpy().astype(np.int64)
            ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            m = 100 - 75 + 75 * n * documents // max(terms_, 1)
            impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends))))
            size = np.concatenate([[0], np.cumsum(fan[terms])])[ends]
            start = 0
            while start < len(ids):
                stop = max(start + 1, int(np.searchsorted(size, size[start] + ENTRIES, side="right")) - 1)
                item, doc, score = accumulated(block, ends[start : stop + 1] - ends[start], terms[ends[start] : ends[stop]], impact[ends[start] : ends[stop]])
                best.add(item, ids[start + doc], score)
                start = stop
        yield best.batch(block.items)

    return posted.mapInArrow(tidy(run), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    docs = one_text_per_id(docs)
    named = items.where(items["item_id"].isNotNull()).groupBy(items["item_id"].cast("long").alias("item_id")).agg(F.max(text_of(items)).alias("text"))
    asked = written(named, "items")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    found = []
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).mapInArrow(tidy(_item_terms), "item_id long, term string, times long").toArrow()
        if not rows.num_rows:
            continue
        block = Block(rows)
        posted = written(_postings(docs, block.terms), "postings")
        counts = posted.select("n", "terms").mapInArrow(tidy(_document_counts), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = dict(zip(counts.column("term").to_pylist(), counts.column("df").to_pylist(), strict=True))
        documents, terms_ = df.get(-1, 0), df.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(block.terms))], np.int64)
        found.append(written(_ranked(posted, block, weights, documents, terms_, top).withColumn("salt", F.spark_partition_id() % SALTS), "best"))
        dropped(posted)
    dropped(asked)
    freed(spark)
    best = found[0] if found else spark.createDataFrame([], "item_id long, doc_id long, score long, salt int")
    for more in found[1:]:
        best = best.unionByName(more)
    order = (F.desc("score"), F.asc("doc_id"))
    for keys in (("item_id", "salt"), ("item_id",)):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
