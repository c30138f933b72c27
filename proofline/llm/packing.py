"""Packing: estimate each piece's linear plus quadratic attention cost, assign in descending order to the cheapest sequence with room.

Documents are tokenised by the tokenizers library (each distinct space-separated piece once), end with an end id, and are cut into
pieces of at most one sequence. Each task packs what it has read, block by block of BLOCK tokens: a block
gets as many sequences as its tokens fill, and pieces, largest first, go to the sequence of the lowest cost that has room for them. A
piece for which none has room is cut between the cheapest ones. What is left over at a task's end goes to sequences whose
lengths are powers of two. So no sequence needs padding, nothing is shuffled, and a lost task is simply run again.

Null text counts as empty: one piece, the end id. Null ids, repeated rows and texts of any length are packed like others;
extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from proofline.llm.bpe import Remembered, tokenizer_path
from proofline.llm.shared import list_parts, row_slices, strings, table, tidy

NAME = "op4_packing"
ORACLE_SQL = None
FILE = "word_bpe_49k.json"
LENGTH = 4096
END = 2
#: Tokens packed at once: enough for even costs, few enough for a Python worker's memory.
BLOCK = 256 * LENGTH
#: Pieces remembered by a Python worker that does nothing else, some 200 MB at most; many are seen again.
REMEMBERED = 600_000
#: As many by default while packing, where a worker may have other operators' memory beside it, and bytes of text encoded at once; with more of them it is faster.
REMEMBERED_HERE, SLICE = 60_000, 1_000_000
#: Relative costs of a token and of a pair of tokens of one document, as of a layer of width 1024.
LINEAR, QUADRATIC = 1.0, 1.0 / (12 * 1024)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, for vocabularies whose tokens never cross white space."""

    def __init__(self, name: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered = Remembered(self.pieces, most=most)

    def pieces(self, new: list[str]) -> list[list[int]]:
        """Some pieces at a time, as what the library returns for each takes far more memory than its ids; places in the text aren't asked for."""
        return [x.ids for k in range(0, len(new), 2_000) for x in self.tokenizer.encode_batch_fast(new[k : k + 2_000], add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.replace_substring(strings(texts), "\n", " ")
        # A pre-token ends between a letter or digit and a mark, so a space there changes nothing, except within a special token.
        parted = pc.replace_substring_regex(plain, "([A-Za-z0-9])([.,!?;:#$%&*])", r"\1 \2")
        offsets, pieces = list_parts(pc.split_pattern(pc.if_else(pc.match_substring(plain, "<|"), plain, parted), " "))
        size, ids = self.remembered(pieces)
        return np.concatenate([[0], np.cumsum(size)])[offsets], ids


@functools.cache
def encoder(name: str, most: int = REMEMBERED) -> LibraryEncoder:
    """One for each Python worker, vocabulary and number of pieces remembered."""
    return LibraryEncoder(name, most)


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def assigned(sizes: list[int], rooms: list[int]) -> list[tuple[int, int, int, int]]:
    """(piece, its first token, number of tokens, sequence): every piece, cut where it must be, into sequences with these
    rooms, which together hold all. Deterministic: ties go to the earlier piece and sequence."""
    costs, room = np.zeros(len(rooms)), np.array(rooms, np.int64)
    out: list[tuple[int, int, int, int]] = []

    def put(piece: int, at: int, n: int, k: int) -> None:
        out.append((piece, at, n, k))
        costs[k] += cost(n)
        room[k] -= n

    late = []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[piece]
        k = int(np.argmin(np.where(room >= n, costs, np.inf)))
        if room[k] >= n:
            put(piece, 0, n, k)
        else:
            late.append(piece)
    heap = [(costs[k], k) for k in np.flatnonzero(room)]
    heapq.heapify(heap)
    for piece in late:
        at = 0
        while at < sizes[piece]:
            _, k = heapq.heappop(heap)
            n = int(min(room[k], sizes[piece] - at))
            put(piece, at, n, k)
            at += n
            if room[k]:
                heapq.heappush(heap, (costs[k], k))
    return out


def rooms(total: int, length: int, last: bool) -> list[int]:
    """Sizes of sequences for so many tokens: full ones and, at the end, descending powers of two."""
    full, rest = divmod(total, length)
    return [length] * full + ([1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1] if last else [])


class Packer:
    """Gathers documents' ids and gives back packed pieces, block by block."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.docs: list[tuple] = []  # id, number of its tokens, first token here, ids
        self.total = 0

    def add(self, doc_id, tokens: int, at: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, tokens, at, ids))
        self.total += len(ids)

    def packed(self, last: bool) -> pa.RecordBatch:
        """What has been gathered; before the last block, the tokens beyond full sequences wait."""
        keep = 0 if last else self.total % self.length
        rest = []
        while keep:
            doc_id, tokens, at, ids = self.docs.pop()
            n = min(keep, len(ids))
            rest.append((doc_id, tokens, at + len(ids) - n, ids[len(ids) - n :]))
            if n < len(ids):
                self.docs.append((doc_id, tokens, at, ids[: len(ids) - n]))
            keep -= n
        pieces = [(d, t, at + k, ids[k : k + self.length]) for d, t, at, ids in self.docs for k in range(0, len(ids), self.length)]
        size = rooms(sum(len(p[3]) for p in pieces), self.length, last)
        filled, costs, rows = [0] * len(size), [0.0] * len(size), []
        for piece, first, n, k in assigned([len(p[3]) for p in pieces], size):
            doc_id, tokens, at, ids = pieces[piece]
            own = np.ascontiguousarray(ids[first : first + n], "<u4")
            rows.append((doc_id, at + first, n, zlib.crc32(own.tobytes()), tokens, self.sequence + k, filled[k], k))
            filled[k] += n
            costs[k] += cost(n)
        self.sequence += len(size)
        self.docs, self.total = rest[::-1], sum(len(r[3]) for r in rest)
        columns = list(zip(*rows, strict=True)) or [()] * 8
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array([costs[k] for k in columns[7]], pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])


def pack(docs: DataFrame, name: str = FILE, length: int = LENGTH, end: int = END, block: int = BLOCK, remembered: int = REMEMBERED_HERE, slice_bytes: int = SLICE) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, and its sequence's estimated cost."""

    def batches(source):
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        for batch in source:
            for part in row_slices(batch, "text", slice_bytes):
                offsets, ids = encoder(name, remembered)(part.column("text"))
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end))
                    packer.add(doc_id, len(own), 0, own)
                    if packer.total >= block:
                        yield packer.packed(last=False)
        encoder(name, remembered).remembered.forget()
        yield packer.packed(last=True)

    return docs.select("doc_id", "text").mapInArrow(tidy(batches), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), remembered=REMEMBERED, slice_bytes=4 * SLICE)
