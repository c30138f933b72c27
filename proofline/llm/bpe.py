"""BPE encoding and decoding.

Encoder: the longest vocabulary entry at a place comes from an Aho-Corasick automaton; a backtracking walk takes such entries from
left to right, checking each neighbour pair against a compatibility table (two tokens may stand together if merging
their bytes anew gives the same two), and so finds the exact merge result in time linear in the word. Decoder: all
tokens' bytes lie in one buffer with an offset table.

Texts are cut into pieces at single spaces and line ends, where pre-tokens always end; each distinct piece of a batch is
encoded once, and recent pieces are remembered. Null text counts as empty: no tokens, an empty decoded text. Texts of any
length, repeated rows, null ids and extra columns are handled like others; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from proofline.llm.shared import list_parts, row_slices, strings, table, tidy

NAME = "op6_bpe"
ORACLE_SQL = None
FILE = "byte_bpe_50k.json"

#: White space as Unicode has it; Python's own \\s also takes U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0  -     　"
PRE_TOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Texts in which pieces can't simply be cut at spaces and line ends (white space elsewhere than singly between other characters, special tokens, the mark).
IRREGULAR = r"[\p{Z}\t-\r\x{85}][\p{Z}\t-\r\x{85}]|^[\p{Z}\t-\r\x{85}]|[\p{Z}\t-\r\x{85}]$|[\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\||\x00"
MARK = "\x00"
#: Pieces remembered by a Python worker.
REMEMBERED = 600_000
#: Entries of the compatibility table that a worker holds at once; they are found anew when needed.
PAIRS = 1_000_000
#: Later than any merge.
NEVER = 2**62


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies on this machine; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """A byte-level BPE vocabulary with its automaton, compatibility table and offset table."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = _byte_of_character()
        plain = {t: bytes(byte_of[c] for c in t).decode("latin-1") for t in vocabulary if t not in self.special}
        # Ranks order tokens as merges make them: single bytes first.
        made = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in merges)]
        single = [t for t in vocabulary if t in plain and len(t) == 1]
        self.rank = {plain[t]: k for k, t in enumerate([*single, *made])}
        self.ids = np.array([vocabulary[t] for t in [*single, *made]], np.uint32)
        self.length = [len(t) for t in self.rank]
        self.parts = [(k, k) for k in range(len(single))]
        self.joined: dict[tuple[int, int], int] = {}
        for k, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (self.rank[plain[a]], self.rank[plain[b]])
            self.joined.setdefault(pair, len(single) + k)
            self.parts.append(pair)
        # Each token's first parts and last parts, from a byte to itself, closed by NEVER.
        self.first, self.last = [(k, NEVER) for k in range(len(single))], [(k, NEVER) for k in range(len(single))]
        for k, (a, b) in enumerate(self.parts[len(single) :], len(single)):
            self.first.append((*self.first[a][:-1], k, NEVER))
            self.last.append((*self.last[b][:-1], k, NEVER))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reached = reached = {t: k for t, k in self.rank.items() if k < len(single) or self._apart(*self.parts[k], before=k)}
        self.prefix = [next((reached[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reached), -1) for t in self.rank]
        self.automaton = ahocorasick.Automaton()
        for t, k in reached.items():
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        self.cut = regex.compile(PRE_TOKENS).findall
        # Decoding: the bytes of all ids, one after the other.
        of_id = {vocabulary[t]: s.encode("latin-1") for t, s in plain.items()} | {i: t.encode() for t, i in self.special.items()}
        every = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        self.bytes = np.frombuffer(b"".join(every), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in every])])

    def _apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether merging the bytes of a and b anew keeps them apart up to the merge `before`.

        Merges come in the order of their ranks, so ranks are times. Until something merges across the border, a and b grow as each does
        alone: the token left of the border passes through a's last parts (`last`), each from its own rank on, the token right of it through
        b's first parts (`first`). A merge across applies if both its tokens still stand there at its time. Of equal merges the left one
        goes first: one within a precedes it, one within b does not."""
        left, right, i, j, joined = self.last[a], self.first[b], 0, 0, self.joined.get
        while True:
            time, end_left, end_right = joined((left[i], right[j]), NEVER), left[i + 1], right[j + 1]
            if time < before and time < end_left and time <= end_right:
                return False
            if end_left == end_right == NEVER:
                return True
            if end_left <= end_right:
                i += 1
            else:
                j += 1

    def _compatible(self, a: int, b: int) -> bool:
        """An entry of the compatibility table, made when first asked for."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a, b] = self._apart(a, b)
        return found

    def word(self, word: str) -> list[int]:
        """Ranks of one pre-token's merge result."""
        data = word.encode("utf-8", "surrogatepass").decode("latin-1")
        reached = self.reached.get
        whole = reached(data)
        if whole is not None:
            return [whole]
        n, out = len(data), []
        open_, at, token, last = bytearray(b"\1") * (n + 1), 0, -1, -1
        length, prefix, known, compatible, reach = self.length, self.prefix, self.pairs.get, self._compatible, self.automaton.longest_prefix
        while at < n:
            if token < 0:  # the longest token here: as far as the automaton goes, then back to a token's end
                rest = data[at:]
                size = reach(rest)
                token = reached(rest[:size])
                while token is None:
                    size -= 1
                    token = reached(rest[:size])
            while True:
                end = at + length[token]
                if open_[end] and (last < 0 or (fits if (fits := known((last, token))) is not None else compatible(last, token))):
                    out.append(token)
                    at, last, token = end, token, -1
                    break
                token = prefix[token]
                if token < 0:
                    open_[at] = 0
                    token = out.pop()
                    at -= length[token]
                    last = out[-1] if out else -1
                    break
        return out

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        word, cut = self.word, self.cut
        return [word(p) if p[p[:1] == " " :].isalpha() else [i for w in cut(p) for i in word(w)] for p in pieces]

    def irregular(self, text: str) -> np.ndarray:
        """Ids of any text at all: special tokens first, then pre-tokens."""
        out: list[int] = []
        places = [(text, None)]
        for content, number in self.special.items():
            places = [y for t, i in places for y in ([(t, i)] if i is not None else _around(t, content, number))]
        for t, i in places:
            out += [i] if i is not None else self.ids[[k for w in self.cut(t) for k in self.word(w)]].tolist()
        return np.array(out, np.uint32)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts that the ids between offsets stand for; bytes that are no UTF-8 become U+FFFD."""
        size = self.offsets[ids + 1] - self.offsets[ids]
        data = self.bytes[gathered(self.offsets[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _around(text: str, content: str, number: int):
    for k, part in enumerate(text.split(content)):
        if k:
            yield content, number
        yield part, None


def _byte_of_character() -> dict[str, int]:
    """The printable characters that stand for bytes in such vocabularies: themselves where printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at start and have the given sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Remembered:
    """Ids of pieces: each distinct piece is encoded once as long as it is remembered."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], table: np.ndarray | None = None, most: int = REMEMBERED):
        """table: what turns encode's numbers into ids, if they aren't ids."""
        self.encode, self.table, self.most = encode, table, most
        self.forget()

    def forget(self) -> None:
        """Also for a task's end: the worker lives on, and its memory is needed by other operators."""
        self.place: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids."""
        encoded = pieces.dictionary_encode()
        names = encoded.dictionary.to_pylist()
        if len(self.place) > self.most:
            self.forget()
        new = [p for p in names if p not in self.place]
        if new:
            ids = self.encode(new)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))
            flat = flat if self.table is None else self.table[flat]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        where = np.fromiter((self.place[p] for p in names), np.int64, len(names))[encoded.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)
        size = self.size[where]
        return size, self.flat[gathered(self.start[where], size)]


class ByteEncoder:
    """Ids of whole texts, batch by batch."""

    def __init__(self, name: str):
        self.bpe = ByteBpe(tokenizer_path(name))
        self.remembered = Remembered(self.bpe.pieces, self.bpe.ids)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts."""
        texts = strings(texts)
        odd = pc.match_substring_regex(texts, IRREGULAR)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", MARK + "\n" + MARK)
        # Pre-tokens also end between a letter or digit and such a mark.
        marked = pc.if_else(odd, "", pc.replace_substring_regex(marked, "([A-Za-z0-9])([.,!?;:#$%&*])", rf"\1{MARK}\2"))
        offsets, pieces = list_parts(pc.split_pattern(marked, MARK))
        size, ids = self.remembered(pieces)
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        if not pc.any(odd).as_py():
            return ends, ids
        each = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            each[k] = self.bpe.irregular(texts[int(k)].as_py())
        return np.concatenate([[0], np.cumsum([len(x) for x in each])]), np.concatenate(each)


@functools.cache
def encoder(name: str) -> ByteEncoder:
    """One for each Python worker and vocabulary."""
    return ByteEncoder(name)


def encode(docs: DataFrame, name: str = FILE) -> DataFrame:
    """doc_id and ids of every text."""

    def batches(source):
        for batch in source:
            for part in row_slices(batch, "text"):
                offsets, ids = encoder(name)(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.LargeListArray.from_arrays(offsets, ids.astype(np.int32)).cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(batches), "doc_id long, ids array<int>")


def digests(docs: DataFrame, name: str = FILE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded and its ids decoded again; one map-only pass."""

    def batches(source):
        for batch in source:
            for part in row_slices(batch, "text"):
                own = encoder(name)
                offsets, ids = own(part.column("text"))
                data = ids.astype("<u4").tobytes()
                of_ids = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                decoded = [hashlib.sha256(t.encode()).hexdigest() for t in own.bpe.decode(offsets, ids)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(of_ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidy(batches), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
