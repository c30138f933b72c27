"""Substring dedup: compact windows of min-hashes over word shingles, joined across enough hashes, then verified.

For each of HASHES hash functions a document's shingles form a Cartesian tree by hash value. A node at place c whose
subtree spans l..r stands for all subsequences that start in l..c and end in c..r: they share one min-hash. Only
nodes spanning at least a passage (WORDS words) count, about two for each WORDS words, so that whole texts are
covered by few rows. Windows with the same min-hash in several documents are aligned with the first and the last of these
documents; aligned intervals of one pair of documents are joined, and where at least AGREE hash functions overlap, the
passages' shingles are compared: kept are passages of at least WORDS words with a Jaccard similarity >= THRESHOLD.

Groups are reduced to their first and last document before the shuffle, so a passage in a third of all documents costs one
row for each, and these two meet every other document. Windows that no verified passage of their document covers then are compared with those of all other
earlier documents that share two keys near each other (a double key: two hash functions, at two places), by one key for each stretch first, then by all:
the shingles around the places are verified inside tasks, which emit the passages that cover such a place, from representatives first, never pairs. An exact repeat of WORDS words has all hash functions agree; one of similarity 0.8 is a candidate with
probability 0.97, one of 0.9 with 0.996.

A repeat within one document doesn't count. Null, empty and shorter texts have no passages. Rows without an id are left out;
rows that repeat an id are one document with the greatest of its texts. Extra columns are ignored (`without_repeats` carries
them). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.shared import checked, dropped, list_parts, mix, one_text_per_id, row_slices, shingle_hashes, strings, table, tidy, unused, word_hashes, written

NAME = "op1_substring_dedup"
ORACLE_SQL = None

SHINGLE, WORDS, THRESHOLD = 5, 50, 0.8
HASHES, AGREE = 4, 2
WIDTH = WORDS - SHINGLE + 1
#: Bytes of text taken at once.
SLICE = 2_000_000
#: What is left over is compared by NEAR shingles on either side of a place, places in a region of REGION shingles at most together;
#: keys with more than BLOCK regions parted by double key, then in blocks of about BLOCK; keys with fewer share groups of about GROUP.
NEAR, REGION, BLOCK, GROUP = 60, 1024, 4096, 1000
#: So many regions that last covered others are met before all others.
REPRESENTATIVES = 8
#: Entries of the matrices by which shared places are counted.
CELLS = 200_000
#: A bound that nothing reaches.
UNLIKE = -(2**30)
#: Places whose double keys are made at once.
PLACES = 20_000
#: A shingle of one side only weighs as much as so many shared places, or fewer, on a passage's two sides together.
PRICE = int(2 * THRESHOLD / (1 - THRESHOLD) + 1e-9)
PASSAGES = {"doc_id": "long", "start": "long", "words": "long", "kept_id": "long", "kept_start": "long", "kept_words": "long", "similarity": "double"}
REGIONS = ["key", "doc_id", "at", "rest", "shingles", "doubles"]
WINDOWS = "key long, doc_id long, f int, l int, c int, r int"


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def compact_windows(offsets: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r (places in values) of all tree nodes that span at least `width` places of one text.

    Such a node is the least of some `width` consecutive values, and so are all its ancestors; the tree is built of these few alone.
    Among equal values the first counts as less.
    """
    n = len(values)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(n.bit_length(), 1))
    ranked = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    least = sliding_argmin(ranked, width)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = text[: n - width + 1] == text[width - 1 :]
    c = (least[whole] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    c = c[np.flatnonzero(np.diff(c, prepend=-1))]  # ascending: a later window's least is no earlier one
    own, value = text[c], ranked[c]
    before, after = _next_less(value, own), len(c) - 1 - _next_less(value[::-1], own[::-1])[::-1]
    left = np.where(before < 0, offsets[own], c[before] + 1)
    right = np.where(after == len(c), offsets[own + 1] - 1, c[np.minimum(after, len(c) - 1)] - 1)
    return left, c, right


def _next_less(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it, of the same text, with a lesser value; -1 for none."""
    found = np.arange(len(value)) - 1
    found[np.flatnonzero(np.diff(text, prepend=-1))] = -1
    at = np.flatnonzero(found >= 0)
    while len(at):  # what lies between a place and the one found has greater values
        there = found[at]
        greater = (there >= 0) & (value[there] > value[at])
        at = at[greater]
        found[at] = found[there[greater]]
    return found


def _windows(source):
    rng = np.random.default_rng(20210618)
    factors = rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in source:
        for part in row_slices(batch, "text", SLICE):
            offsets, shingles = shingle_hashes(*word_hashes(part.column("text")), SHINGLE)
            ids = part.column("doc_id").to_numpy()
            text = np.repeat(np.arange(len(ids)), np.diff(offsets))
            for f in range(HASHES):
                l, c, r = compact_windows(offsets, mix(shingles, f) * factors[f], WIDTH)  # noqa: E741
                base = offsets[text[c]]
                columns = [mix(shingles[c], 100 + f).view(np.int64), ids[text[c]], np.full(len(c), f, np.int32), *((x - base).astype(np.int32) for x in (l, c, r))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "doc_id", "f", "l", "c", "r"])


def _shingles(source):
    for batch in source:
        for part in row_slices(batch, "text", SLICE):
            offsets, shingles = shingle_hashes(*word_hashes(part.column("text")), SHINGLE)
            data = (shingles >> np.uint64(32)).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([data[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["doc_id", "shingles"])


def _aligned(members: DataFrame, anchors: DataFrame) -> DataFrame:
    """a, b, f and intervals of shingles where windows (members) and those of their keys' anchors (key, b, bl, bc, br) overlap."""
    met = members.select("key", F.col("doc_id").alias("a"), "f", "l", "c", "r").join(anchors, "key").where("a <> b")
    before, after = F.least(F.col("c") - F.col("l"), F.col("bc") - F.col("bl")), F.least(F.col("r") - F.col("c"), F.col("br") - F.col("bc"))
    aligned = met.select("a", "b", "f", (F.col("c") - before).alias("a_from"), (F.col("c") + after).alias("a_to"), (F.col("bc") - before).alias("b_from"), (F.col("bc") + after).alias("b_to"))
    return aligned.where(F.col("a_to") - F.col("a_from") + 1 >= WIDTH)


def _islands(aligned: DataFrame, agree: int) -> DataFrame:
    """The interval join: within a pair of documents, intervals that overlap form an island; those of at least `agree` hash functions."""
    ordered = Window.partitionBy("a", "b").orderBy("a_from", "a_to")
    reach = F.max("a_to").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = aligned.withColumn("new", F.when(reach >= F.col("a_from"), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    found = islands.groupBy("a", "b", "island").agg(F.min("a_from").alias("a_from"), F.max("a_to").alias("a_to"), F.min("b_from").alias("b_from"), F.max("b_to").alias("b_to"), F.expr("bit_or(shiftleft(1, f))").alias("fs"))
    return found.where(F.bit_count("fs") >= agree).drop("island", "fs")


def _widest(members: DataFrame) -> DataFrame:
    """Of a document's windows with one key, the widest is aligned with."""
    return members.groupBy("key", F.col("doc_id").alias("b")).agg(F.max_by(F.struct(F.col("l").alias("bl"), F.col("c").alias("bc"), F.col("r").alias("br")), F.col("r") - F.col("l")).alias("w")).select("key", "b", "w.*")


def shared_windows(docs: DataFrame) -> DataFrame:
    """Windows (key, doc_id, f, l, c, r) whose key several documents have, with the first and last of these (lo, hi)."""
    every = written(docs.mapInArrow(tidy(_windows), WINDOWS), "all_windows")
    ends = every.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    ends = written(ends, "ends")
    shared = written(every.join(ends, "key"), "windows")
    dropped(every, ends)
    return shared


def candidates(members: DataFrame) -> DataFrame:
    """a, b (ids, a <> b) and intervals of shingles (a_from, a_to, b_from, b_to) where enough hash functions agree."""
    return _islands(_aligned(members, _widest(members.where("doc_id = lo OR doc_id = hi"))), AGREE)


def _marked(windows: DataFrame, found: DataFrame) -> DataFrame:
    """key, doc_id, f, c of windows (with their group's least document) and rest: whether the place lies in none of the passages
    found in its document as the later one, and an earlier document of the group is left to meet."""
    places = windows.select("doc_id", F.col("c").alias("at"), F.lit(1).alias("kind"), "key", "f", "least", F.lit(0).cast("long").alias("end"))
    none = lambda kind: F.lit(0).cast(kind)
    spans = found.select("doc_id", F.col("start").cast("int").alias("at"), F.lit(0).alias("kind"), none("long").alias("key"), none("int").alias("f"), none("long").alias("least"), (F.col("start") + F.col("words")).alias("end"))
    before = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    reached = places.unionByName(spans).withColumn("end", F.max("end").over(before)).where("kind = 1")
    return reached.select("key", "doc_id", "f", F.col("at").alias("c"), ((F.col("at") + SHINGLE > F.col("end")) & (F.col("doc_id") > F.col("least"))).alias("rest"))


def _double_keys(doc: np.ndarray, key: np.ndarray, c: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of documents in twos, of different hash functions, at most NEAR shingles and at least one apart: the one with the lesser key, the other, and their double key.

    Between the two, one of their keys doesn't occur again: in a text that repeats itself a place has as many partners as keys are
    near it, not as many as places; every place that has a partner with a key before or behind it still has one there.
    """
    order = np.lexsort((c, doc))
    n, doc, at = len(order), doc[order], c[order]
    before, after = np.maximum(at - NEAR, 0), at + NEAR
    same = np.lexsort((key[order], doc))
    again = (doc[same][1:] == doc[same][:-1]) & (key[order][same][1:] == key[order][same][:-1])
    earlier, later = same[:-1][again], same[1:][again]
    before[later] = np.maximum(before[later], at[earlier])
    after[earlier] = np.minimum(after[earlier], at[later])
    # Both ranges of partners are contiguous: up to a place's own key's next occurrence, and from the partner's key's last one on.
    wide = doc * (at.max(initial=0) + NEAR + 1)
    here, stop = np.arange(n), np.searchsorted(wide + at, wide + after, side="right")
    start = np.searchsorted(wide + at, wide + before)
    ahead, behind = stop - here - 1, here - start
    x, y = np.repeat(here, ahead), np.repeat(here, behind)
    one = np.concatenate([x, np.repeat(start - np.cumsum(behind) + behind, behind) + np.arange(len(y))])
    other = np.concatenate([np.repeat(here + 1 - np.cumsum(ahead) + ahead, ahead) + np.arange(len(x)), y])
    new = np.ones(len(one), bool)
    new[len(x) :] = at[other[len(x) :]] > after[one[len(x) :]]
    x, y = order[one[new]], order[other[new]]
    keep = (f[x] != f[y]) & (c[x] != c[y]) & (key[x] != key[y])
    x, y = x[keep], y[keep]
    x, y = np.where(key[x] < key[y], x, y), np.where(key[x] < key[y], y, x)
    return x, y, mix(mix(key[x].view(np.uint64)) ^ key[y].view(np.uint64), 1).view(np.int64)


def _doubles(source):
    """Every document's double keys, and whether one of their places is left (rest)."""
    for whole in source:
        before = np.concatenate([[0], np.cumsum(pc.list_value_length(whole.column("places")).to_numpy())])
        start = 0
        while start < whole.num_rows:  # a document's places make many times as many double keys
            stop = max(start + 1, int(np.searchsorted(before, before[start] + PLACES, side="right")) - 1)
            batch, start = whole.slice(start, stop - start), stop
            ends, flat = list_parts(batch.column("places"))
            key, c, rest, f = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            x, y, double = _double_keys(doc, key, c.astype(np.int64), f)
            left = rest[x] | rest[y]
            order = np.lexsort((~left, double, doc[x]))
            double, of, left = double[order], doc[x][order], left[order]
            first = np.ones(len(order), bool)
            first[1:] = (double[1:] != double[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(double[first]), batch.column("doc_id").take(pa.array(of[first])), pa.array(left[first])], ["double", "doc_id", "rest"])


def _regions(source):
    """The shingles around a document's places in twos, by the lesser key of each two; places near each other share a region. rest: places not covered, from the
    region's start; doubles: its double keys, of those that are given; chosen: whether by its key NEAR shingles with places left are compared first."""
    names = [*REGIONS, "chosen"]
    for batch in source:
        for part in row_slices(batch, "text", SLICE):
            offsets, shingles = shingle_hashes(*word_hashes(part.column("text")), SHINGLE)
            short, ids = (shingles >> np.uint64(32)).astype("<u4"), part.column("doc_id").to_numpy()
            ends, flat = list_parts(part.column("places"))
            key, c, rest, f = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            c = c.astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))
            x, y, double = _double_keys(doc, key, c, f)
            keep = np.isin(double, list_parts(part.column("doubles"))[1].to_numpy())
            x, y, double = x[keep], y[keep], double[keep]
            if not len(x):
                continue
            order = np.lexsort((c[x], key[x], doc[x]))
            x, y, double = x[order], y[order], double[order]
            of, least, at = doc[x], key[x], c[x]
            new = np.ones(len(x), bool)
            new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1]) | (np.diff(at) > 2 * NEAR) | (np.diff(at // REGION) != 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(x))
            start = np.maximum(np.minimum.reduceat(np.minimum(at, c[y]), first) - NEAR, 0)
            stop = np.minimum(np.maximum.reduceat(np.maximum(at, c[y]), first) + NEAR + 1, np.diff(offsets)[of[first]])
            # Where a run of places goes on in the next region, partners may be counted there alone.
            cut = np.flatnonzero((of[first][1:] == of[first][:-1]) & (least[first][1:] == least[first][:-1]) & (at[first[1:]] - at[first[1:] - 1] <= 2 * NEAR))
            start[cut + 1] = np.minimum(start[cut + 1], np.maximum(at[first[cut + 1]] - 2 * NEAR, 0))
            stop[cut] = np.maximum(stop[cut], np.minimum(at[first[cut + 1] - 1] + 2 * NEAR + 1, np.diff(offsets)[of[first[cut]]]))
            base = offsets[of[first]]
            data = [short[i:j].tobytes() for i, j in zip(base + start, base + stop, strict=True)]
            left = []
            for i, j, s in zip(first, last, start, strict=True):
                both = np.concatenate([x[i:j], y[i:j]])
                left.append((np.unique(c[both[rest[both]]]) - s).astype("<i4").tobytes())
            # Copies choose the same key, as its hash decides.
            here = np.flatnonzero(rest[x] | rest[y])
            stretch, rank = at[here] // NEAR, mix(least[here].view(np.uint64), 2)
            order = np.lexsort((rank, stretch, of[here]))
            here, stretch = here[order], stretch[order]
            ahead = np.ones(len(here), bool)
            ahead[1:] = (of[here][1:] != of[here][:-1]) | (stretch[1:] != stretch[:-1])
            chosen = np.zeros(len(x), bool)
            chosen[here[ahead]] = True
            doubles = [np.unique(double[i:j]) for i, j in zip(first, last, strict=True)]
            columns = [pa.array(least[first]), pa.array(ids[of[first]]), pa.array(start), pa.array(left, pa.binary()), pa.array(data, pa.binary()), pa.array(doubles, pa.list_(pa.int64())), pa.array(np.logical_or.reduceat(chosen, first))]
            yield pa.RecordBatch.from_arrays(columns, names)


def _trimmed(source):
    """Regions without the places left that lie in passages found (spans)."""
    for batch in source:
        ends, spans = list_parts(batch.column("spans"))
        start, end = (spans.field(k).to_numpy() for k in range(2))
        out = []
        for k, (rest, at) in enumerate(zip(batch.column("rest").to_pylist(), batch.column("at").to_pylist(), strict=True)):
            left = np.frombuffer(rest, "<i4")
            if len(left) and ends[k] < ends[k + 1]:
                mine = slice(ends[k], ends[k + 1])
                within = (left[:, None] + at >= start[mine]) & (left[:, None] + at + SHINGLE <= end[mine])
                rest = left[~within.any(axis=1)].tobytes()
            out.append(rest)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == "rest" else batch.column(n) for n in REGIONS], REGIONS)


def _near_enough(theirs: np.ndarray, theirs_first: np.ndarray, own: np.ndarray, own_first: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How alike others' regions (columns) are, and for each place left (rows) whether two spans of WIDTH or more, the one in the region with that place in it, which is
    shared, the other with that shingle, can reach THRESHOLD: an upper bound isn't below 0.

    own: numbers of a region's shingles; theirs: those of others' regions, a column each (one more than own's greatest: not in the region); own_first, theirs_first: where
    shingles stand first. Of two spans with s and t shared places and u and v other distinct shingles the similarity is less than THRESHOLD unless
    (1 - THRESHOLD) * (s + t) / 2 >= THRESHOLD * (u + v), as min(s, t) shingles are common at most.
    """

    def sums(there: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Before each place; the least up to there; the greatest from there on; the best span of WIDTH or more from each place."""
        n = np.zeros((len(there) + 1, there.shape[1]), np.int32)
        np.cumsum(np.where(there, np.int32(1), first * np.int32(-PRICE)), axis=0, out=n[1:])
        low, high = np.minimum.accumulate(n, axis=0), np.maximum.accumulate(n[::-1], axis=0)[::-1]
        return low, high, high[WIDTH:] - n[:-WIDTH]

    none = int(own.max()) + 1
    column = np.arange(theirs.shape[1])
    place = np.full((none + 1, len(column)), -1, np.int32)
    place[theirs, column] = np.arange(len(theirs), dtype=np.int32)[:, None]
    again = np.zeros(place.shape, bool)
    at, of = np.nonzero((theirs < none) & ~theirs_first)
    again[theirs[at, of], of] = True
    behind, ahead, spans = sums(place[own] >= 0, own_first[:, None])
    low, high, others = sums(theirs < none, theirs_first)
    best = others.max(axis=0)
    able = spans.max(axis=0) + best >= 0
    if not able.any():
        return np.full(len(column), UNLIKE, np.int32), np.zeros((len(left), len(column)), bool)

    def wide(spans: np.ndarray) -> np.ndarray:
        """The best span of WIDTH or more from one of the WIDTH places up to each place."""
        edge = np.full((WIDTH - 1, len(column)), UNLIKE, np.int32)
        return -sliding_argmin(-np.concatenate([edge, spans, edge]), WIDTH)

    if len(left) > 4:
        here = wide(spans)[left]
    else:
        here = np.stack([spans[max(p + 1 - WIDTH, 0) : p + 1].max(axis=0) for p in left.tolist()])
    far = left >= WIDTH
    here[far] = np.maximum(here[far], ahead[left[far] + 1] - behind[left[far] - WIDTH])
    at, near = place[own[left]], wide(others)
    reached, several, shared = high[at + 1, column], again[own[left]], able & (at >= 0)
    there = np.where(at >= WIDTH, np.maximum(near[at, column], reached - low[at - WIDTH, column]), near[at, column])
    reach = shared & (here + np.where(several, best, there) >= 0)
    there = np.where(several, best, np.minimum(reached - low[at, column], best))
    alike = np.where(shared, here + there, UNLIKE).max(axis=0)
    return alike, reach


class _Group:
    """Regions of one key: their shingles as numbers, and which regions have which."""

    def __init__(self, shingles: list[np.ndarray]):
        self.size = np.array([len(x) for x in shingles])
        flat = np.concatenate(shingles)
        total = len(flat)
        # Shingles and their places sorted as one number each.
        order = np.sort((flat.astype(np.uint64) << np.uint64(32)) | np.arange(total, dtype=np.uint64))
        at = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(total, bool)
        new[1:] = (order[1:] >> np.uint64(32)) != (order[:-1] >> np.uint64(32))
        number = np.cumsum(new) - 1
        codes = np.empty(total, np.int32)
        codes[at] = number
        row = np.repeat(np.arange(len(shingles)), self.size)
        self.rows = row[at]
        first = np.empty(total, bool)
        new[1:] |= self.rows[1:] != self.rows[:-1]
        first[at] = new
        self.ends = np.append(np.flatnonzero(np.diff(number, prepend=-1)), total)
        self.start = np.cumsum(self.size) - self.size
        self.codes, self.first = codes, first
        self.numbers = np.full(len(self.ends), -1, np.int32)

    def holders(self, codes: np.ndarray) -> np.ndarray:
        """The regions of these shingles' places."""
        return np.concatenate([self.rows[x:y] for x, y in zip(self.ends[codes].tolist(), self.ends[codes + 1].tolist(), strict=True)])

    def part(self, k: int) -> slice:
        return slice(self.start[k], self.start[k] + self.size[k])

    def columns(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of shingles (the last: none) and whether they stand first, a column for each of these regions."""
        there = np.arange(self.size[others].max())[:, None]
        within = there < self.size[others]
        at = np.where(within, self.start[others] + there, 0)
        return np.where(within, self.codes[at], len(self.ends) - 1), within & self.first[at]


def _met(docs: np.ndarray, sides: np.ndarray, rest: list[np.ndarray], shingles: list[np.ndarray], doubles: list[np.ndarray]):
    """(row, other row, passages) of verified passages between regions of one key that share a double key: each region with places left
    meets earlier documents' regions, on the other side if there are two, until its places are covered: those first that have
    covered others (a group's representatives), then the most alike. Of equal regions the earliest document's is met."""
    n, group = len(docs), _Group(shingles)
    size, numbers = group.size, group.numbers
    both = sides.min() < sides.max()
    by_doc = np.argsort(docs, kind="stable")
    seen: dict = {}
    same = np.zeros(n, np.int64)
    for k in by_doc.tolist():
        same[k] = seen.setdefault((shingles[k].tobytes(), int(sides[k])), k)
    # For each double key the regions that have it, in order of documents, of equal ones the first.
    rank = np.empty(n, np.int64)
    rank[by_doc] = np.arange(n)
    meets = size >= WIDTH
    of = np.repeat(np.arange(n), [len(x) for x in doubles])
    doubled, number = np.unique(np.concatenate(doubles), return_inverse=True)
    met = np.unique(number[meets[of]] * n + rank[same[of[meets[of]]]])
    holders = np.split(met % n, np.searchsorted(met // n, np.arange(1, len(doubled))))
    ends = np.cumsum([len(x) for x in doubles])
    least, earlier = int(THRESHOLD * WIDTH), np.searchsorted(docs[by_doc], docs)
    recent: list[int] = []
    for a in by_doc.tolist():
        left = rest[a]
        if not len(left) or size[a] < WIDTH:
            continue
        own = group.codes[group.part(a)]
        double = np.zeros(n, bool)
        for k in number[ends[a] - len(doubles[a]) : ends[a]].tolist():
            double[holders[k][: np.searchsorted(holders[k], earlier[a])]] = True
        double = double[rank]
        if both:
            double &= sides != sides[a]
        if not double.any():
            continue
        # A passage has a place left, and THRESHOLD of WIDTH shared places at least.
        place = np.zeros(n, bool)
        place[group.holders(np.unique(own[left]))] = True
        others = np.flatnonzero(double & place)
        if not len(others):
            continue
        different, named = np.unique(own, return_inverse=True)
        others = others[np.bincount(group.holders(different[group.ends[different + 1] > group.ends[different] + 1]), minlength=n)[others] >= least]
        if not len(others):
            continue
        numbers[different] = np.arange(len(different))
        own_first, step = group.first[group.part(a)], max(CELLS // int(size[others].max()), 1)
        known = np.isin(others, recent)
        for those in (others[known], others[~known]):
            alike, able = [], []
            for at in range(0, len(those), step):
                codes, first = group.columns(those[at : at + step])
                theirs = numbers[codes]
                theirs[theirs < 0] = len(different)
                like, reach = _near_enough(theirs, first, named, own_first, rest[a])
                alike.append(like)
                able.append(reach[np.isin(rest[a], left)].any(axis=0))
            if not alike:
                continue
            alike, able = np.concatenate(alike), np.flatnonzero(np.concatenate(able))
            for b in those[able][np.lexsort((docs[those[able]], -alike[able]))].tolist():
                codes = group.codes[group.part(b)]
                theirs = numbers[codes]
                theirs[theirs < 0] = len(different)
                found = _passages(named, theirs, own, codes, own_first, group.first[group.part(b)], WIDTH, THRESHOLD, left)
                if found:
                    yield a, b, found
                    recent = [b, *(r for r in recent if r != b)][:REPRESENTATIVES]
                    left = _outside(left, found)
                    if not len(left):
                        break
            if not len(left):
                break
        numbers[different] = -1


def _outside(places: np.ndarray, found: list[tuple]) -> np.ndarray:
    """The places that lie in none of the passages."""
    for x, y, *_ in found:
        places = places[(places < x) | (places >= y)]
    return places


def _blocks_met(rows):
    """Verified passages (see `_met`) of the keys of one group, or of two blocks of one double key."""
    key, doc, at, block = (rows.column(n).to_numpy() for n in ("key", "doc_id", "at", "block"))
    rest = [np.frombuffer(x, "<i4") for x in rows.column("rest").to_pylist()]
    shingles = [np.frombuffer(x, "<u4") for x in rows.column("shingles").to_pylist()]
    ends, flat = list_parts(rows.column("doubles"))
    doubles = np.split(flat.to_numpy(), ends[1:-1])
    order = np.argsort(key, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(key[order])) + 1).tolist(), len(order)]
    out: list[tuple] = []
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        here = order[x:y]
        for a, b, found in _met(doc[here], block[here], *([of[k] for k in here] for of in (rest, shingles, doubles))):
            a, b = here[a], here[b]
            out += [(doc[a], at[a] + f, t - f + SHINGLE - 1, doc[b], at[b] + c, d - c + SHINGLE - 1, s) for f, t, c, d, s in found]
    columns = list(zip(*out, strict=True)) or [()] * len(PASSAGES)
    return pa.table({n: pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for n, c in zip(PASSAGES, columns, strict=True)})


def _met_by_key(regions: DataFrame) -> DataFrame:
    """Verified passages (written) between regions of one key: regions go by key; those of keys with very many by double key, and of double keys with very many by pairs of blocks."""

    def many(of: DataFrame, name: str) -> DataFrame:
        return written(of.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), name)

    large = many(regions, "large")
    placed = regions.join(checked(large), "key", "left")
    groups = max(1, regions.count() // GROUP)
    single = placed.where("blocks IS NULL").select(*REGIONS, F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"), F.lit(True).alias("several"))
    parted = placed.where("blocks IS NOT NULL").drop("blocks").withColumn("key", F.explode("doubles")).withColumn("doubles", F.array("key"))
    huge = many(parted, "huge")
    parted = parted.join(checked(huge), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("doc_id", "at"), F.col("blocks")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parted = parted.select(*REGIONS, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("key").alias("group"), F.lit(False).alias("several"))
    grouped = single.unionByName(parted).groupBy("several", "group", "i", "j")
    found = written(grouped.applyInArrow(_blocks_met, ", ".join(f"{n} {t}" for n, t in PASSAGES.items())), "passages")
    dropped(large, huge)
    return found


def _left_over(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """Verified passages between the windows left over (rest) and those of all earlier documents that share two keys with them, of different hash functions and near each other.

    Every NEAR shingles with places left are compared by one key first; places that no passage found by then covers, by all of their keys."""
    keys = written(marked.where("rest").select("key").distinct(), "keys")
    places = marked.join(checked(keys), "key", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("key", "c", "rest", "f")).alias("places"))
    places = written(places, "places")
    doubles = written(places.mapInArrow(tidy(_doubles), "double long, doc_id long, rest boolean"), "doubles")
    # What a document with places left shares with an earlier one; later ones need not be met.
    shared = doubles.groupBy("double").agg(F.min("doc_id").alias("first"), F.max(F.when(F.col("rest"), F.col("doc_id"))).alias("last")).where("first < last").drop("first")
    shared = written(shared, "shared_doubles")
    per_doc = doubles.join(checked(shared), "double").where("doc_id <= last").groupBy("doc_id").agg(F.collect_list("double").alias("doubles"))
    per_doc = written(per_doc.join(places, "doc_id"), "left_places")
    ids = written(per_doc.select("doc_id"), "left_ids")
    kinds = "key long, doc_id long, at long, rest binary, shingles binary, doubles array<long>"
    regions = written(texts.join(checked(ids), "doc_id", "left_semi").join(per_doc, "doc_id").mapInArrow(tidy(_regions), f"{kinds}, chosen boolean"), "regions")
    dropped(keys, places, doubles, shared, per_doc, ids)
    keys = written(regions.where("chosen").select("key").distinct(), "keys")
    only = lambda chosen: F.when(F.col("chosen") == chosen, F.col("rest")).otherwise(F.lit(b""))
    found = _met_by_key(regions.join(checked(keys), "key", "left_semi").withColumn("rest", only(True)).select(*REGIONS))
    spans = written(found.groupBy("doc_id").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("words")).alias("end"))).alias("spans")), "spans")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    trimmed = written(regions.withColumn("rest", only(False)).join(checked(spans), "doc_id", "left").withColumn("spans", F.coalesce("spans", none)).mapInArrow(tidy(_trimmed), kinds), "regions")
    dropped(keys, regions, spans)
    keys = written(trimmed.where("length(rest) > 0").select("key").distinct(), "keys")
    found = found.unionByName(_met_by_key(trimmed.join(checked(keys), "key", "left_semi")))
    dropped(keys, trimmed)
    return found


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each place, and in all."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _apart(codes: np.ndarray, flags: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """How many different flagged values are among the `width` from each place on (0 where fewer are left, or if no flagged value repeats)."""
    n = len(codes)
    out = np.zeros(n + 1, np.int64)
    if n < width or not (flags & ~first).any():
        return out
    order = np.argsort(codes, kind="stable")
    before = np.full(n, -1)
    again = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    at = np.flatnonzero(flags)
    start, stop = np.maximum(before[at] + 1, np.maximum(at - width + 1, 0)), np.minimum(at, n - width) + 1
    counts = np.bincount(start, minlength=n + 1)
    np.subtract.at(counts, np.maximum(stop, start), 1)
    out[: n - width + 1] = np.cumsum(counts)[: n - width + 1]
    return out


#: Pairs of runs that are looked at together.
RUN_PAIRS = 250_000


def passages(x: np.ndarray, y: np.ndarray, least: int, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """Passages of x (from, to), their places in y (from, to) and similarity: all longest spans of runs of shared shingles that are
    similar enough as wholes, however wide the gaps between the runs are."""
    n, m = len(x), len(y)
    if n == m and np.array_equal(x, y):
        ordered = np.sort(x)
        if (ordered[1:] != ordered[:-1]).all():
            return [(0, n, 0, n, 1.0)] if n >= max(least, 1) else []
    values, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    own, other = codes[:n], codes[n:]
    first_x, first_y = np.full(len(values), -1), np.full(len(values), -1)
    first_x[own[::-1]], first_y[other[::-1]] = np.arange(n)[::-1], np.arange(m)[::-1]
    theirs = np.where(first_x[other] >= 0, other, len(values))
    return _passages(own, theirs, own, other, first_x[own] == np.arange(n), first_y[other] == np.arange(m), least, threshold)


def _passages(named: np.ndarray, theirs: np.ndarray, own: np.ndarray, other: np.ndarray, own_first: np.ndarray, other_first: np.ndarray, least: int, threshold: float, places: np.ndarray | None = None) -> list[tuple]:
    """Passages, all or those in which some of the places lie, of shingles as numbers (own, other). named: numbers of x's own; theirs: the same for y, above them what x doesn't have."""
    n, m, names = len(own), len(other), int(named.max(initial=-1)) + 1
    also = theirs < names
    first_y = np.full(names, -1)
    at = np.flatnonzero(also)[::-1]
    first_y[theirs[at]] = at
    at = first_y[named]
    shared = at >= 0
    common = _before(shared)
    if common[-1] < threshold * least * 0.9:
        return []
    edges = np.flatnonzero(np.diff(shared, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    lone, only, also = _before(~shared & own_first), _before(~also & other_first), _before(also)
    most = np.count_nonzero(first_y >= 0)
    # Where a text repeats itself, what a span has of one side only needn't stand there first.
    beside, besides = _apart(own, ~shared, own_first, least), _apart(other, theirs >= names, other_first, least)
    fewest = int(besides.min(initial=m)) if m >= least else 0
    lowest = np.minimum.reduceat(np.where(shared, at, m), starts)
    highest = np.maximum.reduceat(at, starts) + 1
    held = None if places is None else np.searchsorted(places, np.arange(n + 1))
    out: list[tuple[int, int, int, int, float]] = []

    def at_most(a, b, c, d):
        """What the similarity of two spans can be at most, from prefix counts: shared places and distinct ones of one side only."""
        both = np.minimum(np.minimum(common[b] - common[a], also[d] - also[c]), most)
        alone = np.maximum(lone[b] - lone[a], beside[a]) + np.maximum(only[d] - only[c], besides[c])
        return both / np.maximum(both + alone, 1)

    def distinct(a: int, b: int, c: int, d: int) -> float:
        one, two = np.zeros(names, bool), np.zeros(names, bool)
        one[named[a:b]] = True
        mine = theirs[c:d]
        inside = mine < names
        two[mine[inside]] = True
        beside = np.sort(other[c:d][~inside])
        alone = np.count_nonzero(beside[1:] != beside[:-1]) + (len(beside) > 0)
        return np.count_nonzero(one & two) / (np.count_nonzero(one | two) + alone)

    def judged(a: int, b: int):
        places = at[a:b][shared[a:b]]
        # The middle of the places guards against shingles that y repeats elsewhere.
        c, d = int(places.min()), int(places.max()) + 1
        if d - c > 1.5 * (b - a) + 2 * SHINGLE:
            mid = int(np.median(places - np.flatnonzero(shared[a:b])))
            c, d = max(mid, 0), min(mid + (b - a), m)
        if d - c < least:  # few distinct shingles: they repeat further on in y, or it has no such passage
            d = min(c + (b - a), m)
            c = max(d - (b - a), 0)
        if d - c < least or at_most(a, b, c, d) < threshold - 1e-9:
            return c, d, 0.0
        return c, d, distinct(a, b, c, d)

    # Only spans that can reach the threshold are judged, the longest first.
    done, step = -1, max(1, RUN_PAIRS // len(starts))
    for top in range(0, len(starts), step):
        rows = np.arange(top, min(top + step, len(starts)))
        a, b = starts[rows][:, None], ends[None, top:]
        both, alone = np.minimum(common[b] - common[a], most), np.maximum(lone[b] - lone[a], beside[a])
        ahead = np.arange(top, len(starts))[None, :] >= rows[:, None]
        fit = ahead & (b - a >= least) & (both >= threshold * (both + alone) - 1e-9)
        if held is not None:
            fit &= held[b] > held[a]
        if not fit.any():
            continue
        c = np.minimum.accumulate(np.where(ahead, lowest[None, top:], m), axis=1)
        d = np.maximum.accumulate(np.where(ahead, highest[None, top:], 0), axis=1)
        c, d = np.minimum(c, d), d
        moved = ((d - c > 1.5 * (b - a) + 2 * SHINGLE) | (d - c < least)) & (both >= threshold * (both + alone + fewest) - 1e-9)
        fit &= moved | (at_most(a, b, c, d) >= threshold - 1e-9)
        for i in np.flatnonzero(fit.any(axis=1)).tolist():
            for j in (top + np.flatnonzero(fit[i])[::-1]).tolist():
                if j <= done:
                    break
                c, d, similar = judged(int(starts[top + i]), int(ends[j]))
                if similar >= threshold:
                    out.append((int(starts[top + i]), int(ends[j]), c, d, similar))
                    done = j
                    break
    return out


def _verified(source):
    names = ["a", "a_start", "a_words", "b", "b_start", "b_words", "similarity"]
    for batch in source:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            x, y = np.frombuffer(r["x"], "<u4"), np.frombuffer(r["y"], "<u4")
            for a, b, c, d, s in passages(x, y, WORDS - SHINGLE + 1, THRESHOLD):
                rows.append((r["a"], r["a_from"] + a, b - a + SHINGLE - 1, r["b"], r["b_from"] + c, d - c + SHINGLE - 1, s))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)


def _compared(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Verified passages of candidates (written)."""
    ids = written(found.select("a").union(found.select("b")).distinct().withColumnRenamed("a", "doc_id"), "involved")
    sets = written(texts.join(checked(ids), "doc_id", "left_semi").mapInArrow(tidy(_shingles), "doc_id long, shingles binary"), "shingles")
    cut = lambda s: F.expr(f"substring(shingles, 4 * {s}_from + 1, 4 * ({s}_to - {s}_from + 1))")
    both = found.join(sets, found["a"] == sets["doc_id"]).withColumn("x", cut("a")).drop("doc_id", "shingles")
    both = both.join(sets, both["b"] == sets["doc_id"]).withColumn("y", cut("b")).drop("doc_id", "shingles")
    kinds = "a long, a_start long, a_words long, b long, b_start long, b_words long, similarity double"
    links = both.mapInArrow(tidy(_verified), kinds)
    later = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))
    out = [("doc_id", "a", "b"), ("start", "a_start", "b_start"), ("words", "a_words", "b_words"), ("kept_id", "b", "a"), ("kept_start", "b_start", "a_start"), ("kept_words", "b_words", "a_words")]
    made = written(links.select(*(pick(x, y).alias(n) for n, x, y in out), "similarity").distinct(), "passages")
    dropped(ids, sets)
    return made


def repeats(docs: DataFrame) -> DataFrame:
    """Verified passages: doc_id (the later document), start, words; kept_id (the earlier), kept_start, kept_words; similarity.
    Starts and lengths are in words."""
    texts = one_text_per_id(docs)
    members = shared_windows(texts)
    met = written(candidates(members), "islands")
    every = _compared(texts, met)
    dropped(met)
    # A group's first and last document have met all others; left to meet are those between them, the first of which has no earlier one.
    between = members.where("doc_id <> lo AND doc_id <> hi").select("key", "doc_id", "f", "c")
    several = written(between.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "several")
    between = written(between.join(checked(several), "key"), "between")
    dropped(members, several)
    marked = written(_marked(between, every), "marked")
    if not marked.where("rest").isEmpty():
        every = every.unionByName(_left_over(texts, marked))
    dropped(between, marked)
    return every.distinct()


def _cut(spans_name: str):
    def batches(source):
        for batch in (part for whole in source for part in row_slices(whole, "text", SLICE)):
            names = batch.schema.names
            texts, out = batch.column("text"), []
            offsets, words = list_parts(pc.utf8_split_whitespace(strings(texts)))
            for k, (text, spans) in enumerate(zip(texts.to_pylist(), batch.column(spans_name).to_pylist(), strict=True)):
                at, borders = 0, []
                for w in words.slice(offsets[k], offsets[k + 1] - offsets[k]).to_pylist():
                    if w:
                        at = text.index(w, at)
                        borders.append((at, at + len(w)))
                        at += len(w)
                gone = np.zeros(len(borders), bool)
                for s in spans:
                    gone[s["start"] : s["start"] + s["words"]] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                parts, at = [], 0
                for a, b in edges:
                    parts.append(text[at : borders[a][0]])
                    at = borders[b - 1][1]
                out.append(("".join(parts) + text[at:]).strip())
            keep = [n for n in names if n != spans_name]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in keep], keep)

    return batches


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut from all but the earliest document that has it; documents of which nothing
    is left go. Rows without an id stay as they are, and so do extra columns, whatever their names; n_chars is counted anew.
    An empty table stays empty."""
    found = written(repeats(docs), "repeats")
    of, spans_name = unused(docs, "spans_of"), unused(docs, "spans")
    spans = written(found.groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("start", "words")).alias(spans_name)), "spans")
    dropped(found)
    joined = docs.join(checked(spans), docs["doc_id"] == spans[of], "left").drop(of)
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    whole = joined.where(F.col(spans_name).isNull()).drop(spans_name)
    shorter = joined.where(F.col(spans_name).isNotNull()).mapInArrow(tidy(_cut(spans_name)), kinds).where("text <> ''")
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionAll(shorter)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
