"""N-gram Jaccard join: MinHash banding for a target recall, shuffle on band hashes, verification on full shingle sets.

Words are lower-cased runs without white space; a document's set holds its shingles of SHINGLE words (all its words as one
shingle where it has fewer). Documents with equal word sequences are one member, counted with its copies. Members that share a
band's bucket are candidates, all of them. Members that buckets of more than SMALL members connect have one home; it is cut into
blocks, and each two blocks are compared once, in a task that counts partners and emits a row for each member instead of one
for each pair. All other pairs are joined with their sets. Only candidates' sets are shuffled.

Result: class_id, the smallest id of the documents connected by verified links (similarity >= THRESHOLD) or equal words, and
n_links, the number of documents that a document's own verified links and copies lead to. A text without
words has no set: it is its own class, without links. Rows without an id are returned with null class and no
links; rows that repeat an id are one document with the greatest of its texts. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import checked, components, mix, one_text_per_id, row_slices, shingle_hashes, table, tidy, word_hashes, written

NAME = "op7_ngram_join"
ORACLE_SQL = None

SHINGLE, THRESHOLD = 5, 0.8
RECALL, ROWS = 0.999, 6
SMALL = 16
#: A block of a home has about so many members at most, and so many bytes of sets.
BLOCK, BLOCK_BYTES = 512, 4_000_000
#: Places of the dense matrices by which blocks are compared.
CELLS = 8_000_000


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of so many rows by which a pair of the threshold's similarity is found with the recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def _signatures(bands: int, rows: int):
    rng = np.random.default_rng(20240607)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def batches(source):
        for batch in source:
            for part in row_slices(batch, "text", 2_000_000):
                offsets, shingles = shingle_hashes(*word_hashes(part.column("text")), SHINGLE)
                size = np.diff(offsets)
                some = np.flatnonzero(size)
                starts = offsets[some]
                place = (np.arange(len(shingles)) - np.repeat(offsets[:-1], size)).astype(np.uint64)
                keys = np.zeros((len(size), 2), np.int64)
                out = np.zeros((len(size), bands), np.uint64)
                if len(some):
                    for k in range(2):
                        keys[some, k] = np.add.reduceat(mix(shingles ^ mix(place, 11 + k), 21 + k), starts).view(np.int64)
                    for b in range(bands):
                        key = np.full(len(some), b, np.uint64)
                        for r in range(b * rows, (b + 1) * rows):
                            key = mix(key ^ np.minimum.reduceat((shingles ^ masks[r]) * factors[r], starts))
                        out[some, b] = key
                lists = pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * bands, out.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(size), lists], ["doc_id", "h1", "h2", "size", "bands"])

    return batches


def _sets(source):
    for batch in source:
        for part in row_slices(batch, "text", 2_000_000):
            offsets, shingles = shingle_hashes(*word_hashes(part.column("text")), SHINGLE)
            sets = [np.unique(shingles[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def _compared(source):
    for batch in source:
        similar = np.zeros(batch.num_rows)
        for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            similar[k] = common / max(len(x) + len(y) - common, 1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar)], ["a", "b", "similarity"])


def _all_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs within buckets of at most SMALL members, without those that share a home: these are compared in its blocks."""
    lists = buckets.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("doc_id", "home"))).alias("l"))
    apart = lambda a: lambda b: a["home"].isNull() | b["home"].isNull() | (a["home"] != b["home"])
    rest = lambda a, i: F.filter(F.slice("l", i + 2, F.size("l")), apart(a))
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(rest(a, i), lambda b: F.struct(a["doc_id"].alias("a"), b["doc_id"].alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


PACKED = {"home": "long", "block": "int", "ids": "binary", "copies": "binary", "bands": "binary", "offsets": "binary", "shingles": "binary"}


def similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """For two lists of sets (offsets, distinct values) which of the first are similar enough to which of the second."""
    n, m = len(x[0]) - 1, len(y[0]) - 1
    values, codes = np.unique(np.concatenate([x[1], y[1]]), return_inverse=True)
    split = len(x[1])
    # Only values that both lists have can be common.
    both = np.zeros(len(values), np.int8)
    both[codes[:split]] |= 1
    both[codes[split:]] |= 2
    place = np.cumsum(both == 3) - 1
    common = np.zeros((n, m), np.float32)
    sides = []
    for (offsets, _), own in ((x, codes[:split]), (y, codes[split:])):
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        some = both[own] == 3
        sides.append((row[some], place[own[some]]))
    total = int((both == 3).sum())
    width = max(min(CELLS // max(n, m, 1), total), 1)
    for at in range(0, total, width):
        dense = []
        for (row, column), rows in zip(sides, (n, m), strict=True):
            here = (column >= at) & (column < at + width)
            matrix = np.zeros((rows, width), np.float32)
            matrix[row[here], column[here] - at] = 1
            dense.append(matrix)
        common += dense[0] @ dense[1].T
    either = np.diff(x[0])[:, None] + np.diff(y[0])[None, :] - common
    return common.astype(np.float64) / np.maximum(either, 1).astype(np.float64) >= threshold


def connected(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix the least node connected with it."""
    label = np.arange(len(linked))
    while True:
        now = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        now = np.minimum(now, now[now])
        if (now == label).all():
            return label
        label = now


def _pack(key, rows):
    """A block's members as one row."""
    sets = rows.column("shingles").to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(s) // 8 for s in sets])]).astype(np.int64)
    bands = np.array(rows.column("bands").to_pylist(), np.int64)
    parts = [rows.column("doc_id").to_numpy().tobytes(), rows.column("copies").to_numpy().tobytes(), bands.tobytes(), offsets.tobytes(), b"".join(sets)]
    columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)]
    return pa.Table.from_arrays(columns, list(PACKED))


def _blocks_compared(threshold: float):
    def compared(rows):
        """a: a member with links between two blocks (or within one), b: the least member connected with it there, links: its partners."""
        sides = []
        for r in rows.to_pylist():
            ids, copies, bands, offsets = (np.frombuffer(r[c], np.int64) for c in ("ids", "copies", "bands", "offsets"))
            sides.append((ids, copies, bands.reshape(len(ids), -1), (offsets, np.frombuffer(r["shingles"], np.uint64))))
        x, y = sides[0], sides[-1]
        met = np.zeros((len(x[0]), len(y[0])), bool)
        for k in range(x[2].shape[1]):
            met |= x[2][:, k][:, None] == y[2][:, k][None, :]
        if len(sides) == 1:
            np.fill_diagonal(met, False)
        linked = met & similar(x[3], y[3], threshold) if met.any() else met
        if len(sides) == 1:
            ids, links, whole = x[0], linked @ x[1], linked
        else:
            ids, links = np.concatenate([x[0], y[0]]), np.concatenate([linked @ y[1], linked.T @ x[1]])
            whole = np.zeros((len(ids), len(ids)), bool)
            whole[: len(x[0]), len(x[0]) :] = linked
            whole[len(x[0]) :, : len(x[0])] = linked.T
        some = np.flatnonzero(links)
        return pa.table({"a": ids[some], "b": ids[connected(whole)][some], "links": links[some].astype(np.int64)})

    return compared


def _by_blocks(homes: DataFrame, threshold: float) -> DataFrame:
    """a, b, links (see `_blocks_compared`) of members with homes (doc_id, home, copies, bands, size, shingles)."""
    about = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("shingles")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    about = written(about, "homes")
    placed = homes.join(checked(about), "home").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    kinds = ", ".join(f"{n} {t}" for n, t in PACKED.items())
    blocks = written(placed.select("home", "block", "doc_id", "copies", "bands", "shingles").groupBy("home", "block").applyInArrow(_pack, kinds), "blocks")
    each = blocks.join(checked(about), "home").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    return written(each.groupBy("home", "i", "j").applyInArrow(_blocks_compared(threshold), "a long, b long, links long"), "partners")


def links(docs: DataFrame, members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of members (doc_id, copies, bands): edges a, b that connect all verified pairs, and doc_id and links, each member's partners
    with their copies, in rows to be added up."""
    buckets = members.select("doc_id", F.explode("bands").alias("key"))
    sized = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    sized = written(sized.where("n > 1"), "buckets")
    joined = written(buckets.join(checked(sized), "key"), "members")
    large = joined.where(F.col("n") > SMALL)
    homes = written(components(large.select(F.col("doc_id").alias("a"), F.col("least").alias("b"))).toDF("doc_id", "home"), "at_home")
    pairs = written(_all_pairs(joined.where(F.col("n") <= SMALL).join(checked(homes), "doc_id", "left")), "pairs")
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(homes.select("doc_id")).distinct(), "candidates")
    sets = written(docs.join(checked(ids), "doc_id", "left_semi").mapInArrow(tidy(_sets), "doc_id long, shingles binary"), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    found = both.select("a", "b", "x", "y").mapInArrow(tidy(_compared), "a long, b long, similarity double").where(F.col("similarity") >= threshold)
    found = written(found.select("a", "b"), "links")
    several = checked(written(members.select(F.col("doc_id").alias("b"), "copies").where("copies > 1"), "copies"))
    each = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(several, "b", "left")
    counts = each.select(F.col("a").alias("doc_id"), F.coalesce("copies", F.lit(1)).alias("links"))
    if homes.isEmpty():
        return found, counts
    blocks = _by_blocks(members.join(checked(homes), "doc_id").join(sets, "doc_id"), threshold)
    return found.unionByName(blocks.where("a <> b").select("a", "b").distinct()), counts.unionByName(blocks.select(F.col("a").alias("doc_id"), "links"))


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, class_id, n_links, n_shingles; edges between members that connect all verified pairs: a, b)."""
    texts = one_text_per_id(docs)
    bands = bands_for(threshold, recall, rows)
    signed = written(texts.mapInArrow(tidy(_signatures(bands, rows)), "doc_id long, h1 long, h2 long, size long, bands array<long>"), "signatures")
    members = signed.where("size > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("member"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    members = written(members, "distinct")
    linked, counts = links(texts, members.select(F.col("member").alias("doc_id"), "copies", "bands"), threshold)
    classes = written(components(linked), "classes")
    partners = counts.groupBy(F.col("doc_id").alias("a")).agg(F.sum("links").alias("links"))
    about = members.select("h1", "h2", "member", "copies").join(partners, F.col("member") == F.col("a"), "left").join(classes, F.col("member") == F.col("node"), "left")
    about = about.select("h1", "h2", F.coalesce("class_id", "member").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = signed.where("size > 0").select("doc_id", "h1", "h2", F.col("size").alias("n_shingles")).join(about, ["h1", "h2"])
    columns = ["doc_id", "class_id", "n_links", "n_shingles"]
    alone = signed.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("size").alias("n_shingles"))
    nameless = docs.where(docs["doc_id"].isNull()).select(*(F.lit(x).cast("long").alias(c) for c, x in zip(columns, (None, None, 0, None), strict=True)))
    return found.select(*columns).unionByName(alone).unionByName(nameless), linked


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))[0]
