"""Hard negatives: for each anchor and positive, rows of other labels that score nearly as high, found exactly by bounded product quantisation.

Rows are whole numbers: each component x is floor(256 x). A score is the inner product with the anchor. Vectors are cut into pairs of components, each pair is coded
by the nearest of at most 256 centres (k-means on a bounded sample), and every row stores its codes and the norm of what the centres leave over. An anchor's products
with all centres are a lookup table; with it a row's score is known up to the anchor's norm times the row's residual norm (and the rounding of sums), which
is a bound, not an estimate. A row goes to the exact integer rerank if its upper bound reaches the least score that can still matter: the best that enough
rows surely reach, by their lower bounds or by exact scores seen before. Nothing else is left out, so the result equals brute force.

Positives come first (the best rows of the anchor's own label), then the windows: rows of other labels with 80 p <= 100 s <= 100 p for a positive's score p. Anchors are a stated
query set, taken in blocks of bounded number against all rows. A task keeps its best rows of each anchor or window; these meet in salted parts, then by anchor.

Rows with a null id, label or vector, or with a component that is null, not finite or 65,536 or more in size take no part. Shorter vectors count as padded with zeros; an empty one
has score 0 with all. Of rows that repeat an id the one with the smallest label and vector counts. Equal scores go by smaller id. An anchor without rows of its label, or a
negative positive score (whose window is empty), has no rows. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.shared import dropped, freed, list_parts, table, tidy, written

NAME = "op13_hard_negatives"
POSITIVES, NEGATIVES = 5, 5
#: Rows that the centres are fitted on, whatever the input's size; every row is coded.
SAMPLE, CENTRES, ROUNDS = 8_192, 256, 8
#: Components that share a code.
WIDTH = 2
#: Anchors taken at once, and scores held at once by a task.
BLOCK, SCORES = 4_096, 1_000_000
SALTS = 64
NOWHERE = np.iinfo(np.int64).min

ORACLE_SQL = """
WITH live AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM live a JOIN live b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""


def live(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (whole numbers) of the rows that take part, one for each id."""
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("int"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 65_536))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & usable)
    found = found.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("vector"))
    if found.groupBy("vec_id").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, padded with zeros."""
    offsets, flat = list_parts(vectors)
    out = np.zeros((len(offsets) - 1, width), np.int64)
    n = np.diff(offsets)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(offsets[:-1], n)] = flat.to_numpy()
    return out


def centres_of(sample: np.ndarray) -> np.ndarray:
    """Centres of each group of components: (groups, centres, WIDTH). Fewer distinct points than centres are centres themselves."""
    out = []
    for group in np.split(sample.astype(np.float64), sample.shape[1] // WIDTH, axis=1):
        points, weight = np.unique(group, axis=0, return_counts=True)
        if len(points) <= CENTRES:
            found = np.concatenate([points, np.broadcast_to(points[:1] if len(points) else np.zeros((1, WIDTH)), (CENTRES - len(points), WIDTH))])
        else:
            found = points[np.linspace(0, len(points) - 1, CENTRES).astype(np.int64)]
            for _ in range(ROUNDS):
                near = nearest(points, found)
                total = np.bincount(near, weight, CENTRES)
                for c in range(WIDTH):
                    mean = np.bincount(near, weight * points[:, c], CENTRES) / np.maximum(total, 1)
                    found[:, c] = np.where(total > 0, mean, found[:, c])
        out.append(found)
    return np.array(out).reshape(-1, CENTRES, WIDTH)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


def encoded(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with their codes and residual norms (rounded up), in the shared folder."""
    sent, width = rows.sparkSession.sparkContext.broadcast(centres), len(centres) * WIDTH

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4_096):
                part = batch.slice(start, 4_096)
                x = matrix(part.column("vector"), width)
                codes = np.zeros((len(x), len(centres)), np.uint8)
                left = np.zeros(len(x))
                for j, own in enumerate(sent.value):
                    group = x[:, j * WIDTH : (j + 1) * WIDTH].astype(np.float64)
                    codes[:, j] = nearest(group, own)
                    left += ((group - own[codes[:, j]]) ** 2).sum(1)
                norm = np.nextafter(np.sqrt(left).astype(np.float32), np.float32(np.inf)) * np.float32(1.000001)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(x), [None, pa.py_buffer(codes)]).cast(pa.binary()) if codes.shape[1] else pa.array([b""] * len(x))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), packed, pa.array(norm), part.column("vector")], ["vec_id", "label", "codes", "residual", "vector"])

    return written(rows.mapInArrow(tidy(run), "vec_id long, label long, codes binary, residual float, vector array<int>"), "codes")


class Anchors:
    """A block of anchors by label, with their lookup tables and what is wanted of each: windows (low, high) of scores, a number of rows in each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, wanted: int):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.low, self.high, self.same, self.wanted, self.width = low[order], high[order], same, wanted, vectors.shape[1]
        groups = self.vectors.astype(np.float64).reshape(len(ids), -1, WIDTH)
        tables = np.einsum("agw,gcw->gca", groups, centres)
        norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        # Sums of so many single-precision numbers are off by less than this.
        self.slack = (np.abs(tables).max(axis=1).sum(axis=0) * (len(centres) + 4) * 2.0**-22 + 1e-6) if len(centres) else np.zeros(len(ids))
        self.tables, self.norms = tables.astype(np.float32), norms

    def bounds(self, codes: np.ndarray, residual: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores (rows, anchors) of rows with these codes."""
        n = at.stop - at.start
        score = np.zeros((len(codes), n), np.float32)
        for own, code in zip(self.tables, codes.T, strict=True):
            score += own[code, at]
        off = (residual.astype(np.float64)[:, None] * self.norms[at] + self.slack[at]) * 1.000001
        return score - off, score + off


class Found:
    """The best rows of every anchor's windows so far, as exact scores and ids."""

    def __init__(self, anchors: Anchors):
        self.anchors, shape = anchors, (*anchors.low.shape, anchors.wanted)
        self.score, self.id = np.full(shape, NOWHERE), np.full(shape, np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, codes: np.ndarray, residual: np.ndarray, vectors: np.ndarray, at: slice) -> None:
        """Rows that anchors at these places may take (their labels have been compared)."""
        a, wanted = self.anchors, self.anchors.wanted
        lower, upper = a.bounds(codes, residual, at)
        maybe = np.zeros(lower.shape, bool)
        for k in range(a.low.shape[1]):
            low, high = a.low[at, k].astype(np.float64), a.high[at, k].astype(np.float64)
            least = np.maximum(low, self.score[at, k, -1])
            enough = wanted + a.same  # an anchor may meet itself, which doesn't count
            if len(ids) >= enough and (self.score[at, k, -1] == NOWHERE).any():
                # What enough rows that are surely inside surely reach.
                sure = np.where((lower >= low) & (upper <= high), lower, -np.inf)
                least = np.maximum(least, np.partition(sure, len(ids) - enough, axis=0)[len(ids) - enough])
            maybe |= (upper >= least) & (lower <= high) & (a.low[at, k] <= a.high[at, k])
        row, anchor = np.nonzero(maybe)
        for start in range(0, len(row), 200_000):
            self._exact(ids, vectors, row[start : start + 200_000], anchor[start : start + 200_000] + at.start)

    def _exact(self, ids: np.ndarray, vectors: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> None:
        """The exact rerank of candidates."""
        a = self.anchors
        own = a.ids[anchor] != ids[row]
        row, anchor = row[own], anchor[own]
        score = np.einsum("ij,ij->i", vectors[row], a.vectors[anchor])
        for k in range(a.low.shape[1]):
            inside = (score >= np.maximum(a.low[anchor, k], self.score[anchor, k, -1])) & (score <= a.high[anchor, k])
            touched = np.unique(anchor[inside])
            if not len(touched):
                continue
            who = np.concatenate([np.repeat(touched, a.wanted), anchor[inside]])
            value = np.concatenate([self.score[touched, k].ravel(), score[inside]])
            name = np.concatenate([self.id[touched, k].ravel(), ids[row[inside]]])
            order = np.lexsort((name, -value.astype(np.float64), who))
            who, value, name = who[order], value[order], name[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            few = place < a.wanted
            self.score[who[few], k, place[few]], self.id[who[few], k, place[few]] = value[few], name[few]

    def batch(self) -> pa.RecordBatch:
        anchor, window, place = np.nonzero(self.score != NOWHERE)
        columns = (self.anchors.ids[anchor], self.anchors.high[anchor, window], self.id[anchor, window, place], self.score[anchor, window, place])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "high", "vec_id", "score"])


def _best(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """anchor_id, high, vec_id, score: the best rows of every window in each task, in salted parts."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        a = sent.value
        found, step = Found(a), max(1, SCORES // max(len(a.ids), 1))
        kinds = np.unique(a.labels)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids, labels, residual = (part.column(c).to_numpy() for c in ("vec_id", "label", "residual"))
                vectors = matrix(part.column("vector"), a.width)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
                for kind in kinds:
                    rows_ = np.flatnonzero((labels == kind) == a.same)
                    if len(rows_):
                        at = slice(int(np.searchsorted(a.labels, kind)), int(np.searchsorted(a.labels, kind, side="right")))
                        found.add(ids[rows_], codes[rows_], residual[rows_], vectors[rows_], at)
        yield found.batch()

    best = rows.mapInArrow(tidy(run), "anchor_id long, high long, vec_id long, score long").withColumn("salt", F.spark_partition_id() % SALTS)
    for keys in (("anchor_id", "high", "salt"), ("anchor_id", "high")):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= anchors.wanted)
    return best.drop("salt")


def mined(rows: DataFrame, every: int = 100, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for anchors whose id is divisible by `every`."""
    spark = rows.sparkSession
    whole = written(live(rows), "vectors")
    n, longest, asked = whole.agg(F.count("*"), F.max(F.size("vector")), F.count_if(F.col("vec_id") % every == 0)).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not asked:
        dropped(whole)
        return spark.createDataFrame([], schema)
    width = -(-longest // WIDTH) * WIDTH
    sample = whole.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * SAMPLE / n).select("vector").toArrow()
    centres = centres_of(matrix(sample.column("vector").combine_chunks(), width))
    coded = encoded(whole, centres)
    dropped(whole)
    found, blocks = None, -(-asked // block)
    for k in range(blocks):
        mine = coded.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k)).select("vec_id", "label", "vector").toArrow()
        if not mine.num_rows:
            continue
        ids, labels, vectors = mine.column("vec_id").to_numpy(), mine.column("label").to_numpy(), matrix(mine.column("vector").combine_chunks(), width)
        far = np.iinfo(np.int64).max
        anywhere = np.full((len(ids), 1), NOWHERE + 1), np.full((len(ids), 1), far)
        positives = written(_best(coded, Anchors(ids, labels, vectors, centres, *anywhere, True, POSITIVES)).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        # A window for each distinct score of an anchor's positives; those not used are empty.
        high = np.full((len(ids), POSITIVES), -1)
        place = {i: p for p, i in enumerate(ids.tolist())}
        for row in positives.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("s")).collect():
            high[place[row["anchor_id"]], : len(row["s"])] = row["s"]
        low = np.where(high >= 0, -(-80 * high // 100), far)
        windows = _best(coded, Anchors(ids, labels, vectors, centres, low, high, False, NEGATIVES)).select("anchor_id", F.col("high").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
        part = written(positives.join(windows, ["anchor_id", "positive_score"]).select(*(c.split()[0] for c in schema.split(", "))), "mined")
        dropped(positives)
        found = part if found is None else found.unionByName(part)
    dropped(coded)
    freed(spark)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))
