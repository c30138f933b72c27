"""Toxicity: class-conditional Kneser-Ney bigram models and their length-normalised log-likelihood difference.

Words are lower-cased runs of letters and digits, all of them cut into pieces of PIECE code points, so that inflected forms share
what they have in common; pieces are what the models speak of. A text's first piece follows an opening mark. With counts n_t (toxic) and n_o (ordinary) of an
expression x in the two classes' texts and a discount D, x's share of the toxic class is

    q(x) = (max(n_t - D, 0) + freed(x) Q(x)) / (n_t + n_o)

where freed(x) is what D takes from both counts, pooled and shared out by Q, what the next shorter expression says: for a pair vw the odds of v and w multiplied,
for a piece w the toxic share of all. Pieces count by their continuation: the number of distinct pieces before them in the class. So
P_t(w | v) / P_o(w | v) is the odds of vw by the odds of v, that of w alone for a pair never seen, and 1 for an unknown piece: a rare expression
falls back to counts that both classes share and speaks for neither. The pooled probability that both classes' models contain cancels. No count is too
small to be used.

A document's score is a logistic function of the difference of its log-likelihoods divided by its number of pieces and by
the root of that number, and of the sum of the fourth powers of differences that speak for toxic, divided by that root: a few strong expressions
in a long text (the difference alone can't tell these; see the README). It is fitted on sampled documents that the counts have not seen, as is the pairs'
discount. If these lack one of the classes, all sampled documents serve for both.

Null and empty texts have no words: their difference is 0 and their score what the function gives there.
Where labels of either class are missing there is nothing to learn and every score is 0. Null ids and repeated
rows are scored like others; a document labelled twice counts as toxic if either label says so. `toxicity` carries extra columns but
replaces ones named score or predicted; `accepted` keeps every column as it is. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import list_parts, row_slices, strings, table, tidy, written

NAME = "op9_toxicity"
ORACLE_SQL = None

#: Bound of the sample of labelled rows, for each class; the counts and the fit see no more, whatever the input's size.
TOXIC_ROWS, ORDINARY_ROWS = 3_000, 5_000
#: One in so many sampled rows is kept from the counts, for fitting the score.
FIT_EVERY = 4
THRESHOLD = 0.3
#: Bytes of text taken at once.
SLICE = 2_000_000
PIECE = 5
#: Discount of pieces, and those of pairs to choose from by the fit's loss.
DISCOUNT, DISCOUNTS = 3.0, (3.0, 10.0, 30.0)
OPENING = np.uint64(0)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of each text's words, those that continue a word told apart by a mark: offsets, and a 64-bit hash of each."""
    import xxhash

    cut = pc.replace_substring_regex(pc.utf8_lower(strings(texts)), "\\+", " ")
    cut = pc.replace_substring_regex(cut, r"([\p{L}\p{N}]{%d})" % PIECE, r"\1 +")
    offsets, flat = list_parts(pc.split_pattern_regex(cut, r"[^\p{L}\p{N}+]+"))
    encoded = flat.dictionary_encode()
    names = encoded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) if w and w != "+" else 0 for w in names), np.uint64, len(names))
    every = hashed[encoded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    keep = every != 0
    return np.concatenate([[0], np.cumsum(keep)])[offsets], every[keep]


def pairs(offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The left neighbour of each word; the text's opening for the first."""
    left = np.concatenate([[OPENING], words[:-1]]) if len(words) else words
    left[offsets[:-1][offsets[:-1] < len(words)]] = OPENING
    return left


def _count_pairs(batches):
    for batch in batches:
        for part in row_slices(batch, "text", SLICE):
            offsets, words = words_of(part.column("text"))
            toxic = np.repeat(part.column("toxic").to_numpy(), np.diff(offsets))
            seen, n = np.unique(np.stack([pairs(offsets, words), words, toxic.astype(np.uint64)]), axis=1, return_counts=True)
            v, w, t = (x.view(np.int64) for x in np.ascontiguousarray(seen))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(np.where(t > 0, n, 0)), pa.array(np.where(t > 0, 0, n))], ["v", "w", "ct", "co"])


def log_odds(q):
    q = np.clip(q, 1e-9, 1 - 1e-9)
    return np.log(q / (1 - q))


def share(toxic: np.ndarray, ordinary: np.ndarray, discount: float, back) -> np.ndarray:
    """The toxic class's share of expressions with these counts, what the discount frees being shared out by `back`."""
    left_t, left_o = np.maximum(toxic - discount, 0), np.maximum(ordinary - discount, 0)
    every = toxic + ordinary
    return np.where(every > 0, (left_t + (every - left_t - left_o) * back) / np.maximum(every, 1), back)


class Model:
    """Log ratios P_t / P_o of pieces and, for each discount, of pairs, from the sample's counts (v, w, ct, co)."""

    def __init__(self, counted: pa.Table):
        get = lambda c: counted.column(c).to_numpy()
        v, w, toxic, ordinary = get("v"), get("w"), get("ct"), get("co")
        keys = pair_key(v, w)
        order = np.argsort(keys)
        self.pair_keys, v, w, toxic, ordinary = keys[order], v[order], w[order], toxic[order], ordinary[order]
        self.word_keys, place = np.unique(np.concatenate([v, w]), return_inverse=True)
        as_v, as_w, m = place[: len(v)], place[len(v) :], len(self.word_keys)
        continued = [np.bincount(as_w, c > 0, m) for c in (toxic, ordinary)]
        of_words = continued[0].sum() / max(sum(c.sum() for c in continued), 1)
        word = log_odds(share(*continued, DISCOUNT, of_words)) - log_odds(of_words)
        of_pairs = toxic.sum() / max(toxic.sum() + ordinary.sum(), 1)
        before = log_odds(share(np.bincount(as_v, toxic, m), np.bincount(as_v, ordinary, m), DISCOUNT, of_pairs)) - log_odds(of_pairs)
        back = _logistic(log_odds(of_pairs) + before[as_v] + word[as_w])
        self.word_ratio = word.astype(np.float32)
        self.pair_ratio = {d: (log_odds(share(toxic, ordinary, d, back)) - log_odds(of_pairs) - before[as_v]).astype(np.float32) for d in DISCOUNTS}
        self.fit, self.discount = np.zeros(4), DISCOUNTS[0]

    def chosen(self, discount: float, fit: np.ndarray) -> None:
        self.discount, self.fit, self.pair_ratio = discount, fit, {discount: self.pair_ratio[discount]}

    def features(self, texts: pa.Array, discount: float) -> np.ndarray:
        """What the score is a function of, for each text."""
        offsets, words = words_of(texts)
        left, words, m = pairs(offsets, words).view(np.int64), words.view(np.int64), len(offsets) - 1
        each = looked_up(self.word_keys, self.word_ratio, words, 0.0)
        each = looked_up(self.pair_keys, self.pair_ratio[discount], pair_key(left, words), each)
        row, n = np.repeat(np.arange(m), np.diff(offsets)), np.maximum(np.diff(offsets), 1)
        difference, strong = (np.bincount(row, x, m) for x in (each, np.maximum(each, 0) ** 4))
        return np.stack([np.ones(m), difference / n, difference / np.sqrt(n), np.log1p(strong / np.sqrt(n))], axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _logistic(self.features(texts, self.discount) @ self.fit)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    """The value of each wanted key, or the default where there is none."""
    if not len(keys):
        return np.broadcast_to(default, len(wanted)).astype(np.float64)
    distinct, back = np.unique(wanted, return_inverse=True)
    place = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    return np.where((keys[place] == distinct)[back], values[place][back], default)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (v * np.int64(-7046029254386353131)) ^ w


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, b = x / scale, np.zeros(x.shape[1])
    for _ in range(60):
        p = _logistic(x @ b)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b)), x.T @ (weight * (y - p)) - 1e-2 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b / scale


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, dict]:
    """Labelled texts, at most about TOXIC_ROWS and ORDINARY_ROWS of them, chosen by a hash of the id; their classes' numbers."""
    may = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None, n
    share = F.when(F.col("toxic") == 1, TOXIC_ROWS / n[1]).otherwise(ORDINARY_ROWS / n[0])
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000))
    chosen = known.where(place < share * 1_000_000).withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(FIT_EVERY)) == 0)
    chosen = written(chosen, "sample")  # bounded by the two constants
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fit"), n


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The two models and the score's fit. Counts are summed relationally; only those of the bounded sample reach the driver."""
    sample, n = _sample(docs, labels)
    if sample is None:
        return None
    sample = written(sample, "labelled")
    parts = {(r["toxic"], r["fit"]) for r in sample.select("toxic", "fit").distinct().collect()}
    if {t for t, _ in parts} != {0, 1}:
        return None
    apart = len(parts) == 4
    seen, unseen = (sample.where(~F.col("fit")), sample.where("fit")) if apart else (sample, sample)
    counted = seen.mapInArrow(tidy(_count_pairs), "v long, w long, ct long, co long").groupBy("v", "w").agg(F.sum("ct").alias("ct"), F.sum("co").alias("co"))
    model = Model(counted.toArrow())
    if not len(model.pair_keys):
        return None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for batch in batches:
            for part in row_slices(batch, "text", SLICE):
                each = np.concatenate([sent.value.features(part.column("text"), d) for d in DISCOUNTS], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(list(each)), part.column("toxic")], ["x", "toxic"])

    found = unseen.select("text", "toxic").mapInArrow(tidy(features), "x array<double>, toxic int").toArrow()
    sent.destroy()
    y = found.column("toxic").to_numpy()
    each = np.array(found.column("x").to_pylist()).reshape(len(y), len(DISCOUNTS), -1)
    have = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    weight = np.where(y == 1, n[1] / have[1], n[0] / have[0]) * len(y) / (n[0] + n[1])
    losses, fits = [], []
    for k in range(len(DISCOUNTS)):
        fits.append(_fitted(each[:, k], y, weight))
        p = np.clip(_logistic(each[:, k] @ fits[k]), 1e-9, 1 - 1e-9)
        losses.append(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum())
    best = int(np.argmin(losses))
    model.chosen(DISCOUNTS[best], fits[best])
    return model


def toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns with score and predicted beside; one pass over the texts, no shuffle."""
    taken = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    if model is None:
        return docs.select(*taken, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def scored(batches):
        for batch in batches:
            for part in row_slices(batch, "text", SLICE):
                score = sent.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*taken).schema)
    return docs.select(*taken).mapInArrow(tidy(scored), f"{kinds}, score double, predicted int")


def accepted(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns and whatever these are called, that are not predicted toxic."""
    columns = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    found = toxicity(docs.select("text", F.struct(*columns).alias("row")), model, threshold)
    return found.where("predicted = 0").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
