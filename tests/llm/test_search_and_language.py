"""Language identification, ranked search and hard negatives: brute force, held-out accuracy, awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofline.llm import hard_negatives, language_id, lexical_search
from proofline.shipping import ship

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return ship(spark).read.parquet(f"{FOLDER}/documents.parquet")


# ---- language ----


def plain_grams(text):
    text = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    data = f" {text} ".encode() if text else b""
    return [data[i : i + 4] for i in range(max(1, len(data) - 3))] if data else []


def plain_model(rows):
    """Languages, and the set of those that contain each n-gram, from (language, text)."""
    n = collections.Counter(lang for lang, _ in rows)
    seen = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for g in set(plain_grams(text)):
            seen[g][lang] += 1
    share = {g: {x: k / n[x] for x, k in c.items()} for g, c in seen.items()}
    return sorted(n, key=lambda x: (-n[x], x)), {g: {x for x, k in seen[g].items() if k >= 2 and share[g][x] >= 0.1 * max(share[g].values())} for g in seen}


def test_languages_equal_brute_force(spark, docs, monkeypatch):
    """With filters too large to err, the counts of n-grams are those of plain sets."""
    monkeypatch.setattr(language_id, "ROOM", 4_000)
    monkeypatch.setattr(language_id, "SLOTS", 1 << 24)
    rows = docs.collect()
    learnt = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    languages, held = plain_model([(r["lang"], r["text"]) for r in learnt])
    filters = language_id.train(docs)
    assert filters.languages == languages and filters.wrong.max() < 1e-6
    found = {r["doc_id"]: r for r in language_id.identified(docs.select("doc_id", "text"), filters).collect()}
    for r in rows:
        grams = plain_grams(r["text"])
        hits = [sum(x in held.get(g, ()) for g in grams) for x in languages]
        if not re.search(r"[^\W\d_]", r["text"]):
            assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == ("und", 0)
        else:
            assert found[r["doc_id"]]["lang_pred"] == languages[int(np.argmax(hits))]
            assert found[r["doc_id"]]["score"] == pytest.approx(max(hits) / len(grams), abs=1e-5)


def test_languages_of_held_out_rows(spark, docs):
    found = language_id.query(docs.sparkSession, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    told = [r for r in found if r["lang_pred"] != "und"]
    assert len(told) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.98


def test_small_filters_err_and_are_corrected(docs):
    """Foreign hits of a crowded filter are taken off by expectation."""
    random.seed(1)
    words = {x: ["".join(random.choices(letters, k=6)) for _ in range(300)] for x, letters in (("x", "abcdefghijkl"), ("y", "mnopqrstuvwz"))}
    rows = [(i, " ".join(random.choices(words[x], k=40)), x) for i, x in enumerate("xy" * 60)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language_id.train(df, F.lit(True))
    slots = np.zeros((1, 1 << 13), np.uint32)
    for k in range(whole.slots.shape[1]):
        slots[0, k % (1 << 13)] |= whole.slots[0, k]
    crowded = language_id.Filters(whole.languages, slots)
    assert crowded.wrong.min() > 0.02
    shares = crowded.shares(pa.array([r[1] for r in rows]))
    foreign = [shares[i, whole.languages.index("y" if r[2] == "x" else "x")] for i, r in enumerate(rows)]
    assert abs(np.mean(foreign)) < 0.1


def test_many_languages(docs):
    """More languages than bits in a word."""
    spark = docs.sparkSession
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(10 * i + k, " ".join(alphabet[i % 26] + alphabet[i // 26] * 2 + alphabet[(i * 7 + j) % 26] for j in range(12)), f"l{i:02}") for i in range(70) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identified(df, language_id.train(df, F.lit(True))).collect()
    assert all(r["lang"] == r["lang_pred"] for r in found)


def test_awkward_texts(docs):
    spark = docs.sparkSession
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "a"), (5, "the " * 50_000), (None, "über"), (6, "日本語の文"), (6, "日本語の文")]
    df = spark.createDataFrame([(*r, "q", 9.0, "r") for r in rows], "doc_id long, text string, lang_pred string, score double, _row string")
    filters = language_id.train(docs)
    found = language_id.identified(df, filters).collect()
    assert [r["lang_pred"] == "und" and r["score"] == 0 for r in found] == [True, True, True, False, False, False, False, False]
    assert found[6] == found[7] and found[6]["lang_pred"] == filters.languages[0] and found[6]["score"] < 0.1 and found[0]["_row"] == "r"
    assert language_id.identified(df.where("false"), filters).count() == 0
    nothing = language_id.train(docs.where("false"))
    assert nothing is None and {r["lang_pred"] for r in language_id.identified(df, nothing).collect()} == {"und"}


# ---- search ----


def plain_search(docs, items, top):
    terms = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = {i: collections.Counter(terms(t)) for i, t in docs.items()}
    counts = {i: c for i, c in counts.items() if c}
    n, length = len(counts), sum(c.total() for c in counts.values())
    df = collections.Counter(t for c in counts.values() for t in c)
    out = []
    for item, text in items.items():
        scores = []
        for i, c in counts.items():
            m = 100 - 75 + 75 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            scores += [(-s, i)] if s > 0 else []
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return out


def test_search_equals_brute_force_on_awkward_rows(spark):
    ship(spark)
    random.seed(5)
    words = ["a", "B", "éa", "x1", " ", "Ünd", "-", "0", "z", "the"]
    docs = [(i, " ".join(random.choices(words, k=random.randrange(12)))) for i in range(60)] + [(60, None), (61, ""), (62, "the " * 30_000), (63, "a B"), (64, "a B"), (65, "À b\x00c")]
    items = [(i, " ".join(random.choices(words, k=6))) for i in range(12)] + [(12, None), (13, "nowhere"), (14, "the the a"), (15, "")]
    d = spark.createDataFrame([(*r, "n", 1) for r in [*docs, (None, "a a a"), (5, "")]], "doc_id long, text string, n string, rank int")
    q = spark.createDataFrame([(*r, 1.0) for r in [*items, (None, "a"), (14, "the")]], "item_id long, text string, score double")
    wanted = plain_search(dict(docs), dict(items), 3)
    for block in (lexical_search.BLOCK, 20):  # one block of items, and many
        found = lexical_search.search(d, q, top=3, block_bytes=block)
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert lexical_search.search(d.where("false"), q).count() == 0 and lexical_search.search(d, q.where("false")).count() == 0


def test_radix_passes_sort_wide_keys():
    random.seed(2)
    key = np.array([random.randrange(1 << 40) for _ in range(5_000)] + [7, 7, 1 << 39], np.int64)
    order = lexical_search.radix_sorted(key, 40)
    assert (key[order] == np.sort(key)).all() and list(order[key[order] == 7]) == sorted(order[key[order] == 7])


# ---- hard negatives ----


def plain_negatives(rows):
    live = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        live[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * v) for v in x])
    out = []
    for a, (own, x) in live.items():
        if a % 100:
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in live.items()}
        best = sorted((-score[i], i) for i, (label, _) in live.items() if label == own and i != a)[:5]
        for s, p in best:
            few = sorted((-score[i], i) for i, (label, _) in live.items() if label != own and -80 * s <= 100 * score[i] <= -100 * s)[:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(few)]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 5])
def test_negatives_equal_brute_force(spark, monkeypatch, width):
    ship(spark)
    random.seed(width)
    vector = lambda: [random.gauss(0, 0.4) for _ in range(width)]
    rows = [(i * random.choice((1, 5)), vector(), random.randrange(4)) for i in range(700)]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(10_000 + i, [0.25] * width, 1) for i in range(30)] + [(9_900, [0.25] * width, 2), (-100, [-0.5] * width, 1)]
    rows += [(20_001, None, 1), (20_002, [None] * width, 1), (20_003, [float("nan")] * width, 1), (20_004, [float("inf")] * width, 2), (20_005, [0.1] * width, None), (None, [0.1] * width, 1), (20_006, [], 2), (20_100, [0.5], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, vector string")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    wanted = plain_negatives(rows)
    monkeypatch.setattr(hard_negatives, "SCORES", 900)  # many slices, so that bounds from one filter the next
    for block in (hard_negatives.BLOCK, 2):
        assert sorted(map(tuple, hard_negatives.mined(df.repartition(3), block=block).collect())) == wanted
    twice = df.unionByName(df.where("vec_id % 3 = 0"))
    assert sorted(map(tuple, hard_negatives.mined(twice).collect())) == wanted
    assert hard_negatives.mined(df.where("false")).count() == 0 and hard_negatives.mined(df.where("vec_id % 100 <> 0")).count() == 0


def test_bounds_hold_and_filter():
    r = np.random.default_rng(4)
    x = np.floor(r.normal(0, 32, (3_000, 64))).astype(np.int64)
    centres = hard_negatives.centres_of(x[:1_000])
    codes = np.stack([hard_negatives.nearest(x[:, 2 * j : 2 * j + 2].astype(float), c) for j, c in enumerate(centres)], axis=1).astype(np.uint8)
    left = x - np.concatenate([c[codes[:, j]] for j, c in enumerate(centres)], axis=1)
    wide = np.full((10, 1), 1)
    anchors = hard_negatives.Anchors(np.arange(10), np.zeros(10, np.int64), x[:10], centres, wide, wide, True, 5)
    low, high = anchors.bounds(codes, np.sqrt((left**2).sum(1)).astype(np.float32), slice(0, 10))
    exact = x @ x[:10].T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 0.5 * exact.std() * 4
