"""Operators against brute force, exact round trips or held-out accuracy, on the smallest tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from proofline.llm import bpe, license_scan, lm_score, ngram_join, packing, quality, substring_dedup, token_order, toxicity
from proofline.shipping import ship

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return ship(spark).read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def near_pairs(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_near_copies(docs, texts):
    found, _ = ngram_join.ngram_join(docs)
    rows = {r["doc_id"]: r for r in found.collect()}
    pairs = near_pairs(texts)
    links = collections.Counter(x for p in pairs for x in p)
    assert {i: rows[i]["n_links"] for i in texts} == {i: links[i] for i in texts}
    assert all(rows[a]["class_id"] == rows[b]["class_id"] for a, b in pairs)


def test_large_buckets_still_make_one_class(spark):
    random.seed(3)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(60):
        w = list(base)
        w[random.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"own{i}x{k}" for k in range(50))) for i in range(20)]
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert {r["class_id"] for r in found if r["doc_id"] < 100} == {0}
    assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in found if r["doc_id"] >= 100)


def test_copies_that_resemble_only_their_base(spark):
    random.seed(8)
    base = [f"word{i}" for i in range(300)]
    texts = {50: " ".join(base)}
    for i in [*range(50), *range(51, 101)]:
        w = list(base)
        for k in range(4):
            w[random.randrange(70) + 75 * k] = f"new{i}x{k}"
        texts[i] = " ".join(w)
    rows = [*texts.items(), (200, texts[50]), (201, texts[3].upper())]
    found = {r["doc_id"]: r for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    pairs = near_pairs(dict(rows))
    assert all((i, 50) in pairs or (50, i) in pairs for i in texts if i != 50) and len(pairs) < 1000
    assert {r["class_id"] for r in found.values()} == {0}
    # Banding finds a pair of 0.87 almost surely.
    links = collections.Counter(x for p in pairs for x in p)
    assert {i: r["n_links"] for i, r in found.items()} == links


def test_links_of_a_large_group_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    random.seed(9)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(80):
        w = list(base)
        w[random.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[7][1]), (101, rows[7][1].upper())]
    found = {r["doc_id"]: r for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert {r["n_links"] for r in found.values()} == {81} and {r["class_id"] for r in found.values()} == {0}


def test_bands_reach_the_recall():
    b = ngram_join.bands_for(0.8, 0.999, 6)
    assert 1 - (1 - 0.8**6) ** b >= 0.999 > 1 - (1 - 0.8**6) ** (b - 1)


def test_compact_windows_are_those_of_the_whole_tree():
    rng = np.random.default_rng(5)
    for n in (0, 3, 10, 60):
        offsets = np.array([0, n // 3, n])
        values = rng.integers(0, 2**62, n, dtype=np.uint64)
        for width in (1, 3, 7):
            l, c, r = substring_dedup.compact_windows(offsets, values, width)  # noqa: E741
            wanted = set()
            for a, b in ((0, n // 3), (n // 3, n)):
                for k in range(a, b):
                    i, j = k, k
                    while i > a and values[i - 1] > values[k]:
                        i -= 1
                    while j < b - 1 and values[j + 1] > values[k]:
                        j += 1
                    if j - i + 1 >= width:
                        wanted.add((i, k, j))
            assert set(zip(l.tolist(), c.tolist(), r.tolist(), strict=True)) == wanted


def test_repeated_passages(docs, texts):
    found = substring_dedup.repeats(docs).collect()
    words = {i: t.lower().split() for i, t in texts.items()}
    covered = collections.defaultdict(set)
    for r in found:
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["words"]))
        x, y = (words[i][s : s + n] for i, s, n in ((r["doc_id"], r["start"], r["words"]), (r["kept_id"], r["kept_start"], r["kept_words"])))
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x, y))
        assert len(x) >= 50 and len(a & b) >= 0.8 * len(a | b) and r["doc_id"] > r["kept_id"]
    where = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    for i, w in words.items():
        for k in range(len(w) - 49):
            if min(where[tuple(w[k : k + 50])]) < i:
                assert covered[i].issuperset(range(k, k + 50))


def test_insertions_leave_passages_whole():
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    ids: dict = {}
    shingles = lambda w: np.array([ids.setdefault(tuple(w[k : k + 5]), len(ids)) for k in range(len(w) - 4)], "<u4")
    for n in range(6, 21):
        for length, at in ((90, 45), (150, 75), (150, 50)):
            base = words("w", length)
            copy = base[:at] + words(f"new{n}x", n) + base[at:]
            own, other = set(shingles(base).tolist()), set(shingles(copy).tolist())
            wanted = len(own & other) / len(own | other)
            for x, y in ((copy, base), (base, copy)):
                x, y = words("left", 20) + x + words("ahead", 20), words("early", 30) + y + words("late", 10)
                found = substring_dedup.passages(shingles(x), shingles(y), 46, 0.8)
                whole = [(a, b, s) for a, b, _, _, s in found if a == 20 and b == len(x) - 24]
                assert bool(whole) == (wanted >= 0.8) and all(abs(s - wanted) < 1e-9 for *_, s in whole)


def test_a_base_in_the_middle_of_its_variants(spark):
    random.seed(12)
    base = [f"word{i}" for i in range(60)]
    variant = lambda i: [*base[: (k := 10 + i % 40)], f"new{i}", *base[k + 1 :]]
    around = lambda i, w: " ".join([*(f"own{i}x{k}" for k in range(30)), *w, *(f"end{i}x{k}" for k in range(30))])
    rows = [(i, around(i, base if i == 20 else variant(i))) for i in range(41)]
    line = [f"line{k}" for k in range(8)]
    passage = [*(f"say{k}" for k in range(22)), *line, *(f"tell{k}" for k in range(22))]
    rows += [(100 + i, around(100 + i, passage if i in (20, 21) else line)) for i in range(42)]
    found = {r["doc_id"]: r for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 121 in found and found[121]["kept_id"] == 120 and found[121]["words"] >= 52
    assert sum(i in found for i in range(21, 41)) >= 19 and found.keys() <= {*range(1, 41), 121}


def test_rows_of_a_family_of_near_copies_grow_with_its_members(spark):
    random.seed(21)
    line = [f"line{k}" for k in range(8)]
    base = [f"word{k}" for k in range(150)]

    def variant(i):
        own = list(base)
        for k in random.sample(range(150), 3):
            own[k] = f"new{i}x{k}"
        return " ".join([*own, *line])

    made = []
    for n in (60, 180):
        rows = [(i, variant(i)) for i in range(1, n + 1)] + [(k, " ".join([f"other{k}"] * 60 + line)) for k in (0, n + 1)]
        found = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len({r["doc_id"] for r in found}) >= 0.9 * (n - 1)
        made.append(len(found))
    assert made[1] <= 4 * made[0]


def test_regions_cover_what_brute_force_covers():
    rng = np.random.default_rng(41)
    covered = 0
    for family in range(12):
        length, period = int(rng.integers(60, 200)), int(rng.choice([20, 45, 1000]))
        base = np.arange(length) % period
        docs = np.sort(rng.integers(0, 25, 30))
        shingles = []
        for k in range(30):
            own = base[rng.integers(0, 10) : length - rng.integers(0, 10)].copy()
            for at in rng.integers(0, len(own), rng.integers(0, 4)):
                own[at : at + 5] = 10_000 + 100 * k + at + np.arange(len(own[at : at + 5]))
            shingles.append(own.astype("<u4"))
        shingles[20] = shingles[3]
        rest = [np.unique(rng.integers(0, len(x), rng.integers(0, 8))).astype("<i4") for x in shingles]
        doubles = [np.unique(rng.integers(0, 4, 2)) for _ in shingles]
        for sides in (np.zeros(30, np.int64), rng.integers(0, 2, 30)):
            found = {a: set() for a in range(30)}
            for a, b, passages in substring_dedup._met(docs, sides, rest, shingles, doubles):
                assert docs[b] < docs[a] and set(passages) <= set(substring_dedup.passages(shingles[a], shingles[b], substring_dedup.WIDTH, 0.8))
                found[a].update(p for x, y, *_ in passages for p in range(x, y))
            for a in range(30):
                for b in range(30):
                    if docs[b] < docs[a] and set(doubles[a]) & set(doubles[b]) and (sides.min() == sides.max() or sides[a] != sides[b]):
                        wanted = {p for x, y, *_ in substring_dedup.passages(shingles[a], shingles[b], substring_dedup.WIDTH, 0.8) for p in rest[a].tolist() if x <= p < y and shingles[a][p] in shingles[b]}
                        covered += len(wanted)
                        assert wanted <= found[a]
    assert covered > 1000


def test_regions_meet_those_with_a_place_left(monkeypatch):
    met, bound = [], substring_dedup._near_enough
    monkeypatch.setattr(substring_dedup, "_near_enough", lambda *a: met.append(len(a[0])) or bound(*a))
    core, n = np.arange(42), 40
    shingles = [np.concatenate([1000 + 100 * k + np.arange(40), core, 50_000 + 100 * k + np.arange(40)]).astype("<u4") for k in range(n)]
    alone = [np.array([3, 100], "<i4")] * n
    assert not list(substring_dedup._met(np.arange(n), np.zeros(n, np.int64), alone, shingles, [np.array([1])] * n)) and not met


def test_equal_texts_are_one_passage():
    for x in (np.arange(60), np.arange(60) % 50, np.arange(45)):
        found, other = (substring_dedup.passages(x, y, substring_dedup.WIDTH, substring_dedup.THRESHOLD) for y in (x, np.append(x, 1000)))
        assert found == other and [(a, b, s) for a, b, *_, s in found] == [(0, len(x), 1.0)][: len(x) >= 46]


def test_repetitive_texts_are_judged_few_times(monkeypatch):
    counted, count = [], np.count_nonzero
    monkeypatch.setattr(np, "count_nonzero", lambda *a, **k: counted.append(1) or count(*a, **k))
    line = np.arange(31)
    x, y = (np.tile(np.where(line < 6, other + line, line), 36).astype("<u4") for other in (100, 200))
    assert not substring_dedup.passages(x, y, substring_dedup.WIDTH, substring_dedup.THRESHOLD) and len(counted) <= 20


def test_double_keys_of_texts_that_repeat_themselves_grow_with_their_places():
    rng = np.random.default_rng(31)
    hashes = rng.integers(-(2**62), 2**62, 30)

    def doubles(doc, key, c):
        x, y, double = substring_dedup._double_keys(doc, key, c, (key % 4).astype(np.int32))
        return x, set(zip(doc[x].tolist(), x.tolist(), double.tolist(), strict=True)) | set(zip(doc[y].tolist(), y.tolist(), double.tolist(), strict=True))

    for spread in (50, 300, 3000):
        places = np.unique(np.stack([rng.integers(0, 3, 200), rng.integers(0, 30, 200), rng.integers(0, spread, 200)]), axis=1)
        doc, key, c = places[0], hashes[places[1]], places[2]
        near = lambda i, j: doc[i] == doc[j] and 0 < abs(c[i] - c[j]) <= substring_dedup.NEAR and (key[i] - key[j]) % 4 and key[i] < key[j]  # noqa: B023, E731
        double = lambda a, b: int(substring_dedup.mix(substring_dedup.mix(np.array([a]).view(np.uint64)) ^ np.array([b]).view(np.uint64), 1).view(np.int64)[0])
        wanted = {(int(doc[i]), k, double(key[i], key[j])) for i in range(len(doc)) for j in range(len(doc)) if near(i, j) for k in (i, j)}
        assert doubles(doc, key, c)[1] == wanted
    for n in (1000, 10000):
        c = np.arange(n)
        assert len(doubles(np.zeros(n, np.int64), hashes[c % 8], c)[0]) <= 20 * n


def test_cutting_leaves_the_rest(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(1, f"start one\n{passage}\nend one"), (2, f"begin  two {passage} stop two"), (3, passage), (4, "clean text")]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[4] == "clean text" and 3 not in out
    assert re.sub(r"\s+", " ", out[2]) == "begin two stop two"


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    own, other = bpe.ByteEncoder(bpe.FILE), tokenizers.Tokenizer.from_file(bpe.tokenizer_path(bpe.FILE))
    random.seed(1)
    parts = ["a", "th", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "1", "23", "!", "...", "'s", "'", "'ll", "漢", "😀", "́", "\x00", "İ", "ſ", "\r\n", "_", "²", "<|", "%.", "#"]
    said = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(4000)]
    offsets, ids = own(pa.array(said))
    wanted = other.encode_batch(said, add_special_tokens=False)
    decoded = own.bpe.decode(offsets, ids)
    for k in range(len(said)):
        assert wanted[k].ids == ids[offsets[k] : offsets[k + 1]].tolist()
        assert decoded[k] == other.decode(wanted[k].ids, skip_special_tokens=False)


def test_pairs_stay_apart_as_merging_anew_says():
    own = bpe.ByteBpe(bpe.tokenizer_path(bpe.FILE))
    tokens = list(own.rank)

    def merged(data):
        ranks = [own.rank[c] for c in data]
        while len(ranks) > 1:
            first, at = min((own.joined.get(pair, bpe.NEVER), k) for k, pair in enumerate(zip(ranks, ranks[1:], strict=False)))
            if first == bpe.NEVER:
                break
            ranks[at : at + 2] = [first]
        return ranks

    random.seed(2)
    runs = [k for k, t in enumerate(tokens) if len(set(t)) == 1]
    pairs = [(random.randrange(len(tokens)), random.randrange(len(tokens))) for _ in range(5000)] + [(random.choice(runs), random.choice(runs)) for _ in range(5000)]
    pairs += [(k, random.choice(runs)) for k in random.sample(range(len(tokens)), 2000)] + random.sample(own.parts[300:], 2000)
    wanted = [merged(tokens[a] + tokens[b]) == [a, b] for a, b in pairs]
    assert [own._apart(a, b) for a, b in pairs] == wanted and 0 < sum(wanted) < len(pairs)
    assert all((t in own.reached) == (merged(t) == [k]) for k, t in enumerate(tokens[:20000]))


def test_packing(docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(packing.tokenizer_path(packing.FILE))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and zlib.crc32(ids[i][at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # full, or another power of two: no padding


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        for key in (1, 2):
            assert sorted(token_order.permuted(np.arange(n), n, key)) == list(range(n))
    assert (token_order.permuted(np.arange(1000), 1000, 1) != token_order.permuted(np.arange(1000), 1000, 2)).mean() > 0.9


def test_shards_resume_at_any_slot(docs, texts, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    ordered = token_order.in_training_order(docs, length=256, slots=64)
    rows = ordered.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    made = token_order.write_shards(ordered, str(tmp_path)).collect()
    assert sum(r["slots"] for r in made) == len(rows)
    for r in rows:
        with open(tmp_path / f"{r['shard']:06d}.bin", "rb") as f:
            f.seek(r["offset"])
            assert f.read(512) == bytes(r["ids"])
    # In the order of their numbers, sequences say each task's texts, each ended; read as one text by the library's decoder.
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path(bpe.FILE))
    wanted = {i: [*library.encode(t, add_special_tokens=False).ids, token_order.END] for i, t in texts.items()}
    assert sum(r["n_tokens"] for r in rows) == sum(map(len, wanted.values()))
    n, at = len(rows), {r["slot"]: r for r in rows}
    said = [x for k in token_order.permuted(np.arange(n), n, token_order.KEY) for x in np.frombuffer(at[k]["ids"], "<u2")[: at[k]["n_tokens"]].tolist()]
    left, start = {tuple(x): i for i, x in wanted.items()}, 0
    for k, x in enumerate(said):
        if x == token_order.END and tuple(said[start : k + 1]) in left:
            start = k + 1
    assert start == len(said)


def test_lm_scores(docs, texts):
    words = {i: t.lower().split() for i, t in texts.items()}
    one, two = collections.Counter(), collections.Counter()
    for w in words.values():
        one.update(w)
        two.update(zip([None, *w], w, strict=False))
    total, texts_with_words = sum(one.values()), sum(map(bool, words.values()))
    for r in lm_score.lm_score(docs, slice_bytes=100_000).collect():
        w = words[r["doc_id"]]
        if not w:
            assert r["score"] is None
            continue
        own, pairs, said, rest = collections.Counter(w), collections.Counter(zip([None, *w], w, strict=False)), 0.0, total - len(w)
        for v, x in zip([None, *w], w, strict=False):
            if (c := two[v, x] - pairs[v, x]) > 0:
                said += math.log(c / (texts_with_words - 1 if v is None else one[v] - own[v]))
            else:
                said += math.log(0.4 * (one[x] - own[x]) / rest) if one[x] > own[x] else math.log(0.16 / rest)
        assert abs(said / len(w) - r["score"]) < 1e-9


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in toxicity.query(ship(spark), folder).collect()}
    marked = [(r["toxic"], found[r["doc_id"]]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    held = [(t, r["predicted"]) for t, r in marked if r["held_out"]]
    hit = sum(t and p for t, p in held)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in found.items())
    assert hit >= 0.85 * sum(t for t, _ in held) and hit >= 0.75 * sum(p for _, p in held)


def test_toxicity_learns_from_the_least(spark):
    plain, vile, other = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    said = {i: f"plain words number {i} and more" for i in range(50)} | {vile: "you vile trash", other: "vile trash again", 100: None}
    docs = spark.createDataFrame([*said.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(plain, 0), (vile, 1)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert len(found) == 51 and all(0 <= r["score"] <= 1 for r in found.values()) and found[other]["score"] > found[plain]["score"]


def test_toxicity_ratios_follow_from_the_counts():
    """The model's log ratios on a toy corpus against the formulas, pair by pair."""
    said = [("a b", 1), ("a b", 1), ("a c b", 0), ("a c", 0), ("c b", 0), ("a b", 0)]
    pairs, before = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for text, toxic in said:
        for v, w in zip([None, *text.split()], text.split(), strict=False):
            pairs[v, w][1 - toxic] += 1
    for (v, _), n in pairs.items():
        before[v] = [x + y for x, y in zip(before[v], n, strict=True)]
    odds = lambda q: math.log(max(q, 1e-9) / max(1 - q, 1e-9))

    def share(n, discount, back):
        left = [max(x - discount, 0) for x in n]
        return (left[0] + (sum(n) - sum(left)) * back) / sum(n)

    kinds = {w: [sum(1 for (_, x), n in pairs.items() if x == w and n[c]) for c in (0, 1)] for _, w in pairs}
    of_words = sum(n[0] for n in kinds.values()) / sum(sum(n) for n in kinds.values())
    of_pairs = sum(n[0] for n in pairs.values()) / sum(sum(n) for n in pairs.values())
    word = {w: odds(share(n, toxicity.DISCOUNT, of_words)) - odds(of_words) for w, n in kinds.items()}
    left = {v: odds(share(n, toxicity.DISCOUNT, of_pairs)) - odds(of_pairs) for v, n in before.items()}
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in said]), pa.array([x for _, x in said], pa.int32())], ["text", "toxic"])
    counted = pa.Table.from_batches(list(toxicity._count_pairs([batch]))).group_by(["v", "w"]).aggregate([("ct", "sum"), ("co", "sum")]).rename_columns(["v", "w", "ct", "co"])
    model = toxicity.Model(counted)
    for d in toxicity.DISCOUNTS:
        for text in ("a b", "b c a", "c", "a zz b"):
            words, wanted = text.split(), 0.0
            for v, w in zip([None, *words], words, strict=False):
                if (v, w) in pairs:
                    back = 1 / (1 + math.exp(-(odds(of_pairs) + left[v] + word[w])))
                    wanted += odds(share(pairs[v, w], d, back)) - odds(of_pairs) - left[v]
                else:
                    wanted += word.get(w, 0.0)
            assert abs(model.features(pa.array([text]), d)[0, 1] - wanted / len(words)) < 1e-5


def test_quality_kept_follows_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in quality.query(ship(spark), folder).collect()}
    marked = [(r["quality"], found[r["doc_id"]]) for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL").collect()]
    good, bad = ([r for q, r in marked if q == x and not r["base_failed"]] for x in (1, 0))
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.6 * len(bad)


def test_near_passages_are_found(spark):
    random.seed(15)
    fresh = (f"x{k}" for k in range(10**9))
    rows, wanted = [], []
    for k in range(60):
        base = [next(fresh) for _ in range(90)]
        for c in range(random.choice([2, 4, 8])):
            copy = list(base)
            for at in random.sample(range(90), 1 if c else 0):
                copy[at] = next(fresh)
            rows.append((len(rows), " ".join([*(next(fresh) for _ in range(30)), *copy, *(next(fresh) for _ in range(20))])))
            if c:
                wanted.append(len(rows) - 1)
    found = {r["doc_id"] for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(i in found for i in wanted) >= 0.98 * len(wanted)


def test_quality_counts(docs, texts):
    for r in quality.quality(docs).collect():
        text = texts[r["doc_id"]]
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = collections.Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wanted = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == wanted
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_em_finds_the_better_rules():
    random.seed(4)
    m = len(quality.RULES)
    patterns = collections.Counter()
    for _ in range(5000):
        good = random.random() < 0.8
        patterns[tuple((1 if random.random() < 0.95 else 0) if good else (-1 if random.random() < 0.6 else 1) for _ in range(m))] += 1
    prior, given = quality.estimated(patterns)
    assert abs(prior - 0.8) < 0.05 and all(g[True][1] > 0.85 and g[False][-1] > 0.4 for g in given)


def test_license_base_places(docs, spark):
    extra = spark.createDataFrame([(10**6, "CC BY cc-by, Apache\nLicense! x gnu general public license version 2 mit license mit  license"), (10**6 + 1, None)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    for r, text in zip(license_scan.scan(every).orderBy("doc_id").collect(), [x["text"] for x in every.orderBy("doc_id").collect()], strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        hits = [(k, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        at = [k for k, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits})) and {x for _, x in hits} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def licenses(text):
    """Labels, number of detections and score by Python's regular expressions."""
    lower, word = (text or "").translate({c: c + 32 for c in range(65, 91)}), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    joined, found, base = " ".join(re.findall(word, lower)), [], []
    signs = re.sub(f"[{license_scan.PLUS}{license_scan.FIELD}]", "\ue002", lower)
    signs = re.sub(r"([0-9])\+(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])", rf"\1{license_scan.PLUS}", signs)
    signs = " ".join(re.findall(word, re.sub(r"(licen[cs]es?|identifier)[\"']?[ \t]*[:=]", rf"\1{license_scan.FIELD} ", signs)))
    for i, (keyword, label, expression, priority, weight) in enumerate(license_scan.rules()):
        read = signs if {license_scan.PLUS, license_scan.FIELD} & set(keyword) else joined
        if keyword in f" {read} ":
            for m in re.finditer(f"(?<= )(?:{expression})(?= )", f" {read} "):
                (found if priority else base).append((read[: m.start()].count(" "), read[: m.end() - 1].count(" "), priority, i, label, weight))
    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and y[2] >= x[2] and ((y[0], y[1], y[2]) != (x[0], x[1], x[2]) or y[3] < x[3])
    kept = [x for x in found if not any(inside(x, y) for y in found)]
    labels = {x[4] for x in kept + base}
    labels = labels - set(license_scan.VAGUE) or labels
    return ",".join(sorted(labels)), len(kept), max([0, *(x[5] for x in kept), *(0.7 for _ in base[:1])])


SAID = {
    "GNU General Public License v3.0": "gpl,gpl-3.0", "under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0", "mit": "", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "GPLv3": "gpl-3.0", "GPLv2 or later": "gpl-2.0-or-later", "Licensed under the Apache License, Version 2.0": "apache,apache-2.0",
    "All rights reserved.": "proprietary", "Copyright X. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "BSD-2-Clause": "bsd-2-clause", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath": "gpl-2.0-or-later", "GPL-3.0": "gpl-3.0", "GNU GPL v3": "gpl-3.0", "GPL 3": "gpl-3.0",
    "General Public License version 2 only": "gpl-2.0", "GPL-2.0-only": "gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0", "GNU GPL version 2 or later": "gpl-2.0-or-later",
    "GPLv2 or any later version": "gpl-2.0-or-later", "LGPL-2.1+": "lgpl-2.1-or-later", "SPDX-License-Identifier: GPL-2.0+": "gpl-2.0-or-later", "License: GPL-3.0+\n": "gpl-3.0-or-later", "GPLv3+, x": "gpl-3.0-or-later",
    "License: MIT": "mit", '"license": "MIT",': "mit", "license = 'Apache-2.0'": "apache-2.0", "a license mit": "", "GPL 2+1": "gpl-2.0", "MIT License: yes": "mit",
    "GNU Affero General Public License version 3": "agpl-3.0", "the Lesser General Public License": "lgpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "gnu",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY": "mit",
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND": "apache-2.0",
}


def test_license_labels(docs, spark):
    assert len(license_scan.rules()) > 400
    random.seed(6)
    words = sorted({w for _, _, x, _, _ in license_scan.rules() for w in re.findall("[a-z0-9]+", x)})
    names = [re.sub(r"\(\?:([^|)]*)[^)]*\)\??|[?]", r"\1", x) for _, _, x, _, _ in license_scan.rules()]
    mixed = [" ".join(random.choice([random.choice(words), random.choice(names)]) for _ in range(random.randint(1, 12))) for _ in range(600)]
    rows = [*enumerate([*SAID, *mixed, None, ""])]
    found = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i]["labels"] for i in range(len(SAID))] == list(SAID.values())
    said = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for r, text in [*((found[i], t) for i, t in rows), *((said[r["doc_id"]], r["text"]) for r in docs.collect())]:
        assert (r["labels"], r["n_detections"], r["score"]) == licenses(text), text
