"""Every operator and pipeline stage on awkward rows: nulls, empty and repeated texts, very long ones, extra columns, no rows at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proofline.llm import bpe, exact_dedup, license_scan, lm_score, ngram_join, packing, quality, substring_dedup, token_order, toxicity
from proofline.shipping import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, a string, b string, _t string, _h string"


@pytest.fixture(scope="module")
def awkward(spark):
    ship(spark)
    long_ = " ".join(f"w{i % 9973}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "same words here"), (5, "same words here"), (5, "same words here"), (6, long_), (7, long_ + " more"), (None, "no id"), (None, None), (8, "Apache License, MIT license. CC-BY"), (9, "aﬁ\x00\x85é <|endoftext|> \U0001f600"), (2**40, "a " * 3000)]
    return spark.createDataFrame([(*r, "en", None, None, 0.5, "k", "a", "b", "t", "h") for r in rows], SCHEMA)


def empty(df):
    return df.where("false")


OPERATORS = {
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "quality": lambda d: quality.quality(d),
    "license": lambda d: license_scan.scan(d),
    "bpe": lambda d: bpe.digests(d),
    "packing": lambda d: packing.pack(d, length=64, block=6400),
    "order": lambda d: token_order.in_training_order(d, length=64, slots=32),
    "near": lambda d: ngram_join.ngram_join(d)[0],
    "substring": lambda d: substring_dedup.repeats(d),
    "lm": lambda d: lm_score.lm_score(d),
    "toxicity": lambda d: toxicity.toxicity(d, None),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_awkward_rows(awkward, name):
    found = OPERATORS[name](awkward).collect()
    if name in ("exact", "quality", "license", "bpe", "lm", "toxicity"):
        assert len(found) == awkward.count()
    assert OPERATORS[name](empty(awkward)).count() == 0


def test_exact_dedup_values(awkward):
    found = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_dedup(awkward).collect()}
    same = [r for r in found.values() if r["keep_id"] == 5]
    assert {r["doc_id"] for r in same} == {4, 5} and same[0]["group_size"] == 3
    assert [r["doc_id"] for r in found.values() if r["keep_id"] == 2 and r["kept"]] == [2]
    kept = exact_dedup.deduplicated(awkward).select("text").collect()
    assert len(kept) == len({r["text"] or "" for r in awkward.collect()})


def test_collisions_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, content_hash=lambda t: F.lit("x")).collect()}
    assert found == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True)}


def test_pipeline_stages_on_awkward_rows(awkward, spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, str(tmp_path))
        assert name == "packing" or out.columns == awkward.columns
        out.collect()
        assert stage(spark, empty(awkward), str(tmp_path)).count() == 0


def test_stages_keep_the_documents_own_columns(spark, tmp_path):
    """Columns that stages use names of themselves come out as they went in."""
    names = ["score", "predicted", "_id", "_spans", "spans", "spans_of", "class_id", "kept", "gone", "SCORE2", "row"]
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = [(1, f"one {passage} first"), (2, f"two {passage} second"), (3, "other text"), (4, "other text"), (5, None)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], schema)
    spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = {r["doc_id"]: r for r in out.collect()}
        assert all(r[n] == f"{n}{i}" for i, r in found.items() for n in names)
        kept[name] = {i: r["text"] for i, r in found.items()}
    texts = {i: t for i, t in rows}
    assert kept["exact_dedup"] == {i: texts[i] for i in (1, 2, 4, 5)} and kept["ngram_join"] == {i: texts[i] for i in (1, 3, 5)}
    assert kept["substring_dedup"] == texts | {2: "two second"} or kept["substring_dedup"] == texts | {2: "two  second"}


def test_pipeline_on_a_small_table(spark):
    """Each stage's outcome on the documents that the stage before kept."""
    folder = "/root/testdata/sf0.001"
    docs = ship(spark).read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() <= before.keys()
        if name == "exact_dedup":
            assert len(set(after.values())) == len(after) and set(after.values()) == set(before.values()) and all(i == max(k for k in before if before[k] == t) for i, t in after.items())
        if name == "ngram_join":
            assert all(after[i] == before[i] for i in after) and len(after) < len(before)
        if name == "substring_dedup":
            assert all(len(after[i]) <= len(before[i]) for i in after) and min(after) == min(before)
        before = after
    packed = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == after.keys() and all(r["start"] + r["length"] <= r["doc_tokens"] for r in packed)
