"""Dense numbers, quantiles and whole batches against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.operators import batch, ordering, rollup
from proofline.operators.reconcile import BatchInputError
from proofline.shipping import ship


@pytest.fixture(scope="module")
def samples(spark):
    random.seed(8)
    return [(random.choice("ab"), float(random.choice((random.randrange(40), 7, -0.5)))) for _ in range(3_000)] + [("one", 3.5), ("none", None)]


def test_numbers_are_dense_and_in_order(spark, samples):
    df = spark.createDataFrame(samples, "key string, value double").repartition(7)
    found = ordering.numbered(df, "key", "value", start=5).orderBy("number").collect()
    assert [r["number"] for r in found] == list(range(5, len(samples) + 5))
    assert [(r["key"], r["value"]) for r in found] == sorted(samples, key=lambda r: (r[0], -1e9 if r[1] is None else r[1]))
    assert ordering.numbered(df.where("false"), "key").count() == 0


def test_quantiles_equal_linear_ones(spark, samples):
    df = spark.createDataFrame(samples, "key string, value double")
    wanted = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = {r["key"]: r for r in ordering.quantiles(df, "value", wanted, "key").collect()}
    assert set(found) == {"a", "b", "one"}
    for key in found:
        own = [v for k, v in samples if k == key]
        assert [found[key][n] for n in wanted] == pytest.approx([np.percentile(own, 100 * q) for q in wanted.values()])
        assert found[key]["n"] == len(own)
    whole = ordering.quantiles(df, "value", {"p95": 0.95}).first()
    assert whole["p95"] == pytest.approx(np.percentile([v for _, v in samples if v is not None], 95))
    assert rollup.timing(df.where("key = 'a'"), "value").first()["mean"] == pytest.approx(np.mean([v for k, v in samples if k == "a"]))


@pytest.mark.parametrize("whole", [True, False])
def test_weighted_medians(spark, samples, whole):
    random.seed(9)
    rows = [(k, v, random.randrange(4) if whole else random.randrange(1, 40) / 8) for k, v in samples]
    df = spark.createDataFrame([(k, v, int(w) if whole else w) for k, v, w in rows], f"key string, value double, w {'long' if whole else 'double'}")
    found = {r["key"]: r["weighted_median"] for r in ordering.weighted_median(df, "value", "w", "key").collect()}
    for key in ("a", "b"):
        own = sorted((v, w) for k, v, w in rows if k == key)
        running = np.cumsum([w for _, w in own])
        assert found[key] == own[int(np.searchsorted(running, running[-1] / 2, side="left"))][0]


def judge(statuses):
    """A verifier that gives all eleven checks the status of the brand's number."""

    def verify(matched):
        number = F.regexp_extract("brand_name", "([0-9]+)", 1).cast("int")
        status = F.element_at(F.array(*map(F.lit, statuses)), number % len(statuses) + 1)
        checks = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("check")) for i, c in enumerate(K.CHECKS)))
        return matched.withColumn("status", status).select("filename", "status", F.explode(checks).alias("c")).select("filename", "c.*", "status")

    return verify


def listed(spark, names):
    return spark.createDataFrame([(n, f"Brand {i}", i) for i, n in enumerate(names)], "filename string, brand_name string, order long")


def test_twenty_images(spark):
    ship(spark)
    names = ["LABEL_00.PNG", *(f"label_{i:02}.png" for i in range(1, 19)), "missing.png"]
    uploads = spark.createDataFrame([(f"label_{i:02}.png", i, bytearray(b"x")) for i in range(20)], "filename string, order long, content binary")
    found = rollup.triaged(batch.results(listed(spark, names), uploads, judge([K.FAIL, K.REVIEW, K.PASS])))
    rows = found.collect()
    assert [r["filename"] for r in rows] == ["LABEL_00.PNG", *(f"label_{i:02}.png" for i in range(3, 19, 3)), "missing.png", "label_19.png", *(f"label_{i:02}.png" for i in range(1, 19, 3)), *(f"label_{i:02}.png" for i in range(2, 19, 3))]
    assert sorted(r["order"] for r in rows) == list(range(21))
    errors = {r["filename"]: r for r in rows if r["error"]}
    assert {n: (r["error"], r["status"], r["order"]) for n, r in errors.items()} == {"missing.png": (K.MISSING_IMAGE, K.NOT_EVALUATED, 19), "label_19.png": (K.MISSING_MANIFEST, K.NOT_EVALUATED, 20)}
    assert errors["missing.png"]["application"]["brand_name"] == "Brand 19" and errors["label_19.png"]["application"] is None
    assert batch.violations(found).count() == 0


def test_severity_order_and_errors_as_failures(spark):
    names = ["pass.png", "nothing.png", "review.png", "missing.png", "fail.png"]
    uploads = spark.createDataFrame([(n, i) for i, n in enumerate(names) if n != "missing.png"], "filename string, order long")
    found = rollup.triaged(batch.results(listed(spark, names), uploads, judge([K.PASS, K.NOT_EVALUATED, K.REVIEW, K.PASS, K.FAIL])))
    assert [r["filename"] for r in found.collect()] == ["missing.png", "fail.png", "review.png", "nothing.png", "pass.png"]


def test_checks_that_are_not_made(spark):
    """A verifier without an answer is an error; one without all checks earns no pass."""
    names = ["lost.png", "part.png", "whole.png"]
    uploads = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "filename string, order long")
    verify = lambda m: judge([K.PASS])(m).where("filename <> 'lost.png'").where("filename <> 'part.png' OR position > 0")
    rows = {r["filename"]: r for r in batch.results(listed(spark, names), uploads, verify).collect()}
    assert (rows["lost.png"]["error"], rows["lost.png"]["checks"], rows["lost.png"]["rank"]) == (K.PROCESSING_ERROR, None, 0)
    assert (rows["part.png"]["status"], rows["whole.png"]["status"]) == (K.NOT_EVALUATED, K.PASS)


def test_stopped_batch_keeps_what_is_finished(spark):
    names = [f"{i}.png" for i in range(6)]
    uploads = spark.createDataFrame([(n, i) for i, n in enumerate(names) if i], "filename string, order long")
    whole = batch.results(listed(spark, names), uploads, judge([K.PASS]))
    found = batch.stopped(whole, spark.createDataFrame([("2.png",), ("4.png",)], "filename string")).orderBy("order").collect()
    assert [r["error"] for r in found] == [K.MISSING_IMAGE, K.CANCELLED, None, K.CANCELLED, None, K.CANCELLED]
    assert [r["status"] for r in found] == [K.PASS if i in (2, 4) else K.NOT_EVALUATED for i in range(6)]


def test_what_can_not_be_told_apart_or_be(spark):
    twice = spark.createDataFrame([("a.png", "x", 0), ("A.png", "y", 1)], "filename string, brand_name string, order long")
    with pytest.raises(BatchInputError, match="repeats filename 'A.png'"):
        batch.checked_manifest(twice)
    rows = [(" ", 0, [], None), ("a", 1, None, None), ("b", 2, [], "e"), ("c", 3, [], None), ("d", 4, None, "e"), (None, 5, [], None)]
    df = spark.createDataFrame(rows, "filename string, order long, checks array<string>, error string")
    assert [(r["order"], r["problem"][:8]) for r in batch.violations(df).orderBy("order").collect()] == [(0, "filename"), (1, "a batch "), (2, "a batch "), (5, "filename")]
