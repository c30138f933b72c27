import pytest

from proofline import constants as K
from proofline.operators import rollup, rules
from proofline.plans import report

CONTROL = dict(
    brand_name="OLD TOM DISTILLERY", class_type="Kentucky Straight Bourbon Whiskey", alcohol_content="45% Alc./Vol. (90 Proof)", net_contents="750 mL",
    bottler="Bottled by Old Tom Distillery, Bardstown, Kentucky", origin_country=None,
)
READ = {f"read_{k}": v for k, v in CONTROL.items()} | {"read_government_warning": K.WARNING}


def checked(spark, *changes):
    rows = [{"filename": f"{i}.png"} | CONTROL | READ | c for i, c in enumerate(changes)]
    schema = ", ".join(f"{k} string" for k in rows[0])
    labels = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    return rules.long_form(rules.evaluated(labels), "filename")


def test_control_label(spark):
    found = {r["check"]: r for r in checked(spark, {}).collect()}
    assert [k for k, r in found.items() if r["status"] == "PASS"] == [k for k in K.CHECKS if k in ("brand_name", "class_type", "alcohol_content", "net_contents", "net_contents_standard_of_fill", "bottler", "government_warning", "government_warning_prefix")]
    assert all(r["extracted"] and r["confidence"] is not None for r in found.values() if r["status"] == "PASS")


CASES = [
    ("brand_name", dict(read_brand_name="Old Tom Distillery, LLC"), "PASS"), ("brand_name", dict(read_brand_name="OLDTOM DISTILLERY"), "PASS"), ("brand_name", dict(read_brand_name="Old Tim Distillary"), "REVIEW"),
    ("brand_name", dict(read_brand_name="Blue Moon"), "FAIL"), ("brand_name", dict(read_brand_name=None), "NOT_EVALUATED"), ("brand_name", dict(read_brand_name="!!"), "NOT_EVALUATED"),
    ("class_type", dict(read_class_type="Kentucky Straight Bourbon Whisky"), "PASS"), ("class_type", dict(read_class_type="Vodka"), "FAIL"),
    ("alcohol_content", dict(read_alcohol_content="45.3% ABV"), "PASS"), ("alcohol_content", dict(read_alcohol_content="45.4% ABV"), "FAIL"), ("alcohol_content", dict(read_alcohol_content="45% ABV 80 proof"), "FAIL"),
    ("alcohol_content", dict(read_alcohol_content="45% or so"), "REVIEW"), ("alcohol_content", dict(class_type="Hard Seltzer"), "REVIEW"), ("alcohol_content", dict(alcohol_content="45% ABV 80 proof"), "REVIEW"),
    ("alcohol_content", dict(class_type="Table Wine", alcohol_content="12% ABV", read_alcohol_content="13.5% ABV"), "PASS"), ("alcohol_content", dict(class_type="Table Wine", alcohol_content="14.5% ABV", read_alcohol_content="16% ABV"), "FAIL"),
    ("net_contents", dict(read_net_contents="0.75 L"), "PASS"), ("net_contents", dict(read_net_contents="25.36 fl oz"), "PASS"), ("net_contents", dict(read_net_contents="751 mL"), "FAIL"), ("net_contents", dict(read_net_contents="12 floz"), "REVIEW"),
    ("net_contents_standard_of_fill", dict(read_net_contents="25.4 fl oz"), "PASS"), ("net_contents_standard_of_fill", dict(read_net_contents="701 mL"), "REVIEW"), ("net_contents_standard_of_fill", dict(read_net_contents="701 mL", net_contents="701 mL"), "FAIL"),
    ("net_contents_standard_of_fill", dict(class_type="Lager Beer"), "NOT_EVALUATED"), ("net_contents_standard_of_fill", dict(class_type="Table Wine", read_net_contents="5 L"), "PASS"),
    ("bottler", dict(read_bottler="Old Tom Distillery, Bardstown, Kentucky, USA"), "REVIEW"), ("bottler", dict(read_bottler="PRODUCED AND BOTTLED BY OLD TOM DISTILLERY BARDSTOWN KENTUCKY"), "PASS"), ("bottler", dict(read_bottler="Zzz"), "FAIL"),
    ("origin_country", dict(origin_country="France", read_origin_country="PRODUCT OF FRANCE"), "PASS"), ("origin_country", dict(origin_country="France", read_origin_country="Spain"), "FAIL"),
    ("origin_country", dict(origin_country="France"), "NOT_EVALUATED"), ("origin_country", dict(origin_country="N/A", read_origin_country="France"), "NOT_EVALUATED"),
    ("government_warning", dict(read_government_warning=None), "FAIL"), ("government_warning", dict(read_government_warning=K.WARNING.replace(" ", "")), "REVIEW"), ("government_warning", dict(read_government_warning=K.WARNING.replace("not ", "")), "FAIL"),
    ("government_warning_prefix", dict(read_government_warning=None), "NOT_EVALUATED"), ("government_warning_prefix", dict(read_government_warning="Government Warning: x"), "FAIL"),
]


def test_rule_cases(spark):
    found = {(r["filename"], r["check"]): r["status"] for r in checked(spark, *(c for _, c, _ in CASES)).collect()}
    assert [(i, CASES[i], found[f"{i}.png", c]) for i, (c, _, s) in enumerate(CASES) if found[f"{i}.png", c] != s] == []


def test_wine_below_seven_percent_is_noted(spark):
    (r,) = [r for r in checked(spark, dict(class_type="Table Wine", alcohol_content="6% ABV", read_alcohol_content="6% ABV")).collect() if r["check"] == "alcohol_content"]
    assert r["status"] == "PASS" and "FDA labeling governs" in r["detail"]


def test_rollup_and_report(spark):
    long = checked(spark, {}, dict(read_brand_name="Blue Moon"), dict(read_net_contents="12 floz"))
    rolled = rollup.rolled_up(long, "filename")
    assert [(r["filename"], r["status"]) for r in rolled.orderBy("rank", "filename").collect()] == [("1.png", "FAIL"), ("2.png", "REVIEW"), ("0.png", "PASS")]
    inputs = rolled.selectExpr("filename", "filename AS order", "error")
    frame = report.wide(report.pivoted(long, inputs)).collect()
    assert len(report.COLUMNS) == 59 and len(frame[0]) == 59 and [r["Overall result"] for r in frame] == ["FAIL", "REVIEW", "PASS"]
    assert frame[2]["Checks that could not be run"] == "3 checks could not be run — Country of origin; Government warning bold text; Government warning type size"


def test_unfinished_checks_and_errors(spark):
    some = spark.createDataFrame([("a", 0, "brand_name", "PASS", None), ("b", None, None, None, "broken"), ("c", 0, "brand_name", "FAIL", None)], "filename string, position int, check string, status string, error string")
    rolled = {r["filename"]: r for r in rollup.rolled_up(some, "filename").collect()}
    assert (rolled["a"]["status"], rolled["b"]["status"], rolled["c"]["status"]) == ("NOT_EVALUATED",) * 2 + ("FAIL",)
    assert (rolled["a"]["rank"], rolled["b"]["rank"], rolled["c"]["rank"]) == (2, 0, 0)
    assert rolled["b"]["disclosure"].startswith("11 checks could not be run — Brand name")


@pytest.mark.parametrize("alternatives", [["A", "B"]])
def test_ambiguous_candidates_go_to_a_person(spark, alternatives):
    labels = spark.createDataFrame([("x", *CONTROL.values(), *READ.values())], "filename string, " + ", ".join(f"{k} string" for k in (*CONTROL, *READ)))
    from pyspark.sql import functions as F

    labels = labels.withColumn("state_brand_name", F.lit("AMBIGUOUS")).withColumn("alternatives_brand_name", F.array(*map(F.lit, alternatives)))
    (r,) = rules.long_form(rules.evaluated(labels), "filename").where("check = 'brand_name'").collect()
    assert (r["status"], r["extracted"], r["confidence"]) == ("REVIEW", "A | B", None)
