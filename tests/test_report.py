"""The wide and the single report on results that are whole, partial, unknown or errors."""

import csv
import glob

from pyspark.sql import functions as F

from proofline import constants as K
from proofline.plans import report, synthetic
from proofline.operators import rules
from proofline.shipping import ship

LONG = "filename string, check string, status string, expected string, extracted string, confidence double, detail string"
INPUTS = "filename string, order long, error string, brand_name string"
ALL = "; ".join(K.CHECKS.values())


def passing(filename, undone=()):
    return [(filename, c, K.NOT_EVALUATED if c in undone else K.PASS, f"Application {c}", f"Label {c}", None if c in undone else 94.0, f"{c} matched.") for c in K.CHECKS]


def frame(spark, results, inputs):
    return report.wide(report.pivoted(spark.createDataFrame(results, LONG), spark.createDataFrame(inputs, INPUTS)))


def test_errors_come_first_and_keep_the_application(spark):
    found = frame(spark, passing("matched.png"), [("matched.png", 0, None, "B"), ("missing.png", 1, "not uploaded", "Application Brand")])
    assert tuple(found.columns) == report.COLUMNS and len(report.COLUMNS) == 59
    missing, matched = found.collect()
    assert (missing["Filename"], missing["Overall result"], missing["Problem"]) == ("missing.png", "NOT CHECKED", "not uploaded")
    assert missing["Checks that could not be run"] == f"11 checks could not be run — {ALL}"
    assert (missing["Brand name — application value"], missing["Brand name — we read this as"], missing["Brand name — confidence"]) == ("Application Brand", None, None)
    assert missing["Brand name — details"] == "This check was not completed."
    assert (matched["Overall result"], matched["Checks that could not be run"]) == ("PASS", "")
    assert [matched[f"Brand name — {s}"] for s in K.REPORT_SUFFIXES] == ["PASS", "Application brand_name", "Label brand_name", 94.0, "brand_name matched."]


def test_partial_and_unknown_checks_are_disclosed(spark):
    results = [("partial.png", "brand_name", K.PASS, "a", "b", 94.0, "d"), ("unknown.png", "unknown_check", K.NOT_EVALUATED, None, None, None, "d"), *passing("none.png", K.CHECKS)]
    rows = {r["Filename"]: r for r in frame(spark, results, [(n, i, None, "B") for i, n in enumerate(("partial.png", "unknown.png", "none.png"))]).collect()}
    assert rows["partial.png"]["Overall result"] == "NOT CHECKED" and rows["partial.png"]["Checks that could not be run"].startswith("10 checks could not be run — Class or type; ")
    assert (rows["partial.png"]["Class or type — result"], rows["partial.png"]["Class or type — details"]) == ("NOT CHECKED", "This check was not completed.")
    assert rows["unknown.png"]["Checks that could not be run"] == f"12 checks could not be run — {ALL}; Unknown check"
    assert rows["none.png"]["Checks that could not be run"] == f"11 checks could not be run — {ALL}" and rows["none.png"]["Country of origin — result"] == "NOT CHECKED"


def test_csv_keeps_columns_and_values(spark, tmp_path):
    report.write_csv(frame(spark, passing("matched.png", ("government_warning_bold", "government_warning_type_size")), [("matched.png", 0, None, "B")]), str(tmp_path / "out"))
    (path,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    with open(path, newline="", encoding="utf-8") as f:
        text = f.read()
    assert "\r" not in text
    head, row = csv.reader(text.splitlines())
    assert tuple(head) == report.COLUMNS
    said = dict(zip(head, row, strict=True))
    assert said["Checks that could not be run"] == "2 checks could not be run — Government warning bold text; Government warning type size"
    assert (said["Brand name — confidence"], said["Problem"], said["Government warning bold text — confidence"]) == ("94.0", "", "")


def test_single_report_lists_missing_checks(spark):
    found = report.single(spark.createDataFrame([("x", "brand_name", K.PASS, " ", "b", 94.0, "d")], LONG), "filename").collect()
    assert [r["Check"] for r in found] == list(K.CHECKS.values())
    assert (found[0]["Application value"], found[0]["We read this as"]) == ("Not provided", "b")
    assert [found[1][c] for c in ("Result", "Application value", "We read this as", "Details")] == ["NOT CHECKED", "Not provided", "Nothing readable was found", "This check was not completed."]


def test_statuses_build_no_details(spark):
    """A plan that asks for statuses neither compares the warning's words nor puts texts together."""
    checked = rules.evaluated(synthetic.labels(ship(spark), "/root/testdata/sf0.001")).select(F.col("check_government_warning.status").alias("w"), F.col("check_net_contents.status").alias("n"))
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "missing expected" not in plan and "unit conversion" not in plan
