"""Rows that take long are dealt out to tasks, and what is made from them is made once."""

from pyspark.sql import functions as F

from proofline.operators import layout
from proofline.plans import catalogue, report, synthetic
from proofline.sources import registry
from proofline.storage import spread


def test_one_file_becomes_many_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(path := str(tmp_path / "t"))
    table = spark.read.parquet(path)
    dealt = spread(table, 100)
    assert dealt.rdd.getNumPartitions() == 10 and sorted(r[0] for r in dealt.collect()) == list(range(1000))
    assert spread(table, 1000).rdd.getNumPartitions() == table.rdd.getNumPartitions()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_filter_is_evaluated_before_rows_are_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(path := str(tmp_path / "t"))
    said = plan(spread(spark.read.parquet(path), 100).where(F.col("id") % 7 == 3))
    assert "% 7" in said and said.index("% 7") < said.index("Repartition")


def test_wide_report_moves_rows_before_it_sorts_them(spark):
    synthetic.parts(spark, "/root/testdata/sf0.001")
    said = plan(catalogue.report_wide(spark, "/root/testdata/sf0.001"))
    sort, moved = said.index("Sort ["), said.index("RepartitionByExpression")
    assert sort < moved and "token_sort_ratio" not in said[:moved]
    rows = catalogue.report_wide(spark, "/root/testdata/sf0.001").select(report.COLUMNS[1]).collect()
    ranks = [("FAIL", "REVIEW", "NOT CHECKED", "PASS").index(r[0]) for r in rows]
    assert ranks == sorted(ranks)


def test_pages_are_parsed_once_for_their_controls(spark):
    pages = spark.createDataFrame([(1, "<form><input name=a>")], "page_id long, html string")
    assert plan(registry.controls_of(pages)).count("regexp_extract_all(regexp_replace(coalesce(html") == 1
    assert "Filter isnotnull(method" not in plan(registry.search_controls(pages))


def test_statuses_alone_make_no_details(spark):
    made = lambda name: "authorized size" in plan(getattr(catalogue, name)(spark, "/root/testdata/sf0.001"))
    assert made("check_details")
    assert not any(map(made, ("check_statuses", "field_accuracy", "verdict_histogram", "disclosure", "batch_results", "extracted_labels_checked")))


def test_candidates_are_placed_only_where_asked(spark):
    blocks = catalogue._blocks(spark, "/root/testdata/sf0.001")
    said, whole = layout.field_candidates(blocks, layout.SAID), layout.field_candidates(blocks)
    assert tuple(whole.columns) == ("label_id", *layout.PARTS) and "array_sort(array_distinct" in plan(whole)
    assert "array_sort(array_distinct" not in plan(catalogue.field_candidates(spark, "/root/testdata/sf0.001"))
    assert sorted(map(str, whole.select(*said.columns).collect())) == sorted(map(str, said.collect()))
