import pytest

from proofline import constants as K
from proofline.operators import layout, reconcile
from proofline.plans import catalogue
from proofline.shipping import ship
from proofline.sources import images, manifest, registry

HEAD = ",".join(K.MANIFEST_COLUMNS)
ROW = "a.png,Old Tom,Bourbon,45% ABV,750 mL,Old Tom Co,"


def stored(folder, data):
    path = folder / "manifest.csv"
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_manifest(spark, tmp_path):
    ship(spark)
    text = f"\ufeff{HEAD}\r\n{ROW}\r\n,,,,,,\r\n\r\nb.png,x,\"y, \"\"q\"\"\nz\",z,w, v ,France\r\n"
    rows = manifest.read(spark, stored(tmp_path, text)).orderBy("order").collect()
    assert [(r["filename"], r["class_type"], r["bottler"], r["origin_country"], r["order"]) for r in rows] == [("a.png", "Bourbon", "Old Tom Co", None, 0), ("b.png", 'y, "q"\nz', "v", "France", 3)]  # a line with nothing on it is a record, too
    assert manifest.read(spark, stored(tmp_path, f"{HEAD}\n{ROW.replace('Old Tom,', 'Café,')}".encode("cp1252"))).first()["brand_name"] == "Café"
    assert manifest.read(spark, stored(tmp_path, f" {HEAD.upper()} \n{ROW}")).first()["filename"] == "a.png"
    odd = stored(tmp_path, f"{HEAD}\n{ROW.replace('a.png', chr(39) + 'b.png')}")
    assert manifest.sample(spark, odd, "'b.png").count() == 1


@pytest.mark.parametrize(
    ("data", "said"),
    [("", "needs a header"), (HEAD.replace("bottler", "x"), "exactly this order"), (f"{HEAD}\na,b", "Row 2 must contain 7"), (f"{HEAD}\n{ROW},8", "Row 2 must contain 7"), (f"{HEAD}\n{ROW}\n{ROW.upper()}", "Row 3 repeats filename 'A.PNG'"), (f"{HEAD}\n{ROW.replace('750 mL', ' ')}", "missing required values: net_contents"), (f'{HEAD}\n"b"c,1,2,3,4,5,6', "could not be read")],
)
def test_manifest_refused(spark, tmp_path, data, said):
    with pytest.raises(manifest.ManifestError, match=said):
        manifest.read(ship(spark), stored(tmp_path, data))


def test_uploads_stand_by_path_after_the_manifest(spark, tmp_path):
    for name in ("b.png", "A.PNG", "c.gif", "z.jpg"):
        (tmp_path / name).write_bytes(b"x")
    files = images.uploads(spark, str(tmp_path))
    m = spark.createDataFrame([("z.JPG", 0), ("y.png", 1)], "filename string, order long")
    rows = reconcile.reconciled(m, files.select("filename", "order")).orderBy("order").collect()
    assert [(r["filename"], r["error"]) for r in rows] == [("z.JPG", None), ("y.png", K.MISSING_IMAGE), ("A.PNG", K.MISSING_MANIFEST), ("b.png", K.MISSING_MANIFEST)]


def test_reconciliation(spark):
    m = spark.createDataFrame([("A.png", 0), ("b.png", 1), ("ß.png", 2)], "filename string, order long")
    u = spark.createDataFrame([("a.PNG", 0), ("c.png", 1), ("SS.png", 2)], "filename string, order long")
    rows = reconcile.reconciled(m, u).orderBy("order").collect()
    assert [(r["filename"], r["error"]) for r in rows] == [("A.png", None), ("b.png", K.MISSING_IMAGE), ("ß.png", None), ("c.png", K.MISSING_MANIFEST)]
    with pytest.raises(reconcile.BatchInputError, match="More than one"):
        reconcile.checked_uploads(spark.createDataFrame([("a.png", 0), (" A.PNG ", 1)], "filename string, order long"))
    with pytest.raises(reconcile.BatchInputError, match="needs a filename"):
        reconcile.checked_uploads(spark.createDataFrame([(" ", 0)], "filename string, order long"))


def block(i, text, x, y, w=100, h=20, c=0.9):
    return (1, i, text, [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))], c, 600.0, 800.0)


def test_layout(spark):
    said = [
        ("OLD TOM", 10, 10, 200, 50), ("DISTILLERY", 230, 12, 200, 50), ("Kentucky Straight Bourbon Whiskey", 10, 90), ("45% Alc./Vol.", 10, 130), ("750 mL", 300, 131),
        ("Bottled by Old Tom Distillery", 10, 170), ("Bardstown, Kentucky", 10, 195), ("PRODUCT OF", 10, 300), ("FRANCE", 10, 322), ("GOVERNMENT WARNING: (1) According to", 10, 500), ("the Surgeon General", 10, 524), ("  ", 0, 0), ("750 mL", 300, 131),
    ]
    blocks = spark.createDataFrame([block(i, *s) for i, s in enumerate(said)][::-1], images.BLOCKS)
    found = {r["field"]: r for r in layout.field_candidates(blocks).collect()}
    assert {f: r["value"] for f, r in found.items()} == {
        "brand_name": "OLD TOM DISTILLERY", "class_type": "Kentucky Straight Bourbon Whiskey", "alcohol_content": "45% Alc./Vol. 750 mL", "net_contents": "750 mL",
        "bottler": "Bottled by Old Tom Distillery\nBardstown, Kentucky", "origin_country": "PRODUCT OF\nFRANCE", "government_warning": "GOVERNMENT WARNING: (1) According to\nthe Surgeon General",
    }
    twice = spark.createDataFrame([block(0, "750 mL (25.4 fl oz)", 10, 10)], images.BLOCKS)
    assert {r["field"]: r["state"] for r in layout.field_candidates(twice).collect()}["net_contents"] == "AMBIGUOUS"


def test_registry_page(spark):
    html = "<script>x</script><tr><td>Brand Name:</td><td>A&amp;B</td></tr><tr><td>Class/Type Code: BOURBON</td></tr><tr><td>Origin Code: OREGON</td></tr><a href='viewColaDetails.do?ttbid=12345678901234'>x</a><form><input name=a><input name=c type=checkbox checked><select name=s><option value=1>x<option selected>two</select></form>"
    row = registry.records(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (row[0]["brand_name"], row[0]["class_type"], row[0]["origin_country"], row[0]["error"]) == ("A&B", "BOURBON", "", None)
    assert row[1]["error"].startswith("detail page")
    pages = spark.createDataFrame([(1, html), (2, "a < b<BR>c &amp;&nbsp;<!-- <p>no</p> --> d<style>p</style><img alt='x > y' SRC=\"i.png\"><a title='href=no'>n</a><textarea name=t>u<b>v</b></textarea>"), (3, None)], "id long, html string")
    controls = registry.controls_of(pages).orderBy("id", "place").collect()
    assert [(r["name"], r["value"], r["kind"]) for r in controls] == [("a", "", "text"), ("c", "on", "checkbox"), ("s", "two", "select"), ("t", "uv", "textarea")]
    lines = {r["id"]: r["lines"] for r in registry.lines_of(pages).collect()}
    assert lines[2] == ["a < b", "c & dnuv"] and lines[3] == []
    links = {r["id"]: (r["hrefs"], r["images"]) for r in registry.links_of(pages).collect()}
    assert links == {1: (["viewColaDetails.do?ttbid=12345678901234"], []), 2: ([], ["i.png"]), 3: ([], [])}


def test_coordinates_round_by_their_binary_value(spark):
    values = [0.35, 0.25, 0.75, 12.05, 2.675, 0.05, 0.15, 0.45, 1.0, 0.0, 99.95, 1234.55, 0.1 + 0.2, 1e6 + 0.35, *(i / 20 for i in range(200))]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", layout.tenths(layout.F.col("v")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in found] == [round(10 * round(v, 1)) for v in values]


FORM = """<form name=a><input name=no></form><FORM Name='searchCriteriaForm' action="x.do?a=1&amp;b=2">
<input name=plain value="a &lt; b"><input value=unnamed><input name=off disabled><input type=SUBMIT name=go value=1><input type=radio name=r value=1><input type=radio name=r value=2 checked>
<input type=checkbox name=c checked><select name=one><option value=1>x<option>&nbsp; two <i>words</i> </select><select name=two><option value=1>x<option selected value>y</select>
<select name=many multiple><option selected>p<option>q<option selected value=''>r</select><select name=none></select><select disabled name=d><option>1</select><textarea name=t> u<b>v</b></textarea></form><input name=after value=1>"""


def test_search_form(spark):
    ship(spark)
    pages = spark.createDataFrame([(1, FORM), (2, "<form name=other><input name=x></form>"), (3, None), (4, "<form action='/p/publicSearchColasBasicProcess.do' method=Post><input name=q><form name=other><input name=z>")], "id long, html string")
    found = registry.search_controls(pages).orderBy("id", "place").collect()
    assert [(r["name"], r["value"], r["kind"]) for r in found if r["id"] == 1] == [
        ("plain", "a < b", "text"), ("r", "2", "radio"), ("c", "on", "checkbox"), ("one", "1", "select"), ("two", "y", "select"), ("many", "p", "select"), ("many", "", "select"), ("t", " uv", "textarea"),
    ]
    assert {(r["method"], r["action"]) for r in found if r["id"] == 1} == {("get", "x.do?a=1&b=2")}
    assert [(r["id"], r["method"], r["name"]) for r in found if r["id"] > 1] == [(4, "post", "q")]
    assert {r["id"]: r["method"] for r in registry.search_forms(pages).collect()} == {1: "get", 2: None, 3: None, 4: "post"}
    assert registry.controls_of(pages.where("id = 1")).count() == 10


def test_a_page_names_its_attributes_once(spark):
    """Each tag's attributes are extracted in one place of the plan for each kind of tag."""
    plan = registry.controls_of(spark.createDataFrame([(1, "")], "id long, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4


def test_stream(spark, tmp_path):
    from proofline.plans import synthetic
    from proofline.streaming import batches

    labels = synthetic.labels(spark, "/root/testdata/sf0.001").limit(20)
    labels.write.parquet(str(tmp_path / "in"))
    seen = []
    query = batches.write(batches.checked(batches.source(spark, str(tmp_path / "in"), labels.schema)), str(tmp_path / "out"), str(tmp_path / "cp"), lambda n, rows: seen.append(rows))
    query.awaitTermination(120)
    assert sum(seen) == 20 * 11 == spark.read.parquet(str(tmp_path / "out")).count()


def test_image_quality_measures_every_order(spark):
    folder = "/root/testdata/sf0.001"
    found = catalogue.image_quality(ship(spark), folder)
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    assert found.count() == orders.count() and found.join(orders, found["path"] == orders["o_orderkey"].cast("string"), "left_anti").isEmpty()
