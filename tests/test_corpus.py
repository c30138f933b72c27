"""Registry tables committed together, the stream stopped and resumed, texts of the law, and what may write to disk."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.plans import synthetic
from proofline.shipping import ship
from proofline.sources import corpus, manifest
from proofline.streaming import batches

HOME = Path(__file__).resolve().parent.parent
RECORD = "page_id long, url string, brand_name string, fanciful_name string, class_type string, origin_code string, bottler string, origin_country string, error string"


def records(spark, *brands):
    return spark.createDataFrame([(i, f"https://r/{i}", b, "", "ALE, old", "12", 'The "Maker"', "ITALY" if i else "", None if b else "no brand") for i, b in enumerate(brands)], RECORD)


def test_both_tables_change_together(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/out"
    assert corpus.read_metadata(spark, folder) is None
    corpus.write_metadata(records(spark, "one", "two"), folder)

    def names():
        truth, listed = corpus.read_metadata(spark, folder)
        return sorted(r["brand_name"] for r in truth.collect()), sorted(r["brand_name"] for r in listed.collect())

    assert names() == (["one", "two"],) * 2
    real = corpus._manifest_table
    monkeypatch.setattr(corpus, "_manifest_table", lambda *_: (_ for _ in ()).throw(OSError("killed between both writes")))
    with pytest.raises(OSError, match="between"):
        corpus.write_metadata(records(spark, "three"), folder)
    assert names() == (["one", "two"],) * 2
    monkeypatch.setattr(corpus, "_manifest_table", real)
    version = corpus.write_metadata(records(spark, "", "four"), folder)
    assert names() == (["four"],) * 2
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == [version]
    truth, listed = (t.first() for t in corpus.read_metadata(spark, folder))
    assert (truth["filename"], truth["source_url"], truth["bottler"]) == ("1.jpg", "https://r/1", 'The "Maker"')
    assert tuple(listed[c] or "" for c in K.MANIFEST_COLUMNS) == ("1.jpg", "four", "ALE, old", "", "", 'The "Maker"', "ITALY")
    with pytest.raises(manifest.ManifestError, match="missing required values: alcohol_content, net_contents"):
        manifest.read(ship(spark), f"{folder}/{version}/manifest")
    assert corpus.summary(records(spark, "a", "", "c")).first().asDict() == {"kept": 2, "skipped": 1, "with_origin_country": 1}


def test_addresses_and_bytes(spark):
    row = spark.createDataFrame([(bytearray(b"caf\xc3\xa9 \xff"), "1&2")], "body binary, id string").select(corpus.decoded_html(F.col("body")), corpus.detail_url("https://r/d.do", "show", F.col("id"))).first()
    assert tuple(row) == ("café �", "https://r/d.do?action=show&ttbid=1%262")


def test_stopped_stream_goes_on(spark, tmp_path):
    """Five files; the stream is stopped after two, and started again."""
    labels = synthetic.labels(ship(spark), "/root/testdata/sf0.001").where("label_id < 100").orderBy("label_id").limit(20)
    rows = labels.collect()
    for i in range(5):
        spark.createDataFrame(rows[4 * i : 4 * i + 4], labels.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    verify = lambda df: df.select("filename", F.col("label_id").alias("order"), F.lit("PASS").alias("status"))
    folder, schema, seen, begun = f"file://{tmp_path}/out", "filename string, order long, status string", [], []
    args = (batches.source(spark, f"{tmp_path}/in", labels.schema), folder, f"{tmp_path}/cp", verify, lambda *x: seen.append(x), 20)
    assert batches.run(*args, should_stop=lambda: begun.append(1) or len(begun) > 2) is False
    assert seen == [(0, 20), (4, 20), (8, 20)]
    done = batches.finished(spark, folder, schema)
    found = batches.outcome(labels, done).collect()
    assert sorted(r["filename"] for r in found) == sorted(r["filename"] for r in rows)
    assert [r["error"] for r in found].count(K.CANCELLED) == 12 and done.count() == 8
    # A micro-batch that died while writing left files but no mark.
    (tmp_path / "out" / "batch=2").mkdir()
    (tmp_path / "out" / "batch=2" / "part-0.parquet").write_bytes(b"half")
    assert batches.finished(spark, folder, schema).count() == 8
    seen.clear()
    assert batches.run(*args) is True
    assert seen == [(8, 20), (12, 20), (16, 20), (20, 20)]
    whole = batches.finished(spark, folder, schema)
    assert sorted(r["filename"] for r in whole.collect()) == sorted(r["filename"] for r in rows)
    assert batches.outcome(labels, whole).where("error IS NOT NULL").count() == 0


def test_other_failures_are_raised(spark, tmp_path):
    labels = synthetic.labels(ship(spark), "/root/testdata/sf0.001").limit(2)
    labels.write.parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="callback"):
        batches.run(batches.source(spark, f"{tmp_path}/in", labels.schema), f"file://{tmp_path}/out", f"{tmp_path}/cp", lambda df: df.select("filename"), on_batch=lambda *_: (_ for _ in ()).throw(ValueError("callback")))


def test_constants_equal_the_law(spark):
    assert [r["value"] for r in corpus.payload(spark, str(HOME / "tests/law/warning.txt")).collect()] == [K.WARNING]
    for name, kind in (("spirits", "distilled_spirits"), ("wine", "wine")):
        sizes = corpus.listed_sizes(corpus.payload(spark, str(HOME / f"tests/law/{name}.txt")))
        assert len(sizes) == 25 and sizes == set(K.SIZES[kind])


#: Functions that write: sinks that the caller asks for, and tables in the shared folder that jobs hand on to each other.
WRITERS = {("storage.py", "written"), ("report.py", "write_csv"), ("batches.py", "write"), ("corpus.py", "_truth_table"), ("corpus.py", "_manifest_table"), ("corpus.py", "write_metadata"), ("catalogue.py", "_listing"), ("shipping.py", "ship")}
TEMPORARY = {("storage.py", "shared_dir"), ("shipping.py", "ship")}


def writes(source):
    """(function, what) of every call in a module's outer functions that can put something on a disk."""
    found = []
    for outer in ast.parse(source).body:
        for node in ast.walk(outer):
            if not isinstance(node, ast.Call):
                continue
            name = ast.unparse(node.func)
            modes = [a.value for a in [*node.args, *(k.value for k in node.keywords)] if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            opens = name.split(".")[-1] in ("open", "ZipFile") and any(set(m) & set("wax+") for m in modes if len(m) <= 3)
            saves = ".write." in f"{name}." or ".writeStream." in name or name.split(".")[-1] in ("save", "saveAsTable", "write_text", "write_bytes", "imwrite", "tofile", "create")
            if opens or saves or "tempfile." in name:
                found.append((getattr(outer, "name", "module"), "temporary" if "tempfile." in name or "ZipFile" in name else "write"))
    return found


@pytest.mark.parametrize("source", ["open('x', 'wb')", "open('x', mode='w')", "p.open('a')", "tempfile.mkdtemp()", "def f(d):\n d.write.parquet('x')", "def f(d):\n d.write.mode('overwrite').csv('x')", "p.write_text('x')", "image.save('x')", "def f(d):\n d.writeStream.format('x').start()"])
def test_writes_are_recognised(source):
    assert writes(source)


@pytest.mark.parametrize("source", ["open('data')", "open('data', 'rb')", "def f(d):\n return d.read.parquet('x')"])
def test_reads_are_not(source):
    assert not writes(source)


def test_only_sinks_write(spark):
    for path in (HOME / "proofline").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for function, what in writes(path.read_text(encoding="utf-8")):
            assert (path.name, function) in (TEMPORARY if what == "temporary" else WRITERS), f"{path.name}: {function} writes"
