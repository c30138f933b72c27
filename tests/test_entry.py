"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from proofline.plans import catalogue
from proofline.shipping import ship

FOLDER = "/root/testdata/sf0.001"


def rows(frame, columns):
    shown = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(str, shown.map(lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    found, wanted = catalogue.queries()[name](ship(spark), FOLDER).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found, sorted(found.columns)) == rows(wanted, sorted(found.columns))


def test_entry_without_the_corpus_operators(tmp_path):
    home = Path(__file__).resolve().parent.parent
    for removed in (("llm",), ("llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(removed))
        shutil.copytree(home, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *removed))
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
        env = {**os.environ, "PYTHONPATH": str(copy)}
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()
        assert int(said[0]) >= len(catalogue.queries()) and int(said[1]) >= len(catalogue.oracle_sql()) and said[2] == "False"
