"""The manifest scan against Python's own reader, over splits that cut through quoted values."""

import csv
import io
import random

import pytest

from proofline import constants as K
from proofline.shipping import ship
from proofline.sources import manifest

HEAD = ",".join(K.MANIFEST_COLUMNS)


@pytest.fixture
def narrow(spark):
    """Splits of a few lines each."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield ship(spark)
    for k, v in kept.items():
        spark.conf.set(k, v)


def value(r):
    kind = r.randrange(8)
    if kind < 4:
        return "".join(r.choices('ab é"', k=r.randrange(5))).lstrip('"')
    return '"' + "".join(r.choices(["a", ",", "\n", '""', "\r\n", "é", " "], k=r.randrange(4))) + '"'


def text_of(r, n):
    lines = []
    for _ in range(n):
        lines.append(r.choices(["", " ", ",".join(value(r) for _ in range(r.randrange(1, 9)))], [1, 1, 8])[0])
    return "".join(line + r.choices(["\n", "\r\n", "\r"], [6, 2, 1])[0] for line in lines)


def by_reader(text):
    """Trimmed values of every record up to the first that is none; null for that one."""
    out, reader = [], csv.reader(io.StringIO(text, newline=""), strict=True)
    while True:
        try:
            out.append([v.strip() for v in next(reader)])
        except StopIteration:
            return out
        except csv.Error:
            return [*out, None]


@pytest.mark.parametrize("seed", range(4))
def test_records_equal_the_readers(narrow, tmp_path, seed):
    r = random.Random(seed)
    text = text_of(r, 90) + ('x"y,"open\nand on\n' if seed == 2 else 'a,"b"c\nd\n' if seed == 3 else "")
    (tmp_path / "m.csv").write_bytes(text.encode())
    found = manifest._records(narrow, str(tmp_path / "m.csv"))
    got = {x["row"]: x["cells"] for x in found.collect()}
    wanted = by_reader(text)
    # A line without anything has no values for the reader, and one empty value here: both are blank records.
    assert [got.get(i + 1) or [] if w != [] else [] for i, w in enumerate(wanted)] == [w or [] for w in wanted]
    assert all((got[i + 1] is None) == (w is None) for i, w in enumerate(wanted))
    if wanted[-1] is not None:
        assert sorted(got) == list(range(1, len(wanted) + 1))


def test_many_splits_number_records_and_order_rows(narrow, tmp_path):
    rows = [f'f{i}.png,"Brand\n{i}, ""old""",Ale,5%,1 L,Maker,' for i in range(80)]
    rows[40:40] = ["", "F3.png,x,y,z,w,v,"]
    (tmp_path / "m.csv").write_text("﻿" + "\n".join([HEAD, *rows]))
    assert narrow.read.text(str(tmp_path / "m.csv")).rdd.getNumPartitions() > 20
    assert [(p["row"], p["problem"]) for p in manifest.scan(narrow, str(tmp_path / "m.csv")).collect()] == [(43, "Row 43 repeats filename 'F3.png'. Filenames must be unique even when letter case differs.")]
    del rows[41]
    (tmp_path / "n.csv").write_text("﻿" + "\n".join([HEAD, *rows]))
    read = manifest.read(narrow, str(tmp_path / "n.csv")).orderBy("order").collect()
    assert [x["filename"] for x in read] == [f"f{i}.png" for i in range(80)] and [x["order"] for x in read] == [i + (i > 39) for i in range(80)]
    assert read[7]["brand_name"] == 'Brand\n7, "old"'


def test_parts_of_a_folder_follow_each_other(narrow, tmp_path):
    for name, text in (("a.csv", f"{HEAD}\nx.png,b,c,d,e,f,\n"), ("b.csv", "y.png,b,c,d,e,f,Italy\n"), ("c.csv", "short\n")):
        (tmp_path / name).write_text(text)
    assert [(p["row"], p["problem"]) for p in manifest.scan(narrow, str(tmp_path)).collect()] == [(4, "Row 4 must contain 7 values.")]


def test_only_the_files_mark_is_dropped_and_names_are_quoted(narrow, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(f"﻿{HEAD}\n﻿o'x.png,b,c,d,e,f,\n﻿O'X.PNG,b,c,d,e,f,\n")
    assert [p["problem"] for p in manifest.scan(narrow, str(path)).collect()] == ["Row 3 repeats filename \"﻿O'X.PNG\". Filenames must be unique even when letter case differs."]


def test_long_values(narrow, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(f'{HEAD}\na.png,"{"x" * 10_000}",c,d,e,f,\n')
    assert len(manifest.read(narrow, str(path)).first()["brand_name"]) == 10_000
    for cell in ("y" * 131_073, '"' + "y\n" * 65_537 + '"'):
        path.write_text(f"{HEAD}\na.png,{cell},c,d,e,f,\n")
        narrow.conf.set("spark.sql.files.maxPartitionBytes", "50000b")
        with pytest.raises(manifest.ManifestError, match="could not be read"):
            manifest.read(narrow, str(path))
