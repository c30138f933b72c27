from decimal import Decimal

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import numbers as N
from proofline.functions import text as T


def mapped(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_identity_folds_and_keeps_words(spark):
    said = ["Straße ﬁ", "O’Malley's", "STONE'S THROW", "  a b\x1cc ", "Crème–de", None, ""]
    assert mapped(spark, said, T.identity) == ["strasse fi", "omalleys", "stones throw", "a b c", "crème de", None, ""]


def test_legal_suffixes(spark):
    said = ["Old Tom Distillery, LLC", "Old Tom Co. Inc.", "Company", "Acme L.L.C.", "Inc. House", "Acme Limited Liability Company"]
    assert mapped(spark, said, T.fuzzy) == ["old tom distillery", "old tom", "company", "acme", "inc house", "acme"]


def test_prefixes_are_stripped_once(spark):
    assert mapped(spark, ["Produced and Bottled by Old Tom", "Bottled by", "made by made by X", "Old Tom"], T.bottler) == ["old tom", "", "made by x", "old tom"]
    assert mapped(spark, ["Product of France", "Country of Origin: Italy", "Origin", "France"], T.origin) == ["france", "italy", "", "france"]


def test_origin_placeholders(spark):
    assert mapped(spark, ["N/A", " none ", "--", "n\\a", "France", "", None], T.has_origin_value) == [False, False, False, False, True, False, False]


def test_warning_repairs(spark):
    said = ["pre-\n gnancy", "heaIth prob1ems", "GOVERNMENT WARNlNG", "(I) (l)", "ﬁre  ﬂy", "A-\nb"]
    assert mapped(spark, said, T.warning) == ["pregnancy", "health problems", "GOVERNMENT WARNING", "(1) (1)", "fire fly", "Ab"]


def test_warning_repair_is_idempotent_on_the_statute(spark):
    assert mapped(spark, [K.WARNING], T.warning) == [K.WARNING]


def test_beverage_class_longest_keyword_then_earlier_class(spark):
    said = ["Barley Wine", "Kentucky Straight Bourbon Whiskey", "Port Finished Bourbon", "Hard Seltzer", "ginger", "Crème de Menthe", None]
    assert mapped(spark, said, T.beverage_class) == ["beer", "distilled_spirits", "wine", None, None, "distilled_spirits", None]


def similarity(a, b):
    """By the table of all prefixes."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_similarity_is_indel_on_sorted_words(spark):
    random.seed(1)
    some = lambda sizes: "".join(random.choices("ab cdeé😀", k=random.choice(sizes)))
    pairs = [("b a", "a b"), ("", ""), ("a", ""), (" ", "a"), ("kitten", "sitting"), ("x" * 120, "x" * 119 + "y"), *((some((3, 20, 59, 60, 61, 130, 190)), some((4, 25, 60, 120))) for _ in range(150))]
    found = spark.createDataFrame([(i, *p) for i, p in enumerate([*pairs, (None, "a"), ("a", None)])], "i int, a string, b string").select("i", T.token_sort_ratio(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in found[:-2]] == pytest.approx([similarity(*p) for p in pairs])
    assert [r["r"] for r in found[-2:]] == [None, None]


def differences(expected, found):
    a, b, said = re.findall(K.WARNING_TOKEN, expected), re.findall(K.WARNING_TOKEN, found), []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        old, new = f"[{' '.join(a[i:j])}]", f"[{' '.join(b[k:m])}]"
        said += {"equal": [], "delete": [f"missing expected {old}"], "insert": [f"unexpected extracted {new}"], "replace": [f"replace expected {old} with extracted {new}"]}[kind]
    return "; ".join(said)


def test_word_differences_equal_difflibs(spark):
    random.seed(2)
    words = K.WARNING.split(" ")
    texts = [K.WARNING, "", " ", ".", ", , ,", "a_b é‿x ́", " ".join(words * 3), K.WARNING.upper()]
    for _ in range(120):
        x = list(words)
        for _ in range(random.randrange(6)):
            i = random.randrange(len(x))
            j = min(len(x), i + random.randrange(1, 9))
            x[i:j] = random.choice(([], x[i:j] * 2, x[i:j][::-1], ["(1)", "the,"], ["ü"], random.choices(words, k=5)))
            x = x or ["of"]
        texts.append(" ".join(x))
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    for expected in (K.WARNING, K.WARNING_PREFIX, "a b c"):
        found = [r["d"] for r in df.select("i", T.word_level_diff(expected, F.col("t")).alias("d")).orderBy("i").collect()]
        assert found[:-1] == [differences(expected, t) for t in texts] and found[-1] is None


@pytest.mark.parametrize(
    ("said", "value", "error"),
    [
        ("45% Alc./Vol. (90 Proof)", 45, None), ("Alcohol Content 40% by Vol", 40, None), ("5.5% ABV", 5.5, None), ("Alcohol Content40%", 40, None), ("45% Alc/Volcano", None, "ABV marker"),
        ("no number", None, None), ("40% ABV 41% ABV", None, "multiple"), ("120% ABV", None, "ABV must be between 0 and 100 percent"), ("GRAPE JUICE 100% BY VOLUME", None, None),
        ("1,2% ABV", None, "invalid"), ("x45% ABV", None, "ABV marker"), ("(45% ABV", 45, None), (None, None, None),
    ],
)
def test_abv(spark, said, value, error):
    (r,) = mapped(spark, [said], N.parse_abv)
    assert (r is None and said is None) or ((float(r["value"]) if r["value"] is not None else None) == value and ((r["error"] or "").startswith(error) if error else r["error"] is None))


def test_proof(spark):
    found = mapped(spark, ["90 Proof", "proof 80", "proof", "300 proof", "80 proof 90 proof", "none"], N.parse_proof)
    assert [float(r["value"]) if r["value"] is not None else None for r in found] == [90, 80, None, None, None, None]
    assert [r["error"] is None for r in found] == [True, True, False, False, False, True]


def test_net_contents(spark):
    found = mapped(spark, ["750 mL", "1 L", "25.36 fl oz", "1.75 Liters", "1,000 ml", "12 fl.oz", "12 floz", "750", "about 750 mL", ".5 l"], N.parse_net_contents)
    assert [r["ml"] for r in found] == [Decimal(x) if x else None for x in ("750", "1000", "749.9847097050", "1750", "1000", None, None, None, None, "500")]
    assert all((r["error"] is None) == (r["ml"] is not None) for r in found)


def test_long_marker_text_is_quick(spark):
    import time

    began = time.time()
    mapped(spark, ["ALC" + " " * 4000 + "X"], N.parse_abv)
    assert time.time() - began < 10


def test_sizes_and_tolerances(spark):
    df = spark.createDataFrame([("wine", "4500"), ("wine", "4501"), ("wine", "760"), ("distilled_spirits", "735"), ("wine", "6000")], "c string, v string").select("c", F.col("v").cast(N.DECIMAL).alias("v"))
    near = [float(r[0]) for r in df.select(N.nearest_size(F.col("v"), F.col("c"))).collect()]
    assert near == [4000, 5000, 750, 720, 6000]
    assert [r[0] is not None for r in df.select(N.authorized_size(F.col("v"), F.lit("ml"), F.col("c"))).collect()] == [False, False, False, False, True]
    strength = spark.createDataFrame([("wine", "14"), ("wine", "14.1"), ("beer", "0.4"), ("beer", "0.5"), ("distilled_spirits", "40"), ("cider", "5")], "c string, v string")
    assert [r[0] and float(r[0]) or 0 for r in strength.select(N.abv_tolerance(F.col("c"), F.col("v").cast(N.DECIMAL))).collect()] == [1.5, 1.0, 0, 0.3, 0.3, 0]
