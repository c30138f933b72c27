"""The eleven checks as Column expressions. Each gives struct(status, expected, extracted, confidence, detail); branch order is the semantics.

Normalised texts are passed in as columns, so that a plan computes each Arrow UDF once; `evaluated` adds them. A check's conditions make a number, the first branch that holds, as
a column of its own; the struct's fields are chosen by it, each by itself, so that a plan which asks for statuses builds no details.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import numbers as N
from proofline.functions import text as T

FIELDS = ("brand_name", "class_type", "alcohol_content", "net_contents", "bottler", "origin_country")
#: What a check's result is made of.
PARTS = ("status", "expected", "extracted", "confidence", "detail")


class Branches:
    """The first branch whose condition holds; null conditions don't."""

    def __init__(self, extracted: Column, expected: Column):
        self.extracted, self.expected, self.made = extracted, expected, []

    def when(self, condition: Column | bool, status: str, detail: Column | str, confidence: Column | float | None = None) -> Branches:
        self.made.append((condition if isinstance(condition, Column) else F.lit(condition), F.lit(status), detail if isinstance(detail, Column) else F.lit(detail), confidence if isinstance(confidence, Column) else F.lit(confidence)))
        return self

    def number(self) -> Column:
        """Which branch it is, from 0."""
        out = F.lit(len(self.made) - 1)
        for i, (condition, *_) in reversed(list(enumerate(self.made[:-1]))):
            out = F.when(condition, i).otherwise(out)
        return out

    def chosen(self, number: Column) -> Column:
        """The result, given the branch's number."""
        status, detail, confidence = (self._of(number, [m[k] for m in self.made]) for k in (1, 2, 3))
        return result(status, self.expected, self.extracted, confidence, detail)

    @staticmethod
    def _of(number: Column, values: list[Column]) -> Column:
        out = values[-1]
        for i, value in reversed(list(enumerate(values[:-1]))):
            out = F.when(number == i, value).otherwise(out)
        return out


def result(status: Column, expected: Column, extracted: Column, confidence: Column, detail: Column) -> Column:
    return F.struct(status.alias("status"), expected.cast("string").alias("expected"), extracted.cast("string").alias("extracted"), confidence.cast("double").alias("confidence"), detail.alias("detail"))


def _empty(x: Column) -> Column:
    return x.isNull() | (x == "")


def _says(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def brand(extracted: Column, expected: Column, x: Column, y: Column, ratio: Column, name: str = "brand") -> Branches:
    """x, y: the texts without legal suffixes; ratio: their sorted similarity. Lost spaces alone still match a brand, not a class."""
    same = (T.compact(x) == T.compact(y)) if name == "brand" else F.lit(False)
    score = F.when(same, K.MATCH).otherwise(ratio)
    made = Branches(extracted, expected).when(_empty(x) | _empty(y), K.NOT_EVALUATED, K.SAYS[f"{name}_missing"])
    return made.when(score >= K.FUZZY_PASS, K.PASS, K.SAYS[f"{name}_pass"], score).when(score >= K.FUZZY_REVIEW, K.REVIEW, K.SAYS[f"{name}_review"], score).when(True, K.FAIL, K.SAYS[f"{name}_fail"], score)


def class_type(extracted: Column, expected: Column, x: Column, y: Column, ratio: Column) -> Branches:
    return brand(extracted, expected, x, y, ratio, "class")


def alcohol(extracted: Column, expected: Column, x: Column, y: Column, beverage: Column, parsed: dict[str, Column]) -> Branches:
    """x, y: identified texts; parsed: abv_x, abv_y, proof_x, proof_y."""
    abv_x, abv_y, proof_x, proof_y = (parsed[k] for k in ("abv_x", "abv_y", "proof_x", "proof_y"))
    error = F.coalesce(abv_x["error"], abv_y["error"], proof_x["error"], proof_y["error"])
    advisory = F.when((beverage == "wine") & (abv_x["value"] < N.decimal(K.WINE_FROM)), K.SAYS["advisory"]).otherwise("")
    tolerance = N.abv_tolerance(beverage, abv_y["value"])
    difference = F.abs(abv_x["value"] - abv_y["value"]).cast(N.DECIMAL)
    twice = lambda v: (v * 2).cast(N.DECIMAL)
    off = lambda proof, abv: F.abs(proof - twice(abv)) > N.decimal(K.PROOF_TOLERANCE)
    made = Branches(extracted, expected).when(_empty(x) | _empty(y), K.NOT_EVALUATED, K.SAYS["alcohol_missing"])
    made.when(error.isNotNull(), K.REVIEW, _says("Alcohol content could not be parsed unambiguously: ", error, ".", advisory))
    made.when(abv_x["value"].isNull() | abv_y["value"].isNull(), K.REVIEW, _says(K.SAYS["alcohol_numeric"], advisory))
    made.when(off(proof_y["value"], abv_y["value"]), K.REVIEW, _says("Application proof ", N.plain(proof_y["value"]), " is inconsistent with its ABV; expected proof ", N.plain(twice(abv_y["value"])), ".", advisory))
    made.when(beverage.isNull(), K.REVIEW, K.SAYS["alcohol_class"])
    made.when(off(proof_x["value"], abv_x["value"]), K.FAIL, _says("Stated proof ", N.plain(proof_x["value"]), " is inconsistent with ABV; expected proof ", N.plain(twice(abv_x["value"])), ".", advisory), K.MISMATCH)
    said = ("ABV differs by ", N.plain(difference), " percentage points, ")
    made.when(difference <= tolerance, K.PASS, _says(*said, "within the CFR tolerance of ", N.plain(tolerance), " for this beverage class; any stated proof is consistent.", advisory), K.MATCH)
    return made.when(True, K.FAIL, _says(*said, "beyond the CFR tolerance of ", N.plain(tolerance), " for this beverage class.", advisory), K.MISMATCH)


def net_contents(extracted: Column, expected: Column, x: Column, y: Column, own: Column, other: Column) -> Branches:
    """own, other: the parsed volumes of label and application."""
    error = F.coalesce(own["error"], other["error"])
    difference = F.abs(own["ml"] - other["ml"]).cast(N.DECIMAL)
    mixed = (own["unit"] != other["unit"]) & ((own["unit"] == "fl oz") | (other["unit"] == "fl oz"))
    tolerance = F.when(mixed, N.decimal(K.FL_OZ_ROUNDING)).otherwise(N.decimal(0))
    made = Branches(extracted, expected).when(_empty(x) | _empty(y), K.NOT_EVALUATED, K.SAYS["net_missing"])
    made.when(error.isNotNull(), K.REVIEW, _says("Net contents could not be parsed unambiguously: ", error, "."))
    made.when(difference <= tolerance, K.PASS, _says("Net contents match after unit conversion (", N.plain(own["ml"]), " mL)."), K.MATCH)
    return made.when(True, K.FAIL, _says("Net contents differ by ", N.plain(difference), " mL after unit conversion."), K.MISMATCH)


def standard_of_fill(extracted: Column, expected: Column, x: Column, y: Column, beverage: Column, own: Column, other: Column, size: Column, wanted: Column, near: Column) -> Branches:
    """own, other: the parsed volumes; size, wanted: the authorised sizes that they stand for; near: the one nearest to the label's."""
    ml = N.plain(own["ml"])
    made = Branches(extracted, expected).when(_empty(x), K.NOT_EVALUATED, K.SAYS["fill_missing"])
    made.when(beverage == "beer", K.NOT_EVALUATED, K.SAYS["fill_beer"]).when(beverage.isNull(), K.REVIEW, K.SAYS["fill_class"])
    made.when(own["error"].isNotNull(), K.REVIEW, _says("Net contents could not be parsed unambiguously for the standards-of-fill check: ", own["error"], "."))
    made.when(size.isNotNull(), K.PASS, _says("Container size resolves to the authorized ", N.plain(size), " mL size under ", N.cfr_section(beverage, size), "."), K.MATCH)
    misread = ~_empty(y) & wanted.isNotNull() & (other["ml"] != own["ml"])
    made.when(misread, K.REVIEW, _says("The label read ", ml, " mL, which is not an authorized size, while the application value resolves to the authorized ", N.plain(other["ml"]), " mL size under ", N.cfr_section(beverage, wanted), ". This is probably an OCR misread; agent review is required."))
    return made.when(True, K.FAIL, _says("Container size ", ml, " mL is not authorized. The nearest authorized size is ", N.plain(near), " mL under ", N.cfr_section(beverage, near), "."), K.MISMATCH)


def bottler(extracted: Column, expected: Column, x: Column, y: Column, ratio: Column) -> Branches:
    """x, y: the texts without bottling phrases. Only equal texts pass; near ones are for a person."""
    extends = x.startswith(F.concat(y, F.lit(" "))) | y.startswith(F.concat(x, F.lit(" ")))
    made = Branches(extracted, expected).when(_empty(x) | _empty(y), K.NOT_EVALUATED, K.SAYS["bottler_missing"])
    made.when(T.compact(x) == T.compact(y), K.PASS, K.SAYS["bottler_pass"], K.MATCH)
    made.when(extends | (ratio >= K.FUZZY_REVIEW), K.REVIEW, K.SAYS["bottler_review"], ratio)
    return made.when(True, K.FAIL, K.SAYS["bottler_fail"], ratio)


def origin(extracted: Column, expected: Column, x: Column, y: Column, required: Column) -> Branches:
    """x, y: the texts without origin phrases; required: whether the application names an origin."""
    made = Branches(extracted, expected).when(~required & ~_empty(x), K.NOT_EVALUATED, K.SAYS["origin_noted"]).when(~required, K.NOT_EVALUATED, K.SAYS["origin_domestic"])
    made.when(_empty(x), K.NOT_EVALUATED, K.SAYS["origin_missing"]).when(x == y, K.PASS, K.SAYS["origin_pass"], K.MATCH)
    return made.when(True, K.FAIL, K.SAYS["origin_fail"], K.MISMATCH)


def government_warning(extracted: Column, x: Column, diff: Column) -> Branches:
    """x: the repaired text; diff: its difference from the statutory one. A missing warning fails."""
    made = Branches(extracted, F.lit(K.WARNING)).when(_empty(x), K.FAIL, K.SAYS["warning_missing"]).when(x == K.WARNING, K.PASS, K.SAYS["warning_pass"], K.MATCH)
    made.when(T.compact(x) == K.WARNING.replace(" ", ""), K.REVIEW, K.SAYS["warning_spaces"])
    said = F.when(diff == "", "normalized text differs at the character level").otherwise(diff)
    return made.when(True, K.FAIL, _says("Government warning deviation: ", said, "."), K.MISMATCH)


def warning_prefix(extracted: Column, x: Column, diff: Column) -> Branches:
    """x: the first characters of the repaired text."""
    made = Branches(F.when(_empty(x), extracted).otherwise(x), F.lit(K.WARNING_PREFIX)).when(_empty(x), K.NOT_EVALUATED, K.SAYS["prefix_missing"])
    made.when(x == K.WARNING_PREFIX, K.PASS, K.SAYS["prefix_pass"], K.MATCH).when(T.compact(x) == K.WARNING_PREFIX.replace(" ", ""), K.REVIEW, K.SAYS["prefix_spaces"])
    return made.when(True, K.FAIL, _says("Government warning prefix deviation: ", diff, "."), K.MISMATCH)


def warning_bold() -> Column:
    return result(F.lit(K.NOT_EVALUATED), F.lit(K.BOLD_EXPECTED), F.lit(None), F.lit(None), F.lit(K.SAYS["bold"]))


def warning_type_size() -> Column:
    return result(F.lit(K.NOT_EVALUATED), F.lit(K.TYPE_SIZE_EXPECTED), F.lit(None), F.lit(None), F.lit(K.SAYS["type_size"]))


def ambiguous(rule: Column, state: Column, alternatives: Column, expected: Column, name: str) -> Column:
    """The rule's result, unless several candidates were found: then a person decides."""
    many = F.nullif(F.array_join(alternatives, " | "), F.lit(""))
    several = result(F.lit(K.REVIEW), expected, many, F.lit(None), F.lit(f"Multiple {name} candidates were located; agent review is required."))
    found = F.coalesce(state == "AMBIGUOUS", F.lit(False))
    return F.struct(*(F.when(found, several[f]).otherwise(rule[f]).alias(f) for f in PARTS))


def evaluated(labels: DataFrame) -> DataFrame:
    """labels' columns with one struct for each check.

    labels has the six application fields under their names and the label's evidence as `read_<field>` and
    `read_government_warning`; where candidates were extracted, also `state_<field>` and `alternatives_<field>`.
    """
    df, helpers = labels, []

    def add(**columns: Column) -> None:
        nonlocal df
        df = df.withColumns({f"_{k}": c for k, c in columns.items()})
        helpers.extend(f"_{k}" for k in columns)

    c = lambda name: F.col(f"_{name}")
    add(**{f"{side}_{f}": T.identity(F.col(p + f)) for side, p in (("x", "read_"), ("y", "")) for f in FIELDS})
    add(**{f"{s}{k}_{f}": fn(c(f"{s}_{f}")) for s in "xy" for f, k, fn in (("brand_name", "s", T.without_suffixes), ("class_type", "s", T.without_suffixes), ("bottler", "s", lambda v: T._without_prefix(v, K.BOTTLER_PREFIXES)), ("origin_country", "s", lambda v: T._without_prefix(v, K.ORIGIN_PREFIXES)))})
    add(**{f"ratio_{f}": T.token_sort_ratio(c(f"xs_{f}"), c(f"ys_{f}")) for f in ("brand_name", "class_type", "bottler")})
    add(beverage=T.beverage_class(c("y_class_type"), identified=True), warning=T.warning(F.col("read_government_warning")), required=T.has_origin_value(F.col("origin_country")))
    add(prefix=F.substring(c("warning"), 1, len(K.WARNING_PREFIX)))
    apart = lambda text, fixed: T.word_level_diff(fixed, F.when(T.compact(text) != fixed.replace(" ", ""), text))  # noqa: E731  lost spaces alone are told otherwise
    add(diff=apart(c("warning"), K.WARNING), prefix_diff=apart(c("prefix"), K.WARNING_PREFIX))
    parsed = {f"{what}_{s}": fn(F.col(p + "alcohol_content")) for what, fn in (("abv", N.parse_abv), ("proof", N.parse_proof)) for s, p in (("x", "read_"), ("y", ""))}
    add(**parsed, net_x=N.parse_net_contents(F.col("read_net_contents")), net_y=N.parse_net_contents(F.col("net_contents")))
    add(**{k: N.authorized_size(c(n)["ml"], c(n)["unit"], c("beverage")) for k, n in (("size", "net_x"), ("wanted", "net_y"))}, near=N.nearest_size(c("net_x")["ml"], c("beverage")))
    pair = lambda f: (F.col(f"read_{f}"), F.col(f))
    ids = lambda f, k="": (c(f"x{k}_{f}"), c(f"y{k}_{f}"))
    checks = {
        "brand_name": brand(*pair("brand_name"), *ids("brand_name", "s"), c("ratio_brand_name")),
        "class_type": class_type(*pair("class_type"), *ids("class_type", "s"), c("ratio_class_type")),
        "alcohol_content": alcohol(*pair("alcohol_content"), *ids("alcohol_content"), c("beverage"), {k: c(k) for k in parsed}),
        "net_contents": net_contents(*pair("net_contents"), *ids("net_contents"), c("net_x"), c("net_y")),
        "net_contents_standard_of_fill": standard_of_fill(*pair("net_contents"), *ids("net_contents"), c("beverage"), *map(c, ("net_x", "net_y", "size", "wanted", "near"))),
        "bottler": bottler(*pair("bottler"), *ids("bottler", "s"), c("ratio_bottler")),
        "origin_country": origin(*pair("origin_country"), *ids("origin_country", "s"), c("required")),
        "government_warning": government_warning(F.col("read_government_warning"), c("warning"), c("diff")),
        "government_warning_prefix": warning_prefix(F.col("read_government_warning"), c("prefix"), c("prefix_diff")),
    }
    add(**{f"branch_{k}": v.number() for k, v in checks.items()})
    checks = {k: v.chosen(c(f"branch_{k}")) for k, v in checks.items()} | {"government_warning_bold": warning_bold(), "government_warning_type_size": warning_type_size()}
    names = {"brand_name": "brand-name", "class_type": "class/type", "alcohol_content": "alcohol-content", "net_contents": "net-contents", "net_contents_standard_of_fill": "net-contents", "bottler": "bottler", "origin_country": "country-of-origin", "government_warning": "government-warning wording", "government_warning_prefix": "government-warning prefix"}
    for check, name in names.items():
        field = {"net_contents_standard_of_fill": "net_contents", "government_warning_prefix": "government_warning"}.get(check, check)
        if f"state_{field}" not in labels.columns:
            continue
        expected = {"government_warning": F.lit(K.WARNING), "government_warning_prefix": F.lit(K.WARNING_PREFIX)}.get(check, F.col(field) if field in labels.columns else F.lit(None))
        state = F.col(f"state_{field}")
        if field == "origin_country":
            state = F.when(c("required"), state)
        checks[check] = ambiguous(checks[check], state, F.col(f"alternatives_{field}"), expected, name)
    return df.withColumns({f"check_{k}": v for k, v in checks.items()}).drop(*helpers)


def long_form(checked: DataFrame, *keys: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row for each label and check, with the parts of its result that are asked for: an optimiser can't tell which parts of an exploded array nobody reads, and would have all details made."""
    entries = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(name).alias("check"), *(F.col(f"check_{name}")[p].alias(p) for p in parts)) for i, name in enumerate(K.CHECKS)))
    return checked.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
