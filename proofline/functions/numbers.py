"""Exact numbers from label text: alcohol, proof, net contents, sizes and tolerances, as Column expressions over decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import text as T

DECIMAL = "decimal(28,10)"


def number(text: Column) -> Column:
    """The value of a whole text that is one number (thousands grouped by three); else null."""
    text = F.trim(text)
    return F.when(text.rlike(f"^(?:{K.NUMBER})$"), F.replace(text, F.lit(","), F.lit("")).try_cast(DECIMAL))


def _marked(text: Column, before: str, after: str, signal: str, low: int, high: int, name: str, missing: str) -> Column:
    """struct(value, error) of the one number that stands at a marker."""
    pattern = f"(?iu)(?:{before}|{after})"
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2), lambda a, b: F.when(a != "", a).otherwise(b))

    def judged(x: Column) -> Column:
        all_, value = x["all"], x["value"]
        error = (
            F.when((F.size(all_) == 0) & text.rlike(f"(?iu){signal}"), missing)
            .when(F.size(all_) == 0, F.lit(None).cast("string"))
            .when(F.size(all_) > 1, f"multiple {name} values are ambiguous")
            .when(value.isNull(), F.concat(F.lit("invalid numeric value: '"), F.get(all_, F.lit(0)), F.lit("'")))
            .when(~value.between(low, high), f"{name} must be between {low} and {high}" + (" percent" if name == "ABV" else ""))
        )
        return T.named(error, lambda e: F.struct(F.when(e.isNull() & (F.size(all_) == 1), value).alias("value"), e.alias("error")))

    parsed = T.named(found, lambda a: T.named(F.struct(a.alias("all"), number(F.get(a, F.lit(0))).alias("value")), judged))
    return F.when(text.isNotNull(), parsed)


def parse_abv(text: Column) -> Column:
    n = K.NUMBER_CANDIDATE
    return _marked(text, rf"{K.NOT_AFTER}({n})\s*%\s*{K.ABV_MARKER}", rf"{K.ABV_MARKER}\s*({n})\s*%{K.NOT_BEFORE}", K.ABV_SIGNAL, *K.ABV_RANGE, "ABV", "ABV marker is present without a valid numeric declaration")


def parse_proof(text: Column) -> Column:
    n = K.NUMBER_CANDIDATE
    return _marked(text, rf"{K.NOT_AFTER}({n})\s*{K.PROOF_MARKER}", rf"{K.PROOF_MARKER}\s*({n}){K.NOT_BEFORE}", K.PROOF_MARKER, *K.PROOF_RANGE, "proof", "proof marker is present without a valid numeric declaration")


def parse_net_contents(text: Column) -> Column:
    """struct(ml, unit, error) of a whole text that is one volume."""
    pattern = rf"(?iu)^\s*({K.NUMBER})\s*({K.NET_UNIT})\s*$"
    raw = F.regexp_extract(text, pattern, 2)
    unit = F.trim(F.regexp_replace(F.replace(F.lower(raw), F.lit("."), F.lit("")), r"\s+", " "))
    factors = F.create_map(*(F.lit(x) for u, f in K.UNIT_ML.items() for x in (u, f)))

    def judged(x: Column) -> Column:
        ml = (x["number"] * x["factor"].cast("decimal(14,10)")).cast(DECIMAL)
        error = F.when(x["unit"] == "", F.concat(F.lit("unsupported net-contents value: '"), text, F.lit("'"))).when(x["factor"].isNull(), F.concat(F.lit("unsupported net-contents unit: '"), x["unit"], F.lit("'")))
        return T.named(error, lambda e: F.struct(F.when(e.isNull(), ml).alias("ml"), F.when(e.isNull(), x["unit"]).alias("unit"), e.alias("error")))

    read = T.named(unit, lambda u: F.struct(u.alias("unit"), factors[u].alias("factor"), number(F.regexp_extract(text, pattern, 1)).alias("number")))
    return F.when(text.isNotNull(), T.named(read, judged))


def decimal(x) -> Column:
    return F.lit(str(x)).cast(DECIMAL)


def plain(x: Column) -> Column:
    """A decimal as text without needless zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def abv_tolerance(beverage: Column, labelled: Column) -> Column:
    """Permitted deviation in percentage points; null for other classes."""
    return (
        F.when(beverage == "distilled_spirits", decimal(K.SPIRITS_TOLERANCE))
        .when((beverage == "wine") & (labelled > decimal(K.WINE_BAND)), decimal(K.WINE_TOLERANCE_ABOVE))
        .when(beverage == "wine", decimal(K.WINE_TOLERANCE_TO_BAND))
        .when((beverage == "beer") & (labelled < decimal(K.MALT_TOLERANCE_FROM)), decimal(0))
        .when(beverage == "beer", decimal(K.MALT_TOLERANCE))
    )


def is_wine_large(ml: Column) -> Column:
    return (ml >= K.WINE_LARGE_FROM) & (ml % K.WINE_LARGE_STEP == 0)


def nearest_wine_large(ml: Column) -> Column:
    """The nearest whole litre from four on; halfway, the lower."""
    lower = (F.floor(ml / K.WINE_LARGE_STEP) * K.WINE_LARGE_STEP).cast(DECIMAL)
    return F.when(ml <= K.WINE_LARGE_FROM, decimal(K.WINE_LARGE_FROM)).when(ml - lower <= lower + K.WINE_LARGE_STEP - ml, lower).otherwise((lower + K.WINE_LARGE_STEP).cast(DECIMAL))


def _sizes(beverage: str) -> Column:
    return F.array(*(decimal(s) for s in K.SIZES[beverage]))


def nearest_size(ml: Column, beverage: Column) -> Column:
    """The authorised size closest to ml; of two as close, the smaller."""

    def closest(sizes: Column) -> Column:
        return F.array_min(F.transform(sizes, lambda s: F.struct(F.abs(ml - s).cast(DECIMAL).alias("d"), s.alias("s"))))["s"]

    wine = closest(F.concat(_sizes("wine"), F.array(nearest_wine_large(ml))))
    return F.when(beverage == "distilled_spirits", closest(_sizes("distilled_spirits"))).when(beverage == "wine", wine)


def authorized_size(ml: Column, unit: Column, beverage: Column) -> Column:
    """The size that a stated volume stands for, or null: fluid ounces within half a printed step, metric ones exactly."""
    near = nearest_size(ml, beverage)
    listed = F.when(beverage == "wine", F.array_contains(_sizes("wine"), ml) | is_wine_large(ml)).otherwise(F.array_contains(_sizes("distilled_spirits"), ml))
    return F.when(unit == "fl oz", F.when(F.abs(ml - near) <= F.lit(str(K.FL_OZ_PRINT_STEP)).cast("decimal(28,12)"), near)).when(listed, ml)


def cfr_section(beverage: Column, size: Column) -> Column:
    return F.when(beverage == "distilled_spirits", "27 CFR 5.203(a)").when(is_wine_large(size), "27 CFR 4.72(b)").otherwise("27 CFR 4.72(a)")


def progress_text(done: Column, total: Column, seconds: Column) -> Column:
    """What is done and left to wait, in words, from the pace so far."""
    left = F.try_divide(seconds, done) * (total - done)
    minutes = F.bround(left / 60, 0).cast("int")
    said = F.when(left < 90, " — under 2 minutes left").otherwise(F.concat(F.lit(" — about "), minutes.cast("string"), F.when(minutes == 1, " minute left").otherwise(" minutes left")))
    have = F.concat(F.lit("Completed "), done.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" labels"))
    return F.when((done <= 0) | (done >= total) | (seconds <= 0), have).otherwise(F.concat(have, said))
