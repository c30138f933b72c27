"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Everything runs as DataFrame expressions. Documents are reduced to one row of counts each (written once); only the numbers
of documents with each combination of votes, at most 3^rules, reach the driver, where EM runs on them.

Null text counts as empty: no words, base_failed, not kept. Null ids and repeated rows are judged like
others; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.shared import table, text_of, written

NAME = "op10_quality_rules"
ORACLE_SQL = None

WINDOW = 8
LEAST_WORDS = 20
KEEP_FROM = 0.5
SPACES = r"[\x20\x09-\x0D]+"

#: Fixed values. Rules by name: a count and its base (None: no base), what votes good, what votes bad; between them the rule abstains.
RULES = {
    "length": ("n_words", None, lambda x: x >= 40, lambda x: x < 20),
    "word_length": ("word_chars", "n_words", lambda x: x.between(3, 10), lambda x: (x < 2) | (x > 15)),
    "symbols": ("n_symbols", "n_words", lambda x: x < 0.02, lambda x: x > 0.1),
    "line_repeats": ("n_dup_lines", "n_lines", lambda x: x < 0.1, lambda x: x > 0.4),
    "word_repeats": ("n_repeat_words", "n_words", lambda x: x < 0.1, lambda x: x > 0.3),
    "letters": ("n_letters", "word_chars", lambda x: x > 0.8, lambda x: x < 0.6),
    "distinct_words": ("n_distinct", "n_words", lambda x: x > 0.2, lambda x: x < 0.05),
    "capitals": ("n_capitals", "word_chars", lambda x: x < 0.2, lambda x: x > 0.6),
}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more. Windows are compared by a 64-bit hash of their words."""
    last = F.size(words) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # A one-element array stands for a name, so that each intermediate array is made once.
    found = F.get(F.transform(F.array(ordered), lambda s: F.get(F.transform(F.array(places(s)), covered), F.lit(0))), F.lit(0))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when((last >= 1) & some, found).otherwise(0).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """One row of counts for each document; map-only."""
    text = text_of(docs)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select("doc_id", text.alias("_t"), _words(text).alias("_w"), lines.alias("_l"))
    squeezed = F.translate(F.col("_t"), " \t\n\x0b\x0c\r", "")
    return read.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )


def votes(counted: DataFrame) -> DataFrame:
    """Each rule's vote beside the counts: 1 good, -1 bad, 0 none (also where the count has no base)."""
    out = {}
    for name, (value, base, good, bad) in RULES.items():
        x = F.try_divide(F.col(value), F.col(base) if base else F.lit(1))
        out[f"vote_{name}"] = F.when(good(x), 1).when(bad(x), -1).otherwise(0)
    return counted.withColumns(out)


def estimated(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, list[dict]]:
    """EM over the numbers of documents with each combination of votes: the share of good ones, and each rule's vote
    probabilities given good and given bad. It starts from doubt where any rule
    votes bad; smoothing keeps rare votes from certainty."""
    m = len(RULES)
    total = sum(patterns.values())
    if not total:
        return 0.5, [{g: {v: 1 / 3 for v in (-1, 0, 1)} for g in (True, False)}] * m
    belief = {p: 0.1 if -1 in p else 0.95 for p in patterns}
    prior, given = 0.5, []
    for _ in range(rounds):
        weight = {True: sum(n * belief[p] for p, n in patterns.items())}
        weight[False] = total - weight[True]
        prior = min(max(weight[True] / total, 1e-4), 1 - 1e-4)
        given = []
        for k in range(m):
            own = {g: {v: 1.0 for v in (-1, 0, 1)} for g in (True, False)}
            for p, n in patterns.items():
                own[True][p[k]] += n * belief[p]
                own[False][p[k]] += n * (1 - belief[p])
            given.append({g: {v: x / (weight[g] + 3) for v, x in own[g].items()} for g in (True, False)})
        old, belief = belief, {p: posterior(p, prior, given) for p in patterns}
        if max(abs(belief[p] - old[p]) for p in patterns) < 1e-9:
            break
    return prior, given


def posterior(pattern: tuple[int, ...], prior: float, given: list[dict]) -> float:
    z = math.log(prior / (1 - prior)) + sum(math.log(g[True][v] / g[False][v]) for g, v in zip(given, pattern, strict=True))
    return 1 / (1 + math.exp(-min(max(z, -35), 35)))


def quality(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, votes, base_failed, the posterior probability of good quality, and kept."""
    voted = written(votes(counts(docs)), "quality")
    names = [f"vote_{name}" for name in RULES]
    patterns = {tuple(r[n] for n in names): r["count"] for r in voted.groupBy(*names).count().collect()}
    prior, given = estimated(patterns)
    z = F.lit(math.log(prior / (1 - prior)))
    for name, g in zip(names, given, strict=True):
        ratio = {v: math.log(g[True][v] / g[False][v]) for v in (-1, 0, 1)}
        z = z + F.when(F.col(name) == 1, ratio[1]).when(F.col(name) == -1, ratio[-1]).otherwise(ratio[0])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
