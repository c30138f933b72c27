"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline import constants as K
from proofline.functions import numbers as N
from proofline.functions import text as T
from proofline.operators import batch, layout, reconcile, rollup, rules
from proofline.plans import report, synthetic
from proofline.sources import corpus, images, manifest, registry
from proofline.storage import place, spread

_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def register(f):
        _Q[f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items() if sql}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.long_form(rules.evaluated(synthetic.labels(spark, sf_dir)), "label_id", "filename")


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks whose details nobody asks for."""
    return rules.long_form(rules.evaluated(synthetic.labels(spark, sf_dir)), "label_id", "filename", parts=("status",))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rolled_up(_statuses(spark, sf_dir), "label_id", "filename")


# ---- flagship ----

_ROLLED = f"""{synthetic.CHECKED},
labels_rolled AS (
  SELECT label_id, filename, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' WHEN bool_or(status = 'PASS') THEN 'PASS' ELSE 'NOT_EVALUATED' END AS overall,
    count(*) FILTER (status = 'NOT_EVALUATED') AS n_not_run
  FROM checks GROUP BY ALL
)
"""


@_query(f"{_ROLLED} SELECT label_id, filename, overall, overall AS status, CAST(CASE overall WHEN 'FAIL' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'NOT_EVALUATED' THEN 2 ELSE 3 END AS INTEGER) AS rank, CAST(n_not_run AS INTEGER) AS n_not_run FROM labels_rolled")
def triage_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _verdicts(spark, sf_dir).withColumn("n_not_run", F.size(F.filter("statuses", lambda s: s == K.NOT_EVALUATED)))
    return rollup.triaged(found, "label_id").select("label_id", "filename", "overall", "status", "rank", "n_not_run")


@_query(f'{synthetic.CHECKED} SELECT label_id, "check", status FROM checks')
def check_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).select("label_id", "check", "status")


@_query(f"{synthetic.DETAILED} SELECT * FROM details")
def check_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


@_query(f"{_ROLLED} SELECT overall AS verdict, count(*) AS n_labels FROM labels_rolled GROUP BY ALL")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.histogram(_verdicts(spark, sf_dir))


@_query(f"""{synthetic.CHECKED} SELECT label_id % 3 AS variant, "check", count(*) FILTER (status = 'PASS') AS n_correct, count(*) AS n_samples
FROM checks WHERE "check" IN {K.APPLICATION_FIELDS} GROUP BY ALL""")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.field_accuracy(_statuses(spark, sf_dir).withColumn("variant", F.col("label_id") % 3), "variant")


_NAMES = ", ".join(f"('{c}', {i}, '{label}')" for i, (c, label) in enumerate(K.CHECKS.items()))


@_query(f"""{synthetic.CHECKED}, names(c, i, label) AS (VALUES {_NAMES})
SELECT label_id, concat(count(*), CASE count(*) WHEN 1 THEN ' check' ELSE ' checks' END, ' could not be run — ', string_agg(label, '; ' ORDER BY i)) AS disclosure
FROM checks JOIN names ON c = "check" WHERE status = 'NOT_EVALUATED' GROUP BY label_id""")
def disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("label_id", "disclosure")


_SHOWN = "CASE {} WHEN 'NOT_EVALUATED' THEN 'NOT CHECKED' ELSE {} END"
_REPORTED = ", ".join(
    f"""max({value}) FILTER ("check" = '{c}') AS "{label} — {suffix}" """
    for c, label in K.CHECKS.items()
    for value, suffix in zip((_SHOWN.format("status", "status"), "expected", "extracted", "confidence", "detail"), K.REPORT_SUFFIXES, strict=True)
)


@_query(f"""{synthetic.DETAILED}, {_ROLLED.partition("labels_rolled AS")[1]}{_ROLLED.partition("labels_rolled AS")[2]}, names(c, i, label) AS (VALUES {_NAMES}),
undone AS (SELECT label_id, concat(count(*), CASE count(*) WHEN 1 THEN ' check' ELSE ' checks' END, ' could not be run — ', string_agg(label, '; ' ORDER BY i)) AS said FROM details JOIN names ON c = "check" WHERE status = 'NOT_EVALUATED' GROUP BY label_id)
SELECT filename AS "Filename", {_SHOWN.format("any_value(overall)", "any_value(overall)")} AS "Overall result", coalesce(any_value(said), '') AS "Checks that could not be run", CAST(NULL AS VARCHAR) AS "Problem", {_REPORTED}
FROM details JOIN labels_rolled USING (label_id, filename) LEFT JOIN undone USING (label_id) GROUP BY label_id, filename""")
def report_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = rules.evaluated(synthetic.labels(spark, sf_dir))
    return report.wide(checked.withColumns({"order": F.col("label_id"), "error": F.lit(None).cast("string")}))


@_query(f"""{synthetic.DETAILED}, names(c, i, label) AS (VALUES {_NAMES})
SELECT label_id, label AS "Check", {_SHOWN.format("status", "status")} AS "Result", CASE WHEN coalesce(trim(expected), '') = '' THEN 'Not provided' ELSE expected END AS "Application value",
  CASE WHEN coalesce(trim(extracted), '') = '' THEN 'Nothing readable was found' ELSE extracted END AS "We read this as", detail AS "Details" FROM details JOIN names ON c = "check" """)
def report_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.single(_checks(spark, sf_dir), "label_id")


# ---- scalar functions ----


@_query(r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.collapse_whitespace(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("n"), F.md5(text).alias("digest"))


@_query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '''', ''), '[^\pL\pN]', ' ', 'g'), ' +', ' ', 'g')) AS identity FROM benchmark""")
def normalize_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", T.identity(F.col("text")).alias("identity"))


_SUFFIXED = "SELECT c_custkey, concat(c_name, CASE c_custkey % 6 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Co., L.L.C.' WHEN 2 THEN ' Limited Liability Company' WHEN 3 THEN ' Brewing Company Ltd' WHEN 4 THEN ' incorporated plc' ELSE '' END) AS said FROM customer"


@_query(f"SELECT c_custkey, regexp_replace({synthetic.NORMAL.format('said')}, '^(.+?)(?: (?:{'|'.join(K.LEGAL_SUFFIXES)}))+$', '\\1') AS fuzzy, replace(fuzzy, ' ', '') AS compact FROM ({_SUFFIXED})")
def legal_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.view(spark, sf_dir, "customer")
    made = spark.sql(_SUFFIXED).withColumn("fuzzy", T.fuzzy(F.col("said")))
    return made.select("c_custkey", "fuzzy", T.compact(F.col("fuzzy")).alias("compact"))


_PREFIXED = "SELECT s_suppkey, concat(CASE s_suppkey % 5 WHEN 0 THEN 'Produced & Bottled by: ' WHEN 1 THEN 'Brewed and Bottled By ' WHEN 2 THEN 'IMPORTED BY ' WHEN 3 THEN 'made by made by ' ELSE '' END, s_name) AS b, concat(CASE s_suppkey % 4 WHEN 0 THEN 'Product of the ' WHEN 1 THEN 'Country of Origin: ' WHEN 2 THEN 'Origin ' ELSE '' END, 'Nation ', s_nationkey) AS o, CASE s_suppkey % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'Domestic' WHEN 2 THEN '--' WHEN 3 THEN NULL ELSE 'France' END AS p FROM supplier"


@_query(f"SELECT s_suppkey, regexp_replace({synthetic.NORMAL.format('b')}, '^(?:{'|'.join(K.BOTTLER_PREFIXES)})(?: |$)', '') AS bottler, regexp_replace({synthetic.NORMAL.format('o')}, '^(?:{'|'.join(K.ORIGIN_PREFIXES)})(?: |$)', '') AS origin, coalesce(trim(p) = 'France', false) AS has_origin FROM ({_PREFIXED})")
def prefix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.view(spark, sf_dir, "supplier")
    return spark.sql(_PREFIXED).select("s_suppkey", T.bottler(F.col("b")).alias("bottler"), T.origin(F.col("o")).alias("origin"), T.has_origin_value(F.col("p")).alias("has_origin"))


_SAID = "SELECT p_partkey, concat(CASE p_partkey % 8 WHEN 0 THEN 'x' WHEN 1 THEN '-' ELSE 'Contents ' END, p_size, CASE p_partkey % 4 WHEN 0 THEN '.5' WHEN 1 THEN '' ELSE ',000' END, CASE p_partkey % 5 WHEN 0 THEN '% ABV' WHEN 1 THEN '% alc/vol' WHEN 2 THEN ' proof' WHEN 3 THEN '% by volume' ELSE '% Alc/Volcano' END) AS said FROM part"


@_query(f"""SELECT p_partkey, CAST(CASE WHEN n IS NOT NULL AND n BETWEEN 0 AND 100 THEN n END AS DOUBLE) AS abv,
  CASE WHEN said ~ '(?i)^-[0-9.,]+% (abv|alc/vol$)' THEN 'invalid' WHEN n IS NULL AND said ~ '(?i)\\b(alc|alcohol|abv)\\b' THEN 'signal' WHEN n > 100 THEN 'range' END AS problem
FROM (SELECT *, TRY_CAST(replace(regexp_extract(said, '(?:^|[^0-9A-Za-z.,+-])([0-9][0-9.,]*)\\s*%\\s*(?:\\balc/vol\\b|\\babv)', 1, 'i'), ',', '') AS DECIMAL(18,2)) AS n FROM ({_SAID}))""")
def parse_abv(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    parsed = N.parse_abv(F.col("said"))
    problem = F.when(parsed["error"].startswith("ABV marker"), "signal").when(parsed["error"].startswith("ABV must"), "range").when(parsed["error"].startswith("invalid"), "invalid")
    return spark.sql(_SAID).select("p_partkey", parsed["value"].cast("double").alias("abv"), problem.alias("problem"))


@_query(f"""SELECT p_partkey, CAST(CASE WHEN n <= 200 THEN n END AS DOUBLE) AS proof
FROM (SELECT *, TRY_CAST(replace(regexp_extract(said, '(?:^|[^0-9A-Za-z.,+-])([0-9][0-9.,]*)\\s*proof\\b', 1), ',', '') AS DECIMAL(18,2)) AS n FROM ({_SAID}))""")
def parse_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    return spark.sql(_SAID).select("p_partkey", N.parse_proof(F.col("said"))["value"].cast("double").alias("proof"))


_VOLUME = "SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN '1,' WHEN 1 THEN '0' ELSE '' END, 100 + p_size, CASE p_partkey % 2 WHEN 0 THEN '.5' ELSE '' END, CASE p_partkey % 6 WHEN 0 THEN ' mL' WHEN 1 THEN ' fl. oz.' WHEN 2 THEN ' Liters' WHEN 3 THEN 'l' WHEN 4 THEN ' floz' ELSE ' cups' END) AS said FROM part"


@_query(f"""SELECT p_partkey, CAST(CAST(replace(regexp_extract(said, '^([0-9.,]+)', 1), ',', '') AS DECIMAL(20,2)) * CAST(CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 29.5735295625 WHEN 2 THEN 1000 WHEN 3 THEN 1000 END AS DECIMAL(14,10)) AS DOUBLE) AS ml,
  CASE p_partkey % 6 WHEN 0 THEN 'ml' WHEN 1 THEN 'fl oz' WHEN 2 THEN 'liters' WHEN 3 THEN 'l' END AS unit FROM ({_VOLUME})""")
def parse_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    parsed = N.parse_net_contents(F.col("said"))
    return spark.sql(_VOLUME).select("p_partkey", parsed["ml"].cast("double").alias("ml"), parsed["unit"].alias("unit"))


_STRENGTH = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'wine' WHEN 1 THEN 'beer' WHEN 2 THEN 'distilled_spirits' ELSE 'cider' END AS cls, CAST(p_size / 3.0 AS DECIMAL(12,3)) AS abv FROM part"


@_query(f"SELECT p_partkey, CAST(CASE cls WHEN 'wine' THEN CASE WHEN abv > 14 THEN 1.0 ELSE 1.5 END WHEN 'beer' THEN CASE WHEN abv < 0.5 THEN 0 ELSE 0.3 END WHEN 'distilled_spirits' THEN 0.3 END AS DOUBLE) AS tolerance FROM ({_STRENGTH})")
def abv_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    return spark.sql(_STRENGTH).select("p_partkey", N.abv_tolerance(F.col("cls"), F.col("abv")).cast("double").alias("tolerance"))


_FILL = "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'wine' ELSE 'distilled_spirits' END AS cls, CAST(p_size * 137 + p_partkey % 900 AS DECIMAL(12,3)) AS ml FROM part"


@_query(f"""WITH sizes(cls, size) AS (VALUES {synthetic.SIZES}), asked AS ({_FILL}),
near AS (SELECT p_partkey, asked.cls, ml, size FROM asked JOIN sizes USING (cls)
  UNION ALL SELECT p_partkey, cls, ml, 4000 + 1000 * greatest(0, k) FROM (SELECT *, unnest([CAST(floor((ml - 4000) / 1000) AS INTEGER), CAST(floor((ml - 4000) / 1000) AS INTEGER) + 1]) AS k FROM asked WHERE cls = 'wine'))
SELECT p_partkey, CAST(arg_min(size, abs(ml - size) * 100000 + size) AS DOUBLE) AS nearest, bool_or(ml = size) AS authorized FROM near GROUP BY p_partkey""")
def nearest_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    ml, cls = F.col("ml"), F.col("cls")
    return spark.sql(_FILL).select("p_partkey", N.nearest_size(ml, cls).cast("double").alias("nearest"), N.authorized_size(ml.cast(N.DECIMAL), F.lit("ml"), cls).isNotNull().alias("authorized"))


_PHRASE = "SELECT p_partkey, concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ' Port Finished Bourbon' WHEN 1 THEN ' BARLEY-WINE style ale' WHEN 2 THEN ' Table Wine' WHEN 3 THEN ' hard seltzer' WHEN 4 THEN ' Single Malt Scotch' WHEN 5 THEN ' gin' WHEN 6 THEN ' ginger' WHEN 7 THEN ' Crème de Menthe' ELSE ' flavored malt beverage with wine' END) AS said FROM part"


@_query(f"""WITH k(cls, word, n, i) AS (VALUES {synthetic.KEYWORDS}), asked AS (SELECT p_partkey, ' ' || trim(regexp_replace(regexp_replace(lower(said), '[^\\pL\\pN]', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS said FROM ({_PHRASE}))
SELECT p_partkey, arg_max(cls, n * 10 - i) FILTER (cls IS NOT NULL) AS beverage_class FROM asked LEFT JOIN k ON contains(said, ' ' || word || ' ') GROUP BY p_partkey""")
def beverage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    return spark.sql(_PHRASE).select("p_partkey", T.beverage_class(F.col("said")).alias("beverage_class"))


_NEXT = f"SELECT p.p_partkey AS id, {synthetic.sorted_words('p.p_name')} AS a, {synthetic.sorted_words('n.p_name')} AS b FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1"


@_query(f"WITH RECURSIVE {synthetic.lcs(_NEXT)} SELECT id AS p_partkey, round(200.0 * n / (length(a) + length(b)), 6) AS ratio FROM pairs LEFT JOIN lcs USING (id)")
def brand_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand and the next one; the last has none."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return parts.join(other, "p_partkey", "left").select("p_partkey", F.round(T.token_sort_ratio(F.col("p_name"), F.col("other")), 6).alias("ratio"))


_REPAIRED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])[1I]([a-z])', '\\1l\\2', 'g'), '([A-Za-z])-[ \\t]*\\r?\\n[ \\t]*([A-Za-z])', '\\1\\2', 'g'), '\\([Il]\\)', '(1)', 'g'), '\\s+', ' ', 'g'))"


_TURNS = "SELECT {'conv_id': conv_id, 'turn': turn} AS k, " + _REPAIRED + " AS t FROM conversations"


@_query(f"SELECT id.conv_id AS conv_id, id.turn AS turn, difference FROM ({synthetic.differences(_TURNS, 'k')})")
def warning_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.warning(F.col("text")).alias("t"))
    return said.select("conv_id", "turn", T.word_level_diff(K.WARNING, F.col("t")).alias("difference"))


_FIRST, _SECOND = K.WARNING[: K.WARNING.index(" (2)")], K.WARNING[K.WARNING.index("(2)") :]
_DEVIATING = f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '{K.WARNING}' WHEN 1 THEN replace('{K.WARNING}', ' women', '') WHEN 2 THEN concat('{K.WARNING} ', p_name) WHEN 3 THEN replace('{K.WARNING}', ',', ' , the') WHEN 4 THEN '{_SECOND} {_FIRST}'
  WHEN 5 THEN replace('{K.WARNING}', 'the', p_brand) WHEN 6 THEN replace('{K.WARNING}', 'of birth defects', 'of of birth birth defects of alcoholic beverages') ELSE concat(p_type, ' of the (1) (2), ', p_name, ' the risk, of. ') END AS t FROM part"""


@_query(f"SELECT id AS p_partkey, difference FROM ({synthetic.differences(_DEVIATING, 'p_partkey')})")
def warning_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings with words lost, added, moved, repeated and replaced."""
    synthetic.parts(spark, sf_dir)
    return spark.sql(_DEVIATING).select("p_partkey", T.word_level_diff(K.WARNING, F.trim("t")).alias("difference"))


_DONE = "SELECT event_id, CAST(event_id % 40 AS INTEGER) AS done, 40 AS total, CAST(value AS DOUBLE) AS seconds FROM events"


@_query(f"""SELECT event_id, 'Completed ' || done || ' of ' || total || ' labels' || CASE WHEN done <= 0 OR done >= total OR seconds <= 0 THEN '' WHEN seconds / done * (total - done) < 90 THEN ' — under 2 minutes left'
  ELSE ' — about ' || CAST(round_even(seconds / done * (total - done) / 60, 0) AS INTEGER) || CASE CAST(round_even(seconds / done * (total - done) / 60, 0) AS INTEGER) WHEN 1 THEN ' minute left' ELSE ' minutes left' END END AS said FROM ({_DONE})""")
def progress_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.view(spark, sf_dir, "events")
    return spark.sql(_DONE).select("event_id", N.progress_text(F.col("done"), F.col("total"), F.col("seconds")).alias("said"))


# ---- joins, sets, aggregates ----

_FILES = "SELECT concat('Doc', doc_id, '.png') AS filename, doc_id AS ord FROM documents WHERE doc_id % 3 <> 0"
_LISTED = "SELECT concat('DOC', doc_id + 7, '.PNG') AS filename, doc_id AS ord FROM labels"


@_query(f"""SELECT coalesce(m.filename, u.filename) AS filename, CASE WHEN u.filename IS NULL THEN 'image' WHEN m.filename IS NULL THEN 'manifest' END AS missing,
  CAST(m.filename IS NULL AS INTEGER) AS part, coalesce(m.ord, u.ord) AS place FROM ({_LISTED}) m FULL JOIN ({_FILES}) u ON lower(m.filename) = lower(u.filename)""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.view(spark, sf_dir, "documents", "labels")
    files, listed = (spark.sql(q).withColumnRenamed("ord", "order") for q in (_FILES, _LISTED))
    missing = F.when(F.col("error") == K.MISSING_IMAGE, "image").when(F.col("error") == K.MISSING_MANIFEST, "manifest")
    return reconcile.reconciled(listed, files).select("filename", missing.alias("missing"), "order.part", "order.place")


@_query(f"SELECT m.filename FROM ({_LISTED}) m WHERE ord NOT IN (SELECT ord FROM ({_FILES}))")
def cancelled_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.view(spark, sf_dir, "documents", "labels")
    done = spark.sql(f"SELECT m.filename FROM ({_LISTED}) m JOIN ({_FILES}) f ON m.ord = f.ord")
    return reconcile.cancelled(spark.sql(_LISTED), done).select("filename")


_TWICE = "SELECT concat(CASE doc_id % 2 WHEN 0 THEN 'IMG' ELSE 'img' END, doc_id % 90, '.png') AS filename, doc_id AS ord FROM documents"


@_query(f'SELECT filename, ord AS "order" FROM (SELECT *, row_number() OVER (PARTITION BY lower(filename) ORDER BY ord) AS n FROM ({_TWICE})) WHERE n = 2')
def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.view(spark, sf_dir, "documents")
    return reconcile.duplicates(spark.sql(_TWICE).withColumnRenamed("ord", "order"))


# ---- a batch: every input once ----

#: Labels listed; those uploaded, some in other letter case, and uploads that no row lists. The verifier gives nothing back for some.
_UPLOADED = f"""SELECT CASE label_id % 2 WHEN 0 THEN upper(filename) ELSE filename END AS filename, label_id AS ord, {', '.join(f'read_{c}' for c in (*K.APPLICATION_FIELDS, 'government_warning'))} FROM ({synthetic.LABELS}) WHERE label_id % 13 <> 5
UNION ALL SELECT concat('extra_', label_id, '.png'), label_id, {', '.join(['NULL'] * 7)} FROM ({synthetic.LABELS}) WHERE label_id % 17 = 3"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = synthetic.labels(spark, sf_dir).select("filename", *K.APPLICATION_FIELDS, F.col("label_id").alias("order"))
    uploads = spark.sql(_UPLOADED).withColumnRenamed("ord", "order")
    number = F.regexp_extract("filename", "([0-9]+)", 1).cast("long")
    return batch.results(batch.checked_manifest(listed), uploads, lambda matched: rules.long_form(rules.evaluated(matched.where(number % 19 != 7)), "filename", parts=("status",)))


_BATCHED = f"""{_ROLLED}, listed AS (SELECT filename, row_number() OVER (ORDER BY label_id) - 1 AS "order", CASE WHEN label_id % 13 = 5 THEN '{K.MISSING_IMAGE}' WHEN label_id % 19 = 7 THEN '{K.PROCESSING_ERROR}' END AS error, overall FROM labels_rolled),
inputs AS (SELECT * FROM listed UNION ALL SELECT concat('extra_', p_partkey, '.png'), (SELECT count(*) FROM part) + row_number() OVER (ORDER BY p_partkey) - 1, '{K.MISSING_MANIFEST}', NULL FROM part WHERE p_partkey % 17 = 3),
batch AS (SELECT filename, CAST("order" AS BIGINT) AS "order", error, CASE WHEN error IS NULL THEN overall ELSE 'NOT_EVALUATED' END AS status FROM inputs)"""


@_query(f"""{_BATCHED} SELECT *, CAST(CASE WHEN error IS NOT NULL THEN 0 ELSE CASE status WHEN 'FAIL' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'NOT_EVALUATED' THEN 2 ELSE 3 END END AS INTEGER) AS rank FROM batch""")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows and verified labels as one batch, in triage order."""
    return rollup.triaged(_batch(spark, sf_dir)).select("filename", "order", "error", "status", "rank")


@_query(f"""{_BATCHED} SELECT filename, "order", CASE WHEN trim(filename) = '' THEN 'filename must not be blank' ELSE 'a batch result must contain exactly one of report or error' END AS problem
FROM (SELECT CASE "order" % 23 WHEN 0 THEN ' ' ELSE filename END AS filename, "order" FROM batch WHERE "order" % 23 IN (0, 1) OR "order" % 23 = 2 AND error IS NOT NULL)""")
def batch_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch spoilt on purpose: names lost, reports and errors lost, reports beside errors."""
    found, kind = _batch(spark, sf_dir), F.col("order") % 23
    some = F.array(F.struct(*(F.lit(None).cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in batch.RESULT.split(", "))))
    spoilt = found.withColumn("filename", F.when(kind == 0, " ").otherwise(F.col("filename"))).withColumn("checks", F.when(kind == 1, None).when(kind == 2, some).otherwise(F.col("checks"))).withColumn("error", F.when(kind != 1, F.col("error")))
    return batch.violations(spoilt)


@_query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY ALL")
def stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.timing(_table(spark, sf_dir, "events"), "value", "event_type").drop("mean")


@_query("""SELECT event_type, min(value) AS weighted_median FROM (SELECT event_type, value, sum(w) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING) AS r, sum(w) OVER (PARTITION BY event_type) AS t
FROM (SELECT event_type, value, 1 + user_id % 5 AS w FROM events)) WHERE r >= t / 2 GROUP BY ALL""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("w", 1 + F.col("user_id") % 5)
    return rollup.weighted_median(events, "value", "w", "event_type")


_KEYWORD_LINES = "SELECT DISTINCT l_orderkey AS label_id, l_linenumber AS line, CASE l_partkey % 5 WHEN 0 THEN 'table wine' WHEN 1 THEN 'single malt scotch whisky' WHEN 2 THEN 'gin' WHEN 3 THEN 'rye whiskey bourbon' ELSE 'proof' END AS said FROM lineitem"


@_query(f"""WITH k(cls, word, n, i) AS (VALUES {synthetic.KEYWORDS}), scored AS (SELECT label_id, line, said, max(n) AS words, count(*) AS hits FROM ({_KEYWORD_LINES}) JOIN k ON contains(' ' || said || ' ', ' ' || word || ' ') GROUP BY ALL)
SELECT label_id, line, said FROM scored QUALIFY rank() OVER (PARTITION BY label_id ORDER BY words DESC, hits DESC) = 1""")
def class_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.view(spark, sf_dir, "lineitem")
    scored = spark.sql(_KEYWORD_LINES).withColumn("s", T.keyword_score(F.col("said"))).where("s IS NOT NULL")
    w = Window.partitionBy("label_id").orderBy(F.desc("s.words"), F.desc("s.hits"))
    return scored.withColumn("k", F.rank().over(w)).where("k = 1").select("label_id", "line", "said")


_BOXES = "SELECT l_orderkey AS label_id, l_linenumber AS line, CAST(l_linenumber * 40 + min(l_suppkey) % 30 AS DOUBLE) AS t, CAST(l_linenumber * 40 + min(l_suppkey) % 30 + 20 AS DOUBLE) AS b FROM lineitem GROUP BY l_orderkey, l_linenumber"


@_query(f"""SELECT label_id, min(line) AS first_line, count(*) AS n_lines FROM (SELECT *, sum(new) OVER (PARTITION BY label_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN line = lag(line) OVER w + 1 AND t - lag(b) OVER w BETWEEN 0 AND 10 THEN 0 ELSE 1 END AS new FROM ({_BOXES}) WINDOW w AS (PARTITION BY label_id ORDER BY line))) GROUP BY label_id, island""")
def brand_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.view(spark, sf_dir, "lineitem")
    w = Window.partitionBy("label_id").orderBy("line")
    joined = (F.col("line") == F.lag("line").over(w) + 1) & (F.col("t") - F.lag("b").over(w)).between(0, 20 * layout.BRAND_GAP)
    marked = spark.sql(_BOXES).withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("label_id", "island").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines")).drop("island")


# ---- the manifest ----

#: A record (on %16 = 0 a blank line before it) for each part; some are short, long, blank, repeated, quoted over two lines, or lack values.
_LISTING = """SELECT p_partkey AS k, CASE p_partkey % 16
  WHEN 0 THEN concat(chr(10), 'file_', p_partkey, '.png,', p_name, ',Ale,5% ABV,1 L,Maker,')
  WHEN 1 THEN concat('file_', p_partkey, '.png,', p_name, ',Ale')
  WHEN 2 THEN concat('FILE_', p_partkey - 2, '.PNG,', p_name, ',Ale,5% ABV,1 L,Maker,France')
  WHEN 3 THEN concat('file_', p_partkey, '.png,"', p_name, ' ""x"", y', chr(10), p_brand, '",Ale,5% ABV,1 L,Maker,')
  WHEN 4 THEN concat('file_', p_partkey, '.png,', p_name, ',Ale,5% ABV, ,,Italy')
  WHEN 5 THEN ' , ,,,,,'
  WHEN 6 THEN concat('file_', p_partkey, '.png,', p_name, ' 5" tall,Ale,5% ABV,1 L,"Maker", ')
  WHEN 7 THEN concat('file_', p_partkey, '.png,', p_name, ',Ale,5% ABV,1 L,Maker,,')
  WHEN 8 THEN concat('file_', p_partkey, '.png,"', p_name, ',', p_brand, '",Ale,5% ABV,1 L,Maker,', chr(13))
  ELSE concat('file_', p_partkey, '.png, ', p_name, ' ,Ale,5% ABV,1 L,Maker,Product of ', p_size) END AS said FROM part"""
_LISTED_ROWS = f"""SELECT k, said, k % 16 AS c, 1 + sum(CASE k % 16 WHEN 0 THEN 2 ELSE 1 END) OVER (ORDER BY k) AS row FROM ({_LISTING})"""


def _listing(spark: SparkSession, sf_dir: str, where: str) -> str:
    """The listing as text files in the shared folder, its header on the first; their path."""
    synthetic.parts(spark, sf_dir)
    said = spark.sql(f"SELECT k, said FROM ({_LISTING}) WHERE {where} UNION ALL SELECT NULL, '{','.join(K.MANIFEST_COLUMNS)}'")
    said.orderBy(F.asc_nulls_first("k")).select("said").write.text(path := place(spark, "manifest"))
    return path


@_query(f"""SELECT CAST(row AS BIGINT) AS row, concat('Row ', CAST(row AS BIGINT), CASE c WHEN 2 THEN concat(' repeats filename ''FILE_', k - 2, '.PNG''. Filenames must be unique even when letter case differs.')
  WHEN 4 THEN ' is missing required values: net_contents, bottler.' ELSE ' must contain 7 values.' END) AS problem FROM ({_LISTED_ROWS}) WHERE c IN (1, 4, 7) OR c = 2 AND k - 2 IN (SELECT p_partkey FROM part)""")
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that a rule forbids, by its true number."""
    return manifest.scan(spark, _listing(spark, sf_dir, "true"))


@_query(f"""SELECT concat('file_', k, '.png') AS filename, CASE c WHEN 3 THEN concat(p_name, ' "x", y', chr(10), p_brand) WHEN 6 THEN concat(p_name, ' 5" tall') WHEN 8 THEN concat(p_name, ',', p_brand) ELSE p_name END AS brand_name,
  CASE WHEN c > 8 THEN concat('Product of ', p_size) END AS origin_country, CAST(sum(CASE c WHEN 0 THEN 2 ELSE 1 END) OVER (ORDER BY k) - 1 AS BIGINT) AS "order"
FROM (SELECT p_partkey AS k, p_partkey % 16 AS c, * FROM part WHERE p_partkey % 16 NOT IN (1, 2, 4, 7)) QUALIFY c <> 5""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a manifest without forbidden records, in their order."""
    return manifest.read(spark, _listing(spark, sf_dir, "k % 16 NOT IN (1, 2, 4, 7)")).select("filename", "brand_name", "origin_country", "order")


# ---- sources and layout ----


@_query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s[^>]*href="[^"]')) AS INTEGER) AS n_links FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.links_of(_table(spark, sf_dir, "pages")).select("page_id", F.size("hrefs").alias("n_links"))


@_query(r"""WITH seen AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->|<!DOCTYPE[^>]*>|<script.*?</script>|<style.*?</style>', '', 'gs'), '\s+', ' ', 'g') AS t FROM pages),
broken AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '</?(br|dd|div|dl|dt|h[1-6]|li|p|section|table|tr)(\s[^>]*)?>', chr(10), 'g'), '</?(td|th)(\s[^>]*)?>', ' ', 'g'), '</?[A-Za-z][^>]*>', '', 'g') AS t FROM seen),
lines AS (SELECT page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') AS ls FROM broken)
SELECT page_id, CAST(len(ls) AS INTEGER) AS n_lines, md5(array_to_string(ls, chr(10))) AS digest FROM lines""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = registry.lines_of(_table(spark, sf_dir, "pages"))
    return read.select("page_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


_FORM = """SELECT p_partkey AS page_id, concat('<form><input type=hidden name="t" value="', p_size, '"><INPUT NAME=box TYPE=checkbox', CASE p_partkey % 2 WHEN 0 THEN ' checked' ELSE '' END,
  '><input type="submit" name="go"><select name="s"><option>', p_type, '</option><option value="v&amp;w"', CASE p_partkey % 3 WHEN 0 THEN ' selected' ELSE '' END,
  '>x</option></select><textarea name="a">', p_brand, '</textarea><input name=off disabled><select name=open><option>y</form>') AS html FROM part"""


@_query("""SELECT * FROM (SELECT p_partkey AS page_id, unnest(['t', 'box', 's', 'a']) AS name, unnest([CAST(p_size AS VARCHAR), CASE p_partkey % 2 WHEN 0 THEN 'on' END, CASE p_partkey % 3 WHEN 0 THEN 'v&w' ELSE p_type END, p_brand]) AS value,
  unnest(['hidden', 'checkbox', 'select', 'textarea']) AS kind FROM part) WHERE value IS NOT NULL""")
def form_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    return registry.controls_of(spark.sql(_FORM)).select("page_id", "name", "value", "kind")


_FORMS = """SELECT p_partkey AS page_id, concat('<form name=login><input name=user value=me></form><input name=stray value=1>', CASE p_partkey % 4 WHEN 0 THEN '<form name="searchCriteriaForm" action="/a.do?x=1&amp;y=2" METHOD=POST>'
  WHEN 1 THEN '<form action="../publicSearchColasBasicProcess.do">' WHEN 2 THEN '<form name=other>' ELSE '<!-- <form name="searchCriteriaForm"> -->' END, '<input name="code" value="', p_size, '"><select name=kind multiple><option value>', p_type,
  '<option selected value=""> none <option selected> ', p_brand, ' <b>x</b> </select><textarea name=note disabled>n</textarea>', CASE p_partkey % 3 WHEN 0 THEN '</form>' ELSE '<form name=next method=get>' END, '<input name=after value=2></form>') AS html FROM part"""


@_query("""SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN 'post' ELSE 'get' END AS method, CASE p_partkey % 4 WHEN 0 THEN '/a.do?x=1&y=2' ELSE '../publicSearchColasBasicProcess.do' END AS action,
  CAST(unnest([0, 1, 2]) AS INTEGER) AS place, unnest(['code', 'kind', 'kind']) AS name, unnest([CAST(p_size AS VARCHAR), '', p_brand || ' x']) AS value, unnest(['text', 'select', 'select']) AS kind FROM part WHERE p_partkey % 4 < 2""")
def search_form_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search form alone would send, among other forms and controls outside of any."""
    synthetic.parts(spark, sf_dir)
    return registry.search_controls(spark.sql(_FORMS)).drop("html")


_LINKED = """SELECT p_partkey AS page_id, concat('<a href="viewColaDetails.do?ttbid=', lpad(p_partkey, 14, '1'), '&amp;x=1">d</a><a href=other.do>o</a><a href="viewColaDetails.do?ttbid=', lpad(p_partkey, 14, '1'), '">again</a><img src="',
  CASE p_partkey % 4 WHEN 0 THEN '../pub/' WHEN 1 THEN '/colas/pub/' WHEN 2 THEN '//registry.example/colas/pub/' ELSE 'https://other.example/colas/pub/' END, 'publicViewAttachment.do?filename=f', p_size, '&amp;filetype=l">') AS html FROM part"""


@_query("""SELECT p_partkey AS page_id, lpad(p_partkey, 14, '1') AS ids, CASE WHEN p_partkey % 4 < 3 THEN concat('https://registry.example/colas/pub/publicViewAttachment.do?filename=f', p_size, '&filetype=l') ELSE '' END AS urls FROM part""".replace("lpad(p_partkey", "lpad(CAST(p_partkey AS VARCHAR)"))
def registry_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    read = registry.links_of(spark.sql(_LINKED))
    urls = registry.attachment_urls(F.col("images"), "https://registry.example/colas/search/detail.do")
    return read.select("page_id", F.array_join(registry.ids(F.col("hrefs"), F.col("html")), ",").alias("ids"), F.array_join(urls, ",").alias("urls"))


_DETAIL = """SELECT p_partkey AS page_id, 'https://registry.example/detail' AS url, concat('<html><script>x</script><table><tr><td>Brand Name:</td><td>', CASE p_partkey % 5 WHEN 0 THEN '' ELSE p_name END,
  '</td></tr><tr><td>Class/Type Code: ', p_type, '</td></tr><tr><td>Origin Code:</td><td>', CASE p_partkey % 3 WHEN 0 THEN 'OREGON' ELSE 'ITALY' END,
  '</td></tr><tr><td>Plant Registry/Basic Permit/Brewers No (Principal Place of Business):</td></tr><tr><td>DSP-KY-', p_size, '</td></tr><tr><td>Maker ', p_brand, '</td></tr><tr><td>Town</td></tr><tr><td>Contact Information:</td></tr></table></html>') AS html FROM part"""


@_query("""SELECT p_partkey AS page_id, CASE p_partkey % 5 WHEN 0 THEN '' ELSE p_name END AS brand_name, p_type AS class_type, CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'ITALY' END AS origin_country,
  concat('Maker ', p_brand, ' / Town') AS bottler, p_partkey % 5 = 0 AS refused FROM part""")
def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    return registry.records(spark.sql(_DETAIL)).select("page_id", "brand_name", "class_type", "origin_country", "bottler", F.col("error").isNotNull().alias("refused"))


@_query("""SELECT count(*) FILTER (p_partkey % 5 <> 0) AS kept, count(*) FILTER (p_partkey % 5 = 0) AS skipped, count(*) FILTER (p_partkey % 5 <> 0 AND p_partkey % 3 <> 0) AS with_origin_country FROM part""")
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.parts(spark, sf_dir)
    return corpus.summary(registry.records(spark.sql(_DETAIL)))


@_query("""SELECT concat(p_partkey, '.jpg') AS filename, p_name AS brand_name, '' AS fanciful_name, p_type AS class_type, CASE p_partkey % 3 WHEN 0 THEN 'OREGON' ELSE 'ITALY' END AS origin_code, CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'ITALY' END AS origin_country,
  concat('Maker ', p_brand, ' / Town') AS bottler, 'https://registry.example/detail' AS source_url FROM part WHERE p_partkey % 5 <> 0""")
def registry_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of every usable record, written together with its manifest and read back."""
    synthetic.parts(spark, sf_dir)
    corpus.write_metadata(registry.records(spark.sql(_DETAIL)), folder := place(spark, "registry"))
    return corpus.read_metadata(spark, folder)[0]


#: Labels laid out as text blocks: the brand, tallest, in two blocks side by side, a second volume on some, the warning on two lines.
_PLACED = f"""
SELECT label_id, 0 AS position, split_part(brand_name, ' ', 1) AS text, 20 AS x, 20 AS y, 60 AS h FROM ({synthetic.LABELS})
UNION ALL SELECT label_id, 1, split_part(brand_name, ' ', 2), 220, 22 + label_id % 5, 60 FROM ({synthetic.LABELS})
UNION ALL SELECT label_id, 2, class_type, 20, 100, 20 FROM ({synthetic.LABELS})
UNION ALL SELECT label_id, 3, alcohol_content, 20, 160, 20 FROM ({synthetic.LABELS})
UNION ALL SELECT label_id, 4, concat(CASE label_id % 5 WHEN 0 THEN 'Net Contents: ' ELSE '' END, net_contents), 20, 220, 20 FROM ({synthetic.LABELS})
UNION ALL SELECT label_id, 5, '99 mL', 20, 260, 20 FROM ({synthetic.LABELS}) WHERE label_id % 7 = 0
UNION ALL SELECT label_id, 6, bottler, 20, 300 + label_id % 3, 20 FROM ({synthetic.LABELS})
UNION ALL SELECT label_id, 7, concat('Product of ', origin_country), 20, 400, 20 FROM ({synthetic.LABELS}) WHERE origin_country IS NOT NULL
UNION ALL SELECT label_id, 8, '{_FIRST}', 20, 460, 20 FROM ({synthetic.LABELS})
UNION ALL SELECT label_id, 9, '{_SECOND}', 20, 485, 20 FROM ({synthetic.LABELS})
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    synthetic.view(spark, sf_dir, "part")  # rows are short until a label's blocks are gathered, which deals them out
    corner = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
    box = F.array(corner(0, 0), corner(180, 0), corner(180, F.col("h")), corner(0, F.col("h")))
    return spark.sql(_PLACED).select("label_id", "position", "text", box.alias("bbox"), F.lit(0.9).alias("confidence"), F.lit(500.0).alias("width"), F.lit(600.0).alias("height"))


@_query(f"""WITH marked AS (SELECT *, CASE WHEN y < max(y + h) OVER (PARTITION BY label_id ORDER BY y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({_PLACED})),
islands AS (SELECT *, sum(new) OVER (PARTITION BY label_id ORDER BY y, x ROWS UNBOUNDED PRECEDING) - 1 AS line FROM marked)
SELECT label_id, CAST(line AS INTEGER) AS line, string_agg(text, ' ' ORDER BY x) AS text, CAST(min(x) AS DOUBLE) AS l, CAST(min(y) AS DOUBLE) AS t, CAST(max(x + 180) AS DOUBLE) AS r, CAST(max(y + h) AS DOUBLE) AS b, CAST(count(*) AS INTEGER) AS n_blocks FROM islands GROUP BY label_id, line""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.text_lines(_blocks(spark, sf_dir)).drop("confidence")


_CANDIDATES = f"""SELECT label_id, unnest(['brand_name', 'class_type', 'alcohol_content', 'net_contents', 'bottler', 'origin_country', 'government_warning']) AS field,
  unnest([brand_name, CASE WHEN class_type <> 'Hard Seltzer' THEN class_type END, alcohol_content, CASE WHEN label_id % 7 <> 0 OR label_id % 5 = 0 THEN net_contents END, bottler, 'Product of ' || origin_country, concat('{_FIRST}', chr(10), '{_SECOND}')]) AS value,
  unnest(['', '', '', CASE WHEN label_id % 7 = 0 AND label_id % 5 <> 0 THEN concat(net_contents, '|99 mL') ELSE '' END, '', '', '']) AS alternatives FROM ({synthetic.LABELS})"""


@_query(f"SELECT label_id, field, value, alternatives, CASE WHEN alternatives <> '' THEN 'AMBIGUOUS' WHEN value IS NULL THEN 'MISSING' ELSE 'FOUND' END AS state FROM ({_CANDIDATES})")
def field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.field_candidates(_blocks(spark, sf_dir), layout.SAID)
    return found.select("label_id", "field", "value", F.array_join("alternatives", "|").alias("alternatives"), "state")


_NOT_RUN = "list_filter([CASE WHEN c = 5 THEN 'Class or type' END, CASE WHEN c IN (2, 3) AND NOT twice THEN 'Container size — approved sizes' END, CASE WHEN o < 2 THEN 'Country of origin' END, 'Government warning bold text', 'Government warning type size'], lambda x: x IS NOT NULL)"


@_query(f"""WITH facts AS (SELECT label_id, label_id % 6 AS c, label_id % 5 AS n, label_id % 4 AS o, label_id % 7 = 0 AND label_id % 5 <> 0 AS twice FROM ({synthetic.LABELS})), said AS (SELECT *, {_NOT_RUN} AS undone FROM facts)
SELECT label_id, CASE WHEN o = 3 OR (NOT twice AND (n = 2 AND c IN (0, 1, 4) OR n = 3 AND c = 0)) THEN 'FAIL' WHEN c = 5 OR twice THEN 'REVIEW' ELSE 'PASS' END AS overall,
  concat(len(undone), ' checks could not be run — ', array_to_string(undone, '; ')) AS disclosure FROM said""")
def extracted_labels_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From blocks to verdicts: layout, candidates, rules, roll-up."""
    found = layout.evidence(layout.field_candidates(_blocks(spark, sf_dir), layout.SAID))
    applied = synthetic.labels(spark, sf_dir).select("label_id", *K.APPLICATION_FIELDS).join(found, "label_id")
    return rollup.rolled_up(rules.long_form(rules.evaluated(applied), "label_id", parts=("status",)), "label_id").select("label_id", "overall", "disclosure")


def _measured(pixels: str) -> str:
    """DuckDB: the statistics of images given as pixels(path, w, h, i, v), rows after each other."""
    tile = lambda at, n: f"list_sum([CASE WHEN {at} >= {n} // 4 * k + least(k, {n} % 4) THEN 1 ELSE 0 END FOR k IN [1, 2, 3]])"
    mirrored = lambda i, n: f"CASE WHEN {n} = 1 THEN 0 WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * {n} - 2 - ({i}) ELSE {i} END"
    at = lambda y, x: f"px[1 + ({mirrored(y, 'h')}) * w + ({mirrored(x, 'w')})]"
    return f"""WITH pixels AS ({pixels}), placed AS (SELECT *, i // w AS y, i % w AS x FROM pixels),
whole AS (SELECT path, list(v ORDER BY i) AS px FROM pixels GROUP BY path),
tiles AS (SELECT path, max(m) - min(m) AS spread FROM (SELECT path, median(v) AS m FROM placed GROUP BY path, {tile('y', 'h')}, {tile('x', 'w')}) GROUP BY path),
laplace AS (SELECT path, count(*) AS n, sum(d) AS s1, sum(d * d) AS s2 FROM (SELECT path, CAST({at('y - 1', 'x')} + {at('y + 1', 'x')} + {at('y', 'x - 1')} + {at('y', 'x + 1')} - 4 * v AS BIGINT) AS d FROM placed JOIN whole USING (path)) GROUP BY path),
measured AS (SELECT path, any_value(w) AS width, any_value(h) AS height, any_value((CAST(n AS DOUBLE) * s2 - CAST(s1 AS DOUBLE) * s1) / (CAST(n AS DOUBLE) * n)) AS blur_variance, quantile_cont(CAST(v AS DOUBLE), 0.99) - quantile_cont(CAST(v AS DOUBLE), 0.01) AS contrast_range,
  count(*) FILTER (v >= 250) / count(*) AS glare_fraction, any_value(spread) AS illumination_spread FROM placed JOIN laplace USING (path) JOIN tiles USING (path) GROUP BY path)
SELECT path, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, blur_variance, round(CAST(contrast_range AS DOUBLE), 6) AS contrast_range, CAST(glare_fraction AS DOUBLE) AS glare_fraction, CAST(illumination_spread AS DOUBLE) AS illumination_spread,
  blur_variance < 80 AS is_blurry, contrast_range < 80 OR illumination_spread > 40 OR glare_fraction BETWEEN 0.02 AND 0.45 AS needs_contrast, glare_fraction BETWEEN 0.02 AND 0.45 AS has_glare, least(width, height) < 736 AS needs_upscale, greatest(width, height) > 1400 AS needs_downscale,
  CAST(CASE WHEN greatest(width, height) > 1400 THEN 1400 / greatest(width, height) WHEN least(width, height) < 736 THEN least(2.0, 736 / least(width, height), 1400 / greatest(width, height)) ELSE 1 END AS DOUBLE) AS scale FROM measured"""


_HEX = "instr('0123456789abcdef', substring(x, CAST(2 * i + {} AS BIGINT), 1)) - 1"
_PIXEL = f"16 * ({_HEX.format(1)}) + {_HEX.format(2)}"


@_query(_measured(f"SELECT path, 16 AS w, 16 AS h, i, {_PIXEL} AS v FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path, {' || '.join(f"sha256(o_orderkey || '{i}')" for i in range(8))} AS x, unnest(range(256)) AS i FROM orders)"))
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey test images made from all orders, with the gates that they pass."""
    made = spread(_table(spark, sf_dir, "orders")).select(F.col("o_orderkey").cast("string").alias("path"), F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.concat(*(F.sha2(F.concat("o_orderkey", F.lit(i)), 256) for i in range(8)))).alias("data"))
    return images.quality(made).withColumn("contrast_range", F.round("contrast_range", 6))  # engines interpolate to within the last bit


_BYTE = "16 * (instr('0123456789ABCDEF', substring(x, CAST(6 * i + {0} AS BIGINT), 1)) - 1) + instr('0123456789ABCDEF', substring(x, CAST(6 * i + {0} + 1 AS BIGINT), 1)) - 1"


@_query(_measured(f"""SELECT path, 7 AS w, h, i, (1868 * ({_BYTE.format(1)}) + 9617 * ({_BYTE.format(3)}) + 4899 * ({_BYTE.format(5)}) + 8192) >> 14 AS v
FROM (SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS path, strlen(text) // 21 AS h, unnest(range(strlen(text) // 21 * 7)) AS i, hex(text) AS x FROM conversations)"""))
def text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of all turns seen as colour images of seven pixels across; what doesn't fill a row is left over."""
    data = F.col("text").cast("binary")
    made = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("path"), F.floor(F.octet_length("text") / 21).cast("int").alias("height"), F.lit(7).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    return images.quality(made).withColumn("contrast_range", F.round("contrast_range", 6))  # engines interpolate to within the last bit


_SIZED = "SELECT p_partkey AS image_id, p_partkey % 9 AS kind, CAST(1 + (p_partkey * 7919 + p_size) % 15000 AS BIGINT) AS width, CAST(1 + (p_partkey * 104729) % 12000 AS BIGINT) AS height FROM part"


def _headers() -> Column:
    """Header bytes for each kind of file."""
    big = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    little = lambda c, n: F.concat(*(F.substring(big(c, n), 2 * (n - k) - 1, 2) for k in range(n)))
    w, h = F.col("width"), F.col("height")
    said = lambda *parts: F.unhex(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    thumbnail = "FFE1000C" + "FFC000080101" + "0000" * 2  # a frame header inside a segment is none
    return (
        F.when(F.col("kind") == 0, said("89504E470D0A1A0A0000000D49484452", big(w, 4), big(h, 4), "0802000000"))
        .when(F.col("kind") == 1, said("FFD8FFE000104A46494600010100000100010000", thumbnail, "FFC20011", "08", big(h, 2), big(w, 2), "03011100"))
        .when(F.col("kind") == 2, said("474946383961", little(w, 2), little(h, 2), "F70000"))
        .when(F.col("kind") == 3, said("424D", "00" * 12, "28000000", little(w, 4), little(F.lit(2**32) - h, 4), "01001800"))
        .when(F.col("kind") == 4, said("52494646", "00" * 4, "57454250", "56503858", "0A000000", "00000000", little(w - 1, 3), little(h - 1, 3)))
        .when(F.col("kind") == 5, said("4D4D002A", "00000008", "0002", "01000003", "00000001", big(w, 2), "0000", "01010004", "00000001", big(h, 4)))
        .when(F.col("kind") == 6, said("89504E470D0A1A0A0000000D49484452", big(w, 4)))
        .when(F.col("kind") == 7, F.encode(F.lit("no image"), "UTF-8"))
    )


@_query(f"""SELECT image_id, CASE kind WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' WHEN 4 THEN 'webp' WHEN 5 THEN 'tiff' WHEN 6 THEN 'png' END AS format, CASE WHEN kind < 6 THEN width END AS width, CASE WHEN kind < 6 THEN height END AS height,
  CASE WHEN kind = 8 THEN '{images.NO_IMAGE}' WHEN kind > 5 THEN '{images.UNDECODABLE}' WHEN width * height > 80000000 THEN '{images.TOO_LARGE}' END AS error FROM ({_SIZED})""")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, size and error of files made from all parts, by their headers alone."""
    synthetic.parts(spark, sf_dir)
    found = images.guarded(spark.sql(_SIZED).select("image_id", "kind", _headers().alias("content")))
    seen = lambda c: F.when(F.col("kind") < 6, F.col(c)).alias(c)  # noqa: E731  a header that breaks off says half of its size
    return found.select("image_id", "format", seen("width"), seen("height"), "error")
