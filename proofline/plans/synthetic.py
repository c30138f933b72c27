"""Labels made up from the driver's tables by SQL that Spark and DuckDB read alike: applications, evidence, and what differs between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofline import constants as K
from proofline.storage import spread

CLASSES = ("Kentucky Straight Bourbon Whiskey", "Table Wine", "Lager Beer", "Barley Wine", "Port Finished Bourbon", "Hard Seltzer")
VOLUMES = {"750 mL": "750", "1 L": "1000", "701 mL": "701", "5 L": "5000", "25.4 fl oz": "751.167650", "25.36 fl oz": "749.984709", "750 ML": "750", "4.5 liters": "4500", "700 mL": "700"}

LABELS = f"""
SELECT p_partkey AS label_id,
  concat('label_', p_partkey, '.png') AS filename,
  p_name AS brand_name,
  CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN concat(upper(p_name), ' LLC') WHEN 2 THEN concat(p_name, ', Inc.')
    WHEN 3 THEN replace(p_name, ' ', '') WHEN 4 THEN 'zzzz qqqq' ELSE p_name END AS read_brand_name,
  CASE p_partkey % 6 WHEN 0 THEN '{CLASSES[0]}' WHEN 1 THEN '{CLASSES[1]}' WHEN 2 THEN '{CLASSES[2]}' WHEN 3 THEN '{CLASSES[3]}'
    WHEN 4 THEN '{CLASSES[4]}' ELSE '{CLASSES[5]}' END AS class_type,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'zzzz qqqq' ELSE CASE p_partkey % 6 WHEN 0 THEN upper('{CLASSES[0]}') WHEN 1 THEN '{CLASSES[1]}.'
    WHEN 2 THEN '{CLASSES[2]}' WHEN 3 THEN '{CLASSES[3]}' WHEN 4 THEN '{CLASSES[4]}' ELSE '{CLASSES[5]}' END END AS read_class_type,
  concat(5 + p_size % 46, '% Alc./Vol. (', 2 * (5 + p_size % 46), ' Proof)') AS alcohol_content,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat(5 + p_size % 46, '% Alc./Vol. (', 2 * (5 + p_size % 46), ' Proof)')
    WHEN 2 THEN concat(5 + p_size % 46, '.2% Alc by Vol') WHEN 3 THEN concat(6 + p_size % 46, '% ABV')
    WHEN 4 THEN concat(5 + p_size % 46, '% Alc./Vol. (', 2 * (5 + p_size % 46) + 5, ' Proof)')
    WHEN 5 THEN 'contains alcohol' ELSE concat(5 + p_size % 46, '.0% alc/vol') END AS read_alcohol_content,
  CASE p_partkey % 5 WHEN 0 THEN '750 mL' WHEN 1 THEN '1 L' WHEN 2 THEN '701 mL' WHEN 3 THEN '5 L' ELSE '25.4 fl oz' END AS net_contents,
  CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '25.36 fl oz' WHEN 2 THEN '750 ML' WHEN 3 THEN '12 floz' WHEN 4 THEN '4.5 liters' WHEN 5 THEN '700 mL'
    ELSE CASE p_partkey % 5 WHEN 0 THEN '750 mL' WHEN 1 THEN '1 L' WHEN 2 THEN '701 mL' WHEN 3 THEN '5 L' ELSE '25.4 fl oz' END END AS read_net_contents,
  concat('Bottled by Maker ', p_brand, ', Town ', p_size) AS bottler,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('PRODUCED AND BOTTLED BY MAKER ', upper(p_brand), ' TOWN ', p_size) WHEN 2 THEN 'qqqq zzzz'
    WHEN 3 THEN concat('Maker ', p_brand, ', Town ', p_size, ' USA') ELSE concat('Bottled by Maker ', p_brand, ', Town ', p_size) END AS read_bottler,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN 'France' ELSE 'Product of Italy' END AS origin_country,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PRODUCT OF FRANCE' WHEN 2 THEN 'Italy' WHEN 3 THEN 'Made in Spain' ELSE 'france' END AS read_origin_country,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 2 THEN replace('{K.WARNING}', 'GOVERNMENT WARNING', 'Government Warning') WHEN 3 THEN replace('{K.WARNING}', ' ', '')
    WHEN 4 THEN replace('{K.WARNING}', ' women', concat(chr(10), 'women')) ELSE '{K.WARNING}' END AS read_government_warning
FROM part
"""


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def parts(spark: SparkSession, sf_dir: str) -> None:
    """part as a view, its rows dealt out: what is made from a row takes far longer than reading it."""
    spread(spark.read.parquet(f"{sf_dir}/part.parquet")).createOrReplaceTempView("part")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts(spark, sf_dir)
    return spark.sql(LABELS)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


KEYWORDS = _values((name, k, len(k.split()), i) for i, (name, ks) in enumerate(K.BEVERAGE_KEYWORDS.items()) for k in ks)
SIZES = _values((name, s) for name, sizes in K.SIZES.items() for s in sizes)
NORMAL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"

#: DuckDB: every label's facts and the status of each check, said in SQL's own way.
CHECKED = f"""
WITH labels AS ({LABELS}),
volumes(said, ml) AS (VALUES {_values(VOLUMES.items())}),
sizes(cls, ml) AS (VALUES {SIZES}),
facts AS (
  SELECT l.*,
    CASE class_type WHEN '{CLASSES[0]}' THEN 'distilled_spirits' WHEN '{CLASSES[1]}' THEN 'wine' WHEN '{CLASSES[4]}' THEN 'wine' WHEN '{CLASSES[5]}' THEN NULL ELSE 'beer' END AS cls,
    TRY_CAST(regexp_extract(read_alcohol_content, '^([0-9.]+)%', 1) AS DECIMAL(12,3)) AS ax,
    TRY_CAST(regexp_extract(alcohol_content, '^([0-9.]+)%', 1) AS DECIMAL(12,3)) AS ay,
    TRY_CAST(regexp_extract(read_alcohol_content, '([0-9]+) Proof', 1) AS DECIMAL(12,3)) AS px,
    CAST(vx.ml AS DECIMAL(18,6)) AS mx, CAST(vy.ml AS DECIMAL(18,6)) AS my,
    read_net_contents LIKE '%oz' AS ox, net_contents LIKE '%oz' AS oy,
    {NORMAL.format("read_bottler")} AS bx, {NORMAL.format("bottler")} AS b_y
  FROM labels l LEFT JOIN volumes vx ON vx.said = read_net_contents LEFT JOIN volumes vy ON vy.said = net_contents
),
sized AS (
  SELECT f.*,
    EXISTS (SELECT 1 FROM sizes s WHERE s.cls = f.cls AND CASE WHEN ox THEN abs(s.ml - mx) <= 1.478676 ELSE s.ml = mx END) OR (cls = 'wine' AND NOT ox AND mx >= 4000 AND mx % 1000 = 0) AS fits,
    EXISTS (SELECT 1 FROM sizes s WHERE s.cls = f.cls AND CASE WHEN oy THEN abs(s.ml - my) <= 1.478676 ELSE s.ml = my END) OR (cls = 'wine' AND NOT oy AND my >= 4000 AND my % 1000 = 0) AS wanted_fits
  FROM facts f
),
wide AS (
  SELECT label_id, filename,
    CASE WHEN read_brand_name IS NULL THEN 'NOT_EVALUATED' WHEN read_brand_name = 'zzzz qqqq' THEN 'FAIL' ELSE 'PASS' END AS brand_name,
    CASE WHEN read_class_type IS NULL THEN 'NOT_EVALUATED' WHEN {NORMAL.format("read_class_type")} = {NORMAL.format("class_type")} THEN 'PASS' ELSE 'FAIL' END AS class_type,
    CASE WHEN read_alcohol_content IS NULL THEN 'NOT_EVALUATED' WHEN ax IS NULL OR cls IS NULL THEN 'REVIEW' WHEN px IS NOT NULL AND abs(px - 2 * ax) > 0.6 THEN 'FAIL'
      WHEN abs(ax - ay) <= CASE cls WHEN 'wine' THEN CASE WHEN ay > 14 THEN 1.0 ELSE 1.5 END ELSE 0.3 END THEN 'PASS' ELSE 'FAIL' END AS alcohol_content,
    CASE WHEN read_net_contents IS NULL THEN 'NOT_EVALUATED' WHEN mx IS NULL THEN 'REVIEW' WHEN abs(mx - my) <= CASE WHEN ox <> oy THEN 0.05 ELSE 0 END THEN 'PASS' ELSE 'FAIL' END AS net_contents,
    CASE WHEN read_net_contents IS NULL OR cls = 'beer' THEN 'NOT_EVALUATED' WHEN cls IS NULL OR mx IS NULL THEN 'REVIEW' WHEN fits THEN 'PASS' WHEN wanted_fits AND my <> mx THEN 'REVIEW' ELSE 'FAIL' END AS net_contents_standard_of_fill,
    CASE WHEN bx IS NULL THEN 'NOT_EVALUATED' WHEN regexp_replace(bx, '^(produced and )?bottled by ', '') = regexp_replace(b_y, '^bottled by ', '') THEN 'PASS'
      WHEN starts_with(bx, regexp_replace(b_y, '^bottled by ', '') || ' ') THEN 'REVIEW' ELSE 'FAIL' END AS bottler,
    CASE WHEN origin_country IS NULL OR origin_country = 'N/A' OR read_origin_country IS NULL THEN 'NOT_EVALUATED'
      WHEN regexp_replace(lower(read_origin_country), '^(product of|made in) ', '') = regexp_replace(lower(origin_country), '^product of ', '') THEN 'PASS' ELSE 'FAIL' END AS origin_country,
    CASE WHEN read_government_warning IS NULL THEN 'FAIL' WHEN regexp_replace(read_government_warning, '\\s+', ' ', 'g') = '{K.WARNING}' THEN 'PASS'
      WHEN read_government_warning = replace('{K.WARNING}', ' ', '') THEN 'REVIEW' ELSE 'FAIL' END AS government_warning,
    CASE WHEN read_government_warning IS NULL THEN 'NOT_EVALUATED' WHEN starts_with(read_government_warning, '{K.WARNING_PREFIX}') THEN 'PASS'
      WHEN starts_with(read_government_warning, 'GOVERNMENTWARNING:') THEN 'FAIL' ELSE 'FAIL' END AS government_warning_prefix,
    'NOT_EVALUATED' AS government_warning_bold, 'NOT_EVALUATED' AS government_warning_type_size
  FROM sized
),
checks AS (UNPIVOT wide ON {", ".join(K.CHECKS)} INTO NAME "check" VALUE status)
"""


def lcs(pairs: str) -> str:
    """DuckDB: CTEs that end in lcs(id, n), the length of the longest common subsequence of a and b of each of the pairs (id, a, b)."""
    return f"""pairs AS ({pairs}),
walked AS (
  SELECT id, a, b, 0 AS i, list_transform(range(length(a) + 1), lambda k: 0) AS reach FROM pairs
  UNION ALL
  SELECT id, a, b, i + 1, list_transform(range(length(a) + 1), lambda j: list_max(maybe[1:j + 1])) FROM (
    SELECT *, list_transform(range(length(a) + 1), lambda k: greatest(reach[k + 1], CASE WHEN k > 0 AND substring(a, k, 1) = substring(b, i + 1, 1) THEN reach[k] + 1 ELSE 0 END)) AS maybe FROM walked WHERE i < length(b))
),
lcs AS (SELECT id, reach[-1] AS n FROM walked WHERE i = length(b))"""


def sorted_words(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')), ' ')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def differences(texts: str, key: str) -> str:
    """DuckDB: how the words of texts (key, t) differ from the statutory warning, found range by range: the longest block, then both sides of it."""
    tokens = "regexp_extract_all({}, '[A-Za-z0-9]+|[^\\pL\\pN_\\s]')"
    best = "list_sort(list_transform(list_filter(ends, lambda e: e.i >= al AND e.i < ah AND e.j >= bl AND e.j < bh), lambda e: {'n': least(e.n, e.i - al + 1, e.j - bl + 1), 'i': -e.i, 'j': -e.j}), 'DESC')[1]"
    return f"""WITH RECURSIVE texts AS ({texts}), a AS (SELECT {tokens.format(_text(K.WARNING))} AS ws), b AS (SELECT {key} AS id, t, {tokens.format("t")} AS ws FROM texts),
pairs AS (SELECT id, i, j FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i FROM a) JOIN (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM b) USING (w)),
runs AS (SELECT id, i, j, row_number() OVER (PARTITION BY id, i - j, island ORDER BY i) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS island FROM pairs)),
ended AS (SELECT id, list({{'i': i, 'j': j, 'n': n}}) AS ends FROM runs GROUP BY id),
walked AS (
  SELECT id, al, ah, bl, bh, {best} AS m FROM (SELECT id, CAST(0 AS BIGINT) AS al, CAST(len(a.ws) AS BIGINT) AS ah, CAST(0 AS BIGINT) AS bl, CAST(len(b.ws) AS BIGINT) AS bh FROM b, a) JOIN ended USING (id)
  UNION ALL
  SELECT id, al, ah, bl, bh, {best} FROM (SELECT id, unnest([{{'al': al, 'ah': 1 - m.i - m.n, 'bl': bl, 'bh': 1 - m.j - m.n}}, {{'al': 1 - m.i, 'ah': ah, 'bl': 1 - m.j, 'bh': bh}}], recursive := true) FROM walked WHERE m IS NOT NULL) JOIN ended USING (id) WHERE al < ah AND bl < bh
),
blocks AS (SELECT id, 1 - m.i - m.n AS i, 1 - m.j - m.n AS j, m.n AS n FROM walked WHERE m IS NOT NULL UNION ALL SELECT id, len(a.ws), len(b.ws), 0 FROM b, a),
gaps AS (SELECT id, i, j, coalesce(lag(i + n) OVER w, 0) AS pi, coalesce(lag(j + n) OVER w, 0) AS pj FROM blocks WINDOW w AS (PARTITION BY id ORDER BY i, j)),
told AS (SELECT id, i, j, array_to_string(a.ws[pi + 1:i], ' ') AS old, array_to_string(b.ws[pj + 1:j], ' ') AS new, i > pi AS less, j > pj AS more FROM gaps JOIN b USING (id), a),
said AS (SELECT id, string_agg(CASE WHEN less AND more THEN concat('replace expected [', old, '] with extracted [', new, ']') WHEN less THEN concat('missing expected [', old, ']') WHEN more THEN concat('unexpected extracted [', new, ']') END, '; ' ORDER BY i, j) AS difference FROM told GROUP BY id)
SELECT id, CASE WHEN t = {_text(K.WARNING)} THEN '' ELSE coalesce(difference, '') END AS difference FROM b JOIN said USING (id)"""


PLAIN = "regexp_replace(regexp_replace(CAST({} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
EXACT = {**VOLUMES, "25.4 fl oz": "751.1676508875", "25.36 fl oz": "749.9847097050"}
_CFR = "CASE WHEN cls = 'distilled_spirits' THEN '27 CFR 5.203(a)' WHEN {0} >= 4000 AND {0} % 1000 = 0 THEN '27 CFR 4.72(b)' ELSE '27 CFR 4.72(a)' END"
_RATIO = "200.0 * {0}.n / (length({1}) + length({2}))"


def _says(check: str, kinds: dict[str, str], status: str) -> str:
    """What a check says by its status."""
    return f"CASE {status} " + " ".join(f"WHEN '{s}' THEN {_text(K.SAYS[f'{check}_{k}'])}" for s, k in kinds.items()) + " END"


def _details() -> str:
    adv = f"CASE WHEN cls = 'wine' AND ax < 7 THEN {_text(K.SAYS['advisory'])} ELSE '' END"
    tolerance = "CASE cls WHEN 'wine' THEN CASE WHEN ay > 14 THEN '1' ELSE '1.5' END ELSE '0.3' END"
    exact = {K.PASS: "100", K.FAIL: "0"}
    scored = lambda status, more=None: f"CASE {status} " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in (exact | (more or {})).items()) + " END"
    fuzzy = {K.NOT_EVALUATED: "missing", K.PASS: "pass", K.REVIEW: "review", K.FAIL: "fail"}
    alcohol = f"""CASE WHEN read_alcohol_content IS NULL THEN {_text(K.SAYS["alcohol_missing"])}
      WHEN ax IS NULL THEN 'Alcohol content could not be parsed unambiguously: ABV marker is present without a valid numeric declaration.' WHEN cls IS NULL THEN {_text(K.SAYS["alcohol_class"])}
      WHEN px IS NOT NULL AND abs(px - 2 * ax) > 0.6 THEN concat('Stated proof ', {PLAIN.format("px")}, ' is inconsistent with ABV; expected proof ', {PLAIN.format("(2 * ax)")}, '.', {adv})
      ELSE concat('ABV differs by ', {PLAIN.format("abs(ax - ay)")}, ' percentage points, ', CASE w.alcohol_content WHEN 'PASS' THEN 'within' ELSE 'beyond' END, ' the CFR tolerance of ', {tolerance}, ' for this beverage class', CASE w.alcohol_content WHEN 'PASS' THEN '; any stated proof is consistent.' ELSE '.' END, {adv}) END"""
    unit = "unsupported net-contents unit: ''floz''."
    net = f"""CASE w.net_contents WHEN 'NOT_EVALUATED' THEN {_text(K.SAYS["net_missing"])} WHEN 'REVIEW' THEN 'Net contents could not be parsed unambiguously: {unit}'
      WHEN 'PASS' THEN concat('Net contents match after unit conversion (', {PLAIN.format("vx")}, ' mL).') ELSE concat('Net contents differ by ', {PLAIN.format("abs(vx - vy)")}, ' mL after unit conversion.') END"""
    size, wanted = "CASE WHEN ox THEN near ELSE vx END", "CASE WHEN oy THEN wanted_near ELSE vy END"
    fill = f"""CASE WHEN read_net_contents IS NULL THEN {_text(K.SAYS["fill_missing"])} WHEN cls = 'beer' THEN {_text(K.SAYS["fill_beer"])} WHEN cls IS NULL THEN {_text(K.SAYS["fill_class"])}
      WHEN vx IS NULL THEN 'Net contents could not be parsed unambiguously for the standards-of-fill check: {unit}'
      WHEN fits THEN concat('Container size resolves to the authorized ', {PLAIN.format(f"({size})")}, ' mL size under ', {_CFR.format(f"({size})")}, '.')
      WHEN wanted_fits AND vy <> vx THEN concat('The label read ', {PLAIN.format("vx")}, ' mL, which is not an authorized size, while the application value resolves to the authorized ', {PLAIN.format("vy")}, ' mL size under ', {_CFR.format(f"({wanted})")}, '. This is probably an OCR misread; agent review is required.')
      ELSE concat('Container size ', {PLAIN.format("vx")}, ' mL is not authorized. The nearest authorized size is ', {PLAIN.format("near")}, ' mL under ', {_CFR.format("near")}, '.') END"""
    foreign = "(s.origin_country IS NOT NULL AND s.origin_country <> 'N/A')"
    origin = f"""CASE WHEN NOT {foreign} AND read_origin_country IS NOT NULL THEN {_text(K.SAYS["origin_noted"])} WHEN NOT {foreign} THEN {_text(K.SAYS["origin_domestic"])} WHEN read_origin_country IS NULL THEN {_text(K.SAYS["origin_missing"])}
      ELSE {_says("origin", {K.PASS: "pass", K.FAIL: "fail"}, "w.origin_country")} END"""
    cased = "replace expected [GOVERNMENT WARNING] with extracted [Government Warning]"
    warning = f"""CASE w.government_warning WHEN 'PASS' THEN {_text(K.SAYS["warning_pass"])} WHEN 'REVIEW' THEN {_text(K.SAYS["warning_spaces"])}
      ELSE CASE WHEN read_government_warning IS NULL THEN {_text(K.SAYS["warning_missing"])} ELSE 'Government warning deviation: {cased}.' END END"""
    joined = "starts_with(read_government_warning, 'GOVERNMENTWARNING')"
    prefix = f"""CASE w.government_warning_prefix WHEN 'PASS' THEN {_text(K.SAYS["prefix_pass"])} WHEN 'NOT_EVALUATED' THEN {_text(K.SAYS["prefix_missing"])}
      ELSE CASE WHEN {joined} THEN 'Government warning prefix deviation: replace expected [GOVERNMENT WARNING] with extracted [GOVERNMENTWARNING]; unexpected extracted [(].' ELSE 'Government warning prefix deviation: {cased}.' END END"""
    none = "CAST(NULL AS VARCHAR)"
    rows = {
        "brand_name": ("s.brand_name", "read_brand_name", scored("w.brand_name", {K.FAIL: _RATIO.format("b", "brand_a", "brand_b")}), _says("brand", fuzzy, "w.brand_name")),
        "class_type": ("s.class_type", "read_class_type", scored("w.class_type", {K.FAIL: _RATIO.format("c", "class_a", "class_b")}), _says("class", fuzzy, "w.class_type")),
        "alcohol_content": ("s.alcohol_content", "read_alcohol_content", scored("w.alcohol_content"), alcohol),
        "net_contents": ("s.net_contents", "read_net_contents", scored("w.net_contents"), net),
        "net_contents_standard_of_fill": ("s.net_contents", "read_net_contents", scored("w.net_contents_standard_of_fill"), fill),
        "bottler": ("s.bottler", "read_bottler", scored("w.bottler", {s: _RATIO.format("m", "maker_a", "maker_b") for s in (K.REVIEW, K.FAIL)}), _says("bottler", fuzzy, "w.bottler")),
        "origin_country": ("s.origin_country", "read_origin_country", scored("w.origin_country"), origin),
        "government_warning": (_text(K.WARNING), "read_government_warning", "CASE WHEN read_government_warning IS NOT NULL THEN " + scored("w.government_warning") + " END", warning),
        "government_warning_prefix": (_text(K.WARNING_PREFIX), f"substring(read_government_warning, 1, {len(K.WARNING_PREFIX)})", scored("w.government_warning_prefix"), prefix),
        "government_warning_bold": (_text(K.BOLD_EXPECTED), none, "NULL", _text(K.SAYS["bold"])),
        "government_warning_type_size": (_text(K.TYPE_SIZE_EXPECTED), none, "NULL", _text(K.SAYS["type_size"])),
    }
    return ", ".join(f"""{{'position': {i}, 'check': '{c}', 'status': w.{c}, 'expected': {e}, 'extracted': {x}, 'confidence': CAST({score} AS DOUBLE), 'detail': {d}}}""" for i, (c, (e, x, score, d)) in enumerate(rows.items()))


_MAKER = "regexp_replace({}, '^(produced and )?bottled by ', '')"

#: DuckDB: all that each check says of each label: details(label_id, filename, position, check, status, expected, extracted, confidence, detail).
DETAILED = f"""{CHECKED.replace("WITH labels", "WITH RECURSIVE labels", 1)},
exact(said, v) AS (VALUES {_values(EXACT.items())}),
compared AS (SELECT label_id, {sorted_words(NORMAL.format("read_brand_name"))} AS brand_a, {sorted_words(NORMAL.format("brand_name"))} AS brand_b, {sorted_words(NORMAL.format("read_class_type"))} AS class_a, {sorted_words(NORMAL.format("class_type"))} AS class_b,
  {sorted_words(_MAKER.format("bx"))} AS maker_a, {sorted_words(_MAKER.format("b_y"))} AS maker_b FROM sized),
{lcs("SELECT 3 * label_id AS id, brand_a AS a, brand_b AS b FROM compared UNION ALL SELECT 3 * label_id + 1, class_a, class_b FROM compared UNION ALL SELECT 3 * label_id + 2, maker_a, maker_b FROM compared")},
asked AS (SELECT label_id, cls, CAST(ex.v AS DECIMAL(28,10)) AS vx, CAST(ey.v AS DECIMAL(28,10)) AS vy FROM sized LEFT JOIN exact ex ON ex.said = read_net_contents LEFT JOIN exact ey ON ey.said = net_contents),
offered AS (SELECT label_id, vx, vy, CAST(ml AS DECIMAL(28,10)) AS ml FROM asked JOIN sizes USING (cls)
  UNION ALL SELECT label_id, vx, vy, CAST(4000 + 1000 * greatest(0, k) AS DECIMAL(28,10)) FROM (SELECT *, unnest([floor((vx - 4000) / 1000), floor((vx - 4000) / 1000) + 1, floor((vy - 4000) / 1000), floor((vy - 4000) / 1000) + 1]) AS k FROM asked WHERE cls = 'wine') WHERE k IS NOT NULL),
nearest AS (SELECT label_id, arg_min(ml, {{'d': abs(ml - vx), 'ml': ml}}) FILTER (vx IS NOT NULL) AS near, arg_min(ml, {{'d': abs(ml - vy), 'ml': ml}}) AS wanted_near FROM offered GROUP BY label_id),
details AS (SELECT label_id, filename, unnest([{_details()}], recursive := true)
  FROM wide w JOIN (SELECT * EXCLUDE (filename) FROM sized) s USING (label_id) JOIN (SELECT label_id, vx, vy FROM asked) a USING (label_id) JOIN compared USING (label_id) LEFT JOIN nearest USING (label_id)
  LEFT JOIN lcs b ON b.id = 3 * label_id LEFT JOIN lcs c ON c.id = 3 * label_id + 1 LEFT JOIN lcs m ON m.id = 3 * label_id + 2)
"""
