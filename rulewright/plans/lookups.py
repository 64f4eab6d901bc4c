"""Registered queries from the texts of rules to what holds at an address, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import headings, laws, lookup, similar
from ..sources.readers import table
from . import queries as base
from .queries import query

# Rules of the lookup: id, level, jurisdiction, presumption, category, own coverage, citation, base, confidence, stage, effective, text on other law.
_TEXTS = [
    ("T1", "state", "S3", False, "rent", True, "Code § 1(a)", "Code § 1", 0.9, "enacted", date(1996, 1, 1), None),
    ("T2", "state", "S3", False, "rent", True, "Code § 1(b)", "Code § 1", 0.8, "enacted", date(1996, 1, 1), "This act does not apply to units under local rent control."),
    ("T3", "state", "S3", False, "fees", False, "Code § 4", "Code § 4", None, "enacted", date(1997, 1, 1), None),
    ("T4", "state", "S3", False, "rent", True, "Code § 1(c)", "Code § 1", 0.5, "enacted", date(1997, 7, 1), None),
    ("T5", "state", "S3", True, "evict", True, "Code § 5", "Code § 5", 0.6, "enacted", date(1995, 1, 1), "A city may not adopt an eviction ordinance."),
    ("C1", "city", "N3, S3", False, "rent", True, "City Code ch. 7", "City Code ch. 7", 0.95, "enacted", date(1995, 6, 1), None),
    ("C2", "city", "N3, S3", False, "evict", True, "City Code ch. 8", "City Code ch. 8", 0.7, "enacted", date(1999, 1, 1), None),
    ("C3", "city", "N3, S3", False, "rent", True, "City Code ch. 9", "City Code ch. 9", 0.4, "enacted", date(1995, 6, 1), None),
]
_TEXT = "rule_id string, level string, jurisdiction string, presume boolean, category string, own boolean, citation string, base string, confidence double, stage string, effective date, interaction string"
_ITEMS = [
    ("T1", 1, "exempts", "other_law", "Units under the city rent ordinance."), ("T3", 1, "covers", "other_law", "Units subject to the City Rent Ordinance."),
    ("T4", 1, "exempts", "other_law", "Units are also covered even if under the city rent ordinance."), ("T5", 1, "covers", "building", "Rent paid in the city."),
]
_LAWS = [("city_rent", r"(?i)\bcity rent ordinance\b", ["city", "rent", "ordinance"], "N3, S3", None, r"^City Code ch\. 7", "rent"), ("other_rent", r"(?i)\bcity rent ordinance\b", ["city", "rent", "ordinance"], "N4, S4", None, None, None)]
_LEAVES = [
    ("T1", "covers", "units", ">=", 5), ("T1", "covers", "year_built", "<", 1980), ("T2", "covers", "units", ">", 0), ("T4", "covers", "year_built", "<", 1990),
    ("T5", "covers", "units", ">=", 2), ("T5", "exempts", "flag_affordable", "==", 1), ("C1", "covers", "units", ">=", 2), ("C2", "covers", "year_built", "<", 1995), ("C3", "covers", "flag_affordable", "==", 1),
]
_CATEGORIES = ("rent", "evict", "fees")
_DAY = date(1998, 6, 30)


def _rules(spark):
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(_TEXTS)], "rule_ord int, " + _TEXT)
    gaps = {"enacted": F.date_sub("effective", 400), "sunset": F.lit(None).cast("date"), "disposition": F.lit("accepted"), "overrides": F.array().cast("array<string>"), "attested": F.lit(False), "conflict_note": F.lit(None).cast("string")}
    return laws.marked(rules.withColumns(gaps)).cache()  # a row per rule, read by every step below


def _edges(spark, rules):
    items = spark.createDataFrame(_ITEMS, "rule_id string, item int, kind string, scope string, text string")
    return laws.edges(rules, items, spark.createDataFrame(_LAWS, "law string, pattern string, words array<string>, place string, level string, citation string, category string")).cache()


def _inputs(spark, d):
    rows = base.addresses(spark, d)
    state, city = F.concat(F.lit("S"), "state"), F.concat(F.lit("N"), "city", F.lit(", S"), "state")
    levels = rows.select("address", F.explode(F.array(F.struct(F.lit("state").alias("level"), state.alias("jurisdiction")), F.struct(F.lit("city").alias("level"), city.alias("jurisdiction")))).alias("x")).select("address", "x.*").where("jurisdiction is not null")
    _, facts, _, _ = base.coverage_inputs(spark, d)
    leaves = spark.createDataFrame([(r, 1, kind, 1, fact, op, value, False) for r, kind, fact, op, value in _LEAVES], "rule_id string, item int, kind string, conj int, fact string, op string, value long, negated boolean")
    rules = _rules(spark)
    return levels, facts, rules, leaves, _edges(spark, rules), rows.where("city is null").select("address"), F.lit(_DAY)


def _tri(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 2 WHEN NOT ({condition}) THEN 0 ELSE 1 END"


_ASKED = {"units >= 5": "CASE WHEN known AND lo >= 5 THEN true WHEN known AND hi < 5 THEN false END", "units > 0": "CASE WHEN known AND lo > 0 THEN true WHEN known AND hi <= 0 THEN false END", "units >= 2": "CASE WHEN known AND lo >= 2 THEN true WHEN known AND hi < 2 THEN false END", "flag_affordable == 1": "flag = 1"}
_LEAF_SQL = " UNION ALL ".join(
    f"SELECT address, '{r}' AS rule_id, '{kind}' AS kind, '{fact}' AS fact, {'CASE WHEN flag = 1 THEN 2 ELSE 0 END' if (r, kind) == ('T5', 'exempts') else _tri(_ASKED.get(f'{fact} {op} {value}', f'yr {op} {value}'))} AS r, "
    f"{'known AND hi IS DISTINCT FROM lo' if fact == 'units' else 'false'} AS ranged, {'flag IS NULL' if (r, kind) == ('T5', 'exempts') else 'false'} AS presumed FROM facts WHERE {'state = 3' if r[0] == 'T' else 'city = 3'}"
    for r, kind, fact, op, value in _LEAVES
)
_ENTRY_SQL = f"""facts AS (SELECT c_custkey AS address, CASE WHEN c_custkey % 50 <> 0 THEN c_nationkey END AS city, n_regionkey AS state, {base._UNITS_LO} AS lo, {base._UNITS_HI} AS hi, c_custkey % 4 <> 3 AS known, {base._YEAR} AS yr, {base._FLAG} AS flag
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
rules AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r[0]}', '{r[1]}', '{r[4]}', {str(r[5]).lower()}, '{r[7]}', {'NULL' if r[8] is None else r[8]}::double, DATE '{r[10]}')" for i, r in enumerate(_TEXTS))}) v(rule_ord, rule_id, level, category, own, base, confidence, effective)),
leaf AS ({_LEAF_SQL}),
sides AS (SELECT address, rule_id, coalesce(min(r) FILTER (WHERE kind = 'covers'), 2) AS c, coalesce(max(r) FILTER (WHERE kind = 'exempts'), 0) AS e, bool_or(ranged) AS ranged, bool_or(presumed) AS presumed FROM leaf GROUP BY 1, 2),
verdict AS (SELECT *, CASE WHEN c = 0 THEN 'not_covered' WHEN e = 2 THEN 'exempt' WHEN c = 2 AND e = 0 THEN 'covered' ELSE 'unknown' END AS verdict FROM sides),
because AS (SELECT address, rule_id, string_agg(DISTINCT fact, ',' ORDER BY fact) AS because, CASE WHEN any_value(verdict) = 'unknown' THEN count(*) ELSE 0 END AS n_missing FROM leaf JOIN verdict USING (address, rule_id)
  WHERE CASE verdict WHEN 'not_covered' THEN kind = 'covers' AND r = 0 WHEN 'exempt' THEN kind = 'exempts' AND r = 2 WHEN 'covered' THEN kind = 'covers' AND r = 2 ELSE r = 1 END GROUP BY 1, 2),
f AS (SELECT address, city IS NULL AS fallback, rules.*, CASE WHEN effective > DATE '{_DAY}' THEN 'not_yet_effective' ELSE 'in_force' END AS status, coalesce(verdict, 'covered') AS verdict, because, coalesce(n_missing, 0) AS n_missing,
  round(CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0::double ELSE confidence END * CASE WHEN ranged THEN 0.9::double ELSE 1 END * CASE WHEN presumed AND verdict IN ('covered', 'not_covered') THEN 0.9::double ELSE 1 END * CASE WHEN city IS NULL THEN 0.85::double ELSE 1 END, 3) AS sure
  FROM facts JOIN rules ON CASE WHEN level = 'state' THEN state = 3 ELSE city = 3 END LEFT JOIN verdict USING (address, rule_id) LEFT JOIN because USING (address, rule_id)),
{base._passes({"T1": ["C1"]}, {"T3": ["C1"]}, {"T2": ["C1", "C3"]}, [("C2", "T5")])}"""


@query(f"""WITH {_ENTRY_SQL} SELECT address, rule_id, result, superseded_by, basis, list_aggregate(list_sort(may), 'string_agg', ',') AS may_yield_to, conflict, category, level, status, verdict, n_missing, because, sure AS confidence, sure < 0.5 AS needs_review,
  row_number() OVER (PARTITION BY address ORDER BY CASE category WHEN 'rent' THEN 1 WHEN 'evict' THEN 2 ELSE 3 END, level <> 'city', rule_id) AS place FROM p6""")
def address_lookup(spark, d):
    """From coverage to result: levels, facts and the edges that the rules' texts give."""
    found = lookup.lookup(*_inputs(spark, d), _CATEGORIES)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ",")).alias(c)
    return found.select("address", "rule_id", "result", "superseded_by", "basis", joined("may_yield_to"), "conflict", "category", "level", "status", "verdict", "n_missing", joined("because"), "confidence", "needs_review", "place")


_CHANGED = " UNION ALL ".join(
    f"SELECT n.address, n.rule_id, {i + 3}, '{step}', n.result, n.superseded_by FROM p{i} n JOIN p{i - 1} o USING (address, rule_id) WHERE n.result IS DISTINCT FROM o.result OR n.superseded_by IS DISTINCT FROM o.superseded_by"
    for i, step in enumerate(("other_law", "depends", "yields", "retarget", "same_law"), 1)
)


@query(f"""WITH {_ENTRY_SQL}, s AS (SELECT address, rule_id, 1 AS k, 'status' AS step, status AS result, NULL AS "by" FROM f UNION ALL SELECT address, rule_id, 2, 'coverage', verdict, because FROM f UNION ALL SELECT address, rule_id, 3, 'base', result, NULL FROM p0
  UNION ALL {_CHANGED} UNION ALL SELECT address, rule_id, 99, 'confidence', CASE WHEN sure < 0.5 THEN 'review' ELSE 'enough' END, NULL FROM f)
  SELECT address, rule_id, row_number() OVER (PARTITION BY address, rule_id ORDER BY k) AS n, step, result, "by" FROM s""")
def lookup_explained(spark, d):
    """Which fact, edge and pass led to each result."""
    return lookup.explain(*_inputs(spark, d))


@query("""WITH law AS (SELECT item_id, regexp_extract_all(substring(text, 1, 60), '[A-Za-zÀ-ÿ]+') AS w FROM benchmark), p AS (SELECT item_id, w[2] || ' ' || w[3] AS named FROM law WHERE len(w) >= 4)
  SELECT doc_id, item_id FROM documents JOIN p ON regexp_matches(lower(regexp_replace(text, '\\s+', ' ', 'g')), '(^|[^a-zà-ÿ])' || lower(named) || '($|[^a-zà-ÿ])')""")
def laws_named(spark, d):
    """Every document against a name of two words per benchmark item, in any case and spacing."""
    w = F.regexp_extract_all(F.substring("text", 1, 60), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))
    names = table(spark, d, "benchmark").select("item_id", w.alias("w")).where("size(w) >= 4").select("item_id", F.transform(F.slice("w", 2, 2), F.lower).alias("words"))
    form = F.concat(F.lit(r"(?iu)(?<![a-zà-ÿ])"), F.array_join("words", r"\s+"), F.lit("(?![a-zà-ÿ])"))
    patterns = names.select(F.col("item_id").alias("law"), form.alias("pattern"), "words", F.array_join("words", " ").alias("holds"), F.lit(None).cast("string").alias("place"))
    texts = table(spark, d, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("place"))
    return laws.named(texts, patterns, ["doc_id"], None).select("doc_id", F.col("law").alias("item_id"))


_FLAGS = [("F1", "3", None, None, "open: nation 3"), ("F2", None, "BUILDING", None, "open: buildings"), ("F3", "3", "BUILDING", None, "open: nation 3"), ("F4", None, "MACHINERY", "held", "open: held machines")]


@query("""WITH r AS (SELECT c_custkey AS rule_id, c_nationkey AS j, c_mktsegment AS c, CASE c_custkey % 3 WHEN 0 THEN 'held' WHEN 1 THEN 'accepted' ELSE 'merged' END AS s, CASE WHEN c_custkey % 5 = 0 THEN 'open: buildings' END AS note FROM customer),
  h AS (SELECT *, CASE WHEN s <> 'merged' THEN concat_ws('; ', CASE WHEN j = 3 THEN 'open: nation 3' END, CASE WHEN c = 'BUILDING' AND note IS NULL THEN 'open: buildings' END, CASE WHEN c = 'MACHINERY' AND s = 'held' THEN 'open: held machines' END) ELSE '' END AS n FROM r)
  SELECT rule_id, s <> 'merged' AND (j = 3 OR c = 'BUILDING' OR (c = 'MACHINERY' AND s = 'held')) AS conflict_flag, CASE WHEN n = '' THEN note ELSE concat_ws('; ', note, n) END AS conflict_note FROM h""")
def review_flags(spark, d):
    """Open questions by place, segment and state, each with the fields it gives."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("rule_id"), F.col("c_nationkey").cast("string").alias("jurisdiction"), F.col("c_mktsegment").alias("category"), F.when(k % 3 == 0, "held").when(k % 3 == 1, "accepted").otherwise("merged").alias("disposition"), F.lit(False).alias("conflict_flag"), F.when(k % 5 == 0, "open: buildings").alias("conflict_note"))
    flags = spark.createDataFrame(_FLAGS, "flag string, jurisdiction string, category string, stage string, note string")
    staged = rows.withColumn("stage", F.col("disposition"))
    return laws.review_flags(staged, flags, ["jurisdiction", "category", "stage"]).select("rule_id", "conflict_flag", "conflict_note")


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
  placed AS (SELECT doc_id, line, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pos FROM lines),
  heads AS (SELECT doc_id, pos, line FROM placed WHERE length(line) BETWEEN 1 AND 40), spans AS (SELECT doc_id, n AS key, pos + 5 AS s, pos + 205 AS e FROM placed WHERE n % 3 = 1),
  near AS (SELECT spans.doc_id, key, arg_max(line, (pos, line)) AS line FROM spans JOIN heads ON heads.doc_id = spans.doc_id AND pos <= s GROUP BY 1, 2),
  inside AS (SELECT spans.doc_id, key, list(line ORDER BY pos) AS inner_lines FROM spans JOIN heads ON heads.doc_id = spans.doc_id AND pos >= s AND pos < e GROUP BY 1, 2)
  SELECT spans.doc_id, spans.key, array_to_string(CASE WHEN near.line IS NULL THEN [] ELSE [near.line] END || coalesce(inner_lines, []), '|') AS anchors FROM spans LEFT JOIN near USING (doc_id, key) LEFT JOIN inside USING (doc_id, key)""")
def heading_anchors(spark, d):
    """Short lines as headings; spans of 200 characters from every third line on."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    ahead = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(ahead), F.lit(0)))
    heads = placed.where("length(line) between 1 and 40").select("doc_id", F.col("at").alias("position"), F.col("line").alias("name"))
    spans = placed.where("n % 3 = 0").select("doc_id", (F.col("n") + 1).cast("long").alias("key"), (F.col("at") + 5).alias("start"), (F.col("at") + 205).alias("end"))
    return headings.anchors(spans, heads).select("doc_id", "key", F.array_join("anchors", "|").alias("anchors"))


@query(None)
def figures_in_force(spark, d):
    """A customer's orders as figures of one rule, in force from their day on, some without end: those worded unlike any earlier one."""
    figure = F.concat(F.lit("at most $"), F.format_string("%.2f", "o_totalprice"), F.lit(", "), F.lower("o_orderpriority"))
    until = F.when(F.col("o_orderkey") % 3 != 0, F.date_add(F.to_date("o_orderdate"), 900))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("rule"), F.col("o_orderkey").alias("figure_id"), figure.alias("figure"), F.to_date("o_orderdate").alias("start"), until.alias("until"))
    return similar.in_force(rows, "rule", "figure_id", "figure", "start", "until", F.lit(_DAY), 85).select("rule", "figure_id", "figure")
