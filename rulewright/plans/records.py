"""Registered queries over building facts, the register of rules, contracts, sources and reports, each with its SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import changes, cleaning, contracts, coverage, evidence, quotes, register, summaries
from ..operators import facts as building
from ..sources.readers import table
from . import queries as base
from .queries import query

DAY = "DATE '1998-06-30'"

# --- building facts ---

_DESCRIBED = "CASE WHEN p_partkey % 2 = 0 THEN '3B-' || (p_size + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END)::varchar || 'U-G' ELSE '3SB' END"
_LO = "CASE p_type WHEN 'ECONOMY' THEN 2 WHEN 'LARGE' THEN 20 WHEN 'PROMO' THEN 5 END"
_HI = "CASE p_type WHEN 'ECONOMY' THEN 4 WHEN 'PROMO' THEN 30 END"


@query(f"""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS stated, regexp_extract({_DESCRIBED}, '([0-9]+)U-', 1) AS u, p_partkey % 12 = 0 AS shop, p_type IN ('ECONOMY', 'LARGE', 'PROMO') AS ranged, {_LO} AS lo, {_HI} AS hi FROM part),
  b AS (SELECT *, CASE WHEN u <> '' THEN u::bigint END AS described FROM a), c AS (SELECT *, coalesce(stated <> described, false) AS differs FROM b),
  d AS (SELECT *, CASE WHEN NOT (differs AND shop) THEN stated END AS exact FROM c), e AS (SELECT *, coalesce(exact, described) AS v FROM d)
  SELECT p_partkey, coalesce(v, lo)::bigint AS lo, coalesce(v, hi)::bigint AS hi, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN described IS NOT NULL THEN 'parsed' WHEN ranged THEN 'range' ELSE 'unknown' END AS certainty,
    concat_ws(',', CASE WHEN differs AND shop THEN 'column_is_commercial_count' WHEN differs THEN 'column_vs_description' END, CASE WHEN ranged AND (coalesce(v < lo, false) OR coalesce(v > hi, false)) THEN 'value_vs_use_code' END) AS warnings FROM e""")
def building_facts_units(spark, d):
    rows = table(spark, d, "part")
    described = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("3B-"), F.col("p_size") + (F.col("p_partkey") % 6 == 0).cast("int"), F.lit("U-G"))).otherwise("3SB")
    shops = F.when(F.col("p_partkey") % 12 == 0, F.array(F.col("p_size").cast("long"))).otherwise(F.array().cast("array<long>"))
    stated = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise("")
    fact = building.units_fact(stated, text.units_in(described), shops, F.col("p_type").isin("ECONOMY", "LARGE", "PROMO"), F.expr(_LO).cast("long"), F.expr(_HI).cast("long"))
    return rows.select("p_partkey", fact.alias("f")).select("p_partkey", "f.lo", "f.hi", "f.certainty", F.concat_ws(",", "f.warnings").alias("warnings"))


@query("""SELECT p_partkey, flag, CASE flag WHEN 'hotel' THEN CASE WHEN contains(p_name, 'small') THEN true WHEN p_partkey % 3 = 0 THEN false END WHEN 'affordable' THEN CASE WHEN p_type = 'ECONOMY' THEN true WHEN p_partkey % 3 IN (0, 1) THEN false END
  ELSE CASE WHEN p_type = 'PROMO' AND p_partkey % 3 = 1 THEN true ELSE false END END AS value FROM part, (VALUES ('hotel'), ('affordable'), ('dormitory')) f(flag)""")
def use_flags_layered(spark, d):
    rows = table(spark, d, "part").withColumn("dataset", F.concat(F.lit("D"), F.col("p_partkey") % 3))
    matches = {"hotel": F.col("p_name").contains("small"), "affordable": F.col("p_type") == "ECONOMY", "dormitory": (F.col("p_type") == "PROMO") & (F.col("dataset") == "D1")}
    flags = building.use_flags(F.col("dataset"), matches, {"D0": ["hotel", "affordable"], "D1": ["affordable"]}, ["dormitory"])
    return rows.select("p_partkey", F.explode(flags).alias("f")).select("p_partkey", "f.flag", "f.value")


@query(f"""WITH {base._COVERED}, open AS (SELECT v.address, v.rule_id, unnest(CASE v.rule_id WHEN 'R1' THEN [CASE WHEN (u5 AND old) IS NULL AND u5 IS NULL THEN 'units' END, CASE WHEN (u5 AND old) IS NULL AND old IS NULL THEN 'year_built' END, CASE WHEN aff IS NULL THEN 'flag_affordable' END]
    WHEN 'R2' THEN [CASE WHEN u2 IS NULL THEN 'units' END, CASE WHEN young IS NULL THEN 'year_built' END] ELSE [CASE WHEN u0 IS NULL THEN 'units' END] END) AS fact FROM verdict v JOIN leaf USING (address) WHERE verdict = 'unknown')
  SELECT fact, count(*) AS n FROM open WHERE fact IS NOT NULL GROUP BY fact ORDER BY n DESC, fact LIMIT 10""")
def missing_facts_topk(spark, d):
    found = coverage.missing_facts(*base.coverage_inputs(spark, d))
    return found.groupBy("fact").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fact").limit(10)


@query(f"""WITH {base._COVERED}, x AS (SELECT CASE WHEN u0 IS FALSE THEN 'not_covered' WHEN coalesce(aff, false) THEN 'exempt' WHEN u0 THEN 'covered' ELSE 'unknown' END AS presumed,
    CASE WHEN u0 IS FALSE THEN 'not_covered' WHEN aff THEN 'exempt' WHEN u0 AND aff IS FALSE THEN 'covered' ELSE 'unknown' END AS plain FROM leaf WHERE state = 2) SELECT presumed, plain, count(*) AS n FROM x GROUP BY 1, 2""")
def presumption_effect(spark, d):
    levels, facts, rules, leaves = base.coverage_inputs(spark, d)
    only = rules.where("rule_id = 'R3'")
    verdict = lambda r, name: coverage.verdicts(levels, facts, r, leaves).select("address", F.col("verdict").alias(name))
    both = verdict(only, "presumed").join(verdict(only.withColumn("presume", F.lit(False)), "plain"), "address")
    return both.groupBy("presumed", "plain").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT n_name AS city, CASE c_custkey % 4 WHEN 2 THEN 'range' WHEN 3 THEN 'unknown' WHEN 1 THEN 'parsed' ELSE 'exact' END AS certainty, {base._YEAR} AS year, {base._FLAG} AS flag FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT city, count(*) FILTER (WHERE certainty = 'exact') AS exact, count(*) FILTER (WHERE certainty = 'parsed') AS parsed, count(*) FILTER (WHERE certainty = 'range') AS range, count(*) FILTER (WHERE certainty = 'unknown') AS unknown, count(year) AS with_year, count(*) FILTER (WHERE flag = 1) AS flagged FROM a GROUP BY city""")
def facts_summary(spark, d):
    certainty = F.element_at(F.array(*map(F.lit, ("exact", "parsed", "range", "unknown"))), (F.col("address") % 4 + 1).cast("int"))
    rows = base.addresses(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), F.col("nation") == F.col("k"))
    rows = rows.select(F.col("name").alias("city"), certainty.alias("certainty"), "year", "flag")
    kinds = [F.count_if(F.col("certainty") == c).alias(c) for c in ("exact", "parsed", "range", "unknown")]
    return rows.groupBy("city").agg(*kinds, F.count("year").alias("with_year"), F.count_if(F.col("flag") == 1).alias("flagged"))


@query(f"""WITH {base._COVERED} SELECT state, rule_id, verdict, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY state, rule_id), 1)::double AS percent FROM verdict GROUP BY state, rule_id, verdict""")
def lookup_summary(spark, d):
    return summaries.shares(base.covered(spark, d), ["state", "rule_id"], "verdict")


@query("""WITH a AS (SELECT n_name AS city, CASE WHEN c_custkey % 3 <> 0 THEN 'batch' WHEN c_custkey % 2 = 0 THEN 'retry' ELSE 'fallback' END AS via FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT coalesce(city, 'TOTAL') AS city, count(*) FILTER (WHERE via = 'batch') AS batch, count(*) FILTER (WHERE via = 'retry') AS retry, count(*) FILTER (WHERE via = 'fallback') AS fallback, count(*) AS n FROM a GROUP BY ROLLUP (city)""")
def geocode_summary(spark, d):
    """The first batch's matches, then the retry's, then the city that the data names."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    batch = rows.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_nationkey").alias("place"))
    retry = rows.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_nationkey").alias("place"))
    found = summaries.first_found(rows, "c_custkey", "place", {"batch": batch, "retry": retry}, "c_nationkey", "fallback")
    named = found.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("city")), "place")
    return summaries.with_total(named, "city", "via", ["batch", "retry", "fallback"])


@query(f"WITH {base._LISTINGS} SELECT n_name AS zone, b.bedrooms, count(listing_id) AS n FROM nation CROSS JOIN (VALUES (0), (1), (2), (3), (4)) b(bedrooms) LEFT JOIN listings ON zone = n_name AND listings.bedrooms = b.bedrooms GROUP BY 1, 2")
def listings_zero_filled(spark, d):
    zones = table(spark, d, "nation").select(F.col("n_name").alias("zone"), F.explode(F.array(*map(F.lit, range(5)))).alias("bedrooms"))
    return summaries.zero_filled(base.listings(spark, d), zones, ["zone", "bedrooms"])


@query("SELECT r_name AS state, arg_max(n_name, (n, -n_nationkey)) AS city, max(n) AS n FROM (SELECT r_name, n_name, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) GROUP BY r_name")
def largest_city(spark, d):
    """The largest of each state; the first of equals."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(places, "n_nationkey")
    return sizes.groupBy(F.col("r_name").alias("state")).agg(F.max_by("n_name", F.struct("n", -F.col("n_nationkey"))).alias("city"), F.max("n").alias("n"))


@query("SELECT lang, sum(n_chars)::bigint AS chars, round(avg(n_chars), 3) AS mean, max(n_chars) AS longest, sum(n_chars) + 1000 <= 1000000 AS fits FROM documents GROUP BY lang")
def audio_budget(spark, d):
    """Characters by language, and whether 1,000 more stay within a budget of a million."""
    rows = table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 3).alias("mean"), F.max("n_chars").alias("longest"))
    return rows.withColumn("fits", F.col("chars") + 1000 <= 1_000_000)


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def longest_three(spark, d):
    return summaries.first_of_each(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 3)


# --- the register of rules ---


@query(f"SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE (l_linenumber % 3 = 0 OR l_shipdate::date <= {DAY}) AND (l_linenumber % 4 = 0 OR {DAY} <= l_shipdate::date + l_quantity::int)")
def rule_figures_in_force(spark, d):
    rows = table(spark, d, "lineitem")
    first = F.when(F.col("l_linenumber") % 3 != 0, F.to_date("l_shipdate"))
    until = F.when(F.col("l_linenumber") % 4 != 0, F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")))
    return rows.where(dates.in_force(F.to_date(F.lit("1998-06-30")), first, until)).select("l_orderkey", "l_partkey", "l_linenumber")


@query("""WITH e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS cell, s_suppkey // 2 + 1 AS number FROM supplier WHERE s_suppkey % 3 <> 0),
  c AS (SELECT s.s_suppkey, s_nationkey, s_name, number AS prior, number IS NOT NULL AND row_number() OVER (PARTITION BY s_nationkey, number ORDER BY s_name, s.s_suppkey) = 1 AS keeps FROM supplier s LEFT JOIN e ON s.s_suppkey = e.s_suppkey AND s_nationkey = cell),
  u AS (SELECT cell, max(number) AS used FROM e GROUP BY cell)
  SELECT s_suppkey, (CASE WHEN keeps THEN prior ELSE coalesce(used, 0) + row_number() OVER (PARTITION BY s_nationkey, keeps ORDER BY s_name, s_suppkey) END)::bigint AS number FROM c LEFT JOIN u ON s_nationkey = cell""")
def stable_ids(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cell"), "s_name")
    had = rows.where("s_suppkey % 3 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, F.col("cell") + 1).otherwise(F.col("cell")).alias("cell"), (F.floor(F.col("s_suppkey") / 2) + 1).alias("number"))
    return register.stable_ids(rows, had, ["cell"], "s_suppkey", ["s_name", "s_suppkey"]).select("s_suppkey", "number")


@query("""WITH r AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS stage, l_linestatus = 'O' AS secondary, l_partkey * 1000000 + l_suppkey AS uid, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS value,
    CASE WHEN l_orderkey % 3 = 0 THEN DATE '2000-01-01' WHEN l_linenumber % 5 <> 0 THEN l_shipdate::date END AS sunset FROM lineitem)
  SELECT l_orderkey, count(*) AS members, first(value ORDER BY stage DESC, secondary, l_discount DESC, uid, l_linenumber, value) FILTER (WHERE value IS NOT NULL) AS value, CASE WHEN count(sunset) = count(*) AND min(sunset) = max(sunset) THEN min(sunset) END AS sunset,
    max(l_discount) AS confidence, bool_or(l_tax > 0.07) AS conflict, bool_and(secondary) AS secondary FROM r GROUP BY l_orderkey""")
def merge_rules_attrs(spark, d):
    stage = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    sunset = F.when(F.col("l_orderkey") % 3 == 0, F.lit("2000-01-01").cast("date")).when(F.col("l_linenumber") % 5 != 0, F.to_date("l_shipdate"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stage.alias("stage"), (F.col("l_linestatus") == "O").alias("secondary"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("uid"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("value"), sunset.alias("sunset"), F.col("l_discount").alias("confidence"), (F.col("l_tax") > 0.07).alias("conflict"))
    rank = [(-F.col("stage")).alias("s"), F.col("secondary"), (-F.col("confidence")).alias("c"), F.col("uid"), F.col("l_linenumber"), F.col("value")]
    return register.merged(rows, "l_orderkey", rank, ["value"], ["sunset"], ["confidence"], ["conflict"], ["secondary"])


_RULES_OF_PARTS = "r AS (SELECT p_partkey AS k, p_brand, p_type, p_partkey % 4 AS doc, unnest(list_distinct([p_size % 5, p_size % 7 + 10])) AS law, round(p_retailprice) AS v FROM part)"


def _part_rules(spark, d):
    laws = F.array(F.col("p_size") % 5, F.col("p_size") % 7 + 10)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_type", (F.col("p_partkey") % 4).alias("doc"), laws.alias("laws"), F.round("p_retailprice").alias("v"))


_PAIRS = "SELECT a.k AS a, b.k AS b, count(*) AS laws FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.law = b.law AND a.k < b.k AND a.doc <> b.doc AND a.v <> b.v GROUP BY 1, 2"


@query(f"WITH {_RULES_OF_PARTS} {_PAIRS}")
def self_join_conflicts(spark, d):
    return register.contradictions(_part_rules(spark, d), "k", ["p_brand", "p_type"], "doc", "laws", "v")


@query(f"WITH {_RULES_OF_PARTS}, now AS ({_PAIRS}) SELECT a, b FROM now WHERE NOT (a % 3 <> 0 AND b % 3 <> 0)")
def new_conflicts_except(spark, d):
    rules = _part_rules(spark, d)
    return register.new_contradictions(rules, rules.where("k % 3 <> 0"), "k", ["p_brand", "p_type"], "doc", "laws", "v")


@query("""WITH r AS (SELECT n_nationkey AS k, 'city' AS level, n_regionkey AS st, n_nationkey % 2 AS cat FROM nation UNION ALL SELECT 100 + 2 * r_regionkey + c, 'state', r_regionkey, c FROM region, (VALUES (0), (1), (2)) x(c))
  SELECT s.k::bigint AS state_rule, l.k::bigint AS local_rule FROM r s LEFT JOIN r l ON l.level = 'city' AND s.st = l.st AND s.cat = l.cat WHERE s.level = 'state'""")
def preemption_pairs(spark, d):
    city = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lit("city").alias("level"), F.concat("n_name", F.lit(", "), "n_regionkey").alias("jurisdiction"), F.lit(None).cast("string").alias("st"), (F.col("n_nationkey") % 2).alias("cat"))
    state = table(spark, d, "region").select("r_regionkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cat")).select((100 + 2 * F.col("r_regionkey") + F.col("cat")).cast("long").alias("k"), F.lit("state").alias("level"), F.col("r_regionkey").cast("string").alias("jurisdiction"), F.col("r_regionkey").cast("string").alias("st"), "cat")
    return register.unions_by_law(city.unionByName(state), "st", "level", "jurisdiction", "cat", "k")


_A = "'$' || (o_orderkey % 4)::varchar || ',000 and ' || (o_custkey % 3)::varchar || '%'"
_B = "'$' || (o_orderkey % 8)::varchar || '000' || CASE WHEN o_orderkey % 3 = 0 THEN ' (no percentage)' ELSE '; ' || (o_custkey % 5)::varchar || '.0 percent' END"
_NUMBERS = lambda c: f"list_distinct(list_transform(regexp_extract_all(replace({c}, ',', ''), '[0-9]+(?:[.][0-9]+)?'), lambda x: x::double))"


@query(f"""WITH v AS (SELECT o_orderkey, {_A} AS a, {_B} AS b FROM orders), n AS (SELECT *, {_NUMBERS('a')} AS x, {_NUMBERS('b')} AS y FROM v)
  SELECT o_orderkey, a, b FROM n WHERE NOT (len(x) > 0 AND len(y) > 0 AND (list_has_all(x, y) OR list_has_all(y, x)))""")
def key_value_conflict(spark, d):
    """Orders whose two stated values differ in their figures."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_A.replace("::varchar", "")).alias("a"), F.expr(_B.replace("::varchar", "")).alias("b"))
    return rows.where(~text.figures_agree(F.col("a"), F.col("b")))


def _older_ids(spark, d):
    category = F.when(F.col("p_partkey") % 2 == 0, "ALGO").otherwise("ALG")
    number = F.when(F.col("p_partkey") % 3 == 0, F.format_string("%03d", "p_size")).otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("NJ-"), category, F.lit("-"), F.when(F.col("p_size") % 3 == 0, "H").otherwise("P"), number).alias("id"))


@query("SELECT p_partkey, 'NJ-ALG-' || CASE WHEN p_size % 3 = 0 THEN 'H' ELSE 'P' END || p_size::varchar AS upgraded FROM part")
def legacy_id_upgrade(spark, d):
    return _older_ids(spark, d).select("p_partkey", text.upgraded_id(F.col("id")).alias("upgraded"))


@query("""WITH a AS (SELECT doc_id, nfc_normalize(CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), ' ' || chr(13) || chr(10)) ELSE replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10) || chr(10)) || '  e' || chr(769) || '  ' END) AS t FROM documents)
  SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '\\s+$', '') || chr(10)) AS sha FROM a""")
def canonical_text(spark, d):
    spoiled = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(" \r\n"))).otherwise(F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n\n\n\n")), F.lit("  é  ")))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.canonical(spoiled), 256).alias("sha"))


# --- dates ---


_CUT_ABOUT = "CASE o_orderkey % 4 WHEN 0 THEN 'A building first built ' WHEN 1 THEN 'Homes sold ' WHEN 2 THEN 'Units whose certificate of occupancy was issued ' ELSE 'Housing completed and let for the first time ' END"
_CUT_RELATION = "CASE o_orderkey % 5 WHEN 0 THEN 'on or before ' WHEN 1 THEN 'before ' WHEN 2 THEN 'PRIOR TO ' WHEN 3 THEN 'on or after ' ELSE 'On or Before ' END"
_CUT_DAY = r"[a-z]{3,9}\.?\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"


@query(rf"""WITH a AS (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN o_orderkey % 11 = 0 THEN make_date(year(o_orderdate)::int, 12, 31) ELSE o_orderdate::date END AS day FROM orders),
  b AS (SELECT *, {_CUT_ABOUT} || {_CUT_RELATION} || CASE o_orderkey % 3 WHEN 0 THEN strftime(day, '%B %-d, %Y') WHEN 1 THEN strftime(day, '%b. %-d %Y') ELSE strftime(day, '%-m/%-d/%Y') END || CASE WHEN o_orderkey % 7 = 0 THEN ' or constructed on or before ' || strftime(day + 40, '%B %-d, %Y') ELSE '' END || '.' AS t FROM a),
  c AS (SELECT *, unnest(regexp_extract_all(t, '(?i)\b(?:built|constructed|completed|occupancy)\b[^.;]{{0,60}}?(?:on or before|before|prior to|after|on or after)\s+(?:{_CUT_DAY})')) AS m FROM b),
  e AS (SELECT *, lower(regexp_extract(m, '(?i)(on or before|before|prior to|after)\s+(?:{_CUT_DAY})$', 1)) AS rel, coalesce(try_strptime(regexp_extract(m, '(?i)({_CUT_DAY})$', 1), '%B %d, %Y'), try_strptime(regexp_extract(m, '(?i)({_CUT_DAY})$', 1), '%b. %d %Y'), try_strptime(regexp_extract(m, '(?i)({_CUT_DAY})$', 1), '%m/%d/%Y'))::date AS dd FROM c),
  f AS (SELECT DISTINCT o_orderkey, CASE WHEN rel = 'on or before' THEN dd ELSE dd - 1 END AS last FROM e WHERE rel <> 'after'),
  g AS (SELECT f.o_orderkey, min(last) AS last FROM f JOIN b USING (o_orderkey) WHERE year(last) = y GROUP BY f.o_orderkey HAVING count(*) = 1)
  SELECT o_orderkey, CASE WHEN regexp_matches(t, '(?i)\bcertificates? of occupancy\b') OR strftime(last, '%m-%d') <> '12-31' THEN last END AS cutoff FROM b LEFT JOIN g USING (o_orderkey)""")
def certificate_cutoff(spark, d):
    """The one cutoff day in a rule's text, by what the text is about; two of one year, or a bare end of a year, give none."""
    day = F.when(F.col("o_orderkey") % 11 == 0, F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))).otherwise(F.to_date("o_orderdate"))
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "MMMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "MMM. d yyyy")).otherwise(F.date_format(day, "M/d/yyyy"))
    second = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit(" or constructed on or before "), F.date_format(F.date_add(day, 40), "MMMM d, yyyy"))).otherwise("")
    wording = F.concat(F.expr(_CUT_ABOUT), F.expr(_CUT_RELATION), written, second, F.lit("."))
    return table(spark, d, "orders").select("o_orderkey", dates.certificate_day(F.year("o_orderdate"), wording).alias("cutoff"))


_DATE_FORMS = ("%Y-%m-%d", "%B %-d, %Y", "%b. %d %Y", "%-d %B %Y", "%-m/%-d/%Y", "%m-%d-%y", "%-m.%d.%Y")


@query(rf"""WITH t AS (SELECT o_orderkey, o_orderdate::date AS day, CASE o_orderkey % 9 {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_DATE_FORMS))} WHEN 7 THEN strftime(o_orderdate, '%Y-%m-%d7') ELSE strftime(o_orderdate, 'x%B %-d, %Y') END AS w FROM orders),
  f AS (SELECT o_orderkey, w, unnest([{', '.join(f"strftime(day, '{f}')" for f in _DATE_FORMS)}]) AS form FROM t)
  SELECT o_orderkey, bool_or(regexp_matches(' EFFECTIVE ' || upper(w) || ' AT THE LATEST', '[^\p{{L}}\p{{N}}]' || regexp_replace(upper(form), '[.]', '[.]', 'g') || '[^0-9]')) AS stands FROM f GROUP BY o_orderkey""")
def date_stands_in_text(spark, d):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 9
    spark_forms = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM. dd yyyy", "d MMMM yyyy", "M/d/yyyy", "MM-dd-yy", "M.dd.yyyy")
    written = F.concat(F.lit("x"), F.date_format(day, "MMMM d, yyyy"))
    for i, form in enumerate((*spark_forms, "yyyy-MM-dd'7'")):
        written = F.when(k == i, F.date_format(day, form)).otherwise(written)
    return table(spark, d, "orders").select("o_orderkey", dates.stands_in(day, F.concat(F.lit(" EFFECTIVE "), F.upper(written), F.lit(" at  the latest"))).alias("stands"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', o_orderdate)::date WHEN 1 THEN date_trunc('month', o_orderdate)::date WHEN 2 THEN o_orderdate::date END AS day FROM orders""")
def partial_dates(spark, d):
    day = F.to_date("o_orderdate")
    forms = [F.date_format(day, f) for f in ("yyyy", "yyyy-MM", "yyyy-MM-dd")] + [F.lit("unknown day")]
    return table(spark, d, "orders").select("o_orderkey", dates.padded(F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("day"))


@query(f"SELECT c_custkey AS address, unnest([make_date((y + 15)::int, 1, 1), make_date((y + 15)::int, 12, 31)]) AS day FROM (SELECT c_custkey, {base._YEAR} AS y FROM customer) WHERE y IS NOT NULL")
def rolling_age_flips(spark, d):
    return base.addresses(spark, d).where("year is not null").select("address", F.explode(dates.age_flips(F.col("year"), F.lit(15))).alias("day"))


# --- changes ---

_STATUS = base._status_sql(DAY)
_TESTED = f"WITH {base._CLAIMS}, t AS (SELECT rule, owner, n_name AS city, {_STATUS} AS result, rule % 13 = 0 AS flag FROM claims JOIN customer ON owner = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def _tested(spark, d):
    rows = base.claims(spark, d).select("rule", "owner", base._status(F.to_date(F.lit("1998-06-30"))).alias("result"), (F.col("rule") % 13 == 0).alias("flag"))
    who = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("owner"), F.col("n_name").alias("city"))
    return rows.join(who, "owner")


def _change_sql(rules: str, wanted: str) -> str:
    return f"{_TESTED}, hit AS (SELECT city, owner, bool_or(result IN ({wanted})) AS hit, bool_or(flag) AS flag FROM t WHERE {rules} GROUP BY city, owner) SELECT city, count(*) FILTER (WHERE hit) AS affected, count(*) FILTER (WHERE hit AND flag) AS flagged FROM hit GROUP BY city"


@query(_change_sql("rule % 17 < 5", "'in_force', 'not_yet_effective'"))
def boundary_test(spark, d):
    return changes.affected(_tested(spark, d).where("rule % 17 < 5"), "city", "owner", ["in_force", "not_yet_effective"])


@query(_change_sql("rule % 5 = 0", "'pending'"))
def pending_test(spark, d):
    return changes.affected(_tested(spark, d).where("rule % 5 = 0"), "city", "owner", ["pending"])


@query(_change_sql("city = 'NATION_3' AND rule % 19 = 0", "'in_force'"))
def negative_test(spark, d):
    return changes.affected(_tested(spark, d).where("city = 'NATION_3' and rule % 19 = 0"), "city", "owner", ["in_force"])


@query(f"{_TESTED} SELECT c.owner, c.rule, c.effective, row_number() OVER (PARTITION BY c.owner ORDER BY c.effective, c.rule) AS place FROM claims c JOIN t USING (rule) WHERE result IN ('pending', 'not_yet_effective')")
def pending_list(spark, d):
    return changes.pending(base.claims(spark, d).withColumn("result", base._status(F.to_date(F.lit("1998-06-30")))), "owner", "rule", "effective")


# --- sources and evidence ---


_QUOTED = "quoted AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN replace(upper(text), ' ', '  ') ELSE text END AS text FROM benchmark)"


@query(f"""WITH {_QUOTED}, e AS (SELECT doc_id, item_id FROM documents JOIN quoted ON contains(documents.text, quoted.text)),
  n AS (SELECT doc_id, item_id FROM (SELECT doc_id, {base._form_sql('text')} AS t FROM documents) JOIN (SELECT item_id, {base._form_sql('text')} AS q FROM quoted) ON contains(t, q))
  SELECT coalesce(n.doc_id, e.doc_id) AS doc_id, coalesce(n.item_id, e.item_id) AS item_id, CASE WHEN e.doc_id IS NOT NULL THEN 'exact' ELSE 'normalized' END AS match FROM n FULL OUTER JOIN e ON n.doc_id = e.doc_id AND n.item_id = e.item_id""")
def quote_normalized(spark, d):
    return _matched(spark, d).select(F.col("source_id").alias("doc_id"), F.col("quote_id").alias("item_id"), "match")


def _matched(spark, d):
    written = F.when(F.col("item_id") % 3 == 0, F.replace(text.upper(F.col("text")), F.lit(" "), F.lit("  "))).otherwise(F.col("text"))
    quoted = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), written.alias("text"))
    return quotes.quotes_matched(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), quoted, lambda c: text.quote_form(c, True))


@query(f"""WITH {_QUOTED}, f AS (SELECT text, {base._form_sql('text')} AS folded FROM documents), q AS (SELECT item_id, text, {base._form_sql('text')} AS folded FROM quoted),
  b AS (SELECT item_id, max(CASE WHEN contains(f.text, q.text) THEN 2 WHEN contains(f.folded, q.folded) THEN 1 ELSE 0 END) AS m FROM q CROSS JOIN f GROUP BY item_id)
  SELECT count(*) AS quotes, count(*) FILTER (WHERE m = 2) AS exact, count(*) FILTER (WHERE m = 1) AS normalized, round(count(*) FILTER (WHERE m > 0) / count(*), 6) AS rate FROM b""")
def quote_verified_rate(spark, d):
    best = _matched(spark, d).groupBy(F.col("quote_id").alias("item_id")).agg(F.min("match").alias("match"))
    rows = table(spark, d, "benchmark").select("item_id").join(best, "item_id", "left")
    kinds = [F.count_if(F.col("match") == k).alias(k) for k in ("exact", "normalized")]
    return rows.agg(F.count("*").alias("quotes"), *kinds, F.round(F.count("match") / F.count("*"), 6).alias("rate"))


_MARKED = """s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10) || chr(10)) || chr(10) ELSE text END AS text FROM documents),
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM s),
  m AS (SELECT *, regexp_full_match(line, '\\S+( \\S+){0,5}') AS nav, trim(line) = '' AS blank FROM l),
  w AS (SELECT *, last_value(CASE WHEN NOT nav THEN blank END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous, max(n) FILTER (WHERE NOT nav AND NOT blank) OVER (PARTITION BY doc_id) AS last FROM m),
  marked AS (SELECT *, CASE WHEN nav THEN 'nav-line' WHEN blank AND (coalesce(previous, true) OR n > coalesce(last, 0)) THEN 'blank' END AS reason FROM w)"""


def _marked(spark, d):
    spread = F.when(F.col("doc_id") % 2 == 0, F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n\n")), F.lit("\n"))).otherwise(F.col("text"))
    lines = cleaning.numbered_lines(table(spark, d, "documents").select("doc_id", spread.alias("text")), "doc_id", "text")
    return cleaning.removal_reasons(lines, "doc_id", F.col("line").rlike(r"^\S+( \S+){0,5}$"))


@query(f"WITH {_MARKED} SELECT doc_id, n::bigint AS n FROM marked WHERE reason = 'nav-line'")
def clean_drop_lines(spark, d):
    return _marked(spark, d).where("reason = 'nav-line'").select("doc_id", F.col("n").cast("long").alias("n"))


@query(f"WITH {_MARKED} SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE reason IS NULL), '')) AS sha FROM marked GROUP BY doc_id")
def blank_collapse(spark, d):
    return cleaning.kept_text(_marked(spark, d), "doc_id").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"WITH {_MARKED}, r AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM marked WHERE reason = 'nav-line') SELECT doc_id, min(n)::bigint AS first, max(n)::bigint AS last FROM r GROUP BY doc_id, run")
def removed_blocks(spark, d):
    return cleaning.removed_blocks(_marked(spark, d), "doc_id").select("doc_id", "first", "last")


@query(base.SQL["evidence_chain_status"].replace("SELECT conv_id, turn, min(", "SELECT conv_id, role, min(").join(("WITH v AS (", """), r AS (SELECT conv_id, role, bool_or(valid) AS ok, bool_and(valid) AS whole FROM v GROUP BY conv_id, role),
  s AS (SELECT conv_id, count(*) FILTER (WHERE ok AND role IN ('user', 'assistant')) AS valid_roles, bool_and(whole) AS whole FROM r GROUP BY conv_id)
  SELECT conv_id, valid_roles, CASE WHEN NOT whole THEN 'invalidated' WHEN valid_roles = 2 THEN 'signed' WHEN valid_roles > 0 THEN 'partial' ELSE 'pending' END AS overall FROM s""")))
def signature_rollup(spark, d):
    signed = base.evidence_chain_status(spark, d).join(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return evidence.rollup(signed, "conv_id", "role", "valid", ["user", "assistant"])


@query("SELECT event_id, sha256('{\"amount\":' || round(value * 100)::bigint::varchar || ',\"type\":\"' || event_type || '\",\"user\":' || user_id::varchar || '}') AS sha FROM events")
def canonical_json(spark, d):
    """JSON with its keys in order and no blanks, hashed."""
    fields = F.struct(F.round(F.col("value") * 100).cast("long").alias("amount"), F.col("event_type").alias("type"), F.col("user_id").alias("user"))
    return table(spark, d, "events").select("event_id", F.sha2(F.to_json(fields), 256).alias("sha"))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id % 10 = 3 AND event_type IN ('error', 'purchase')")
def audit_run_filter(spark, d):
    return table(spark, d, "events").where("user_id % 10 = 3 and event_type in ('error', 'purchase')").select("event_id", "user_id", "event_type")


# --- contracts ---

REQUIREMENTS = [
    ("FED-1", "FED", "term", "law", True), ("FED-2", "FED", "deposit", "law", True), ("S1-1", "REGION_1", "deposit", "law", True), ("S2-1", "REGION_2", "notice", "law", True), ("FED-3", "FED", "price", "law", True),
    ("FED-4", "FED", "term", "guide", True), ("FED-5", "FED", "deposit", "law", False),
]
CHECKS = [("FED-1", "term_months", "ge", 6), ("FED-2", "deposit_months", "le", 2), ("FED-2", "deposit_months", "le", 2), ("S1-1", "deposit_months", "le", 1), ("S2-1", "payment_day", "lt", 25), ("FED-5", "deposit_months", "le", 0)]
CLAUSES = [
    ("rent", 1, "parties", True, "federal", False, False, ["name"], [], []), ("rent", 2, "term", False, "federal", False, False, ["term_months"], ["term"], []),
    ("rent", 3, "deposit", False, "any", False, True, ["deposit", "term_months"], ["deposit"], []), ("rent", 4, "notice", False, "state", False, False, ["payment_day"], ["notice"], []),
    ("rent", 5, "guarantor", True, "federal", True, False, ["guarantor_name"], [], []), ("rent", 6, "pets", False, "federal", False, False, [], ["pets"], []),
    ("rent", 7, "price", False, "federal", False, False, [], [], ["FED-3"]),
]
_CONTRACT = """c AS (SELECT o_orderkey AS id, r_name AS state, n_regionkey IN (1, 2) AS verified, o_custkey % 3 = 0 AS guarantor, CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE o_totalprice * (o_orderkey % 5) / 2 END AS deposit, o_totalprice AS rent,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 24 END AS term_months, o_orderkey % 28 AS payment_day, CASE WHEN o_custkey % 2 = 0 THEN 'G' ELSE '' END AS guarantor_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_PLAN = f"""{_CONTRACT}, names AS (SELECT min(r_name) FILTER (WHERE r_regionkey = 1) AS one, min(r_name) FILTER (WHERE r_regionkey = 2) AS two FROM region),
  p AS (SELECT c.*, key, pos, CASE WHEN key = 'guarantor' AND NOT guarantor THEN 'no_guarantor' WHEN key = 'deposit' AND deposit = 0 THEN 'no_deposit_agreed' WHEN key = 'notice' AND NOT verified THEN 'federal_law_only' WHEN key = 'pets' OR key = 'notice' AND state <> two THEN 'no_verified_requirement' END AS reason,
    CASE key WHEN 'term' THEN 'FED-1' WHEN 'price' THEN 'FED-3' WHEN 'deposit' THEN CASE WHEN verified AND state = one THEN 'S1-1,FED-2' ELSE 'FED-2' END WHEN 'notice' THEN CASE WHEN verified AND state = two THEN 'S2-1' ELSE '' END ELSE '' END AS requirements
  FROM c, names, (VALUES ('parties', 1), ('term', 2), ('deposit', 3), ('notice', 4), ('guarantor', 5), ('pets', 6), ('price', 7)) k(key, pos))"""


def _planned(spark, d):
    regions = table(spark, d, "region").select(F.concat(F.lit("REGION_"), "r_regionkey").alias("jurisdiction"), "r_name")
    reqs = spark.createDataFrame(REQUIREMENTS, contracts.REQUIREMENTS).join(regions, "jurisdiction", "left").withColumn("jurisdiction", F.coalesce("r_name", "jurisdiction")).drop("r_name")
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    deposit = F.when(F.col("o_orderkey") % 4 == 0, 0.0).when(F.col("o_orderkey") % 4 == 1, F.lit(None)).otherwise(F.col("o_totalprice") * (F.col("o_orderkey") % 5) / 2)
    rows = rows.select(
        F.col("o_orderkey").alias("id"), F.col("r_name").alias("state"), F.col("n_regionkey").isin(1, 2).alias("verified"), (F.col("o_custkey") % 3 == 0).alias("guarantor"), deposit.alias("deposit"), F.col("o_totalprice").alias("rent"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 24).alias("term_months"), (F.col("o_orderkey") % 28).alias("payment_day"), F.when(F.col("o_custkey") % 2 == 0, "G").otherwise("").alias("guarantor_name"), F.lit("rent").alias("template"),
    )
    return contracts.clause_plan(rows, spark.createDataFrame(CLAUSES, contracts.CLAUSES), reqs)


@query(f"WITH {_PLAN} SELECT id, key, reason, requirements, CASE WHEN reason IS NULL THEN count(*) FILTER (WHERE reason IS NULL) OVER (PARTITION BY id ORDER BY pos) END AS ordinal FROM p")
def clause_plan(spark, d):
    """Every clause of every contract: why it is left out, or its number and the requirements behind it."""
    planned = _planned(spark, d)
    number = F.when(F.col("reason").isNull(), F.count_if(F.col("reason").isNull()).over(Window.partitionBy("id").orderBy("pos")))
    return planned.select("id", "key", "reason", F.array_join("requirements", ",").alias("requirements"), number.alias("ordinal"))


@query(f"""WITH {_PLAN}, f AS (SELECT *, unnest(CASE key WHEN 'term' THEN ['term_months'] WHEN 'deposit' THEN ['deposit', 'term_months'] WHEN 'notice' THEN ['payment_day'] WHEN 'guarantor' THEN ['guarantor_name'] ELSE [] END) AS field FROM p WHERE reason IS NULL)
  SELECT id, field, string_agg(nullif(requirements, ''), ',' ORDER BY pos) AS requirements FROM f WHERE CASE field WHEN 'term_months' THEN term_months::varchar WHEN 'deposit' THEN deposit::varchar WHEN 'payment_day' THEN payment_day::varchar ELSE guarantor_name END IS NULL OR field = 'guarantor_name' AND guarantor_name = '' GROUP BY id, field""")
def missing_fields(spark, d):
    found = contracts.missing_fields(_planned(spark, d), "id", {name: F.col(name) for name in ("term_months", "deposit", "payment_day", "guarantor_name")})
    return found.select("id", "field", F.nullif(F.array_join("requirements", ","), F.lit("")).alias("requirements"))


@query(f"""WITH {_PLAN}, u AS (SELECT DISTINCT id, unnest(string_split(requirements, ',')) AS requirement, deposit::decimal(18,4) AS held, rent::decimal(18,4) AS rent, term_months, payment_day FROM p WHERE reason IS NULL)
  SELECT id, requirement FROM u WHERE CASE requirement WHEN 'FED-1' THEN term_months < 6 WHEN 'FED-2' THEN held > 2 * rent WHEN 'S1-1' THEN held > rent WHEN 'S2-1' THEN payment_day >= 25 ELSE false END""")
def check_violations(spark, d):
    months = F.col("deposit").cast("decimal(18,4)") / F.col("rent").cast("decimal(18,4)")
    values = {"deposit_months": months, "term_months": F.col("term_months"), "payment_day": F.col("payment_day")}
    return contracts.violations(_planned(spark, d), "id", spark.createDataFrame([(*c[:3], Decimal(c[3])) for c in CHECKS], contracts.CHECKS), values).select("id", "requirement")


# --- search ---


@query("""SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' AND (contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7')) ORDER BY c_custkey LIMIT 50""")
def address_search(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found, _ = summaries.search(rows, {"nation-3": ["NATION_3"]}, "nation-3", "n_name", "7", ["c_name", "c_mktsegment"], ["c_custkey"], 50)
    return found.select("c_custkey", "n_name")


@query("SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (1 + s_suppkey % 90 + (s_suppkey % 60) / 60.0 + (s_suppkey % 600) / 36000.0), 6)::double AS degrees FROM supplier")
def coordinates_decimal(spark, d):
    written = F.format_string("%d°%d'%.1f\" %s", F.col("s_suppkey") % 90 + 1, F.col("s_suppkey") % 60, (F.col("s_suppkey") % 600) / 10, F.when(F.col("s_suppkey") % 2 == 0, "W").otherwise("N"))
    return table(spark, d, "supplier").select("s_suppkey", text.degrees(written).alias("degrees"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'money' WHEN c_custkey % 4 = 1 THEN 'percent,months' WHEN c_custkey % 4 = 2 THEN 'days' ELSE '' END AS kinds FROM customer""")
def quantity_kinds(spark, d):
    forms = [F.concat(F.lit("at most $"), F.col("c_custkey")), F.concat(F.col("c_custkey"), F.lit("% within 12 Months")), F.concat(F.lit("notice of "), F.col("c_custkey"), F.lit(" days")), F.lit("monthly statements")]
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.quantity_kinds(F.element_at(F.array(*forms), (F.col("c_custkey") % 4 + 1).cast("int"))), ",").alias("kinds"))
