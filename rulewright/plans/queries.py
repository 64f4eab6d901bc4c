"""The registered queries over rules, evidence and listings, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kleene, spanish, text
from ..operators import coverage, evidence, market, merging, precedence, quotes, rules, status
from ..sources.readers import json_records, table
from ..streaming import token_bucket

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def listings(spark: SparkSession, d: str) -> DataFrame:
    """One listing per order: zone of the customer, rent, bedrooms, date."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("listing_id"), F.col("n_name").alias("zone"), F.col("r_name").alias("state"), F.col("o_totalprice").alias("rent"), (F.col("o_orderkey") % 5).alias("bedrooms"), F.col("o_orderdate").alias("created_at"))


_LISTINGS = """listings AS (SELECT o_orderkey AS listing_id, n_name AS zone, r_name AS state, o_totalprice AS rent, o_orderkey % 5 AS bedrooms, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _prices(level: str) -> str:
    return f"""WITH {_LISTINGS} SELECT {level}, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(min(rent), 3) END AS low,
  CASE WHEN count(*) >= 3 THEN round(median(rent), 3) END AS median, CASE WHEN count(*) >= 3 THEN round(max(rent), 3) END AS high FROM listings WHERE rent > 0 GROUP BY {level}"""


@query(_prices("zone"))
def price_summary_by_zone(spark, d):
    return market.price_summary(listings(spark, d), ["zone"], "rent")


@query(_prices("state"))
def price_summary_by_state(spark, d):
    return market.price_summary(listings(spark, d), ["state"], "rent")


@query(f"WITH {_LISTINGS} SELECT listing_id, zone, bedrooms FROM listings WHERE cast(rent AS decimal(12,2)) <= 150000 AND bedrooms >= 2")
def listing_filter(spark, d):
    return listings(spark, d).where(F.expr("try_cast(rent as decimal(12,2)) <= 150000") & (F.col("bedrooms") >= 2)).select("listing_id", "zone", "bedrooms")


@query(f"WITH {_LISTINGS} SELECT zone, listing_id, n FROM (SELECT zone, listing_id, row_number() OVER (PARTITION BY zone ORDER BY created_at DESC, listing_id) AS n FROM listings) WHERE n <= 5")
def listing_newest(spark, d):
    n = F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("created_at"), "listing_id"))
    return listings(spark, d).select("zone", "listing_id", n.cast("long").alias("n")).where("n <= 5")


@query("""SELECT n_nationkey, n_name FROM (SELECT *, strip_accents(lower(n_name)) AS folded FROM nation) WHERE contains(folded, 'nation_1')
  ORDER BY CASE WHEN starts_with(folded, 'nation_1') THEN 0 ELSE 1 END, n_nationkey LIMIT 10""")
def zone_search(spark, d):
    return search(table(spark, d, "nation"), "n_name", "Natión_1", "n_nationkey", 10).select("n_nationkey", "n_name")


def search(rows, name, term, tie, top):
    """The first rows whose name holds the term, without case or accents; names that start with it come first."""
    folded, wanted = text.fold(F.col(name)), text.fold(F.lit(term))
    return rows.where(folded.contains(wanted)).orderBy(F.when(folded.startswith(wanted), 0).otherwise(1), tie).limit(top)


# Facts, rules and leaves of the coverage queries; see FIXTURES.md, part 3.
RULES = [("R1", "state", 1, False), ("R2", "city", 3, False), ("R3", "state", 2, True), ("R4", "state", 3, False)]
LEAVES = [
    ("R1", 1, "covers", 1, "units", ">=", 5, False),
    ("R1", 1, "covers", 1, "year_built", "<", 1980, False),
    ("R1", 1, "exempts", 1, "flag_affordable", "==", 1, False),
    ("R2", 1, "covers", 1, "units", ">=", 2, False),
    ("R2", 1, "covers", 2, "year_built", ">=", 1995, True),
    ("R3", 1, "covers", 1, "units", ">", 0, False),
    ("R3", 1, "exempts", 1, "flag_affordable", "==", 1, False),
]
_UNITS_LO = "CASE c_custkey % 4 WHEN 2 THEN 5 WHEN 3 THEN NULL ELSE 1 + c_custkey % 40 END"
_UNITS_HI = "CASE WHEN c_custkey % 4 IN (2, 3) THEN NULL ELSE 1 + c_custkey % 40 END"
_YEAR = "CASE WHEN c_custkey % 7 <> 0 THEN 1940 + c_custkey % 85 END"
_FLAG = "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 0 END"


def addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    city = F.when(F.col("c_custkey") % 50 != 0, F.col("c_nationkey"))
    return rows.select(F.col("c_custkey").alias("address"), city.alias("city"), F.col("n_regionkey").alias("state"), F.col("c_nationkey").alias("nation"), F.expr(_UNITS_LO).alias("units_lo"), F.expr(_UNITS_HI).alias("units_hi"), F.expr("c_custkey % 4 <> 3").alias("units_known"), F.expr(_YEAR).alias("year"), F.expr(_FLAG).alias("flag"))


def coverage_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Levels, facts, rules and leaves, as coverage.verdicts() takes them."""
    rows = addresses(spark, d)
    levels = rows.selectExpr("address", "stack(2, 'state', state, 'city', city) as (level, jurisdiction)").where("jurisdiction is not null")
    facts = rows.selectExpr("address", "stack(3, 'units', units_lo, units_hi, units_known, 'year_built', year, year, year is not null, 'flag_affordable', cast(flag as bigint), cast(flag as bigint), flag is not null) as (fact, lo, hi, known)")
    rule = spark.createDataFrame(RULES, "rule_id string, level string, jurisdiction int, presume boolean")
    leaf = spark.createDataFrame(LEAVES, "rule_id string, item int, kind string, conj int, fact string, op string, value long, negated boolean")
    return levels, facts, rule, leaf


def covered(spark: SparkSession, d: str) -> DataFrame:
    return coverage.verdicts(*coverage_inputs(spark, d)).join(addresses(spark, d).select("address", "state"), "address")


_COVERED = f"""facts AS (SELECT c_custkey AS address, CASE WHEN c_custkey % 50 <> 0 THEN c_nationkey END AS city, n_regionkey AS state, {_UNITS_LO} AS lo, {_UNITS_HI} AS hi, c_custkey % 4 <> 3 AS known, {_YEAR} AS yr, {_FLAG} AS flag
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
leaf AS (SELECT *, CASE WHEN known AND lo >= 5 THEN true WHEN known AND hi < 5 THEN false END AS u5, CASE WHEN known AND lo >= 2 THEN true WHEN known AND hi < 2 THEN false END AS u2,
  CASE WHEN known AND lo > 0 THEN true WHEN known AND hi <= 0 THEN false END AS u0, yr < 1980 AS old, yr >= 1995 AS young, flag = 1 AS aff FROM facts),
verdict AS (
  SELECT address, state, 'R1' AS rule_id, CASE WHEN (u5 AND old) IS FALSE THEN 'not_covered' WHEN aff THEN 'exempt' WHEN (u5 AND old) AND aff IS FALSE THEN 'covered' ELSE 'unknown' END AS verdict,
    CASE WHEN (u5 AND old) IS NULL THEN (u5 IS NULL)::int + (old IS NULL)::int ELSE 0 END + CASE WHEN aff IS NULL THEN 1 ELSE 0 END AS miss FROM leaf WHERE state = 1
  UNION ALL SELECT address, state, 'R2', CASE WHEN (u2 OR NOT young) IS FALSE THEN 'not_covered' WHEN (u2 OR NOT young) THEN 'covered' ELSE 'unknown' END,
    (u2 IS NULL)::int + (young IS NULL)::int FROM leaf WHERE city = 3
  UNION ALL SELECT address, state, 'R3', CASE WHEN u0 IS FALSE THEN 'not_covered' WHEN coalesce(aff, false) THEN 'exempt' WHEN u0 THEN 'covered' ELSE 'unknown' END, (u0 IS NULL)::int FROM leaf WHERE state = 2
)"""


@query(f"WITH {_COVERED} SELECT address, rule_id, verdict, CASE WHEN verdict = 'unknown' THEN miss ELSE 0 END::bigint AS n_missing FROM verdict")
def coverage_lookup(spark, d):
    return covered(spark, d).select("address", "rule_id", "verdict", "n_missing")


@query(f"WITH {_COVERED} SELECT state, rule_id, count(*) FILTER (WHERE verdict = 'covered') AS covered, count(*) FILTER (WHERE verdict = 'exempt') AS exempt, count(*) FILTER (WHERE verdict = 'not_covered') AS not_covered, count(*) FILTER (WHERE verdict = 'unknown') AS unknown FROM verdict GROUP BY state, rule_id")
def coverage_summary(spark, d):
    return covered(spark, d).groupBy("state", "rule_id").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("covered", "exempt", "not_covered", "unknown")))


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 3 = 0 END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END AS b FROM customer)
  SELECT c_custkey, a AND b AS k_and, a OR b AS k_or, NOT a AS k_not FROM t""")
def kleene_rowwise(spark, d):
    a, b = F.expr("CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 3 = 0 END"), F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END")
    return table(spark, d, "customer").select("c_custkey", (a & b).alias("k_and"), (a | b).alias("k_or"), (~a).alias("k_not"))


@query("""WITH t AS (SELECT c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal > -900 END AS v FROM customer)
  SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE v IS FALSE) > 0 THEN false WHEN count(*) FILTER (WHERE v IS NULL) = 0 THEN true END AS k_all,
  CASE WHEN count(*) FILTER (WHERE v) > 0 THEN true WHEN count(*) FILTER (WHERE v IS NULL) = 0 THEN false END AS k_any FROM t GROUP BY c_nationkey""")
def kleene_group_all_any(spark, d):
    v = kleene.code(F.expr("CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal > -900 END"))
    out = table(spark, d, "customer").groupBy("c_nationkey").agg(kleene.all_of(v).alias("lo"), kleene.any_of(v).alias("hi"))
    return out.select("c_nationkey", kleene.decode(F.col("lo")).alias("k_all"), kleene.decode(F.col("hi")).alias("k_any"))


@query(f"""WITH t AS (SELECT c_custkey, {_UNITS_LO} AS lo, {_UNITS_HI} AS hi, c_custkey % 4 <> 3 AS known FROM customer)
  SELECT c_custkey, CASE WHEN known AND lo >= 5 THEN true WHEN known AND hi < 5 THEN false END AS ge5, CASE WHEN known AND hi <= 4 THEN true WHEN known AND lo > 4 THEN false END AS le4,
  CASE WHEN known AND lo = 7 AND hi = 7 THEN true WHEN known AND (lo > 7 OR hi < 7) THEN false END AS eq7 FROM t""")
def interval_compare(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.expr(_UNITS_LO).alias("lo"), F.expr(_UNITS_HI).alias("hi"), F.expr("c_custkey % 4 <> 3").alias("known"))
    test = lambda op, v: kleene.compare_interval(F.col("lo"), F.col("hi"), F.col("known"), op, F.lit(v))
    return rows.select("c_custkey", test(">=", 5).alias("ge5"), test("<=", 4).alias("le4"), test("==", 7).alias("eq7"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """A rule per order: enacted, effective and sunset dates, and its stage."""
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("sunset"))
    rows = table(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stage = F.when(F.col("o_orderkey") % 11 == 0, "failed").when(F.col("o_orderstatus") == "P", "pending").otherwise("enacted")
    return rows.select(F.col("o_orderkey").alias("rule"), F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("effective"), "sunset", F.date_sub(F.to_date("o_orderdate"), 90).alias("enacted"), stage.alias("stage"))


_CLAIMS = """claims AS (SELECT o_orderkey AS rule, o_custkey AS owner, o_orderdate::date AS effective, sunset, o_orderdate::date - 90 AS enacted,
  CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'enacted' END AS stage
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate::date) AS sunset FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def _status_sql(day: str) -> str:
    return f"CASE WHEN stage = 'failed' THEN 'failed' WHEN stage = 'pending' THEN 'pending' WHEN enacted > {day} THEN 'pending' WHEN sunset <= {day} THEN 'failed' WHEN effective > {day} THEN 'not_yet_effective' ELSE 'in_force' END"


def _status(day):
    return status.status_at(day, F.col("stage"), F.col("enacted"), F.col("sunset"), F.col("effective"))


@query(f"WITH {_CLAIMS} SELECT rule, {_status_sql('DATE ' + chr(39) + '1998-06-30' + chr(39))} AS status FROM claims")
def status_as_of(spark, d):
    return claims(spark, d).select("rule", _status(F.to_date(F.lit("1998-06-30"))).alias("status"))


@query(f"WITH {_CLAIMS} SELECT owner, coalesce(max(effective) FILTER (WHERE effective <= DATE '1998-06-30'), min(effective)) AS effective, min(effective) <= DATE '1998-06-30' AND max(effective) > DATE '1998-06-30' AS ambiguous FROM claims GROUP BY owner")
def effective_date_as_of(spark, d):
    return status.effective_at(claims(spark, d), ["owner"], "effective", F.to_date(F.lit("1998-06-30")))


@query(f"""WITH {_CLAIMS}, b AS (SELECT rule, {_status_sql("DATE '1996-01-01'")} AS s FROM claims WHERE rule % 3 <> 0), a AS (SELECT rule, {_status_sql("DATE '1998-06-30'")} AS s FROM claims WHERE rule % 5 <> 0)
  SELECT coalesce(b.rule, a.rule) AS rule, coalesce(b.s, 'omitted') AS before, coalesce(a.s, 'omitted') AS after FROM b FULL OUTER JOIN a ON b.rule = a.rule WHERE coalesce(b.s, 'omitted') <> coalesce(a.s, 'omitted')""")
def asof_diff(spark, d):
    at = lambda day: claims(spark, d).withColumn("status", _status(F.to_date(F.lit(day))))
    return status.diff(at("1996-01-01").where("rule % 3 <> 0"), at("1998-06-30").where("rule % 5 <> 0"), ["rule"], "status")


@query(f"""WITH {_CLAIMS}, x AS (SELECT {_status_sql("DATE '1996-01-01'")} AS before, {_status_sql("DATE '1998-06-30'")} AS after FROM claims) SELECT before, after, count(*) AS n FROM x WHERE before <> after GROUP BY 1, 2""")
def change_transitions(spark, d):
    rows = claims(spark, d).select(*(_status(F.to_date(F.lit(day))).alias(name) for name, day in (("before", "1996-01-01"), ("after", "1998-06-30"))))
    return rows.where("before <> after").groupBy("before", "after").agg(F.count("*").alias("n"))


@query(f"""WITH {_CLAIMS}, days AS (SELECT DISTINCT rule, unnest([effective, sunset, enacted]) AS d FROM claims), x AS (SELECT claims.rule, d, {_status_sql("(d - 1)")} AS before, {_status_sql("d")} AS after FROM claims JOIN days ON claims.rule = days.rule WHERE d BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')
  SELECT rule, d, before, after FROM x WHERE before <> after""")
def timeline_events(spark, d):
    own = F.array("effective", "sunset", "enacted")
    rows = claims(spark, d).where("rule is not null").withColumn("days", F.flatten(F.collect_list(own).over(Window.partitionBy("rule"))))
    asked = F.filter("days", lambda x: x.between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    return status.timeline(rows, _status(F.col("as_of")), asked).select("rule", "d", "before", "after")


@query(f"WITH {_CLAIMS} SELECT owner, min(effective) FILTER (WHERE effective > DATE '1998-06-30') AS next_change FROM claims GROUP BY owner")
def next_change(spark, d):
    return claims(spark, d).groupBy("owner").agg(F.min(F.when(F.col("effective") > "1998-06-30", F.col("effective"))).alias("next_change"))


@query("SELECT o_orderkey, make_date(year(o_orderdate) + 1, 1, 1) AS effective FROM orders WHERE o_orderpriority NOT LIKE '%URGENT%'")
def calendar_default(spark, d):
    return table(spark, d, "orders").where(~F.col("o_orderpriority").contains("URGENT")).select("o_orderkey", F.make_date(F.year("o_orderdate") + 1, F.lit(1), F.lit(1)).alias("effective"))


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def quote_exact(spark, d):
    found = quotes.quotes_found(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return found.select(F.col("source_id").alias("doc_id"), F.col("quote_id").alias("item_id"))


def _form_sql(c: str) -> str:
    return f"lower(trim(regexp_replace(translate({c}, '‘’“”–—', '''''\"\"--'), '\\s+', ' ', 'g')))"


@query(f"SELECT doc_id, item_id FROM (SELECT doc_id, {_form_sql('text')} AS t FROM documents) JOIN (SELECT item_id, {_form_sql('text')} AS q FROM benchmark) ON contains(t, q)")
def quote_fold(spark, d):
    form = lambda df, key: df.select(F.col(key).alias("id"), text.quote_form(F.col("text"), True).alias("text"))
    found = quotes.quotes_found(form(table(spark, d, "documents"), "doc_id"), form(table(spark, d, "benchmark"), "item_id"))
    return found.select(F.col("source_id").alias("doc_id"), F.col("quote_id").alias("item_id"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) = 1 AS ok FROM documents")
def duplicates_poisoned(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("a"), F.sha2("text", 256).alias("b"))
    return rules.poison_duplicates(docs, ["a", "b"]).select("doc_id", "ok")


@query("SELECT min(doc_id) AS doc_id, n_chars FROM documents GROUP BY text, n_chars")
def first_wins_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256), "n_chars").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "n_chars")


@query("SELECT s_suppkey, n_regionkey::varchar || '-' || s_nationkey::varchar || '-H' || format('{:02d}', row_number() OVER (PARTITION BY n_regionkey, s_nationkey ORDER BY s_name, s_suppkey)) AS rule_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def assign_ids(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rules.assign_ids(rows, ["n_regionkey", "s_nationkey"], ["s_name", "s_suppkey"]).select("s_suppkey", "rule_id")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)
  SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice""")
def rule_diff_new_modified_removed(spark, d):
    rows = table(spark, d, "orders")
    new = rows.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return rules.compare_sets(rows.where("o_orderkey % 7 <> 0"), new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""WITH e AS (SELECT *, lag(text) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  h AS (SELECT *, CASE WHEN turn = 2 AND conv_id % 3 = 0 THEN 'x' ELSE sha256(coalesce(p, '') || ':' || text) END AS claimed, sha256(coalesce(p, '') || ':' || text) AS sha FROM e)
  SELECT conv_id, turn, min(CASE WHEN claimed = sha THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1 AS valid FROM h""")
def evidence_chain_status(spark, d):
    links = evidence.link_hashes(table(spark, d, "conversations"), "conv_id", "turn", "text")
    broken = F.when((F.col("turn") == 2) & (F.col("conv_id") % 3 == 0), F.lit("x")).otherwise(F.col("sha"))
    links = links.withColumn("claimed", broken).withColumn("claimed_prev", F.col("prev_sha")).drop("sha", "prev_sha")
    return evidence.chain_status(links, "conv_id", "turn", "text", "claimed", "claimed_prev").select("conv_id", "turn", "valid")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def kv_latest_wins(spark, d):
    return rules.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[]' WHEN 2 THEN 'null' WHEN 3 THEN '{' ELSE props END AS p FROM events)
  SELECT event_id, json_valid(p) AND coalesce(json_type(CASE WHEN json_valid(p) THEN p END), '') = 'OBJECT' AS usable FROM e""")
def kv_corrupt_dropped(spark, d):
    lines = table(spark, d, "events").select("event_id", F.expr("CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[]' WHEN 2 THEN 'null' WHEN 3 THEN '{' ELSE props END").alias("p"))
    return json_records(lines, "p").select("event_id", "usable")


@query("SELECT coalesce(r_name, 'ALL') AS state, coalesce(c_mktsegment, 'ALL') AS category, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)")
def facts_matrix_cube(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.cube("r_name", "c_mktsegment").agg(F.count("*").alias("n")).select(F.coalesce("r_name", F.lit("ALL")).alias("state"), F.coalesce("c_mktsegment", F.lit("ALL")).alias("category"), "n")


@query("SELECT doc_id, line_no, start FROM (SELECT doc_id, i AS line_no, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))")
def line_offsets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), start.cast("long").alias("start"))


@query("SELECT doc_id, regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._-]*@([A-Za-z0-9.-]+)', '\\1***@\\2', 'g') AS masked FROM documents WHERE contains(text, '@')")
def mask_email(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", text.mask_email(F.col("text")).alias("masked"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sha FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("sha"))


@query("""WITH split AS (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line FROM documents),
  added AS (SELECT doc_id, n_chars::bigint AS total, (sum(length(line)) + count(*) - 1)::bigint AS parts FROM split GROUP BY doc_id, n_chars)
  SELECT doc_id, total, parts, total = parts AS ok FROM added""")
def conservation_check(spark, d):
    """Whether the lines of a document account for the characters that its row states."""
    lines = table(spark, d, "documents").select("doc_id", "n_chars", F.split("text", "\n").alias("lines"))
    parts = F.aggregate("lines", F.size("lines").cast("long") - 1, lambda n, x: n + F.length(x))
    return lines.select("doc_id", F.col("n_chars").cast("long").alias("total"), parts.alias("parts"), (F.col("n_chars") == parts).alias("ok"))


@query("SELECT labels.doc_id, quality, toxic, lang FROM labels JOIN documents ON labels.doc_id = documents.doc_id WHERE quality = 0 OR toxic = 1")
def label_review_flags(spark, d):
    return table(spark, d, "labels").where("quality = 0 or toxic = 1").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "quality", "toxic", "lang")


@query(None)
def token_bucket_decisions(spark, d):
    return token_bucket.decide(table(spark, d, "events"), "user_id", "ts", "event_id")


# Rules of the precedence queries: number, id, coverage of its own, base citation, category, status, confidence.
LAWS = [
    (1, "A", False, "S1", "rent", "in_force", 0.9), (2, "B", False, "S1", "rent", "in_force", 0.8), (3, "C", True, "S2", "evict", "in_force", 0.0),
    (4, "D", True, "L1", "rent", "in_force", 0.95), (5, "E", False, "L2", "evict", "in_force", 0.55), (6, "F", True, "L3", "rent", "pending", 0.7), (7, "G", False, "L4", "fees", "in_force", None),
]
OTHER_LAW, DEPENDS, YIELDS, PAIRS = {"A": ["D", "F"], "C": ["E"]}, {"G": ["D"]}, {"C": ["D", "E"], "E": ["D"]}, [("A", "D"), ("C", "E")]
_REACHES = "CASE (address * rule_ord + rule_ord) % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'not_covered' WHEN 2 THEN CASE WHEN address % 3 = 0 THEN 'exempt' ELSE 'unknown' END ELSE 'covered' END"


def _values(edges) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in edges.items() for b in bs) + ") v(src, dst)"


def _give_way(new: str, old: str, edges, basis: str) -> str:
    """One pass of giving way, as joins."""
    return f"""{new}_c AS (SELECT s.address, s.rule_id, min((t.result <> 'applies')::int::varchar || (NOT t.own)::int::varchar || t.rule_id) FILTER (WHERE t.verdict = 'covered') AS best,
    list(t.rule_id ORDER BY t.rule_id) FILTER (WHERE t.verdict = 'unknown') AS maybe
  FROM {old} s JOIN {_values(edges)} ON s.rule_id = src JOIN {old} t ON t.address = s.address AND t.rule_id = dst WHERE t.status = 'in_force' AND t.result IS NOT NULL AND s.result IN ('applies', 'unknown') GROUP BY 1, 2),
{new} AS (SELECT {old}.* REPLACE (CASE WHEN best IS NOT NULL THEN 'superseded' ELSE result END AS result, coalesce(best[3:], superseded_by) AS superseded_by, CASE WHEN best IS NOT NULL THEN '{basis}' ELSE basis END AS basis,
    CASE WHEN best IS NULL THEN list_distinct(may || coalesce(maybe, [])) ELSE may END AS may) FROM {old} LEFT JOIN {new}_c USING (address, rule_id))"""


def _passes(other_law, depends, yields, pairs) -> str:
    """The passes as joins, from f (the entries) to p6."""
    both_ways = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in pairs)
    return f"""p0 AS (SELECT *, CASE WHEN verdict IN ('not_covered', 'exempt') OR status = 'failed' THEN NULL WHEN status IN ('pending', 'not_yet_effective') THEN status WHEN verdict = 'covered' THEN 'applies' ELSE 'unknown' END AS result,
  NULL::varchar AS superseded_by, NULL::varchar AS basis, []::varchar[] AS may FROM f),
{_give_way("p1", "p0", other_law, "other_law")},
p2_c AS (SELECT s.address, s.rule_id, bool_or(coalesce(t.result = 'applies', false)) AS via, bool_or(coalesce(t.result IS NOT NULL AND (t.result = 'unknown' OR t.verdict = 'unknown'), false)) AS undecided
  FROM p1 s JOIN {_values(depends)} ON s.rule_id = src LEFT JOIN p1 t ON t.address = s.address AND t.rule_id = dst GROUP BY 1, 2),
p2 AS (SELECT p1.* REPLACE (CASE WHEN via IS NULL OR via THEN result WHEN undecided AND result = 'applies' THEN 'unknown' WHEN undecided THEN result END AS result) FROM p1 LEFT JOIN p2_c USING (address, rule_id)),
{_give_way("p3", "p2", yields, "overrides")},
p4_c AS (SELECT s.address, s.rule_id, min(t.rule_id) FILTER (WHERE t.own) AS b1, min(t.rule_id) AS b2
  FROM p3 s JOIN (SELECT * FROM {_values(other_law)} UNION SELECT * FROM {_values(yields)}) ON s.rule_id = src JOIN p3 t ON t.address = s.address AND t.rule_id = dst
  JOIN p3 u ON u.address = s.address AND u.rule_id = s.superseded_by WHERE u.result IS DISTINCT FROM 'applies' AND t.status = 'in_force' AND t.result = 'applies' AND t.verdict = 'covered' GROUP BY 1, 2),
p4 AS (SELECT p3.* REPLACE (CASE WHEN result = 'superseded' THEN coalesce(b1, b2, superseded_by) ELSE superseded_by END AS superseded_by) FROM p3 LEFT JOIN p4_c USING (address, rule_id)),
p5_c AS (SELECT s.address, s.rule_id, arg_min(t.rule_id, t.rule_ord) AS kin, arg_min(t.superseded_by, t.rule_ord) AS over FROM p4 s JOIN p4 t ON t.address = s.address AND t.base = s.base AND t.category = s.category AND t.rule_id <> s.rule_id
  WHERE t.result = 'superseded' AND s.result IN ('applies', 'unknown') AND s.status = 'in_force' GROUP BY 1, 2),
p5 AS (SELECT p4.* REPLACE (CASE WHEN kin IS NULL THEN result ELSE 'superseded' END AS result, coalesce(over, superseded_by) AS superseded_by, coalesce('same_law:' || kin, basis) AS basis) FROM p4 LEFT JOIN p5_c USING (address, rule_id)),
p6 AS (SELECT s.*, EXISTS (SELECT 1 FROM p5 t JOIN (VALUES {both_ways}) v(a, b) ON t.rule_id = v.b WHERE t.address = s.address AND v.a = s.rule_id AND t.result IS NOT NULL) AS conflict FROM p5 s WHERE s.result IS NOT NULL)"""


_PRECEDENCE = f"""WITH laws AS (SELECT * FROM (VALUES {", ".join(str(x).replace("None", "NULL") for x in LAWS)}) l(rule_ord, rule_id, own, base, category, status, confidence)),
e AS (SELECT c_custkey AS address, c_custkey % 50 = 0 AS fallback, laws.* FROM customer, laws), f AS (SELECT *, {_REACHES} AS verdict FROM e),
{_passes(OTHER_LAW, DEPENDS, YIELDS, PAIRS)}"""


def precedence_rows(spark: SparkSession, d: str) -> DataFrame:
    law = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("rule_ord", "rule_id", "own", "base", "category", "status"), x, strict=False)), F.lit(x[-1]).cast("double").alias("confidence")) for x in LAWS]
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("address"), (F.col("c_custkey") % 50 == 0).alias("fallback"), F.explode(F.array(*law)).alias("law")).select("address", "fallback", "law.*")
    rows = rows.withColumn("verdict", F.expr(_REACHES)).withColumn("coverage_confidence", F.when(F.col("verdict") == "unknown", 0.8).otherwise(1.0))
    edges = [(kind, a, b) for kind, of in (("other_law", OTHER_LAW), ("depends", DEPENDS), ("yields", YIELDS)) for a, bs in of.items() for b in bs]
    return precedence.resolve(rows, spark.createDataFrame([*edges, *(("preempts", a, b) for a, b in PAIRS)], "kind string, source string, target string"))


@query(_PRECEDENCE + """ SELECT address, rule_id, result, superseded_by, basis, list_aggregate(list_sort(may), 'string_agg', ',') AS may_yield_to, conflict FROM p6""")
def precedence_superseded(spark, d):
    may = F.when(F.size("may_yield_to") > 0, F.array_join(F.array_sort("may_yield_to"), ","))
    return precedence_rows(spark, d).select("address", "rule_id", "result", "superseded_by", "basis", may.alias("may_yield_to"), "conflict")


@query(_PRECEDENCE + """, c AS (SELECT address, rule_id, round(CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0 ELSE confidence::double END * CASE WHEN verdict = 'unknown' THEN 0.8 ELSE 1.0 END::double * CASE WHEN fallback THEN 0.85 ELSE 1.0 END::double, 3) AS confidence FROM p6)
  SELECT address, rule_id, confidence, confidence < 0.5 AS needs_review FROM c""")
def confidence_product(spark, d):
    return precedence_rows(spark, d).select("address", "rule_id", "confidence", "needs_review")


@query("""WITH RECURSIVE m AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey - n_nationkey % 4 // 2 - 1 END AS nxt FROM nation),
  walk AS (SELECT k, k AS last FROM m UNION ALL SELECT walk.k, m.nxt FROM walk JOIN m ON m.k = walk.last WHERE m.nxt IS NOT NULL)
  SELECT k, last FROM walk WHERE last IN (SELECT k FROM m WHERE nxt IS NULL)""")
def merge_chain_follow(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(k.alias("k"), F.when(k % 4 != 0, k - F.floor((k % 4) / 2).cast("int") - 1).alias("into"))
    return merging.follow(rows, "k", "into")


@query(None)
def merge_clusters(spark, d):
    value, day = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") % 5), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") % 3)
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", value.alias("key_value"), day.alias("effective"))
    return merging.merge_clusters(rows, ["p_brand"], "p_type", "key_value", "effective", "p_partkey")


@query(f"""WITH w AS (SELECT [{", ".join(f"'{w}'" for w in spanish.spelled())}] AS w), o AS (SELECT o_orderkey, o_totalprice::decimal(18,2) AS a, floor(o_totalprice::decimal(18,2))::bigint AS p FROM orders)
  SELECT o_orderkey, upper(CASE WHEN p = 0 THEN 'cero' ELSE concat_ws(' ', CASE WHEN p // 1000000 = 1 THEN 'un millón' WHEN p // 1000000 > 1 THEN w[p // 1000000 + 1] || ' millones' END,
    CASE WHEN p // 1000 % 1000 = 1 THEN 'mil' WHEN p // 1000 % 1000 > 1 THEN w[p // 1000 % 1000 + 1] || ' mil' END, CASE WHEN p % 1000 > 0 THEN w[p % 1000 + 1] END) END
    || CASE WHEN p >= 1000000 AND p % 1000000 = 0 THEN ' de' ELSE '' END || ' pesos ' || lpad(((a - p) * 100)::int::varchar, 2, '0') || '/100 M.N.') AS words FROM o, w""")
def money_words(spark, d):
    return table(spark, d, "orders").select("o_orderkey", spanish.money_words(F.col("o_totalprice")).alias("words"))


_CITE = "concat('§ ', p_partkey, CASE p_size % 4 WHEN 0 THEN '(a)(1)' WHEN 1 THEN '.G' WHEN 2 THEN ' (b)' ELSE '.12' END)"


@query(f"SELECT p_partkey, regexp_replace(regexp_replace({_CITE}, '\\s*(\\([A-Za-z0-9]+\\))+$', ''), '\\.[A-Z]$', '') AS base FROM part")
def citation_base(spark, d):
    return table(spark, d, "part").select("p_partkey", text.base_citation(F.expr(_CITE)).alias("base"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & Co. § 4'), '[^a-z0-9§.]+', ' ', 'g')) AS name FROM part")
def name_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.plain_name(F.concat("p_name", F.lit(" & Co. § 4"))).alias("name"))


_DESC = "concat(p_size, 'S-F', CASE WHEN p_partkey % 4 <> 0 THEN concat('-', p_partkey % 30, 'U') ELSE '' END, CASE p_partkey % 8 WHEN 1 THEN concat('/2F-', p_size, 'U') WHEN 3 THEN '-1OU' WHEN 4 THEN '-3UG' ELSE '-H' END)"


@query(f"SELECT p_partkey, list_sum(list_transform(regexp_extract_all({_DESC}, '(?:^|[-/ ])([0-9][0-9O]*)U\\b', 1), lambda x: replace(x, 'O', '0')::bigint))::bigint AS units FROM part")
def parse_units_desc(spark, d):
    return table(spark, d, "part").select("p_partkey", text.units_in(F.expr(_DESC)).alias("units"))


@query("""WITH t AS (SELECT doc_id, text, left(text, 100) || CASE WHEN doc_id % 3 = 0 THEN ' 987654' ELSE '' END AS s FROM documents)
  SELECT doc_id, len(list_filter(regexp_extract_all(s, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(text, '[0-9]+'), x))) = 0 AS kept FROM t""")
def figure_guard(spark, d):
    summary = F.concat(F.substring("text", 1, 100), F.when(F.col("doc_id") % 3 == 0, " 987654").otherwise(""))
    return table(spark, d, "documents").select("doc_id", text.figures_kept(summary, F.col("text")).alias("kept"))
