"""Registered queries that decide nested conditions and hold quotes against their sources, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import predicates, quotes
from ..sources.readers import table
from . import queries as base
from .queries import query

CONDITIONS = {
    "P1": {"or": [{"and": [{"fact": "units", "op": ">=", "value": 5}, {"not": {"fact": "year_built", "op": ">=", "value": 1980}}]}, {"fact": "flag_affordable", "op": "==", "value": True}]},
    "P2": {"not": {"or": [{"fact": "units", "op": "<", "value": 3}, {"and": [{"fact": "year_built", "op": "in", "value": [1950, 1960, 1970]}, {"const": True}]}]}},
    "P3": {"and": [{"missing": "owner"}, {"fact": "units", "op": ">=", "value": 2}]},
    "P4": {"and": [{"or": [{"not": {"and": [{"fact": "year_built", "op": "<", "value": 1990}, {"not": {"fact": "segment", "op": "in", "value": ["BUILDING", "MACHINERY"]}}]}}, {"const": False}]}, {"fact": "segment", "op": "!=", "value": "FURNITURE"}]},
}


@query(f"""WITH a AS (SELECT c_custkey AS address, {base._UNITS_LO} AS lo, {base._UNITS_HI} AS hi, c_custkey % 4 <> 3 AS known, {base._YEAR} AS y, {base._FLAG} AS flag, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg FROM customer),
  b AS (SELECT *, CASE WHEN known AND lo >= 5 THEN true WHEN known AND hi < 5 THEN false END AS u5, CASE WHEN known AND hi < 3 THEN true WHEN known AND lo >= 3 THEN false END AS below3, CASE WHEN known AND lo >= 2 THEN true WHEN known AND hi < 2 THEN false END AS u2 FROM a)
  SELECT address, 'P1' AS rule_id, (u5 AND NOT y >= 1980) OR flag = 1 AS holds FROM b UNION ALL SELECT address, 'P2', NOT (below3 OR (y IN (1950, 1960, 1970) AND true)) FROM b
  UNION ALL SELECT address, 'P3', NULL::boolean AND u2 FROM b UNION ALL SELECT address, 'P4', (NOT (y < 1990 AND NOT seg IN ('BUILDING', 'MACHINERY')) OR false) AND seg <> 'FURNITURE' FROM b""")
def predicate_tree(spark, d):
    """Nested conditions, decided for every address."""
    segment = table(spark, d, "customer").select(F.col("c_custkey").alias("address"), F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment"))
    rows = base.addresses(spark, d).join(segment, "address")
    stacked = "stack(4, 'units', if(units_known, double(units_lo), null), double(units_hi), null, 'year_built', double(year), double(year), null, 'flag_affordable', double(flag), double(flag), null, 'segment', null, null, segment) as (fact, lo, hi, word)"
    facts = rows.selectExpr("address", stacked).where("lo is not null or word is not null")
    rules = spark.createDataFrame([(k, json.dumps(v)) for k, v in CONDITIONS.items()], "rule_id string, condition string")
    pairs = rows.select("address", F.explode(F.array(*map(F.lit, CONDITIONS))).alias("rule_id"))
    return predicates.decided(pairs, predicates.nodes(rules).cache(), facts, "address")


_CLAIM = "substring(text, (41 + doc_id % 50)::int, (60 + doc_id % 40)::int)"
_QUOTED = f"CASE doc_id % 4 WHEN 0 THEN {_CLAIM} WHEN 1 THEN replace({_CLAIM}, ' ', ' ' || chr(10) || ' ') WHEN 2 THEN replace(replace(replace({_CLAIM}, '-', '—'), chr(39), '’'), ' ', '  ') ELSE reverse({_CLAIM}) END"
_SIGNS = "'“”‘’–—', '\"\"' || chr(39) || chr(39) || '--'"


@query(rf"""WITH a AS (SELECT doc_id, text, regexp_replace({_QUOTED}, '^\s+|\s+$', '', 'g') AS q FROM documents WHERE length(text) >= 200),
  b AS (SELECT *, translate(text, {_SIGNS}) AS t2, translate(q, {_SIGNS}) AS q2, instr(text, q) AS pos FROM a),
  p AS (SELECT *, regexp_replace(regexp_replace(q, '([^\p{{L}}\p{{N}}\s])', '\\\1', 'g'), '\s+', '\\s+', 'g') AS p1, regexp_replace(regexp_replace(q2, '([^\p{{L}}\p{{N}}\s])', '\\\1', 'g'), '\s+', '\\s+', 'g') AS p2 FROM b),
  r AS (SELECT *, regexp_extract(text, '(?s)^(.*?)(' || p1 || ')', 1) AS a1, regexp_extract(text, '(?s)^(.*?)(' || p1 || ')', 2) AS b1, regexp_extract(t2, '(?s)^(.*?)(' || p2 || ')', 1) AS a2, regexp_extract(t2, '(?s)^(.*?)(' || p2 || ')', 2) AS b2 FROM p),
  s AS (SELECT doc_id, text, CASE WHEN q = '' THEN NULL WHEN pos > 0 THEN 'exact' WHEN b1 <> '' OR b2 <> '' THEN 'normalized' END AS match, CASE WHEN q = '' THEN NULL WHEN pos > 0 THEN pos - 1 WHEN b1 <> '' THEN length(a1) WHEN b2 <> '' THEN length(a2) END AS s, CASE WHEN pos > 0 THEN length(q) WHEN b1 <> '' THEN length(b1) ELSE length(b2) END AS n FROM r)
  SELECT doc_id, match, s::int AS raw_start, (s + n)::int AS raw_end, sha256(substring(text, (s + 1)::int, n::int)) AS raw_sha FROM s""")
def quote_spans(spark, d):
    """Quotes of documents as they are, with other white space, with other signs, and reversed: where they stand."""
    docs = table(spark, d, "documents").where("length(text) >= 200")
    claims = docs.select("doc_id", F.col("doc_id").alias("source_id"), F.expr(_QUOTED).alias("quote"))
    found = quotes.located(claims, docs.select(F.col("doc_id").alias("id"), "text"))
    return found.select("doc_id", "match", "raw_start", "raw_end", F.sha2("raw_text", 256).alias("raw_sha"))


@query(None)
def quote_fuzzy(spark, d):
    """Quotes with a letter left out and one replaced: the place most like them."""
    docs = table(spark, d, "documents").where("length(text) >= 200")
    cut = F.expr(_CLAIM)
    spoiled = F.concat(F.substring(cut, 1, 10), F.substring(cut, 12, 18), F.lit("~"), F.substring(cut, 31, 70))
    found = quotes.located(docs.select("doc_id", F.col("doc_id").alias("source_id"), spoiled.alias("quote")), docs.select(F.col("doc_id").alias("id"), "text"))
    return found.select("doc_id", "match", "raw_start", "raw_end", "raw_text", "score")
