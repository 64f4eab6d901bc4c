"""Source divergence audit: how far the word use of each source lies from the others and from its language.

Plain relational work. Terms are exploded and counted by language, source and term in one aggregation with
map-side sums; the kept vocabulary of a language is crossed with the groups of the language, which makes
absent terms zeros; the dense profile joins itself on language and term; sums and window ranks follow.

The cross is a hash join on language and a salt of the term: the groups (few) are repeated once a salt, so
a language that holds most of the vocabulary is dealt over all tasks. Terms that a row repeats are marked in
the row, so documents need no second pass to be counted. Whole numbers run as decimals where they may
pass 64 bits.

Defined results: null text, language and source read as ''; a term is a run of letters A-Z (lower-cased) and
characters beyond ASCII; rows of one id are documents of their own; a group without any term still has its
pairs (0 where the language keeps no term); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound, few_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of characters that are no ASCII signs, digits or blanks.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What lies between terms: cutting a text there takes less time than finding each term, and leaves an empty one at its ends.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that hold a kept term, what is added to each count, the scale, and ranks of terms.
LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, no other letter. Texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.sort_array(F.array_remove(F.split(text, BETWEEN), "")).alias("terms"))
    mark = lambda terms: F.transform(terms, lambda t, i: F.struct(t.alias("term"), F.when((i > 0) & (F.get(terms, i - 1) == t), 0).otherwise(1).alias("first")))
    each = rows.select("lang", "source", F.explode(bound(F.col("terms"), mark)).alias("t"))
    return each.groupBy("lang", "source", F.col("t.term").alias("term")).agg(F.count("*").alias("n"), F.sum("t.first").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exact."""
    whole = lambda x: x.cast("decimal(25,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * whole(count + ADDED)
    return F.call_function("div", top, whole(total + ADDED * terms)) + 1


def profiles(counts: DataFrame, groups: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, p, q) of every group of groups and every kept term of its language.

    counts as from term_counts() and groups (lang, source), both written.
    """
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "total")
    kept = scratch.keep(kept, "kept")
    langs = scratch.keep(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total")), "langs")
    salts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dense = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    filled = dense.join(counts.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    filled = scratch.keep(filled, "dense")
    totals = scratch.keep(filled.groupBy("lang", "source").agg(F.sum("n").alias("group_total")), "totals")
    known = filled.join(few_broadcast(totals), ["lang", "source"]).join(few_broadcast(langs), "lang")
    return known.select("lang", "source", "term", "n", _share(F.col("n"), F.col("group_total"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: per group the distance to every other source (part pair) and
    the terms it uses more than its language does (part term, ranks to top)."""
    scratch = Scratch(docs.sparkSession, "divergence")
    groups = scratch.keep(docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct(), "groups")
    profile = scratch.keep(profiles(scratch.keep(term_counts(docs), "counts"), groups, scratch, least_docs), "profile")
    near, far = (profile.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}")) for s in ("a", "b"))
    apart = near.join(far, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("p_a") - F.col("p_b"))).alias("value"))
    sums = apart.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = profile.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", order).union(terms.withColumn("rank", order).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


#: The audit of documents as DuckDB SQL.
SQL = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
  o AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
  g AS (SELECT DISTINCT lang, source FROM d),
  k AS (SELECT lang, term, count(*)::hugeint AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
  l AS (SELECT lang, count(*)::hugeint AS terms, sum(n)::hugeint AS total FROM k GROUP BY lang),
  c AS (SELECT lang, source, term, count(*)::hugeint AS n FROM o GROUP BY lang, source, term),
  e AS (SELECT lang, source, term, k.n AS lang_n, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
  t AS (SELECT lang, source, sum(n)::hugeint AS total FROM e GROUP BY lang, source),
  p AS (SELECT lang, source, term, n, 1 + ({SCALE} * (n + {ADDED})) // (t.total + {ADDED} * l.terms) AS p, 1 + ({SCALE} * (lang_n + {ADDED})) // (l.total + {ADDED} * l.terms) AS q FROM e JOIN t USING (lang, source) JOIN l USING (lang)),
  s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  x AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0)::bigint AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
  y AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::bigint AS value FROM p WHERE n > 0 AND p > q),
  z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM (SELECT * FROM x UNION ALL SELECT * FROM y))
  SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= {TOP}"""
