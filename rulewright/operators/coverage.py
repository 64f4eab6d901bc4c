"""Which rules cover which addresses, in three-valued logic over interval-valued facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kleene import code, compare_interval, negate_code


def leaf_results(levels: DataFrame, facts: DataFrame, rules: DataFrame, leaves: DataFrame) -> DataFrame:
    """A row per address, rule that reaches it and leaf of the rule, with r: 0, 1 or 2 for false, unknown and true;
    presumed and ranged: whether r rests on a presumption, or was asked of a fact known as a range only."""
    pairs = levels.join(rules, ["level", "jurisdiction"]).select("address", "rule_id", "presume")
    asked = pairs.join(leaves, "rule_id").join(facts, ["address", "fact"], "left")
    plain = code(compare_interval(F.col("lo"), F.col("hi"), F.coalesce("known", F.lit(False)), F.col("op"), F.col("value")))
    guess = (plain == 1) & F.coalesce("presume", F.lit(False)) & F.col("fact").startswith("flag_")
    presumed = F.when(guess, 0).otherwise(plain)
    ranged = F.coalesce("known", F.lit(False)) & ~F.col("lo").eqNullSafe(F.col("hi"))
    return asked.withColumns({"r": F.when(F.col("negated"), negate_code(presumed)).otherwise(presumed), "presumed": guess, "ranged": ranged})


def verdicts(levels: DataFrame, facts: DataFrame, rules: DataFrame, leaves: DataFrame) -> DataFrame:
    """(address, rule_id, verdict, n_missing): conditions and exemptions decided, or unknown.

    levels: (address, level, jurisdiction); facts: (address, fact, lo, hi, known), one row per fact;
    rules: (rule_id, level, jurisdiction, presume); leaves: (rule_id, item, kind covers or exempts, conj,
    fact, op, value, negated), a disjunction of items of disjunctions of conjunctions. presume: a special
    flag that is not known counts as false. Rules and leaves are small against addresses and join by hash.
    """
    return _decided(leaf_results(levels, facts, rules, leaves)).select("address", "rule_id", "verdict", "n_missing")


def reasoned(levels: DataFrame, facts: DataFrame, rules: DataFrame, leaves: DataFrame) -> DataFrame:
    """(address, rule_id, verdict, n_missing, because, coverage_confidence) of every rule that reaches an address.

    A rule without leaves covers all that it reaches. because: the facts that decide the verdict, sorted, or that leave it
    open. A fact known as a range, and a presumption that a decided verdict rests on, weaken it to nine tenths each.
    """
    asked = leaf_results(levels, facts, rules, leaves)
    seen = asked.groupBy("address", "rule_id").agg(F.bool_or("ranged").alias("ranged"), F.bool_or("presumed").alias("presumed"), F.collect_set(F.struct("kind", "r", "fact")).alias("seen"))
    found = _decided(asked).join(seen, ["address", "rule_id"])
    of = lambda kind, r: F.filter("seen", lambda x: (x["kind"] == kind) & (x["r"] == r))
    none = F.filter("seen", lambda x: F.lit(False))
    open_ = F.concat(F.when(F.col("c") == 1, of("covers", 1)).otherwise(none), F.when(F.col("e") == 1, of("exempts", 1)).otherwise(none))
    picked = F.when(F.col("verdict") == "not_covered", of("covers", 0)).when(F.col("verdict") == "exempt", of("exempts", 2)).when(F.col("verdict") == "covered", of("covers", 2)).otherwise(open_)
    tenth = lambda weak: F.when(weak, 0.9).otherwise(1.0)
    weight = tenth(F.col("ranged")) * tenth(F.col("presumed") & F.col("verdict").isin("covered", "not_covered"))
    found = found.select("address", "rule_id", "verdict", "n_missing", F.array_sort(F.array_distinct(F.transform(picked, lambda x: x["fact"]))).alias("because"), weight.alias("coverage_confidence"))
    reached = levels.join(rules, ["level", "jurisdiction"]).select("address", "rule_id")
    given = {"verdict": F.lit("covered"), "n_missing": F.lit(0).cast("long"), "because": F.array().cast("array<string>"), "coverage_confidence": F.lit(1.0)}
    return reached.join(found, ["address", "rule_id"], "left").select("address", "rule_id", *(F.coalesce(c, v).alias(c) for c, v in given.items()))


def _decided(asked: DataFrame) -> DataFrame:
    items = asked.groupBy("address", "rule_id", "kind", "item", "conj").agg(F.min("r").alias("r"), F.count_if(F.col("r") == 1).alias("u"))
    items = items.groupBy("address", "rule_id", "kind", "item").agg(F.max("r").alias("r"), F.sum("u").alias("u"))
    side = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("r")))
    missing = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("u"))), F.lit(0))
    decided = items.groupBy("address", "rule_id").agg(F.coalesce(side("covers", F.min), F.lit(2)).alias("c"), F.coalesce(side("exempts", F.max), F.lit(0)).alias("e"), missing("covers").alias("uc"), missing("exempts").alias("ue"))
    verdict = F.when(F.col("c") == 0, "not_covered").when(F.col("e") == 2, "exempt").when((F.col("c") == 2) & (F.col("e") == 0), "covered").otherwise("unknown")
    open_facts = F.when(F.col("c") == 1, F.col("uc")).otherwise(0) + F.when(F.col("e") == 1, F.col("ue")).otherwise(0)
    return decided.select("address", "rule_id", "c", "e", verdict.alias("verdict"), F.when(verdict == "unknown", open_facts).otherwise(0).cast("long").alias("n_missing"))


def missing_facts(levels: DataFrame, facts: DataFrame, rules: DataFrame, leaves: DataFrame) -> DataFrame:
    """(address, rule_id, fact), each once: facts whose absence leaves a side of an unknown verdict undecided."""
    asked = leaf_results(levels, facts, rules, leaves)
    open_ = _decided(asked).where("verdict = 'unknown'").select("address", "rule_id", "c", "e")
    of_side = ((F.col("kind") == "covers") & (F.col("c") == 1)) | ((F.col("kind") == "exempts") & (F.col("e") == 1))
    return asked.where("r = 1").join(open_, ["address", "rule_id"]).where(of_side).select("address", "rule_id", "fact").distinct()
