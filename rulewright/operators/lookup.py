"""The rules of an address at a day, from coverage to result, and how each result came about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import coverage, precedence
from .sizes import small
from .status import status_at

_KEPT = ("level", "effective", "n_missing", "because")


def _entries(levels: DataFrame, facts: DataFrame, rules: DataFrame, leaves: DataFrame, fallback: DataFrame, as_of: Column) -> DataFrame:
    reach = coverage.reasoned(levels, facts, small(rules.select("rule_id", "level", "jurisdiction", "presume")), small(leaves))
    dated = rules.withColumn("status", status_at(as_of, F.col("stage"), F.col("enacted"), F.col("sunset"), F.col("effective")))
    known = dated.select("rule_id", "rule_ord", "own", "base", "category", "status", "confidence", "level", "effective")
    return reach.join(small(known), "rule_id").join(fallback.select("address", F.lit(True).alias("fallback")).distinct(), "address", "left").fillna(False, ["fallback"])


def _resolved(levels, facts, rules, leaves, edges, fallback, as_of, steps: bool) -> DataFrame:
    rows = _entries(levels, facts, rules, leaves, fallback, as_of)
    return precedence.resolve(rows, edges, steps, ("category", "status", "verdict", *_KEPT))


def lookup(levels: DataFrame, facts: DataFrame, rules: DataFrame, leaves: DataFrame, edges: DataFrame, fallback: DataFrame, as_of: Column, categories: Sequence[str]) -> DataFrame:
    """Every rule with a result at an address: precedence.resolve()'s columns, category, level, status, effective, verdict,
    n_missing, because and place (long, from 1).

    levels, facts and leaves: as for coverage.verdicts(). rules: (rule_id, rule_ord, level, jurisdiction, presume, category,
    own, base, confidence, stage, enacted, sunset, effective). edges: as from laws.edges(). fallback: the addresses placed by
    their data set's city only. place orders an address's rules by category as listed (others last, by name), a city's before
    its state's, then by id. An address that no rule reaches has no row.
    """
    found = _resolved(levels, facts, rules, leaves, edges, fallback, as_of, False)
    turn = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    order = Window.partitionBy("address").orderBy(F.when(turn > 0, turn).otherwise(len(categories) + 1), "category", F.col("level") != "city", "rule_id")
    return found.withColumn("place", F.row_number().over(order).cast("long"))


def explain(levels: DataFrame, facts: DataFrame, rules: DataFrame, leaves: DataFrame, edges: DataFrame, fallback: DataFrame, as_of: Column) -> DataFrame:
    """(address, rule_id, n, step, result, by): the steps by which every rule that reaches an address got its result, or lost it.

    Parameters as for lookup(). In order: status; coverage, by the facts that decide it or leave it open; the base result;
    each pass that changed it, by the rule that supersedes it; confidence, with ``review`` where it is low. A null result
    means that the rule is omitted from there on.
    """
    found = _resolved(levels, facts, rules, leaves, edges, fallback, as_of, True)
    line = lambda step, result, by=F.lit(None).cast("string"): F.struct(F.lit(step).alias("step"), result.alias("result"), by.alias("by"))
    facts_named = F.when(F.size("because") > 0, F.array_join("because", ","))
    sure = F.when(F.col("needs_review"), "review").otherwise("enough")
    steps = F.concat(F.array(line("status", F.col("status")), line("coverage", F.col("verdict"), facts_named)), F.col("steps"), F.array(line("confidence", sure)))
    return found.select("address", "rule_id", F.posexplode(steps).alias("n", "s")).select("address", "rule_id", (F.col("n") + 1).cast("long").alias("n"), "s.*")
