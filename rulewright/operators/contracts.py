"""Which clauses a contract gets, which of its fields they need, and which bounds it breaks.

The rule set is four tables, joined by their keys; Spark broadcasts those that are small and shuffles the others:

* clauses: template, pos, key, agreed (needs no law), scope (federal, state or any), guarantor_only, deposit_only,
  fields, categories and requirement_ids (arrays);
* requirements: id, jurisdiction, category, kind, in_contract;
* checks: requirement, field, op, bound (decimal).

A contract names its template. Plans are rows of contract and clause, so none of them is gathered in one record.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NATION = "FED"
CLAUSES = "template string, pos int, key string, agreed boolean, scope string, guarantor_only boolean, deposit_only boolean, fields array<string>, categories array<string>, requirement_ids array<string>"
REQUIREMENTS = "id string, jurisdiction string, category string, kind string, in_contract boolean"
CHECKS = "requirement string, field string, op string, bound decimal(18,4)"
#: The kinds of requirement that bind a contract.
LAW = ("law",)


def backing(clauses: DataFrame, requirements: DataFrame, kinds: tuple[str, ...] = LAW) -> DataFrame:
    """(template, pos, jurisdiction, ids): the requirements behind each clause in each jurisdiction, sorted.

    A clause names categories, or single requirements; both are looked up by equality.
    """
    binding = requirements.where(F.col("kind").isin(*kinds) & F.col("in_contract")).select("id", "jurisdiction", "category")
    named = lambda column, key: clauses.select("template", "pos", "scope", F.explode(column).alias(key)).join(binding, key).select("template", "pos", "scope", "jurisdiction", "id")
    level = F.when(F.col("jurisdiction") == NATION, "federal").otherwise("state")
    reached = named("categories", "category").union(named("requirement_ids", "id")).where((F.col("scope") == "any") | (F.col("scope") == level))
    return reached.groupBy("template", "pos", "jurisdiction").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def clause_plan(contracts: DataFrame, clauses: DataFrame, requirements: DataFrame) -> DataFrame:
    """Every clause of every contract's template, with reason (null: included) and requirements.

    contracts has template, state, verified, guarantor and deposit; its columns stay. A state's own requirements
    stand before the nation's, and count only where the state is verified. The first reason that holds is given.
    """
    behind = backing(clauses, requirements)
    wide = behind.where(F.col("jurisdiction") == NATION).select("template", "pos", F.col("ids").alias("__wide"))
    own = behind.where(F.col("jurisdiction") != NATION).select("template", "pos", F.col("jurisdiction").alias("__place"), F.col("ids").alias("__own"))
    known = F.coalesce("verified", F.lit(False))
    rows = contracts.withColumn("__place", F.when(known, F.col("state"))).join(clauses.drop("categories", "requirement_ids"), "template")
    rows = rows.join(wide, ["template", "pos"], "left").join(own, ["template", "pos", "__place"], "left")
    none = F.array().cast("array<string>")
    ids = F.when(F.col("agreed"), none).otherwise(F.concat(F.coalesce("__own", none), F.coalesce("__wide", none)))
    why = {
        "no_guarantor": F.col("guarantor_only") & ~F.coalesce("guarantor", F.lit(False)),
        "no_deposit_agreed": F.col("deposit_only") & (F.col("deposit") == 0),
        "federal_law_only": ~F.col("agreed") & (F.col("scope") == "state") & ~known,
        "no_verified_requirement": ~F.col("agreed") & (F.size(ids) == 0),
    }
    first = F.coalesce(*(F.when(holds, name) for name, holds in why.items()))
    return rows.withColumn("requirements", ids).withColumn("reason", first).drop("__wide", "__own", "__place")


def included(planned: DataFrame) -> DataFrame:
    return planned.where("reason is null")


def missing_fields(planned: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """(key, field, requirements) of fields that an included clause needs and the contract lacks (null or empty).

    values: each field as text. requirements: distinct, in clause order; empty if only the template asks.
    """
    given = F.create_map(*(x for name, value in values.items() for x in (F.lit(name), value.cast("string"))))
    needed = included(planned).withColumn("__given", given).select(key, "pos", "requirements", "__given", F.explode("fields").alias("field"))
    lacking = needed.where(F.array_contains(F.map_keys("__given"), F.col("field")) & (F.coalesce(F.col("__given")[F.col("field")], F.lit("")) == ""))
    asked = lacking.groupBy(key, "field").agg(F.array_sort(F.collect_list(F.struct("pos", "requirements"))).alias("by"))
    return asked.select(key, "field", F.array_distinct(F.flatten("by.requirements")).alias("requirements"))


def violations(planned: DataFrame, key: str, checks: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """(key, requirement, field, op, bound) of bounds that requirements behind included clauses set and values break.

    Values are decimals, so that one at its bound keeps it; a null value breaks none; a repeated check counts once.
    """
    given = F.create_map(*(x for name, value in values.items() for x in (F.lit(name), value.cast("decimal(30,12)"))))
    used = included(planned).withColumn("__given", given).select(key, "__given", F.explode("requirements").alias("requirement"))
    value = F.col("__given")[F.col("field")]
    side = F.when(value < F.col("bound"), -1).when(value > F.col("bound"), 1).when(value == F.col("bound"), 0)
    # the sides that each operator allows
    allowed = F.expr("CASE op WHEN 'lt' THEN array(-1) WHEN 'le' THEN array(-1, 0) WHEN 'eq' THEN array(0) WHEN 'ge' THEN array(0, 1) WHEN 'gt' THEN array(1) END")
    broken = used.join(checks.distinct(), "requirement").where(~F.array_contains(allowed, side))
    # dealt by contract first: a map-side pass would hold every violation of an input split, and merge next to none
    return broken.select(key, "requirement", "field", "op", "bound").repartition(key).distinct()
