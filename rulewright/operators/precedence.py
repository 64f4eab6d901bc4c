"""Which of an address's rules prevail: the passes over the rules that reach one address.

An address has at most one entry per rule, so its entries fit an array that grows with the rule set and not
with the data. One grouping by address brings them together; every pass after it is a column expression.
Entries are structs with ENTRY's fields, in rule order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import small

INPUT = ("rule_ord", "rule_id", "own", "base", "category", "status", "verdict", "confidence", "coverage_confidence")
REVIEW_BELOW = 0.5
FALLBACK_FACTOR = 0.85

#: What the edges of a rule become in its entry: the ids of the rules they lead to.
KINDS = ("other_law", "depends", "yields", "preempts")


def base_result(status: Column, verdict: Column) -> Column:
    """The result before any precedence; null is omitted."""
    reaches = verdict.isin("covered", "unknown")
    first = F.when(~reaches | (status == "failed"), F.lit(None).cast("string")).when(status.isin("pending", "not_yet_effective"), status)
    return first.otherwise(F.when(verdict == "covered", "applies").otherwise("unknown"))


def _with(entry: Column, **new: Column) -> Column:
    for name, value in new.items():
        entry = entry.withField(name, value)
    return entry


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value named once however often it is used: passes on passes would be repeated otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _targets(entries: Column, names: Column) -> Column:
    return F.filter(entries, lambda x: F.array_contains(names, x["rule_id"]))


def _best(candidates: Column) -> Column:
    """The covered candidate in force to follow: one that applies, then one with coverage of its own, then by id."""
    live = F.filter(candidates, lambda x: (x["status"] == "in_force") & x["result"].isNotNull() & (x["verdict"] == "covered"))
    return F.array_min(F.transform(live, lambda x: F.struct((x["result"] != "applies").alias("idle"), (~x["own"]).alias("derived"), x["rule_id"].alias("rule_id"))))


def _undecided(result: Column) -> Column:
    return F.coalesce(result.isin("applies", "unknown"), F.lit(False))


def supersede(entries: Column, kind: str, basis: str) -> Column:
    """An edge's source gives way to the best target, or may have to where none is sure."""

    def turn(e: Column) -> Column:
        targets = _targets(entries, e[kind])
        best = _best(targets)
        maybe = F.transform(F.filter(targets, lambda x: (x["status"] == "in_force") & x["result"].isNotNull() & (x["verdict"] == "unknown")), lambda x: x["rule_id"])
        gives = _undecided(e["result"]) & best.isNotNull()
        may = F.when(_undecided(e["result"]) & best.isNull(), F.array_union(e["may_yield_to"], maybe)).otherwise(e["may_yield_to"])
        return _with(
            e,
            result=F.when(gives, "superseded").otherwise(e["result"]),
            superseded_by=F.when(gives, best["rule_id"]).otherwise(e["superseded_by"]),
            basis=F.when(gives, basis).otherwise(e["basis"]),
            may_yield_to=may,
        )

    return F.transform(entries, turn)


def depend(entries: Column) -> Column:
    """A rule defined by another law's coverage needs that law to apply; unknown if that is not decided."""

    def turn(e: Column) -> Column:
        targets = _targets(entries, e["depends"])
        via = F.exists(targets, lambda x: F.coalesce(x["result"] == "applies", F.lit(False)))
        open_ = F.exists(targets, lambda x: x["result"].isNotNull() & ((x["result"] == "unknown") | (x["verdict"] == "unknown")))
        asks = e["asks"] & e["result"].isNotNull() & ~via
        weak = F.when(open_, F.when(e["result"] == "applies", "unknown").otherwise(e["result"]))
        return _with(e, result=F.when(asks, weak).otherwise(e["result"]))

    return F.transform(entries, turn)


def retarget(entries: Column) -> Column:
    """A rule superseded by one that does not apply itself follows to a candidate that does."""

    def turn(e: Column) -> Column:
        idle = F.exists(entries, lambda x: (x["rule_id"] == e["superseded_by"]) & (F.coalesce(x["result"], F.lit("")) != "applies"))
        best = _best(_targets(entries, F.array_union(e["other_law"], e["yields"])))
        moves = F.coalesce((e["result"] == "superseded") & idle & ~best["idle"], F.lit(False))
        return _with(e, superseded_by=F.when(moves, best["rule_id"]).otherwise(e["superseded_by"]))

    return F.transform(entries, turn)


def same_law(entries: Column) -> Column:
    """What prevails over a rule prevails over the other rules in force of its law, section and category."""
    gone = F.filter(entries, lambda x: F.coalesce(x["result"] == "superseded", F.lit(False)))

    def turn(e: Column) -> Column:
        kin = F.filter(gone, lambda x: (x["base"] == e["base"]) & x["category"].eqNullSafe(e["category"]) & (x["rule_id"] != e["rule_id"]))
        first = F.get(kin, F.lit(0))
        falls = _undecided(e["result"]) & (e["status"] == "in_force") & first.isNotNull()
        return _with(
            e,
            result=F.when(falls, "superseded").otherwise(e["result"]),
            superseded_by=F.when(falls, first["superseded_by"]).otherwise(e["superseded_by"]),
            basis=F.when(falls, F.concat(F.lit("same_law:"), first["rule_id"])).otherwise(e["basis"]),
        )

    return F.transform(entries, turn)


def preempt(entries: Column) -> Column:
    """Both rules of a pair are flagged where both have a result; neither gives way."""
    flag: Callable = lambda e: e["result"].isNotNull() & F.exists(_targets(entries, e["preempts"]), lambda x: x["result"].isNotNull())
    return F.transform(entries, lambda e: _with(e, conflict=flag(e)))


PASSES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("other_law", lambda x: supersede(x, "other_law", "other_law")), ("depends", depend), ("yields", lambda x: supersede(x, "yields", "overrides")),
    ("retarget", retarget), ("same_law", same_law), ("preempt", preempt),
)


def by_rule(edges: DataFrame) -> DataFrame:
    """(rule_id, KINDS, asks): a row per rule with edges. edges: (kind, source, target); a pair that preempts counts
    both ways. asks: it has a depends edge, if only one without target."""
    back = edges.where("kind = 'preempts'").select("kind", F.col("target").alias("source"), F.col("source").alias("target"))
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("target")))).alias(kind)
    return edges.select("kind", "source", "target").unionByName(back).groupBy(F.col("source").alias("rule_id")).agg(*map(of, KINDS), F.bool_or(F.col("kind") == "depends").alias("asks"))


def _noted(step: str, turn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The pass, with a note in each entry whose result or superseding rule it changed."""

    def note(old: Column, new: Column) -> Column:
        same = old["result"].eqNullSafe(new["result"]) & old["superseded_by"].eqNullSafe(new["superseded_by"])
        line = F.struct(F.lit(step).alias("step"), new["result"].alias("result"), new["superseded_by"].alias("by"))
        return new.withField("steps", F.when(same, old["steps"]).otherwise(F.concat(old["steps"], F.array(line))))

    return lambda x: F.zip_with(x, turn(x), note)


def resolve(rows: DataFrame, edges: DataFrame, steps: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """address, rule_id, result, superseded_by, basis, may_yield_to, conflict, confidence and needs_review of
    every rule that is not omitted.

    rows: (address, fallback, INPUT), one per address and rule that reaches it. edges: (kind, source, target), as
    laws.edges() reads them from the rules' texts. fallback: the address was placed by its data set's city only.
    The passes run in the order of PASSES; each sees the results of the one before. steps: also the omitted rules,
    with a null result, and a column of (step, result, by): the base result, then every pass that changed it.
    keep: further columns of rows to return.
    """
    none, ids = F.lit(None).cast("string"), F.array().cast("array<string>")
    base = base_result(F.col("status"), F.col("verdict"))
    first = F.array(F.struct(F.lit("base").alias("step"), base.alias("result"), none.alias("by")))
    led = rows.join(small(by_rule(edges)), "rule_id", "left")
    links = (*(F.coalesce(k, ids).alias(k) for k in KINDS), F.coalesce("asks", F.lit(False)).alias("asks"))
    own = F.struct(*INPUT, *(c for c in keep if c not in INPUT), base.alias("result"), none.alias("superseded_by"), none.alias("basis"), ids.alias("may_yield_to"), F.lit(False).alias("conflict"), *links, *((first.alias("steps"),) if steps else ()))
    each = led.select("address", "fallback", own.alias("e")).groupBy("address").agg(F.any_value("fallback").alias("fallback"), F.array_sort(F.collect_list("e")).alias("entries"))
    for name, turn in PASSES:
        each = each.select("address", "fallback", _bound(F.col("entries"), _noted(name, turn) if steps else turn).alias("entries"))
    out = each.select("address", "fallback", F.explode("entries").alias("e"))
    if not steps:
        out = out.where("e.result is not null")
    given = F.when(F.coalesce(F.col("e.confidence"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("e.confidence"))
    confidence = F.round(given * F.col("e.coverage_confidence") * F.when(F.col("fallback"), FALLBACK_FACTOR).otherwise(1.0), 3)
    return out.select(
        "address", *(F.col(f"e.{c}").alias(c) for c in ("rule_id", "result", "superseded_by", "basis", "may_yield_to", "conflict", *(("steps",) if steps else ()), *keep)),
        confidence.alias("confidence"), (confidence < REVIEW_BELOW).alias("needs_review"),
    )
