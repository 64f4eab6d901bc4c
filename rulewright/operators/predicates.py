"""Nested conditions over facts: checked, written out, turned into leaf tables, and decided in three-valued logic.

A condition is JSON: {"and": [...]}, {"or": [...]}, {"not": ...}, {"const": true}, {"missing": "what"} (never known) or
{"fact": ..., "op": ..., "value": ...} with an op of OPS. A table of conditions becomes a table of their nodes, one row a node,
and an evaluation joins facts to the leaves and folds the levels upwards, so that neither rules nor entities
are gathered. normal_form() gives the leaves that coverage.verdicts() takes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kleene import code, compare_interval, decode, in_interval, negate_code

OPS = ("<", "<=", "==", "!=", ">=", ">", "in")
JOINED = {"and": "all", "or": "any"}
NODES = "rule_id string, node int, parent int, depth int, kind string, fact string, op string, numbers array<double>, words array<string>, label string"
_TYPES = {"int": lambda x: type(x) is int, "bool": lambda x: type(x) is bool, "enum": lambda x: isinstance(x, str), "date": lambda x: isinstance(x, str) and _day(x) is not None}


def _day(text: str) -> date | None:
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def walk(tree: object) -> Iterator[tuple[int, int, int, str, object]]:
    """(node, parent, depth, kind, content) of every node, parents first; kind is bad for what the grammar has not."""
    todo, node = [(tree, -1, 0)], 0
    while todo:
        part, parent, depth = todo.pop(0)
        names = set(part) if isinstance(part, dict) else set()
        kind, content, below = "bad", part, []
        if len(names) == 1:
            (name,) = names
            content = part[name]
            if name in JOINED and isinstance(content, list) and content:
                kind, below = JOINED[name], content
            elif name == "not":
                kind, below = "not", [content]
            elif name == "const" and isinstance(content, bool):
                kind = "const"
            elif name == "missing" and isinstance(content, str) and content.strip():
                kind = "open"
            else:
                content = part
        elif names == {"fact", "op", "value"}:
            kind = "leaf"
        yield node, parent, depth, kind, content
        todo += [(x, node, depth + 1) for x in below]
        node += 1


def problems(tree: object, facts: dict[str, str]) -> list[str]:
    """What is wrong with a condition; facts: the type of each fact (int, bool, date or enum)."""
    out = []
    for _, _, _, kind, x in walk(tree):
        if kind == "bad":
            out.append(f"no condition: {json.dumps(x, default=str)}")
        elif kind == "leaf" and x["fact"] not in facts:
            out.append(f"no such fact: {x['fact']}")
        elif kind == "leaf" and x["op"] not in OPS:
            out.append(f"no such operator: {x['op']}")
        elif kind == "leaf":
            type_, several = facts[x["fact"]], x["op"] == "in"
            values = x["value"] if several else [x["value"]]
            if not isinstance(values, list) or not all(map(_TYPES[type_], values)):
                out.append(f"{x['fact']} takes {'a list of ' * several}{type_}: {json.dumps(x['value'], default=str)}")
            elif type_ in ("bool", "enum") and x["op"] not in (("==", "!=") if type_ == "bool" else ("==", "!=", "in")):
                out.append(f"{x['fact']} is not ordered: {x['op']}")
    return out


def _fold(tree: dict, leaf, joined, turned):
    """leaf(kind, content) at the ends; joined(kind, parts) and turned(part) above them, from the last level up."""
    rows = list(walk(tree))
    made: dict[int, object] = {}
    below: dict[int, list[int]] = {}
    for node, parent, *_ in rows:
        below.setdefault(parent, []).append(node)
    for node, _, _, kind, content in reversed(rows):
        parts = [made[k] for k in below.get(node, ())]
        made[node] = turned(parts[0]) if kind == "not" else joined(kind, parts) if kind in ("all", "any") else leaf(kind, content)
    return made[0]


def written(tree: dict) -> str:
    """A condition as text: (units <= 3 AND NOT owner_occupied == true)."""
    ends = {"const": lambda x: str(x).upper(), "open": lambda x: f"MISSING[{x}]", "leaf": lambda x: f"{x['fact']} {x['op']} {json.dumps(x['value'])}"}
    link = {"all": " AND ", "any": " OR "}
    return _fold(tree, lambda kind, x: ends[kind](x), lambda kind, parts: parts[0] if len(parts) == 1 else f"({link[kind].join(parts)})", lambda part: f"NOT {part}")


def facts_used(tree: dict) -> set[str]:
    return {x["fact"] for _, _, _, kind, x in walk(tree) if kind == "leaf"}


def normal_form(tree: dict) -> list[frozenset[tuple[str, str, bool]]]:
    """The condition as a disjunction of conjunctions of (kind, content as JSON, negated); no conjunction holds another one.

    De Morgan's and the distributive laws hold in three-valued logic, so both give the same answer for the same facts; a
    condition and its own denial do not cancel out there and both stay.
    """

    def either(parts):
        every = {c for p in parts for c in p}
        return [c for c in every if not any(d < c for d in every)]

    def both(parts):
        return either([[frozenset().union(*chosen)] for chosen in product(*parts)])

    pair = lambda kind, x: tuple([frozenset([(kind, json.dumps(x, sort_keys=True), negated)])] for negated in (False, True))
    join = {"all": (both, either), "any": (either, both)}
    plain, _ = _fold(tree, pair, lambda kind, parts: tuple(f([p[i] for p in parts]) for i, f in enumerate(join[kind])), lambda part: part[::-1])
    return sorted(plain, key=lambda c: sorted(c))


def _number(x: object) -> float | None:
    """A value on a number line: dates by their ordinal, truth as 0 and 1; null for other text."""
    if isinstance(x, str):
        day = _day(x)
        return float(day.toordinal()) if day else None
    return float(x)


def node_rows(rule_id: str, tree: dict) -> list[tuple]:
    out = []
    for node, parent, depth, kind, x in walk(tree):
        values = (x["value"] if isinstance(x["value"], list) else [x["value"]]) if kind == "leaf" else []
        numbers = [n for n in map(_number, values) if n is not None]
        words = [v for v in values if isinstance(v, str) and _day(v) is None]
        label = x if kind == "open" else str(x).lower() if kind == "const" else None
        out.append((rule_id, node, parent, depth, kind, x["fact"] if kind == "leaf" else None, x["op"] if kind == "leaf" else None, numbers, words, label))
    return out


def nodes(rules: DataFrame) -> DataFrame:
    """NODES of every condition of rules (rule_id, condition as JSON); a null condition has none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in NODES.split(", ")]
        for batch in batches:
            rows = [row for rule_id, text in zip(batch["rule_id"], batch["condition"], strict=True) if text is not None for row in node_rows(rule_id, json.loads(text))]
            yield pd.DataFrame(rows, columns=names)

    return rules.select(F.col("rule_id").cast("string").alias("rule_id"), F.col("condition").cast("string").alias("condition")).mapInPandas(cut, NODES)


def decided(pairs: DataFrame, conditions: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(key, rule_id, holds) of every pair (key, rule_id) whose rule has nodes; holds is null where it stays unknown.

    conditions: from nodes(), written or cached. facts: (key, fact, lo, hi, word), a number or date (as its ordinal) known to be in
    [lo, hi] (hi null: open), or a word; one row a fact, none for what is not known. Partial results are held by
    (key, rule_id), which all levels group by, so they are shuffled once.
    """
    deepest = conditions.agg(F.max("depth")).first()[0]
    ends = conditions.where("kind in ('leaf', 'open', 'const')").select("rule_id", "node", "parent", "depth", "kind", "fact", "op", "numbers", "words", "label")
    asked = pairs.select(key, "rule_id").join(ends, "rule_id").join(facts.select(key, "fact", "lo", "hi", "word"), [key, "fact"], "left")
    known, first = F.col("lo").isNotNull(), F.get("numbers", F.lit(0))
    ranged = F.when(F.col("op") == "in", in_interval(F.col("lo"), F.col("hi"), known, F.col("numbers"))).otherwise(compare_interval(F.col("lo"), F.col("hi"), known, F.col("op"), first))
    same = F.array_contains("words", F.col("word"))
    worded = F.when(F.col("op") == "!=", ~same).otherwise(same)
    truth = F.when(F.col("kind") == "const", F.col("label") == "true").when((F.col("kind") == "leaf") & (F.size("words") > 0), worded).when(F.col("kind") == "leaf", ranged)
    now = asked.select(key, "rule_id", "node", "parent", "depth", code(truth).alias("r")).repartition(key, "rule_id")
    inner = conditions.select("rule_id", F.col("node").alias("parent"), F.col("kind").alias("above"), F.col("parent").alias("next"))
    for depth in range(deepest or 0, 0, -1):
        level = now.where(F.col("depth") == depth).join(inner, ["rule_id", "parent"])
        made = level.groupBy(key, "rule_id", "parent").agg(F.first("above").alias("above"), F.first("next").alias("next"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        r = F.when(F.col("above") == "all", F.col("lo")).when(F.col("above") == "any", F.col("hi")).otherwise(negate_code(F.col("lo")))
        made = made.select(key, "rule_id", F.col("parent").alias("node"), F.col("next").alias("parent"), F.lit(depth - 1).alias("depth"), r.alias("r"))
        now = now.where(F.col("depth") < depth).union(made)
    return now.select(key, "rule_id", decode(F.col("r")).alias("holds"))
