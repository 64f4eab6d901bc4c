"""Nested conditions against a recursive evaluation."""

import json
import random

from rulewright.operators import predicates

FACTS = {"units": "int", "year": "int", "opened": "date", "flag": "bool", "use": "enum"}


def leaf(x, known):
    if x["fact"] not in known:
        return None
    a, values = known[x["fact"]], x["value"]
    if not isinstance(a, tuple):
        return (a in values) if x["op"] == "in" else (a == values) == (x["op"] == "==")
    lo, hi = a
    tests = {"<": lambda v: v < values, "<=": lambda v: v <= values, "==": lambda v: v == values, "!=": lambda v: v != values, ">=": lambda v: v >= values, ">": lambda v: v > values, "in": lambda v: v in values}
    seen = {tests[x["op"]](v) for v in range(lo, (hi if hi is not None else 200) + 1)}
    return seen.pop() if len(seen) == 1 else None


def truth(p, known):
    (name,) = p if len(p) == 1 else ("fact",)
    if name in ("and", "or"):
        parts = [truth(x, known) for x in p[name]]
        stop = name == "or"
        return stop if stop in parts else None if None in parts else not stop
    if name == "not":
        x = truth(p["not"], known)
        return None if x is None else not x
    return p["const"] if name == "const" else None if name == "missing" else leaf(p, known)


def made(rng, depth):
    kind = rng.choice(["and", "or", "not", "leaf", "leaf"]) if depth else rng.choice(["leaf", "leaf", "leaf", "const", "missing"])
    if kind in ("and", "or"):
        return {kind: [made(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
    if kind == "not":
        return {"not": made(rng, depth - 1)}
    if kind == "const":
        return {"const": rng.random() < 0.5}
    if kind == "missing":
        return {"missing": "owner"}
    fact = rng.choice(["units", "year", "use"])
    if fact == "use":
        op = rng.choice(["==", "!=", "in"])
        return {"fact": fact, "op": op, "value": ["shop", "home"] if op == "in" else "home"}
    op = rng.choice(predicates.OPS)
    return {"fact": fact, "op": op, "value": [3, 5, 8] if op == "in" else rng.randint(1, 9)}


def test_any_tree_equals_its_recursive_evaluation(spark):
    rng = random.Random(3)
    trees = {f"R{i}": made(rng, i % 5) for i in range(40)}
    people = {}
    for i in range(25):
        lo = rng.randint(1, 9)
        people[i] = {k: v for k, v in {"units": (lo, rng.choice([lo, lo + rng.randint(0, 4), None])), "year": (5, 5), "use": rng.choice(["home", "shop", "farm"])}.items() if rng.random() < 0.8}
    facts = [(i, k, float(v[0]) if isinstance(v, tuple) else None, float(v[1]) if isinstance(v, tuple) and v[1] is not None else None, None if isinstance(v, tuple) else v) for i, known in people.items() for k, v in known.items()]
    rules = spark.createDataFrame([*((k, json.dumps(t)) for k, t in trees.items()), ("none", None)], "rule_id string, condition string")
    pairs = spark.createDataFrame([(i, r) for i in people for r in [*trees, "none"]], "who int, rule_id string")
    got = {(r.who, r.rule_id): r.holds for r in predicates.decided(pairs, predicates.nodes(rules).cache(), spark.createDataFrame(facts, "who int, fact string, lo double, hi double, word string"), "who").collect()}
    want = {(i, k): truth(t, known) for i, known in people.items() for k, t in trees.items()}
    assert got == want and {True, False, None} == set(want.values())
    for i, known in people.items():
        for k, t in trees.items():
            end = {"leaf": lambda x: leaf(x, known), "const": lambda x: x, "open": lambda x: None}  # noqa: B023
            sides = []
            for c in predicates.normal_form(t):
                parts = [end[kind](json.loads(x)) for kind, x, _ in c]
                parts = [p if p is None else p != negated for p, (_, _, negated) in zip(parts, c, strict=True)]
                sides.append(False if False in parts else None if None in parts else True)
            assert (True if True in sides else None if None in sides else False) == want[i, k]


def test_grammar():
    good = {"and": [{"fact": "units", "op": "<=", "value": 3}, {"not": {"or": [{"fact": "flag", "op": "==", "value": True}, {"fact": "use", "op": "in", "value": ["home"]}]}}, {"const": False}, {"missing": "owner"}]}
    assert predicates.problems(good, FACTS) == []
    assert predicates.written(good) == '(units <= 3 AND NOT (flag == true OR use in ["home"]) AND FALSE AND MISSING[owner])'
    assert predicates.written({"or": [{"const": True}]}) == "TRUE"
    assert predicates.facts_used(good) == {"units", "flag", "use"}
    bad = [None, {}, [], {"and": []}, {"and": {}}, {"const": 1}, {"missing": " "}, {"not": None}, {"xor": []}, {"and": [{"const": True}], "or": []}, {"fact": "units", "op": "<"}]
    bad += [{"fact": f, "op": o, "value": v} for f, o, v in (("rent", "==", 1), ("units", "~", 1), ("units", "==", True), ("units", "==", "3"), ("units", "in", 3), ("flag", "<", True), ("flag", "==", 1), ("use", "<", "a"), ("opened", "<", "2024-02-30"), ("opened", "in", ["x"]))]
    assert all(predicates.problems(x, FACTS) for x in bad)
    assert all(predicates.problems({"and": [good, x]}, FACTS) for x in bad)


def test_deep_condition():
    deep = {"fact": "units", "op": "==", "value": 1}
    for _ in range(5000):
        deep = {"not": deep}
    assert predicates.problems(deep, FACTS) == [] and predicates.written(deep).startswith("NOT NOT ") and len(predicates.normal_form(deep)) == 1
