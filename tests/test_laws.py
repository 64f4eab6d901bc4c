"""Which rules a text means, which gives way, and the steps of a lookup."""

import re

import pytest
from pyspark.sql import functions as F

from rulewright.operators import laws, precedence

RULE = "rule_id string, level string, jurisdiction string, category string, interaction string, attested boolean, conflict_note string, disposition string, stage string, overrides array<string>, own boolean, citation string"


def rule(i, level, place, category, text=None, **more):
    have = {"attested": False, "note": None, "disposition": "accepted", "stage": "enacted", "own": True, "citation": None} | more
    return (i, level, place, category, text, have["attested"], have["note"], have["disposition"], have["stage"], None, have["own"], have["citation"])


def test_fitting_equals_all_pairs(spark):
    values = [None, "x", "y"]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in values for b in values)]
    flags = [(f"f{i}", a, b) for i, (a, b) in enumerate((a, b) for a in values for b in values if a or b)]
    got = laws.fitting(spark.createDataFrame(rows, "id int, a string, b string"), spark.createDataFrame(flags, "flag string, a string, b string"), ["a", "b"])
    want = {(r[0], f[0]) for r in rows for f in flags if all(v is None or v == w for v, w in zip(f[1:], r[1:], strict=True))}
    assert {(r.id, r.flag) for r in got.collect()} == want and got.count() == len(want)
    none = spark.createDataFrame([], "flag string, a string, b string")
    assert laws.fitting(spark.createDataFrame(rows, "id int, a string, b string"), none, ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        laws.fitting(spark.createDataFrame(rows, "id int, a string, b string"), spark.createDataFrame([("f", None, None)], "flag string, a string, b string"), ["a", "b"])


def test_named(spark):
    patterns = [("rso", r"\bRSO\b", ["rso"], "LA, CA"), ("rent", "(?i)the rent ordinance", ["the", "rent", "ordinance"], "SF, CA"), ("just", "(?i)local just cause", ["local", "just", "cause"], None), ("absent", "zebra law", ["zebra", "law"], None), ("wordless", ".", [], None)]
    texts = [
        (1, "Units under the RSO.", "LA, CA"), (2, "Units under the RSO.", "CA"), (3, "Units under the RSO.", "SF, CA"), (4, "The RSO, even if vacant.", "LA, CA"), (5, None, "LA, CA"), (6, "", "CA"),
        (7, "The  Rent ordinance", "SF, CA"), (8, "The Rent Ordinance and local just cause, local just cause", "CA"), (9, "rso", "LA, CA"), (10, "under the rent " + "x " * 50000 + "ordinance", "CA"),
    ]
    for most in (laws.MOST, 0):  # by broadcast and by shuffle
        laws.MOST, before = most, laws.MOST
        got = laws.named(spark.createDataFrame(texts, "id int, text string, place string"), spark.createDataFrame(patterns, "law string, pattern string, words array<string>, place string"), ["id"])
        assert sorted((r.id, r.law) for r in got.collect()) == [(1, "rso"), (2, "rso"), (8, "just"), (8, "rent")]
        laws.MOST = before


def test_named_runs_patterns_where_their_text_stands(spark):
    texts = [(1, "The  RENT\n ordinance", None), (2, "rent the ordinance", None), (3, "the ſmall rent ordinance", None)]
    patterns = [("law", "ordinance", ["ordinance"], None, "the rent ordinance"), ("small", r"(?iu)small\s+rent", ["rent"], None, "small rent")]
    for most in (laws.MOST, 0):
        laws.MOST, before = most, laws.MOST
        got = laws.named(spark.createDataFrame(texts, "id int, text string, place string"), spark.createDataFrame(patterns, "law string, pattern string, words array<string>, place string, holds string"), ["id"])
        assert sorted((r.id, r.law) for r in got.collect()) == [(1, "law"), (3, "small")]
        laws.MOST = before


def test_marks_are_read_back(spark):
    rules = [
        rule("CA-RENT-1", "state", "CA", "rent", "Does not apply to units under stricter local law."), rule("CA-EVIC-1", "state", "CA", "evict", "A city may not enact any such ordinance."),
        rule("CA-FEES-1", "state", "CA", "fees", "This does not preempt local law."), rule("LA-RENT-2", "city", "LA, CA", "rent", "Own text."), rule("LA-RENT-1", "city", "LA, CA", "rent"),
        rule("LA-RENT-3", "city", "LA, CA", "rent", stage="pending"), rule("NY-RENT-1", "city", "NY, NY", "rent"), rule("LA-EVIC-1", "city", "LA, CA", "evict"), rule("LA-EVIC-2", "city", "LA, CA", "evict", disposition="held"),
        rule("SF-RENT-1", "city", "SF, CA", "fees", None, attested=True, note="see LA-RENT-1, SF-RENT-1 and XX-RENT-9"), rule("NV-RENT-1", "state", "NV", "rent", "yields to all"),
    ]
    marked = laws.marked(spark.createDataFrame(rules, RULE))
    at = {r.rule_id: r for r in marked.collect()}
    assert len(at) == len(rules)
    assert at["CA-RENT-1"].interaction.endswith("[Yields to: LA-RENT-1, LA-RENT-2]") and at["CA-RENT-1"].overrides == ["LA-RENT-1", "LA-RENT-2"]
    assert at["LA-RENT-2"].interaction == "Own text. [Takes precedence over CA-RENT-1 where more protective]" and at["LA-RENT-2"].overrides == ["CA-RENT-1"]
    assert at["LA-EVIC-1"].interaction == "[Subject to preemption by CA-EVIC-1]"
    assert at["CA-FEES-1"].interaction == "This does not preempt local law." and at["NV-RENT-1"].overrides is None
    got = {tuple(r) for r in laws.markers(marked).collect()}
    assert got == {
        ("yields", "CA-RENT-1", "LA-RENT-1"), ("yields", "CA-RENT-1", "LA-RENT-2"), ("preempts", "CA-EVIC-1", "LA-EVIC-1"),
        ("preempts", "CA-EVIC-1", "LA-EVIC-2"), ("preempts", "LA-RENT-1", "SF-RENT-1"),
    }
    assert laws.markers(spark.createDataFrame([], RULE)).count() == 0


def test_edges(spark):
    rules = spark.createDataFrame([
        rule("A", "state", "CA", "rent"), rule("B", "city", "LA, CA", "rent", citation="Code ch. 7"), rule("C", "city", "LA, CA", "evict", citation="Code ch. 7"), rule("D", "city", "LA, CA", "rent", own=False, citation="Code ch. 7"),
        rule("E", "state", "CA", "fees", own=False), rule("F", "state", "CA", "fees", own=False),
    ], RULE)
    items = [("A", 1, "exempts", "other_law", "under the RSO"), ("D", 1, "covers", "building", "RSO units"), ("E", 1, "covers", "review", "under the RSO"), ("F", 1, "covers", "other_law", "under the old law"), ("B", 1, "covers", "other_law", "under the RSO")]
    known = [("rso", "RSO", ["rso"], "LA, CA", None, r"ch\. 7", None), ("old", "old law", ["old", "law"], None, None, "^none$", "fees")]
    got = laws.edges(rules, spark.createDataFrame(items, "rule_id string, item int, kind string, scope string, text string"), spark.createDataFrame(known, "law string, pattern string, words array<string>, place string, level string, citation string, category string"))
    # D's own coverage text names the law, so D is no target; B has coverage of its own, so it depends on none
    assert {tuple(r) for r in got.collect()} == {("other_law", "A", "B"), ("depends", "E", "B"), ("depends", "E", "C"), ("depends", "F", None)}


def test_steps_name_the_pass(spark):
    columns = "address int, fallback boolean, rule_ord int, rule_id string, own boolean, base string, category string, status string, verdict string, confidence double, coverage_confidence double"
    rows = spark.createDataFrame([
        (1, False, 1, "S", True, "b", "rent", "in_force", "covered", 0.9, 1.0), (1, False, 2, "K", True, "b", "rent", "in_force", "unknown", 0.9, 1.0), (1, False, 3, "L", True, "l", "rent", "in_force", "covered", 0.4, 1.0),
        (1, False, 4, "G", False, "g", "fees", "in_force", "covered", None, 1.0), (2, True, 1, "S", True, "b", "rent", "failed", "covered", 0.9, 1.0),
    ], columns)
    edges = spark.createDataFrame([("yields", "S", "L"), ("depends", "G", None)], laws.EDGES)
    got = {(r.address, r.rule_id): r for r in precedence.resolve(rows, edges, steps=True).collect()}
    short = {k: [tuple(s) for s in r.steps] for k, r in got.items()}
    assert short[1, "S"] == [("base", "applies", None), ("yields", "superseded", "L")]
    assert short[1, "K"] == [("base", "unknown", None), ("same_law", "superseded", "L")]
    assert short[1, "G"] == [("base", "applies", None), ("depends", None, None)] and got[1, "G"].result is None
    assert short[2, "S"] == [("base", None, None)] and got[1, "L"].needs_review
    plain = {(r.address, r.rule_id): r.result for r in precedence.resolve(rows, edges).collect()}
    assert plain == {k: r.result for k, r in got.items() if r.result}
    assert precedence.resolve(rows.limit(0), edges.limit(0), steps=True).count() == 0


def test_review_flags(spark):
    rules = spark.createDataFrame([("A", "held", "CA", "rent", False, None), ("B", "merged", "CA", "rent", None, None), ("C", "accepted", "CA", None, True, "old; one")], "rule_id string, disposition string, jurisdiction string, category string, conflict_flag boolean, conflict_note string")
    flags = spark.createDataFrame([("2", "CA", None, "one"), ("1", "CA", "rent", "two"), ("3", "CA", "rent", "one")], "flag string, jurisdiction string, category string, note string")
    got = {r.rule_id: (r.conflict_flag, r.conflict_note) for r in laws.review_flags(rules, flags, ["jurisdiction", "category"]).collect()}
    assert got == {"A": (True, "two; one"), "B": (False, None), "C": (True, "old; one")}


def test_denied_preemption(spark):
    texts = ["It preempts local law", "It does not preempt local law", "Cities may not adopt an ordinance", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(laws.forbids_local(F.col("t"))).collect()]
    assert got == [True, False, True, False, False] and re.search(laws.RULE_ID, "CA-RENT-01")
