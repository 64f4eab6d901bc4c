"""Similarity joins against all pairs."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rulewright.operators import similar


def plain(a, b):
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def corpus(n=120):
    rng = random.Random(3)
    rows, texts = [], []
    for k in range(n):
        if texts and rng.random() < 0.7:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(max(1, len(t) // 4) + 1)):
                i = rng.randrange(len(t) + 1)
                t[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "é", "$"])
            t = "".join(t)
        else:
            t = "".join(rng.choice("ab c1$é") for _ in range(rng.choice([0, 1, 2, 3, 8, 20, 40, 90])))
        texts.append(t)
        rows.append((rng.choice(["x", "y"]), k, t))
    return rows


def greedy(rows, percent):
    taken = []
    for g, k, t in sorted(rows, key=lambda r: r[1]):
        if not any(g == h and plain(t, u) >= percent for h, _, u in taken):
            taken.append((g, k, t))
    return {(g, k) for g, k, _ in taken}


@pytest.mark.parametrize("percent", [80, 85, 95, 100])
def test_pairs_equal_all_pairs(spark, percent):
    rows = corpus()
    first = {}
    for g, k, t in rows:
        first.setdefault((g, t), k)
    rows = [(g, k, t) for (g, t), k in first.items()]
    got = [(r.g, r.a, r.b) for r in similar.pairs(spark.createDataFrame([*rows, ("x", 900, None), (None, 901, "ab")], "g string, k int, t string"), "g", "k", "t", percent).collect()]
    want = {(g, min(k, j), max(k, j)) for g, k, t in rows for h, j, u in rows if g == h and k < j and plain(t, u) >= percent - 1e-9}
    assert set(got) == want and len(got) == len(want) and len(want) > {80: 20, 85: 20, 95: 4, 100: -1}[percent]


def test_no_all_pairs_plan(spark):
    plan = similar.pairs(spark.createDataFrame(corpus(9), "g string, k int, t string"), "g", "k", "t", 85)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_of_alike(spark, tmp_path):
    rows = corpus(90)
    got = [tuple(r) for r in similar.first_of_alike(spark.createDataFrame(rows, "g string, k int, t string"), "g", "k", "t", 85, str(tmp_path)).collect()]
    assert set(got) == greedy(rows, 85) and len(got) == len(set(got))
    assert similar.first_of_alike(spark.createDataFrame([], "g string, k int, t string"), "g", "k", "t", 85, str(tmp_path)).count() == 0


def test_in_force(spark, tmp_path):
    day = date(2024, 6, 1)
    rows = [
        ("r", 1, "2 percent and 30 dollars", None, None), ("r", 2, "2 percent and 31 dollars", date(2024, 1, 1), None), ("r", 3, "4 months of rent", day, day),
        ("r", 4, "8 months of notice", date(2024, 6, 2), None), ("r", 5, "9 days", None, date(2024, 5, 31)), ("s", 6, "2 percent and 31 dollars", None, None), ("r", 7, None, None, None),
    ]
    found = similar.in_force(spark.createDataFrame(rows, "rule string, k int, figure string, start date, until date"), "rule", "k", "figure", "start", "until", F.lit(day), 85, str(tmp_path))
    assert sorted(r.k for r in found.collect()) == [1, 3, 6]


def test_registered_query(spark):
    from rulewright.plans import lookups, queries

    d, day = "/root/testdata/sf0.001", lookups._DAY
    orders = spark.read.parquet(f"{d}/orders.parquet").collect()
    live = []
    for o in orders:
        start = o.o_orderdate.date()
        until = start + timedelta(days=900) if o.o_orderkey % 3 else None
        if start <= day and (until is None or day <= until):
            live.append((o.o_custkey, (start, o.o_orderkey), f"at most ${o.o_totalprice:.2f}, {o.o_orderpriority.lower()}"))
    want = {(g, k[1]) for g, k in greedy(live, 85)}
    got = {(r.rule, r.figure_id) for r in queries.QUERIES["figures_in_force"](spark, d).collect()}
    assert got == want and len(want) < len(live)


def test_exploded_tokens_are_not_gathered_at_the_driver(spark):
    texts = spark.createDataFrame([("x", i, f"at most ${i * 37}.{i % 90:02d}, number {i}") for i in range(300)], "g string, k int, t string").groupBy("g", "k").agg({"t": "max"}).toDF("g", "k", "t")
    found = similar.pairs(texts, "g", "k", "t", 85)
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
