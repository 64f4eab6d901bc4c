"""What keeps a task's work in proportion to its part of the input."""

import os
import random
import re
import time
from decimal import Decimal

from pyspark.sql import functions as F

from rulewright.llm import clusters, common, lines
from rulewright.operators import contracts


def test_violations_are_dealt_by_contract(spark):
    """No hash table of all violations of an input split: they are dealt by contract before repeats go."""
    planned = spark.createDataFrame([(1, None, ["A", "B"], 3), (1, None, ["A"], 3), (2, None, ["A"], 9), (3, "no", ["A"], 1), (4, None, ["A"], None)], "id long, reason string, requirements array<string>, months int")
    checks = spark.createDataFrame([("A", "months", "ge", Decimal(6)), ("A", "months", "ge", Decimal(6)), ("B", "months", "gt", Decimal(3))], contracts.CHECKS)
    found = contracts.violations(planned, "id", checks, {"months": F.col("months")})
    assert sorted((r.id, r.requirement) for r in found.collect()) == [(1, "A"), (1, "B")]
    assert "RepartitionByExpression [id" in found._jdf.queryExecution().optimizedPlan().toString()


def test_shuffles_go_with_the_table_they_made(spark):
    """No shuffle file of a written table waits for the driver's garbage collector."""
    files = lambda: set(re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")))
    before, mode = files(), spark.conf.get(common.SHUFFLES_GO)
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "count")
    out = common.Scratch(spark, "test").keep(df, "counts")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(common.SHUFFLES_GO) == mode
    assert out.count() == 100 and df.count() == 100


def test_line_dedup_leaves_only_its_verdicts(spark):
    """The lines themselves, the largest table, are gone when the verdicts are written."""
    words = ["alphabet", "betamax", "gammaray", "deltawing", "epsilon", "zetajones", "thetawave"]
    docs = spark.createDataFrame([(i, " ".join(words[: 5 + i % 3]) + f"\n{' '.join(words[::-1])} x{i}") for i in range(12)], "doc_id long, text string")
    top = common.shared_dir(spark).removeprefix("file:")
    there = set(os.listdir(top)) if os.path.isdir(top) else set()
    verdicts = lines.line_verdicts(docs)
    tables = {t.split("-", 1)[1]: os.path.join(top, d, t) for d in set(os.listdir(top)) - there for t in os.listdir(os.path.join(top, d))}
    assert "verdicts" in tables and not tables.keys() & {"lines", "sketches", "keys", "members", "repeated", "texts", "marks", "marked", "left", "light", "candidates"}
    assert verdicts.count() == 11 + 11


def test_only_rows_that_may_meet_get_marks(spark):
    """Of a bucket's rows those stay that pass the cheap test with one of another component: rows, not pairs, in whatever parts they are dealt."""
    rng = random.Random(4)
    rows = [(key, node, rng.choice([node, 0, 0, 1])) for key in range(20) for node in rng.sample(range(10, 900), rng.choice([2, 9, 60]))]
    left = spark.createDataFrame([(*r, 0, 1 + r[0] % 3) for r in rows], "key long, node long, component long, main long, parts int")
    light = spark.createDataFrame([(n, n * 37 % 400) for n in range(900)], "node long, mark long")
    may = lambda x, y: F.abs(F.col(f"{x}mark") - F.col(f"{y}mark")) <= 3
    got = sorted((r.key, r.node) for r in clusters._candidates(left, light, may, common.Scratch(spark, "test")).collect())
    mark = lambda n: n * 37 % 400
    wanted = sorted((k, n) for k, n, c in rows if any(k == key and c != d and abs(mark(n) - mark(m)) <= 3 for key, m, d in rows))
    assert got == wanted and 0 < len(got) < len(rows)
