"""Releases that appear whole or not at all; headings of spans."""

import os
import random
import uuid

import pytest

from rulewright.operators import headings
from rulewright.sources import publish


@pytest.fixture
def root(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def tables(spark, rows):
    return {"rules": spark.createDataFrame(rows, "rule_id string, value double"), "uses": spark.createDataFrame([(1, "A"), (2, None)], "address int, rule_id string")}


CHECKS = {"ids": lambda t: publish.repeated(t["rules"], ["rule_id"]), "references": lambda t: publish.missing_in(t["uses"], "rule_id", t["rules"].select("rule_id"))}


def test_release(spark, root):
    made = publish.publish(spark, root, "r1", tables(spark, [("A", 1.0), ("B", None)]), CHECKS, ["rules"])
    assert made == publish.manifest(spark, f"{root}/r1") and made["tables"]["rules"]["rows"] == 2
    assert sorted(publish.read(spark, root, "r1", "rules").collect()) == [("A", 1.0), ("B", None)]
    assert spark.read.json(f"{root}/r1/{made['tables']['rules']['path']}.json").count() == 2
    with pytest.raises(FileExistsError):
        publish.publish(spark, root, "r1", tables(spark, [("A", 2.0)]), CHECKS)
    assert publish.damaged(spark, root, "r1") == []
    spark.createDataFrame([("C", 3.0)], "rule_id string, value double").write.mode("append").parquet(f"{root}/r1/{made['tables']['rules']['path']}")
    assert publish.damaged(spark, root, "r1") == ["rules"]


def test_bad_rows_publish_nothing(spark, root):
    with pytest.raises(publish.Rejected) as error:
        publish.publish(spark, root, "r1", tables(spark, [("B", 1.0), ("B", 2.0), (None, 1.0)]), CHECKS)
    assert "ids: 2 rows" in str(error.value) and "references: 1 rows" in str(error.value)
    assert publish.manifest(spark, f"{root}/r1") is None
    with pytest.raises(FileNotFoundError):
        publish.read(spark, root, "r1", "rules")
    publish.publish(spark, root, "r1", tables(spark, [("A", 1.0)]), CHECKS)  # what the failed run left is in nobody's way
    assert publish.read(spark, root, "r1", "rules").count() == 1 and len(os.listdir(f"{root}/r1")) >= 2


def test_empty_tables_and_lost_files(spark, root):
    empty = {"rules": spark.createDataFrame([], "rule_id string, value double")}
    made = publish.publish(spark, root, "none", empty, {"ids": CHECKS["ids"]})
    assert made["tables"]["rules"]["rows"] == 0 and publish.read(spark, root, "none", "rules").columns == ["rule_id", "value"]
    os.rename(f"{root}/none/{made['tables']['rules']['path']}", f"{root}/gone")
    assert publish.damaged(spark, root, "none") == ["rules"]


def test_digest(spark):
    at = lambda rows, schema="a string, b int": publish.digest(spark.createDataFrame(rows, schema))
    assert at([("x", 1), ("y", 2)]) == at([("y", 2), ("x", 1)]) and at([(1, "x")], "b int, a string") == at([("x", 1)])
    values = [at([("x", 1)]), at([("x", 1), ("x", 1)]), at([("", 1)]), at([(None, 1)]), at([("null", 1)]), at([])]
    assert len(set(values)) == len(values)


def test_anchors_equal_bisection(spark):
    rng = random.Random(5)
    heads = [(d, rng.randrange(60), f"h{d}-{i}") for d in range(12) for i in range(rng.randrange(8))]
    spans = [(d, k, s, s + rng.randrange(0, 25)) for d in range(13) for k in range(9) for s in [rng.randrange(70)]] + [(1, 99, None, 4)]
    got = {(r.doc_id, r.key): r.anchors for r in headings.anchors(spark.createDataFrame(spans, "doc_id int, key int, start int, end int"), spark.createDataFrame([*heads, (1, None, "nowhere")], "doc_id int, position int, name string")).collect()}
    for d, k, s, e in spans:
        mine = sorted((p, n) for x, p, n in heads if x == d)
        want = [] if s is None else [n for p, n in mine if p <= s][-1:] + [n for p, n in mine if s <= p < e]
        assert got[d, k] == want
    none = spark.createDataFrame([], "doc_id int, position int, name string")
    assert [r.anchors for r in headings.anchors(spark.createDataFrame([(1, 1, 0, 9)], "doc_id int, key int, start int, end int"), none).collect()] == [[]]
