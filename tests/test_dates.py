"""Cutoffs and dates in texts, Spanish words and contract rules against hand-made cases."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rulewright.functions import dates, spanish
from rulewright.operators import contracts

DAY = datetime.date


@pytest.mark.parametrize(
    ("text", "year", "want"),
    [
        ("housing first built on or before October 1, 1978 is covered", 1978, DAY(1978, 10, 1)),
        ("a building constructed prior to January 5, 1999", 1999, DAY(1999, 1, 4)),
        ("built before Jan. 5, 1999", 1999, DAY(1999, 1, 4)),
        ("completed BEFORE Sept 5 1999", 1999, DAY(1999, 9, 4)),
        ("sold on or before January 5, 1999", 1999, None),
        ("built before December 31, 1990", 1990, DAY(1990, 12, 30)),
        ("built on or before December 31, 1990", 1990, None),
        ("a certificate of occupancy issued on or before December 31, 1990", 1990, DAY(1990, 12, 31)),
        ("a certificate of occupancy issued after January 5, 1999", 1999, None),
        ("built. Sold before January 5, 1999", 1999, None),
        ("built before 2/30/1999", 1999, None),
        ("built before 2/3/1999 or completed before 3/3/1999", 1999, None),
        ("built before 2/3/1999, and completed before February 3, 1999", 1999, DAY(1999, 2, 2)),
        (None, 1999, None),
    ],
)
def test_certificate_day(spark, text, year, want):
    row = spark.createDataFrame([(text, year)], "t string, y int").select(dates.certificate_day(F.col("y"), F.col("t"), F.lit(None).cast("string")).alias("d")).first()
    assert row.d == want


def test_stands_in(spark):
    day = DAY(2024, 9, 5)
    yes = ["2024-09-05", "September 5, 2024", "september 05 2024", "Sep. 5, 2024", "SEPT 5, 2024", "sept. 5 2024", "5 September 2024", "05 sep 2024", "9/5/2024", "09/05/24", "9-5-24", "9.5.2024", "on September\n 5, 2024.", "(9/5/24)"]
    no = ["2024-09-051", "x2024-09-05", "19/5/2024", "9/5/20245", "9/5-2024", "September 15, 2024", "September. 5, 2024", "5/9/2024", "é9/5/24", ""]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", dates.stands_in(F.lit(day), F.col("t")).alias("ok")).collect()
    assert {r.t for r in rows if r.ok} == set(yes)


def test_spelled_numbers(spark):
    # How Spanish writes these.
    want = {1: "un", 16: "dieciséis", 31: "treinta y un", 99: "noventa y nueve", 100: "cien", 101: "ciento un", 999: "novecientos noventa y nueve"}
    assert {n: spanish.spelled()[n] for n in want} == want and len(set(spanish.spelled())) == 1000
    rows = spark.createDataFrame([(Decimal(x),) for x in ("1.005", "2000000", "0.5", "1001000.10")], "a decimal(18,3)").select(spanish.money_words(F.col("a")).alias("w")).collect()
    assert [r.w for r in rows] == ["UN PESOS 01/100 M.N.", "DOS MILLONES DE PESOS 00/100 M.N.", "CERO PESOS 50/100 M.N.", "UN MILLÓN MIL PESOS 10/100 M.N."]


def test_contract_rules(spark):
    clauses = spark.createDataFrame([("t", 1, "open", True, "federal", False, False, ["name"], [], []), ("t", 2, "cap", False, "any", False, True, ["deposit"], ["cap"], ["N2"]), ("t", 3, "local", False, "state", False, False, [], ["local"], []), ("t", 4, "bond", True, "federal", True, False, ["bond"], [], [])], contracts.CLAUSES)
    requirements = spark.createDataFrame([("N1", "FED", "cap", "law", True), ("N2", "FED", "other", "law", True), ("A1", "A", "cap", "law", True), ("A2", "A", "local", "guide", True), ("B1", "B", "local", "law", True), ("B2", "B", "cap", "law", False)], contracts.REQUIREMENTS)
    rows = [(1, "A", True, True, Decimal(2), "t", "x"), (2, "B", True, None, Decimal(0), "t", ""), (3, "A", False, False, None, "t", None), (4, "A", True, False, Decimal("2.01"), "other", "x")]
    deals = spark.createDataFrame(rows, "id int, state string, verified boolean, guarantor boolean, deposit decimal(18,4), template string, who string")
    planned = contracts.clause_plan(deals, clauses, requirements).cache()
    got = {(r.id, r.key): (r.reason, list(r.requirements)) for r in planned.collect()}
    assert len(got) == 12 and got[1, "cap"] == (None, ["A1", "N1", "N2"]) and got[3, "cap"] == (None, ["N1", "N2"])
    assert got[2, "cap"][0] == "no_deposit_agreed" and got[2, "bond"][0] == "no_guarantor" and got[1, "bond"] == (None, [])
    assert (got[1, "local"][0], got[2, "local"], got[3, "local"][0]) == ("no_verified_requirement", (None, ["B1"]), "federal_law_only")
    missing = {(r.id, r.field): list(r.requirements) for r in contracts.missing_fields(planned, "id", {"name": F.col("who"), "deposit": F.col("deposit")}).collect()}
    assert missing == {(2, "name"): [], (3, "name"): [], (3, "deposit"): ["N1", "N2"]}
    checks = spark.createDataFrame([("N1", "deposit", op, Decimal(2)) for op in ("lt", "le", "eq", "ge", "gt", "lt")], contracts.CHECKS)
    broken = sorted((r.id, r.op) for r in contracts.violations(planned, "id", checks, {"deposit": F.col("deposit")}).collect())
    assert broken == [(1, "gt"), (1, "lt")]
