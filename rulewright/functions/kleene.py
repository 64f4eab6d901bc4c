"""Three-valued logic over nullable booleans and 0/1/2 codes (false, unknown, true)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code(value: Column) -> Column:
    return F.when(value.isNull(), 1).when(value, 2).otherwise(0)


def decode(value: Column) -> Column:
    return F.when(value == 2, True).when(value == 0, False)


def negate_code(value: Column) -> Column:
    return 2 - value


def all_of(codes: Column) -> Column:
    """Aggregate: conjunction of codes."""
    return F.min(codes)


def any_of(codes: Column) -> Column:
    """Aggregate: disjunction of codes."""
    return F.max(codes)


def compare_interval(lo: Column, hi: Column, known: Column, op: str | Column, value: Column) -> Column:
    """Does a value known to lie in [lo, hi] (hi null: unbounded) stand in relation op to value?

    Null where neither answer follows from the interval, or where nothing is known.
    """
    above, below = lo > value, hi < value
    cases = {
        ">=": F.when(lo >= value, True).when(below, False),
        ">": F.when(above, True).when(hi <= value, False),
        "<=": F.when(hi <= value, True).when(above, False),
        "<": F.when(below, True).when(lo >= value, False),
        "==": F.when((lo == value) & (hi == value), True).when(above | below, False),
        "!=": F.when((lo == value) & (hi == value), False).when(above | below, True),
    }
    if isinstance(op, str):
        return F.when(known, cases[op])
    out = F.lit(None).cast("boolean")
    for name, case in cases.items():
        out = F.when(op == name, case).otherwise(out)
    return F.when(known, out)


def in_interval(lo: Column, hi: Column, known: Column, values: Column) -> Column:
    """Is a value known to lie in [lo, hi] (hi null: unbounded) one of the values (an array)? Null where that does not follow."""
    within = F.exists(values, lambda v: (v >= lo) & F.coalesce(v <= hi, F.lit(True)))
    return F.when(known, F.when(~within, False).when(lo == hi, True))
