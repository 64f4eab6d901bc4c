"""What is known of a building: dwelling units from several sources, and three-state use flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def units_fact(stated: Column, described: Column, commercial: Column, ranged: Column, lo: Column, hi: Column) -> Column:
    """Struct lo, hi, certainty, warnings (array): the number of dwelling units and where it comes from.

    The stated number (text) counts as exact, unless it differs from the described one and is among the commercial
    counts; then the described one counts; then the range that the use code implies (ranged: it implies one; lo and
    hi null: open). A number outside of the range is kept with a warning.
    """
    number = F.when(stated.rlike("^[0-9]+$"), stated.try_cast("long"))
    differs = F.coalesce(number != described, F.lit(False))
    shops = differs & F.coalesce(F.array_contains(commercial, number), F.lit(False))
    exact = F.when(~shops, number)
    value = F.coalesce(exact, described)
    certainty = F.when(exact.isNotNull(), "exact").when(described.isNotNull(), "parsed").when(ranged, "range").otherwise("unknown")
    outside = ranged & F.coalesce((value < lo) | (value > hi), value < lo, value > hi, F.lit(False))
    warnings = F.array_compact(F.array(F.when(shops, "column_is_commercial_count"), F.when(differs & ~shops, "column_vs_description"), F.when(outside, "value_vs_use_code")))
    open_end = lambda end: F.coalesce(value, F.when(ranged, end))
    return F.struct(open_end(lo).alias("lo"), open_end(hi).alias("hi"), certainty.alias("certainty"), warnings.alias("warnings"))


def use_flags(dataset: Column, matches: Mapping[str, Column], domains: Mapping[str, Sequence[str]], ruled_out: Sequence[str]) -> Column:
    """Array of (flag, value): true where an entry matches, else false where the class rules the flag out or the
    dataset's codes would tell, else null. matches holds a condition per flag."""
    rows = []
    for flag, hit in matches.items():
        told = [name for name, flags in domains.items() if flag in flags]
        known = F.lit(flag in ruled_out) | dataset.isin(told)
        rows.append(F.struct(F.lit(flag).alias("flag"), F.when(hit, True).when(known, False).alias("value")))
    return F.array(*rows)
