"""Texts that are worded alike: a set-similarity join by rare tokens, and what is left without near repeats.

The ratio of two texts is 200 * (longest common subsequence) / (sum of lengths), in per cent; two empty texts have 100.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.writers import shared_folder


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one whole number."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([200.0 * common(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def _tokens(text: Column, size: int) -> Column:
    """Runs of ``size`` characters, each with how often it stood before: a set that counts repeats."""
    grams = F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    ordered = F.array_sort(grams)  # equal runs stand together, so a run's number is its distance from the first
    return F.get(F.transform(F.array(ordered), lambda a: F.transform(a, lambda g, i: F.concat(g, F.lit("\x00"), (i + 1 - F.array_position(a, g)).cast("string")))), F.lit(0))


def _shuffled(rows: DataFrame) -> DataFrame:
    """rows for a join that never gathers them at the driver: exploded rows are many more than Spark's estimate of them."""
    return rows.hint("merge")


def pairs(texts: DataFrame, group: str, key: str, text: str, percent: int) -> DataFrame:
    """(group, a, b, score): texts of a group, a's key the smaller, with a ratio of ``percent`` (over 75) or more.

    texts: (group, key, text), key unique in a group; a null group or text is like nothing. No pair is lost. With d the share
    of unlike characters, 1 - percent / 100, a text of n characters has partners of m >= n (1 - d) / (1 + d) only, with
    c >= (1 - d) (n + m) / 2 characters in common. Of its n - 1 pairs of neighbours at most 2 (n - c) + (m - c) do not outlast
    the changes, so two that are alike share one among their rarest pairs of that number and one more. Texts so short that
    none need outlast them, and those long enough to be their partners, meet by their rarest single characters as well, of which
    at most n - c are lost. Equal texts are compared once, as one text with its keys.
    """
    if not 75 < percent <= 100:
        raise ValueError("percent must be over 75, at most 100")
    d = 1 - percent / 100
    known = texts.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(text).alias("t"))
    each = known.groupBy("g", "t").agg(F.min("k").alias("k"))
    size = F.length("t")
    shortest = (1 - d) / (1 + d)
    lost_pairs = (2 - 1.5 * (1 - d)) + (1 - 1.5 * (1 - d)) * shortest  # of each character, with the shortest partner
    lost_single = 1 - (1 - d) / 2 * (1 + shortest)
    brief = 2 / (1 - lost_pairs) / shortest
    kinds = F.array(
        F.struct(F.lit(2).alias("size"), _tokens(F.col("t"), 2).alias("tokens"), (size * lost_pairs).alias("lost")),
        F.struct(F.lit(1).alias("size"), F.when(size <= brief + 1, _tokens(F.col("t"), 1)).alias("tokens"), (size * lost_single).alias("lost")),
    )
    held = each.select("g", "k", size.alias("n"), F.explode(kinds).alias("x")).select("g", "k", "n", "x.size", "x.lost", F.explode("x.tokens").alias("token"))
    often = held.groupBy("g", "size", "token").agg(F.count("*").alias("often"))
    ranked = _shuffled(held).join(often, ["g", "size", "token"]).withColumn("rank", F.row_number().over(Window.partitionBy("g", "k", "size").orderBy("often", "token")))
    rare = ranked.where(F.col("rank") <= F.floor(F.col("lost") + 1e-6) + 1).select("g", "k", "n", "token")
    other = rare.select("g", "token", F.col("k").alias("k2"), F.col("n").alias("n2"))
    near = 2 * F.least("n", "n2") >= (1 - d) * (F.col("n") + F.col("n2")) - 1e-6
    met = _shuffled(rare).join(other, ["g", "token"]).where((F.col("k") < F.col("k2")) & near).select("g", "k", "k2").distinct()
    left, right = each.select("g", "k", F.col("t").alias("ta")), each.select("g", F.col("k").alias("k2"), F.col("t").alias("tb"))
    scored = _shuffled(_shuffled(met).join(left, ["g", "k"])).join(right, ["g", "k2"]).withColumn("score", ratio("ta", "tb")).where(F.col("score") >= percent - 1e-9)
    ends = lambda c: known.select("g", F.col("t").alias(f"t{c}"), F.col("k").alias(c))
    unlike = _shuffled(_shuffled(scored.select("g", "ta", "tb", "score")).join(ends("a"), ["g", "ta"])).join(ends("b"), ["g", "tb"]).select("g", "a", "b", "score")
    return unlike.select(F.col("g").alias(group), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def _kept(spark: SparkSession, folder: str, rows: DataFrame, name: str) -> DataFrame:
    rows.write.parquet(f"{folder}/{name}")
    return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")


def first_of_alike(texts: DataFrame, group: str, key: str, text: str, percent: int, folder: str) -> DataFrame:
    """(group, key): what is left if each group's texts are taken by key and one that is like a text taken before is not.

    folder: shared by driver and executors; every round is written there, so lost executors repeat one round only. A round
    settles every text whose earlier like texts are settled; their number is that of the longest chain of like texts, each after
    the one before. Of equal texts the first counts. Rows with a null group or text are left out.
    """
    spark = texts.sparkSession
    place = f"{folder.rstrip('/')}/similar-{uuid.uuid4().hex}"
    known = texts.where(F.col(group).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(group).alias("g"), F.col(text).alias("t")).agg(F.min(key).alias("k"))
    one = _kept(spark, place, known, "texts")
    links = pairs(one, "g", "k", "t", percent).select("g", F.col("a").alias("before"), F.col("b").alias("k"))
    links = _kept(spark, place, links, "links")
    linked = links.select("g", "k").distinct()
    kept = [_shuffled(one.select("g", "k")).join(linked, ["g", "k"], "left_anti")]  # nothing like them before
    fresh, turn = kept[0], 0
    while links.limit(1).count():
        turn += 1
        gone = _shuffled(links).join(fresh.withColumnRenamed("k", "before"), ["g", "before"], "left_semi").select("g", "k").distinct()
        gone = _kept(spark, place, gone, f"gone{turn}")
        # a text that goes holds back none after it; what then has no earlier like text left is taken
        rest = _shuffled(_shuffled(links).join(gone, ["g", "k"], "left_anti")).join(gone.withColumnRenamed("k", "before"), ["g", "before"], "left_anti")
        rest = _kept(spark, place, rest, f"rest{turn}")
        fresh = _shuffled(_shuffled(links.select("g", "k").distinct()).join(gone, ["g", "k"], "left_anti")).join(rest.select("g", "k").distinct(), ["g", "k"], "left_anti")
        fresh = _kept(spark, place, fresh, f"taken{turn}")
        kept.append(fresh)
        links = rest
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.select(F.col("g").alias(group), F.col("k").alias(key))


def in_force(rows: DataFrame, group: str, key: str, text: str, start: str, until: str, as_of: Column, percent: int, folder: str | None = None) -> DataFrame:
    """The rows in force at as_of, without those whose text is like that of an earlier one of the group: by start (open
    first), then key. A null start or until is open; both days are included.

    folder: as for first_of_alike(); shared_folder() if not given.
    """
    folder = folder or shared_folder(rows.sparkSession)
    live = rows.where((F.col(start).isNull() | (F.col(start) <= as_of)) & (F.col(until).isNull() | (as_of <= F.col(until))))
    turn = F.concat(F.coalesce(F.date_format(start, "yyyyMMdd"), F.lit("00000000")), F.lit("/"), F.lpad(F.col(key).cast("string"), 20, "0"))
    ordered = live.withColumn("__turn", turn)
    left = first_of_alike(ordered, group, "__turn", text, percent, folder)
    return _shuffled(ordered).join(left, [group, "__turn"], "left_semi").select(*rows.columns)
