"""The register of rules: ids that outlive a run, merged records, and records that contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import small


def stable_ids(rows: DataFrame, existing: DataFrame, cell: list[str], uid: str, order: list[str]) -> DataFrame:
    """rows with number: the one their uid had in the same cell, else the next free one of the cell by order.

    existing: (uid, cell columns, number). Of rows that claim one number the first by order keeps it. Numbers of
    the cell that no row claims any more are not given away again.
    """
    prior = existing.select(F.col(uid), *cell, F.col("number").alias("__prior"))
    claimed = rows.join(prior, [uid, *cell], "left")
    turn = F.row_number().over(Window.partitionBy(*cell, "__prior").orderBy(*order))
    claimed = claimed.withColumn("__keeps", F.col("__prior").isNotNull() & (turn == 1))
    used = existing.groupBy(*cell).agg(F.max("number").alias("__used"))
    fresh = F.row_number().over(Window.partitionBy(*cell, "__keeps").orderBy(*order))
    numbered = claimed.join(used, cell, "left").withColumn("__fresh", F.coalesce("__used", F.lit(0)) + fresh)
    number = F.when(F.col("__keeps"), F.col("__prior")).otherwise(F.col("__fresh")).cast("long")
    return numbered.withColumn("number", number).select(*rows.columns, "number")


def merged(rows: DataFrame, cluster: str, rank: list[Column], first: list[str], same: list[str], most: list[str], some: list[str], every: list[str]) -> DataFrame:
    """One row per cluster, its members taken in rank order (the last rank must tell any two apart).

    first: the first value that is not null. same: the value, if all members agree on it (null is a value).
    most: the largest. some: true for a member. every: true for all. All are map-side aggregates, so a large
    cluster is not brought together in one task.
    """
    named = rows.withColumn("__rank", F.struct(*rank))
    ahead = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c)
    agreed = lambda c: F.when((F.count(c) == F.count("*")) & F.min(c).eqNullSafe(F.max(c)), F.min(c)).alias(c)
    aggregates = [*map(ahead, first), *map(agreed, same), *(F.max(c).alias(c) for c in most), *(F.bool_or(c).alias(c) for c in some), *(F.bool_and(c).alias(c) for c in every)]
    return named.groupBy(cluster).agg(F.count("*").alias("members"), *aggregates)


#: Into how many parts the pairs of one cell are dealt, so that a large cell is not one task's work.
PARTS = 8


def contradictions(rules: DataFrame, key: str, cell: list[str], document: str, laws: str, value: str, touching: DataFrame | None = None) -> DataFrame:
    """(a, b, laws): rules of one cell and at least one law in different documents that state different values.

    Laws are counted once for each two sets of laws of a cell, in a join on the cell and each law; rules meet through their
    sets, so those without a law in common never do, and pairs are neither shuffled nor counted. Only those of a key with
    several rows are. touching: a table of keys, of which a pair must hold one.
    """
    given = F.array_sort(F.array_distinct(F.array_compact(F.col(laws))))
    rows = rules.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(cell)), F.col(document).alias("doc"), F.col(value).alias("value"), given.alias("laws"))
    rows = rows.withColumn("many", F.count("*").over(Window.partitionBy("k")) > 1)
    cells, asked = [f"c{i}" for i in range(len(cell))], F.lit(True)
    if touching is not None:
        rows = rows.hint("merge").join(touching.select(F.col(key).alias("k"), F.lit(True).alias("asked")).distinct(), "k", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        rows = rows.hint("merge").join(rows.where("asked").select(*cells).distinct(), cells, "left_semi")  # where none is asked for, none meet
        asked = F.col("l.asked") | F.col("r.asked")
    sets = rows.select(*cells, "laws").distinct().withColumn("law", F.explode("laws"))
    common = sets.join(sets.withColumnRenamed("laws", "its"), [*cells, "law"]).groupBy(*cells, "laws", "its").agg(F.count("*").alias("n"))
    n = 4 * max(rules.sparkSession.sparkContext.defaultParallelism, int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        on = [*cells, "its", "part"]
        one = left.hint("merge").join(common, [*cells, "laws"]).withColumn("part", F.pmod(F.xxhash64("k"), F.lit(PARTS)).cast("int")).drop("laws")
        other = right.withColumnRenamed("laws", "its").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        apart = (F.col("l.k") < F.col("r.k")) & (F.col("l.doc") != F.col("r.doc")) & (F.col("l.value") != F.col("r.value")) & asked
        pairs = one.repartition(n, *on).hint("merge").alias("l").join(other.repartition(n, *on).alias("r"), [*(F.col(f"l.{c}") == F.col(f"r.{c}") for c in on), apart])
        return pairs.select(F.col("l.k").alias("a"), F.col("r.k").alias("b"), F.col("n").alias("laws"))

    once, often = rows.where("not many"), rows.where("many")
    rest = met(often, rows).unionByName(met(once, often)).groupBy("a", "b").agg(F.sum("laws").alias("laws"))
    return met(once, once).unionByName(rest)


def new_contradictions(rules: DataFrame, before: DataFrame, key: str, cell: list[str], document: str, laws: str, value: str) -> DataFrame:
    """(a, b): contradictions among rules that were none among before, the same table at an earlier time.

    Two rules that both stand in before as they are now contradicted each other then as well, so only pairs with a key whose
    rows have changed are looked for, on both sides.
    """
    columns = [key, *cell, document, laws, value]
    both = rules.select(*columns, F.lit(0).alias("__then")).union(before.select(*columns, F.lit(1)))
    changed = both.groupBy(*columns).agg(F.min("__then").alias("__first"), F.max("__then").alias("__last")).where("__first = __last").select(key).distinct()
    found, known = (contradictions(rows, key, cell, document, laws, value, changed).select("a", "b") for rows in (rules, before))
    return not_yet_known(found, known)


def not_yet_known(found: DataFrame, known: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of found that known holds in neither order. Few known pairs go to every task, so those found stay where they are."""
    ordered = lambda df: df.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    return ordered(found).join(small(ordered(known).distinct()), [a, b], "left_anti")


def unions_by_law(rules: DataFrame, state: str, level: str, jurisdiction: str, category: str, key: str) -> DataFrame:
    """(state_rule, local_rule): rules of a state and those of its cities ("City, ST") in the same category;
    local_rule is null where the state has none there."""
    local = rules.where(F.col(level) == "city").select(F.element_at(F.split(jurisdiction, ", "), -1).alias("__st"), F.col(category).alias("__cat"), F.col(key).alias("local_rule"))
    above = rules.where(F.col(level) == "state").select(F.col(state).alias("__st"), F.col(category).alias("__cat"), F.col(key).alias("state_rule"))
    return above.join(local, ["__st", "__cat"], "left").select("state_rule", "local_rule")
