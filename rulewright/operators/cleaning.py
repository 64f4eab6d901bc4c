"""Lines of a source that are not its text: navigation, and blank lines beyond the first of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line, at): lines from 1 and the place of each one's first character, from 0."""
    lines = docs.select(key, F.split(text, "\n").alias("__lines"))
    sizes = F.transform("__lines", lambda x: F.length(x) + 1)
    parts = lines.select(key, F.posexplode(F.arrays_zip(F.col("__lines").alias("line"), sizes.alias("size"))).alias("i", "x")).select(key, (F.col("i") + 1).alias("n"), "x.line", "x.size")
    before = F.sum("size").over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select(key, "n", "line", F.coalesce(before, F.lit(0)).cast("long").alias("at"))


def removal_reasons(lines: DataFrame, key: str, navigation: Column) -> DataFrame:
    """lines with reason: nav-line, blank (after another blank line that stays, or at either end), or null."""
    blank = F.trim(F.col("line")) == ""
    ordered = Window.partitionBy(key).orderBy("n")
    rows = lines.withColumn("__nav", navigation).withColumn("__blank", blank)
    stays = F.when(~F.col("__nav"), F.col("__blank"))
    previous = F.last(stays, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    last = F.max(F.when(~F.col("__nav") & ~F.col("__blank"), F.col("n"))).over(Window.partitionBy(key))
    gone = F.col("__blank") & (F.coalesce(previous, F.lit(True)) | (F.col("n") > F.coalesce(last, F.lit(0))))
    return rows.withColumn("reason", F.when(F.col("__nav"), "nav-line").when(gone, "blank")).drop("__nav", "__blank")


def kept_text(marked: DataFrame, key: str) -> DataFrame:
    """(key, text): the lines that stay; a text that loses all of them is empty."""
    rows = marked.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("n", "line")))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))


def removed_blocks(marked: DataFrame, key: str) -> DataFrame:
    """(key, reason, first, last): runs of consecutive lines that went for one reason other than being blank."""
    gone = marked.where("reason is not null and reason <> 'blank'")
    run = F.col("n") - F.row_number().over(Window.partitionBy(key, "reason").orderBy("n"))
    return gone.withColumn("__run", run).groupBy(key, "reason", "__run").agg(F.min("n").cast("long").alias("first"), F.max("n").cast("long").alias("last")).drop("__run")
