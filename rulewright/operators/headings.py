"""The headings that spans of a document stand under."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchors(spans: DataFrame, headings: DataFrame, document: str = "doc_id") -> DataFrame:
    """spans with ``anchors``: the name of the last heading at or before their start, then those inside them, in order.

    spans: (document, key, start, end), end exclusive, key unique in a document; headings: (document, position, name). Of
    headings at one position the smaller name comes first, and the other is the nearer one. A span before any heading has
    only those inside it, or none; nulls in start or end give none. One sort by position in each document finds the
    number of headings before a span's start and end; the names in between come from a join on document and number.
    A document's rows are sorted in one task but not gathered in it.
    """
    numbered = headings.where(F.col("position").isNotNull()).select(document, F.col("position").cast("long").alias("at"), "name")
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy(document).orderBy("at", "name")).cast("long"))
    none, flat = F.lit(None).cast("long"), ("at", "turn", "number", "key")
    marks = numbered.select(document, "at", F.lit(1).alias("turn"), "number", F.lit(None).cast(spans.schema["key"].dataType).alias("key"))
    # a start takes headings up to itself as before it (turn 2), those from itself on as inside: both ends look strictly before (turn 0)
    ends = F.explode(F.array(*(F.struct(F.col(c).cast("long").alias("at"), F.lit(t).alias("turn"), F.lit(w).alias("which")) for c, t, w in (("start", 2, "near"), ("start", 0, "from"), ("end", 0, "to")))))
    asked = spans.where("start is not null and end is not null").select(document, "key", ends.alias("x")).select(document, "x.at", "x.turn", none.alias("number"), "key", "x.which")
    both = marks.withColumn("which", F.lit(None).cast("string")).select(document, *flat, "which").unionByName(asked.select(document, *flat, "which"))
    before = F.last("number", True).over(Window.partitionBy(document).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    count = lambda w: F.coalesce(F.max(F.when(F.col("which") == w, F.col("before"))), F.lit(0))
    found = both.withColumn("before", before).where("which is not null").groupBy(document, "key").agg(count("near").alias("near"), count("from").alias("lo"), count("to").alias("hi"))
    inside = F.when(F.col("hi") > F.col("lo"), F.sequence(F.col("lo") + 1, F.col("hi"))).otherwise(F.array().cast("array<bigint>"))
    nearest = F.when(F.col("near") > 0, F.array("near")).otherwise(F.array().cast("array<bigint>"))
    wanted = found.select(document, "key", F.posexplode(F.concat(nearest, inside)).alias("place", "number"))
    named = wanted.join(numbered.select(document, "number", "name"), [document, "number"]).groupBy(document, "key").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("__named"))
    names = F.coalesce(F.transform("__named", lambda x: x["name"]), F.array().cast("array<string>"))
    return spans.join(named, [document, "key"], "left").select(*(spans[c] for c in spans.columns), names.alias("anchors"))
