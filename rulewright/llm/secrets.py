"""Secret scans: base patterns, and sliding-window Shannon entropy. DataFrame functions only.

Base spans come from three patterns (leftmost, not overlapping, per kind). Further candidates are runs of
20 or more of ``[A-Za-z0-9+/_=-]`` with a letter and a digit. Each is put in a character class (hex, one
letter case and digits, mixed), and the entropy of its windows of 20 characters is kept up as the window
slides: a character that enters or leaves changes its own count and that count's term. A candidate whose best window
reaches its class's threshold is a span of kind ``entropy`` unless the allow-list knows its shape (slugs
and paths of plain words and numbers, UUIDs, placeholders) or it overlaps a base span.

All work is per row; texts are searched whole. Places are code points, ends exclusive. Defined results:
a null text counts as empty and has no spans; repeated rows and null ids are scanned row by row; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # the runs [0-9a-f]+ of 24 characters or more
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 6
RUN = 256
UNIT = 1 << 32
WINDOW = 20
#: (class, pattern of the whole candidate, least entropy in bits of a window of 20 characters)
CLASSES = (("hex", "[0-9a-f]+|[0-9A-F]+", 3.0), ("one case", "[0-9a-z]+|[0-9A-Z]+", 3.4), ("mixed", ".*", 3.8))
ALLOWED = (
    r"(?:[A-Za-z]+|[0-9]+)(?:[-_/+=]+(?:[A-Za-z]+|[0-9]+))*[-_/+=]*",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r".*(?:EXAMPLE|example|xxxx|XXXX|0123456789|abcdefgh).*",
)
_SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"


def found(text: Column, pattern: str, kind: int, group: int | None = None) -> Column:
    """Spans of a pattern: what lies between the matches gives their places. value: a group of the match.

    Matches are taken in runs of RUN, each with its own start, so that a text with very many of them does
    not copy one growing array for each.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = matches if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), value.alias("value"))
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["match"])
        span = F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.when(x["match"].isNull(), acc).otherwise(F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")))

    def spans(parts: Column) -> Column:
        run = lambda k: F.slice(parts, k * RUN + 1, F.lit(RUN))
        runs = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int"))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(runs, first, lambda acc, k: F.struct((acc["at"] + F.aggregate(run(k), F.lit(0), lambda n, x: n + size(x))).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
        begin = lambda at: F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans"))
        return F.flatten(F.transform(starts, lambda at, k: F.aggregate(run(k), begin(at), add)["spans"]))

    return bound(parts, spans)


def window_entropy(value: Column) -> Column:
    """The largest entropy in bits of any window of WINDOW characters.

    The accumulator holds the count of every character of the window. A step changes one count, by the
    character that leaves or enters, and the sum of n * log2(n) by that count's term; so a candidate takes
    time in proportion to its length.
    """
    # in units of 2**-32: sums of whole numbers do not drift
    terms = F.array(*(F.lit(round(n * math.log2(n) * UNIT) if n > 1 else 0).cast("long") for n in range(WINDOW + 2)))
    places = ord("z") - ord("+") + 1
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - (ord("+") - 1))  # from 1

    def steps(codes: Column) -> Column:
        enter = lambda c: F.struct(c.alias("code"), F.lit(1).alias("by"))
        leave = lambda i: F.struct(F.get(codes, i - WINDOW).alias("code"), F.lit(-1).alias("by"))
        return F.flatten(F.transform(codes, lambda c, i: F.when(i < WINDOW, F.array(enter(c))).otherwise(F.array(leave(i), enter(c)))))

    def step(acc: Column, x: Column) -> Column:
        n = F.element_at(acc["counts"], x["code"])
        counts = F.concat(F.slice(acc["counts"], F.lit(1), x["code"] - 1), F.array(n + x["by"]), F.slice(acc["counts"], x["code"] + 1, F.lit(places)))
        total = acc["total"] + F.get(terms, n + x["by"]) - F.get(terms, n)
        seen = acc["seen"] + F.when(x["by"] > 0, 1).otherwise(0)
        full = (x["by"] > 0) & (seen >= WINDOW)
        least = F.when(full, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), total.alias("total"), seen.alias("seen"), least.alias("least"))

    start = F.struct(F.array_repeat(F.lit(0), places).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("seen"), F.lit(round(WINDOW * math.log2(WINDOW) * UNIT)).cast("long").alias("least"))
    return math.log2(WINDOW) - F.aggregate(bound(codes, steps), start, step)["least"] / (UNIT * WINDOW)


def suspicious(value: Column) -> Column:
    """Has a letter and a digit, is no allowed shape, and is random enough for its class."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    least = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(whole(pattern), F.lit(bits)).otherwise(least)
    plain = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    for p in ALLOWED:
        plain = plain & ~whole(p)
    return F.when(plain, window_entropy(value) >= least - 1e-9).otherwise(F.lit(False))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, stop, kind number, value; sorted) of every row of docs."""
    return spans_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))).select("doc_id", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def spans_of(rows: DataFrame) -> DataFrame:
    """rows (__text, not null, and more columns) with __base, the spans of the patterns, and __spans, those and the entropy spans."""
    none = F.array().cast(_SPAN)
    where = lambda test, spans: F.when(test, spans).otherwise(none)
    text = F.col("__text")
    assign = F.filter(found(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    base = F.concat(where(text.rlike(ASSIGN), assign), where(text.contains("AKIA"), found(text, ACCESS, 1)), where(text.rlike(HEX), found(text, HEX, 2)))
    # a digit among 19 others of a candidate; the exact test is made on each candidate
    maybe = text.rlike(r"[A-Za-z0-9+/_=-]{20}") & text.rlike(r"[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]")
    rows = rows.withColumn("__base", base).withColumn("__runs", where(maybe, F.filter(found(text, CANDIDATE, 3), lambda s: s["value"].rlike("[0-9]"))))
    free = lambda s: ~F.exists("__base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    more = F.when(F.size("__runs") > 0, F.filter("__runs", lambda s: suspicious(s["value"]) & free(s))).otherwise(none)
    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"], s["value"])))
    return rows.withColumn("__spans", order(F.concat("__base", more))).withColumn("__base", order("__base")).drop("__runs")


def digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row of docs."""
    rows = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", count(0), count(1), count(2), F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span that scan() finds replaced, columns as they came."""
    rows = spans_of(docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    text = F.col("__text")

    def cut(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(inside, acc["out"]).otherwise(piece).alias("out"))

    done = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut)
    masked = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return rows.withColumn("text", F.when(F.size("__spans") > 0, masked).otherwise(F.col("text"))).select(*docs.columns)
