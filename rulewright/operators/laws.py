"""Laws that texts refer to: which rules are meant, and which rule gives way to which."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower
from .sizes import MOST

EDGES = "kind string, source string, target string"

# Wordings that decide what a text says about other laws.
INCLUDES = r"(?i)\b(are|is) (also )?covered\b|\beven if\b"
GIVES_WAY = r"(?i)does not apply to [^.]{0,120}(local|rent control|ordinance|RSO)|more (restrictive|protective)|local [^.]{0,60}applies instead|\byields? to\b"
FORBIDS = r"(?i)(?<!not )(?<!n't )\bpreempts?\b|prohibits? local|municipalit(y|ies) (are|is) prohibited|overrides? municipal|may not (enact|adopt) [^.]{0,40}ordinance"
DENIES = r"(?i)\b(not|n't|nor)\b[^.]{0,20}\bpreempt"
RULE_ID = r"\b[A-Z]{2,3}-[A-Z]{3,4}-[A-Z]?\d{1,2}\b"


def fitting(rows: DataFrame, patterns: DataFrame, fields: list[str]) -> DataFrame:
    """rows joined with the patterns that agree with them in every field the pattern gives; its null fits any value.

    The patterns are split by which fields they give, and each part is an equi-join on just those. A null in a
    row fits no given value. A pattern that gives no field would fit every row and is refused. Fields are kept
    once, as the rows have them; the other columns of both sides must differ in name.
    """
    given = F.concat(*(F.when(F.col(f).isNull(), "0").otherwise("1") for f in fields))
    marked = patterns.withColumn("__given", given)
    masks = dict(sorted(tuple(r) for r in marked.groupBy("__given").count().collect()))  # at most 2 ** len(fields)
    if "0" * len(fields) in masks:
        raise ValueError("a pattern gives none of " + ", ".join(fields))
    parts = []
    for mask, n in masks.items():
        on = [f for f, g in zip(fields, mask, strict=True) if g == "1"]
        part = marked.where(F.col("__given") == mask).drop("__given", *(f for f in fields if f not in on))
        parts.append(rows.join(F.broadcast(part) if n <= MOST else part, on).select(*rows.columns, *(c for c in patterns.columns if c not in fields)))
    if parts:
        return reduce(DataFrame.unionByName, parts)
    return rows.join(patterns.limit(0), fields).select(*rows.columns, *(c for c in patterns.columns if c not in fields))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def named(texts: DataFrame, patterns: DataFrame, key: list[str], unless: str | None = INCLUDES) -> DataFrame:
    """(key, law), each once: the patterns that a text holds.

    texts: (key, text, place); patterns: (law, pattern, words, place), where words are lower-case words of which every
    match holds all (at least one; a pattern without words finds nothing). A pattern runs only on texts that hold its
    rarest word over all texts. A text that fits ``unless`` names no law. A law of a place is meant only there or,
    if it is a city's ("City, ST"), in its state; a law without place anywhere. A null text names nothing. patterns may have
    ``holds``: what every match holds once it is in lower case with single spaces; the pattern runs only where a text does.
    """
    plain = F.lit("")  # what is searched for ``holds``, with the sign that a pattern without regard to case takes for an s
    if "holds" in patterns.columns:
        plain = F.translate(lower(F.regexp_replace("text", r"\s+", " ")), "ſ", "s")
    else:
        patterns = patterns.withColumn("holds", F.lit(""))
    read = texts.where(F.col("text").isNotNull())
    if unless:
        read = read.where(~F.col("text").rlike(unless))
    shown = read.select(*key, "text", "place", plain.alias("__plain"))
    wanted = patterns.select("law", F.explode(F.array_distinct("words")).alias("word"))
    few = patterns.limit(MOST + 1).count() <= MOST
    hint = F.broadcast if few else (lambda df: df)
    held = read.select(F.explode(words(F.col("text"))).alias("word"))
    counts = held.join(hint(wanted.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "word", "left").groupBy("law").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("w"))
    index = patterns.select("law", "pattern", "holds", F.col("place").alias("__of")).join(rarest.where("w.n > 0").select("law", F.col("w.word").alias("word")), "law")
    if few:
        met = shown.select("*", F.explode(words(F.col("text"))).alias("word")).join(F.broadcast(index), "word")
    else:  # only keys and words move; the texts join what was fetched
        met = read.select(*key, F.explode(words(F.col("text"))).alias("word")).join(index, "word").join(shown, key)
    there = F.col("__of").isNull() | (F.col("__of") == F.col("place")) | (F.element_at(F.split("__of", ", "), -1) == F.col("place"))
    return met.where(there & F.contains("__plain", F.col("holds"))).where(F.expr("rlike(text, pattern)")).select(*key, "law").distinct()


def markers(rules: DataFrame) -> DataFrame:
    """EDGES that the rules' own texts state: ``yields`` (the source gives way to the target) and ``preempts``
    (a pair in doubt, the smaller id first).

    rules: (rule_id, level, jurisdiction, category, interaction, attested, conflict_note). Marks in brackets name ids;
    the note of an attested rule is in doubt with every known rule it names; a state's rule whose text forbids local
    law is in doubt with its cities' rules of the category. Nulls state nothing.
    """
    note = F.coalesce("interaction", F.lit(""))
    found = lambda form: F.regexp_extract_all(note, F.lit(form), F.lit(1))
    ids = lambda form: F.flatten(F.transform(found(form), lambda x: F.transform(F.split(x, ","), lambda i: F.trim(i))))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("source"), b.alias("target"))
    own = F.col("rule_id")
    stated = F.concat(
        F.transform(ids(r"\[Yields to: ([^\]]+)\]"), lambda x: edge("yields", own, x)),
        F.transform(found(r"\[Takes precedence over ([A-Z0-9-]+)"), lambda x: edge("yields", x, own)),
        F.transform(ids(r"\[Preempts: ([^\]]+)\]"), lambda x: edge("preempts", own, x)),
        F.transform(found(r"\[Subject to preemption by ([A-Z0-9-]+)\]"), lambda x: edge("preempts", own, x)),
    )
    in_brackets = rules.select(F.explode(stated).alias("e")).select("e.*")
    noted = rules.where(F.col("attested")).select("rule_id", F.explode(F.regexp_extract_all(F.coalesce("conflict_note", F.lit("")), F.lit(RULE_ID), F.lit(0))).alias("target"))
    in_notes = noted.where("target <> rule_id").join(rules.select(F.col("rule_id").alias("target")), "target", "left_semi").select(F.lit("preempts").alias("kind"), F.col("rule_id").alias("source"), "target")
    above = rules.where((F.col("level") == "state") & forbids_local(F.col("interaction"))).select(F.col("rule_id").alias("source"), F.col("jurisdiction").alias("__st"), "category")
    by_category = above.join(_local(rules).select(F.col("rule_id").alias("target"), "__st", "category"), ["__st", "category"]).select(F.lit("preempts").alias("kind"), "source", "target")
    both = in_brackets.unionByName(in_notes).unionByName(by_category).where("target <> ''")
    pair = F.col("kind") == "preempts"
    return both.select("kind", F.when(pair, F.least("source", "target")).otherwise(F.col("source")).alias("source"), F.when(pair, F.greatest("source", "target")).otherwise(F.col("target")).alias("target")).distinct()


def forbids_local(interaction: Column) -> Column:
    return F.coalesce(F.regexp_replace(interaction, DENIES, " ").rlike(FORBIDS), F.lit(False))


def _local(rules: DataFrame) -> DataFrame:
    return rules.where((F.col("level") == "city") & F.col("jurisdiction").contains(", ")).withColumn("__st", F.element_at(F.split("jurisdiction", ", "), -1))


def marked(rules: DataFrame) -> DataFrame:
    """rules with ``overrides`` and ``interaction`` filled from what the states' texts say; markers() reads it back.

    rules: as for markers(), with disposition (accepted or held), stage and overrides (array). A state's rule that gives way
    and forbids at once gives way. Only accepted, enacted city rules of the category are named, sorted by id; a city's rule
    takes the marks of several state rules by their ids. Rules without a counterpart stay as they are.
    """
    gives = F.coalesce(F.col("interaction").rlike(GIVES_WAY), F.lit(False))
    above = rules.where((F.col("level") == "state") & F.col("disposition").isin("accepted", "held") & (gives | forbids_local(F.col("interaction"))))
    above = above.select(F.col("rule_id").alias("__s"), F.col("jurisdiction").alias("__st"), "category", gives.alias("__gives"))
    local = _local(rules).where("disposition = 'accepted' and stage = 'enacted'").select(F.col("rule_id").alias("__l"), "__st", "category")
    pairs = above.join(local, ["__st", "category"])
    up = F.concat(F.when(F.col("__gives"), "[Yields to: ").otherwise("[Preempts: "), F.array_join("__ids", ", "), F.lit("]"))
    of_states = pairs.groupBy("__s", "__gives").agg(F.array_sort(F.collect_set("__l")).alias("__ids")).select(F.col("__s").alias("rule_id"), "__ids", up.alias("__mark"))
    down = F.when(F.col("__gives"), F.concat(F.lit("[Takes precedence over "), "__s", F.lit(" where more protective]"))).otherwise(F.concat(F.lit("[Subject to preemption by "), "__s", F.lit("]")))
    each = pairs.select("__l", "__s", down.alias("__m")).groupBy("__l").agg(F.array_sort(F.collect_set(F.struct("__s", "__m"))).alias("__x"))
    of_cities = each.select(F.col("__l").alias("rule_id"), F.transform("__x", lambda x: x["__s"]).alias("__ids"), F.array_join(F.transform("__x", lambda x: x["__m"]), " ").alias("__mark"))
    none = F.array().cast("array<string>")
    joined = rules.join(of_states.unionByName(of_cities), "rule_id", "left")
    overrides = F.array_sort(F.array_union(F.coalesce("overrides", none), F.coalesce("__ids", none)))
    text = F.when(F.col("__mark").isNull(), F.col("interaction")).otherwise(F.concat_ws(" ", F.when(F.col("interaction") != "", F.col("interaction")), "__mark"))
    return joined.withColumn("interaction", text).withColumn("overrides", F.when(F.col("__ids").isNull(), F.col("overrides")).otherwise(overrides)).select(*rules.columns)


def edges(rules: DataFrame, items: DataFrame, laws: DataFrame) -> DataFrame:
    """EDGES of all kinds that the texts of rules give; precedence.resolve() takes them.

    rules: as for markers(), with own (coverage of its own) and citation. items: (rule_id, item, kind covers or exempts,
    scope, text). laws: (law, pattern, words, place, level, citation, category), as for named(); level, citation and category
    say which rules of an address are that law. ``other_law``: a rule exempts what another law reaches; the law is looked for
    in its category, or the rule's. ``depends``: a rule without coverage of its own is defined by another law's; without a rule
    that is that law its target is null. Rules that depend on another law, or whose coverage text names one, are no target.
    """
    of = rules.select("rule_id", F.col("jurisdiction").alias("place"), "own", F.col("category").alias("__cat"))
    texts = items.join(of, "rule_id").select("rule_id", "item", "kind", "scope", "text", "place", "own", "__cat")
    known = named(texts, laws.select("law", "pattern", "words", "place"), ["rule_id", "item", "kind"])
    about = known.join(texts.select("rule_id", "item", "kind", "scope", "own", "__cat"), ["rule_id", "item", "kind"])
    borrowed = ~F.col("own") & (F.col("kind") == "covers")
    exempt = about.where("kind = 'exempts' and scope = 'other_law'").select(F.lit("other_law").alias("kind"), "rule_id", "law", "__cat").distinct()
    defined = about.where(borrowed & F.col("scope").isin("other_law", "review")).select(F.lit("depends").alias("kind"), "rule_id", "law", F.lit(None).cast("string").alias("__cat")).distinct()
    asks = exempt.unionByName(defined).join(laws.select("law", F.col("place").alias("jurisdiction"), "level", F.col("citation").alias("__form"), "category"), "law")
    asks = asks.select("kind", F.col("rule_id").alias("source"), "law", "jurisdiction", "level", "__form", F.coalesce("category", "__cat").alias("category"))
    free = rules.join(about.where(borrowed).select("rule_id").distinct(), "rule_id", "left_anti").select(F.col("rule_id").alias("target"), "jurisdiction", "level", "category", "citation")
    met = fitting(free, asks, ["jurisdiction", "level", "category"])
    is_law = F.col("__form").isNull() | F.expr("rlike(coalesce(citation, ''), __form)")
    hits = met.where(is_law & (F.col("target") != F.col("source"))).select("kind", "source", "target").distinct()
    alone = defined.select("kind", F.col("rule_id").alias("source")).distinct().join(hits, ["kind", "source"], "left_anti").select("kind", "source", F.lit(None).cast("string").alias("target"))
    return hits.unionByName(alone).unionByName(markers(rules))


def review_flags(rules: DataFrame, flags: DataFrame, fields: list[str]) -> DataFrame:
    """rules with conflict_flag and conflict_note: open questions that fit a rule in every field they give.

    rules: (rule_id, disposition, fields, conflict_flag, conflict_note); flags: (flag, note, fields with null for any).
    Only accepted and held rules are flagged. Notes are added in order of the flags' ids, each once, and none that the
    rule's note holds already.
    """
    live = rules.where(F.col("disposition").isin("accepted", "held")).select("rule_id", *fields)
    hits = fitting(live, flags.select("flag", "note", *fields), fields).select("rule_id", "flag", "note")
    first = hits.withColumn("__n", F.row_number().over(Window.partitionBy("rule_id", "note").orderBy("flag"))).where("__n = 1")
    notes = first.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("flag", "note"))).alias("__notes"))
    own = F.coalesce("conflict_note", F.lit(""))
    step = lambda have, x: F.when(F.contains(have, x["note"]), have).otherwise(F.when(have == "", x["note"]).otherwise(F.concat(have, F.lit("; "), x["note"])))
    hit = F.col("__notes").isNotNull()
    out = rules.join(notes, "rule_id", "left")
    return out.withColumn("conflict_flag", F.coalesce("conflict_flag", F.lit(False)) | hit).withColumn("conflict_note", F.when(hit, F.aggregate("__notes", own, step)).otherwise(F.col("conflict_note"))).select(*rules.columns)
