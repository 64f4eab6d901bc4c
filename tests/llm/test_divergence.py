import random
import re
from collections import Counter

from rulewright.llm import divergence

UP = str.maketrans(divergence.UPPER, divergence.LOWER)


def expected(rows, least, top):
    """The audit in plain Python, from its definition."""
    docs = [(lang or "", source or "", re.findall(divergence.TERM, (text or "").translate(UP))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= least}
        p = {}
        for name in [None, *{d[1] for d in mine}]:
            count = Counter(t for d in mine if name in (None, d[1]) for t in d[2] if t in kept)
            total = sum(count.values())
            p[name] = {t: (1 + 1000000000 * (count[t] + 5) // (total + 5 * len(kept)), count[t]) for t in kept}
        for s in p.keys() - {None}:
            pairs = [(o, sum(abs(p[s][t][0] - p[o][t][0]) for t in kept)) for o in p.keys() - {None, s}]
            terms = [(t, p[s][t][0] - p[None][t][0]) for t in kept if p[s][t][1] and p[s][t][0] > p[None][t][0]]
            for part, items in (("pair", pairs), ("term", terms)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or k <= top:
                        out.add((lang, s, part, item, value, k))
    return out


def test_matches_plain_python(spark):
    """Nulls, empty texts, ties, repeated rows, a source without terms, a very long text, clashing columns."""
    rng = random.Random(5)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本", "x1y", "don't", "K", "ſ", "𝒜b", "gamma", "delta", "ZZ"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None, "c"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for _ in range(80)]
    rows += [("en", "empty", None), ("en", "signs", "123 -- @"), ("xx", "one", "alpha"), ("xx", "two", ""), ("en", "a", "alpha beta " * 200_000)] + rows[:5]
    docs = spark.createDataFrame([(i % 7, t, lang, s, 1, 2, "z") for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, rank int, term string")
    for least, top in ((1, 50), (9, 3)):
        got = [tuple(r) for r in divergence.audit(docs, least, top).collect()]
        assert len(got) == len(set(got)) and set(got) == expected(rows, least, top)
    assert ("xx", "one", "pair", "two", 0, 1) in got
    assert divergence.audit(docs.limit(0)).collect() == []


def test_counts_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", "x", 10**13, 40), ("en", "b", "y", 3, 40)], "lang string, source string, term string, n long, docs long")
    got = {(r.source, r.term): (r.p, r.q) for r in divergence.profiles(counts, counts.select("lang", "source").distinct(), divergence.Scratch(spark, "t")).collect()}
    n, total = 10**13, 10**13 + 3
    assert got["a", "x"] == (1 + 10**9 * (n + 5) // (n + 10), 1 + 10**9 * (n + 5) // (total + 10))
    assert got["b", "x"] == (1 + 10**9 * 5 // 13, got["a", "x"][1]) and got["a", "y"][1] == 1 + 10**9 * 8 // (total + 10)


def test_texts_are_cut_between_terms(spark):
    docs = spark.createDataFrame([(" Beta-alpha, beta ", "en", "a"), ("", "en", "a"), (None, None, None)], "text string, lang string, source string")
    counts = divergence.term_counts(docs)
    assert {tuple(r) for r in counts.collect()} == {("en", "a", "alpha", 1, 1), ("en", "a", "beta", 2, 1)}
    assert "regexp_extract_all" not in counts._jdf.queryExecution().optimizedPlan().toString()
