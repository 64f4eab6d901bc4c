"""Merging, units, words and sinks against plain versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rulewright.functions import spanish, text
from rulewright.operators import evidence, merging, register, rules, status
from rulewright.sources import readers, writers


def test_merge_clusters_match_a_greedy_loop(spark):
    rows = [(i, "j", "s" if i % 7 else "t", None if i % 3 == 0 else i % 4, None if i % 5 == 0 else i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, jur string, sig string, kv long, eff long")
    got = {r.id: r.cluster for r in merging.merge_clusters(df, ["jur"], "sig", "kv", "eff", "id").collect()}
    fits = lambda x, y: all(a is None or b is None or a == b for a, b in zip(x[3:], y[3:], strict=True))
    clusters = []
    for r in rows:
        home = next((c for c in clusters if c[0][2] == r[2] and all(fits(x, r) for x in c)), None)
        clusters.append([r]) if home is None else home.append(r)
    assert got == {r[0]: c[0][0] for c in clusters for r in c}


def test_follow_ends_and_circles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (8, 9), (9, 8), (7, 70)], "k long, into long")
    assert {r.k: r.last for r in merging.follow(df, "k", "into").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: None, 9: None, 7: 70}


# Unit counts that these type codes stand for.
@pytest.mark.parametrize(
    ("code", "units"),
    [("3S-F-D-6U-NH", 6), ("4-S-BT-21U-H", 21), ("3B-7U/4B-24U-G", 31), ("2F-4U/2F-2U", 6), ("5B-1OU", 10), ("13B-93U-2C-G", 93), ("2,4B-16U-H-X", 16), ("4 1/2B-10U-BA", 10), ("3SF3UG", None), ("USCB16UG", None), ("3SB", None)],
)
def test_units(spark, code, units):
    assert spark.range(1).select(text.units_in(F.lit(code))).first()[0] == units


def test_words(spark):
    want = {0: "cero", 1: "un", 21: "veintiún", 31: "treinta y un", 100: "cien", 101: "ciento un", 1000: "mil", 2_000_000: "dos millones", 1_001_100: "un millón mil cien", -1: None}
    rows = spark.createDataFrame([(n,) for n in want], "n long").select("n", spanish.number_words(F.col("n")).alias("w")).collect()
    assert {r.n: r.w for r in rows} == want


def test_citations(spark):
    for given, base in (("§ 16729(a)", "§ 16729"), ("2A:18-61.1(f)", "2A:18-61.1"), ("8.22.G", "8.22")):
        assert spark.range(1).select(text.base_citation(F.lit(given))).first()[0] == base


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", None)], "id long, kind string, xs array<long>")
    writers.json_lines(df, f"{tmp_path}/j", ["kind"])
    assert {(r.id, r.kind) for r in spark.read.json(f"{tmp_path}/j").collect()} == {(1, "a"), (2, "b")}
    writers.json_lines(df.where("id = 2").withColumn("id", F.lit(3)), f"{tmp_path}/j", ["kind"])
    assert {(r.id, r.kind) for r in spark.read.json(f"{tmp_path}/j").collect()} == {(1, "a"), (3, "b")}
    writers.tables(df, f"{tmp_path}/t", ["kind"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    writers.csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").where("id = 1").first().xs == "[1,2]"
    writers.append_records(df, f"{tmp_path}/s", "id")
    writers.append_records(df, f"{tmp_path}/s", "id")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 4


def test_ids_beyond_two_digits(spark):
    rows = spark.range(101).selectExpr("'A' AS g", "id")
    ids = [r.rule_id for r in rules.assign_ids(rows, ["g"], ["id"]).orderBy("id").collect()]
    assert ids == [f"A-H{n:02d}" for n in range(1, 102)]


def test_search_folds_accents_and_puts_starts_first(spark):
    from rulewright.plans.queries import search

    rows = spark.createDataFrame([(1, "Del Ángel"), (2, "ÁNGELES"), (3, "Angelópolis"), (4, "Norte"), (5, None)], "k long, name string")
    assert [r.k for r in search(rows, "name", "ángel", "k", 10).collect()] == [2, 3, 1]


def test_diff_tells_null_from_omitted(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    got = {tuple(r) for r in status.diff(rows((1, "a"), (2, None), (3, None), (4, "d")), rows((1, "a"), (2, None), (3, "c"), (5, None)), ["k"], "v").collect()}
    assert got == {(3, None, "c"), (4, "d", "omitted"), (5, "omitted", None)}


def test_chains_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (1, 2, "a"), (2, 1, "")], "c int, n int, t string")
    got = [(r.c, r.t, r.sha, r.prev_sha) for r in evidence.link_hashes(rows, "c", "n", "t").orderBy("c", "n", "t").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == [(1, None, sha(":"), None), (1, "a", sha(":a"), sha(":")), (1, "b", sha("a:b"), sha(":a")), (2, "", sha(":"), None)]


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("doc,url\n a ,http://x\nb,\n")
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.csv"), ["doc", "url"]).orderBy("doc").collect()] == [("a", "http://x"), ("b", "")]
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "1.txt").write_text("SOURCE: http://x\nRETRIEVED: 2024-05-06T07:08:09Z\nFirst line\nsecond\n")
    (folder / "2.txt").write_text("no head")
    got = {r.path[-5:]: r for r in readers.headed_texts(spark, str(folder)).collect()}
    assert got["1.txt"].ok and got["1.txt"].source == "http://x" and got["1.txt"].text == "First line\nsecond\n" and got["1.txt"].retrieved.year == 2024
    assert not got["2.txt"].ok
    rows = readers.json_records(spark.createDataFrame([('{"k": 1}',), ("{oops",), ("[1]",), (None,)], "line string"), "line").collect()
    assert [r.usable for r in rows] == [True, False, False, False]


_PARTS_OF_RULES = "k int, cell string, doc int, laws array<int>, v int"


def _contradicting(rows):
    found = {}
    for a in rows:
        for b in rows:
            if None not in (a[0], b[0], a[1], b[1], a[4], b[4]) and a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and a[4] != b[4]:
                n = len({x for x in a[3] if x is not None} & {x for x in b[3] if x is not None})
                if n:
                    found[a[0], b[0]] = found.get((a[0], b[0]), 0) + n
    return found


_SOME_RULES = [(i, f"c{i % 3}", i % 4, [i % 5, i % 7 + 10, i % 5, None][: i % 5], i % 6 or None) for i in range(60)] + [(7, "c1", 9, [2, 10], 8), (None, "c1", 9, [2], 8), (8, None, 9, [3], 8)]


def test_contradictions_of_repeated_keys_and_nulls(spark):
    rules = spark.createDataFrame(_SOME_RULES, _PARTS_OF_RULES)
    found = register.contradictions(rules, "k", ["cell"], "doc", "laws", "v")
    assert sorted(tuple(r) for r in found.collect()) == sorted((*p, n) for p, n in _contradicting(_SOME_RULES).items())


def test_contradictions_do_not_shuffle_pairs(spark):
    rules = spark.createDataFrame(_SOME_RULES[:60], _PARTS_OF_RULES)
    found = register.contradictions(rules, "k", ["cell"], "doc", "laws", "v")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a" not in plan.split("+- == Initial Plan ==")[0]


def test_new_contradictions_of_changed_rules(spark):
    before = [r if r[0] is None or r[0] % 4 else (*r[:4], 99) for r in _SOME_RULES if r[0] is None or r[0] % 5]
    frames = (spark.createDataFrame(rows, _PARTS_OF_RULES) for rows in (_SOME_RULES, before))
    found = register.new_contradictions(*frames, "k", ["cell"], "doc", "laws", "v")
    assert sorted(tuple(r) for r in found.collect()) == sorted(set(_contradicting(_SOME_RULES)) - set(_contradicting(before)))


def test_timeline_of_repeated_keys_is_decided_in_the_row(spark):
    rows = spark.createDataFrame([(1, "2000-01-05"), (1, "2000-01-09"), (2, None)], "k int, since string").withColumn("since", F.to_date("since"))
    days = F.transform(F.array(F.lit("2000-01-05"), F.lit("2000-01-09"), F.lit("2000-01-09"), F.lit(None)), lambda x: x.cast("date"))
    found = status.timeline(rows, F.when(F.col("since") > F.col("as_of"), "open").otherwise("held"), days)
    assert sorted((r.k, str(r.since), str(r.d), r.before, r.after) for r in found.collect()) == [(1, day, day, "open", "held") for day in ("2000-01-05", "2000-01-09")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_case_letter_by_letter(spark):
    row = spark.createDataFrame([("Straße ﬁn É", "ΟΔΟΣ İ a\x0bb")], "a string, b string").select(text.upper(F.col("a")).alias("a"), text.quote_form(text.upper(F.col("a")), True).alias("c"), text.quote_form(F.col("b"), True).alias("b")).first()
    assert tuple(row) == ("STRAßE ﬁN É", "straße ﬁn é", "οδοσ i a\x0bb")


def test_texts_are_composed_in_small_batches(spark):
    rows = spark.createDataFrame([("é  \r\n",), ("plain \n",), (None,)], "t string").select(text.canonical(F.col("t")).alias("c"))
    assert [r.c for r in rows.collect()] == ["é\n", "plain\n", None]
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().executedPlan().toString()
