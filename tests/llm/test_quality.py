import random
import re
from collections import Counter

from rulewright.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    rng = random.Random(5)
    bits = ["a", "b", "c d", "\n", "\n\n", " ", "\t", "é#", "ü|x", "\x0b", " ", "<b>", "日本", ".\n"]
    texts = [None, "", " ", "\n", "a", "a\n", "\na\na", "a\n\na\n"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(None, "x y", False), (5, "a\n", True)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 60)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            n = brute(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r.kept and r.base_failed)
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.judge(docs.limit(0), labels.limit(0)).collect() == []
    assert {r.score for r in quality.judge(docs, labels.limit(0)).collect()} == {0.0}


def test_junk_scores_below_prose(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(20)]
    prose = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(60)]
    junk = [" | ".join(f"k{rng.randrange(10**6)}" for _ in range(120)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(60, 70)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == set(range(60))


def test_labelled_junk_goes_and_held_out_good_stays(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = labels.where("xxhash64(doc_id) % 2 = 0")
    scored = quality.judge(docs, half).where("not base_failed").join(labels, "doc_id")
    junk = [r.kept for r in scored.where("quality = 0").collect()]
    held = [r.kept for r in scored.join(half, "doc_id", "left_anti").where("quality = 1 and coalesce(toxic, 0) = 0").collect()]
    assert len(junk) > 200 and not any(junk)
    assert len(held) > 1000 and sum(held) >= 0.95 * len(held)


def test_table_grows_with_the_target(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7919 + j * j) % 50000}" for j in range(2000))) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    sizes = [len(quality.fit(docs, labels.where(f"doc_id < {n}"))) for n in (1, 100)]
    assert sizes[0] < sizes[1]
