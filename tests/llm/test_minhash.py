import random
import re

from rulewright.llm import minhash

LOW = {i: i + 32 for i in range(65, 91)}


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one two"), (7, "é e"), (8, "a b c")]
    at = 10
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((at, " ".join(text)))
            at += rng.randint(1, 3)
    # a chain in which each text is like its neighbours only
    text = [rng.choice(words) for _ in range(200)]
    for _ in range(15):
        rows.append((at, " ".join(text)))
        at += 1
        for _ in range(4):
            text[rng.randrange(200)] = rng.choice(words)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, component_id string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == brute(rows, 3, 85)
    kept = minhash.dedup(docs, 3, 85)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[2]}


def test_repeats_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b c d")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert minhash.near_duplicates(docs.limit(0), 3, 85).collect() == []
