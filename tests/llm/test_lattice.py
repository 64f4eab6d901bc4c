import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from rulewright.llm import lattice, packing

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def all_ways(word, log_p):
    """The probability of word over its segmentations, by recursion over what is left."""
    known = {len(word): 1.0}
    for at in range(len(word) - 1, -1, -1):
        known[at] = sum(math.exp(log_p[word[at:to]]) * known[to] for to in range(at + 1, len(word) + 1) if word[at:to] in log_p)
    return math.log(known[0])


def expected(rows):
    docs = [(i, zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))) for i, t in rows]
    train = [d for d in docs if not d[1]]
    count = Counter(w for d in train for w in d[2]) + Counter({None: len(train)})
    n, v = sum(count.values()), len(count)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    pieces, seen = lattice._pieces(packing.vocabulary()), Counter()
    for w, k in count.items():
        for i in tok.encode(" " + w, add_special_tokens=False).ids if w is not None else ():
            seen[i] += k
    over = math.log(sum(seen.values()) + len(train) + len(pieces) + 1)
    log_p = {p: math.log(seen[i] + 1) - over for i, p in enumerate(pieces)}
    out = []
    for i, held, words in docs:
        tokens = [*words, None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        lp = sum(all_ways(b" " + w.encode(), log_p) for w in words) + math.log(len(train) + 1) - over
        out.append((i, held, len(tokens), sum(count[w] > 0 for w in tokens), n, base, lp / math.log(10)))
    return out


def test_matches_plain_recursion(spark, monkeypatch):
    """Nulls, blanks, repeated rows and ids, other scripts, long words; common words by broadcast and by shuffle."""
    rng = random.Random(8)
    words = ["The", "the", "of", "Straße", "日本語", "don't", "x" * 90, "-" * 200, "qzx", "<|endoftext|>", "İ", "a b", "—", "unhappiness"]
    rows = [(i, " ".join(rng.choice(words[: 3 if rng.random() < 0.3 else None]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(1, rows[1][1]), (1, "another text"), (None, "the end"), (70, None), (71, " \n\t "), (72, "only here"), (9, "held out words " * 3)]
    docs = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, row int, n int, word string")
    key = lambda r: (str(r[0]), r[2], round(r[6], 4))
    for share in (lattice.WORD_SHARE, 20):
        monkeypatch.setattr(lattice, "WORD_SHARE", share)
        got = sorted((tuple(r) for r in lattice.score(docs).collect()), key=key)
        want = sorted(expected(rows), key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    assert any(w[1] for w in want) and any(w[3] < w[2] for w in want)


def test_empty_table_and_no_training_row(spark):
    docs = spark.createDataFrame([(9, "one two")], "doc_id long, text string")
    assert lattice.score(docs.limit(0)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lattice.score(spark.createDataFrame([(only, "one two")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == 0 and math.isfinite(r.score)


@pytest.mark.parametrize("text", ["a" * 300_000, "xyzzy-" * 50_000, "日" * 60_000])
def test_very_long_words(spark, text):
    """One word in blocks is the same as the plain recursion."""
    pieces = lattice._pieces(packing.vocabulary())
    weight = -np.array([5.0 + i % 11 for i in range(len(pieces))])
    got = lattice.Lattice(pieces, weight).log_probability([text])[0]
    log_p, most = dict(zip(pieces, weight)), max(map(len, pieces))
    word = b" " + text.encode()
    alpha = [0.0]
    for e in range(1, len(word) + 1):
        ways = [alpha[s] + log_p[word[s:e]] for s in range(max(0, e - most), e) if word[s:e] in log_p]
        alpha.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
    assert abs(got - alpha[-1]) < 1e-6 * abs(got)


def test_likely_text_scores_higher(spark):
    """Held-out texts of the corpus' words against the same letters shuffled."""
    rng = random.Random(2)
    words = "the river ran below the old stone bridge while every winter brought more snow to its quiet valley".split()
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    rows = {i: " ".join(rng.choice(words) for _ in range(30)) for i in range(300) if i not in held}
    for k, i in enumerate(held):
        text = " ".join(rng.choice(words) for _ in range(30))
        rows[i] = text if k % 2 else " ".join("".join(rng.sample(w, len(w))) for w in text.split())
    got = {r.doc_id: r.score / len(rows[r.doc_id]) for r in lattice.score(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert min(got[i] for i in held[1::2]) > max(got[i] for i in held[::2])
