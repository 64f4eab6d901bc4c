import hashlib
import math
import random
import re
from collections import Counter

from rulewright.llm import secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def entropy(s):
    return max(-sum(n / 20 * math.log2(n / 20) for n in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))


def brute(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        s = m[0]
        if not (re.search("[A-Za-z]", s) and re.search("[0-9]", s)) or any(re.fullmatch(p, s) for p in secrets.ALLOWED):
            continue
        least = next(bits for _, p, bits in secrets.CLASSES if re.fullmatch(p, s))
        if entropy(s) >= least - 1e-9 and not any(a < m.end() and m.start() < b for a, _, b in base):
            more.append((m.start(), 3, m.end()))
    name = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    kinds = Counter(k for _, k, _ in base)
    return kinds[0], kinds[1], kinds[2], hashlib.sha256(name(base).encode()).hexdigest(), name(base + more)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    b64 = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    parts = [lambda: "password: hunter22", lambda: "PassWd='abc'", lambda: "secret=token:abcdefgh", lambda: "api_key = \"é\"", lambda: f"apikey={b64(12)}", lambda: "AKIA" + b64(18).upper(), lambda: "AKIAX",
             lambda: hexes(rng.choice([20, 23, 24, 40])), lambda: b64(rng.choice([19, 20, 44])), lambda: "long-slug-of-words-2024-and-more", lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "é日本", lambda: " ", lambda: "\n", lambda: "the", lambda: "a1" * 15, lambda: "𝒳"]
    texts = [None, "", "token=secret: \"abcdefghij\"", "x" * 5000 + " token=abcdef"] + ["".join(rng.choice(parts)() + rng.choice(["", " ", " ", "; "]) for _ in range(rng.randint(1, 30))) for _ in range(250)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "", 0)], "doc_id long, text string, base int")
    rows = secrets.report(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == brute(texts[r.doc_id]), texts[r.doc_id]
    assert any("entropy" in r.spans for r in rows)
    assert secrets.report(docs.limit(0)).collect() == []
    out = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert out[2] == "[secret]: \"abcdefghij\"" and out[0] is None
    assert secrets.redact(docs).columns == docs.columns


def test_redact_takes_entropy_spans_too(spark):
    text = "the key is Zx9kQ2mV7bT4wR8yL1nP5sD3 here, \U0001d4b3 and q7W2e9R4t1Y8u3I6o5P0aSdF."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain words")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.report(docs).collect()}[1].count("entropy") == 2
    out = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert out == {1: "the key is [secret] here, \U0001d4b3 and [secret].", 2: None, 3: "plain words"}


def test_long_candidates_and_many_matches(spark):
    rng = random.Random(5)
    value = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))
    many = " ".join(f"token={i:06d} \U0001d4b3" for i in range(3000))
    docs = spark.createDataFrame([(1, value), (2, many), (3, "ab1" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.report(docs).collect()}
    for i, text in ((1, value), (2, many)):
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256, got[i].spans) == brute(text)
    assert got[3].spans == "hex:0:60000"
