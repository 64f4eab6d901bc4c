import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rulewright.llm import packing


def test_fullest_is_a_subset_sum_optimum():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in got.items())


def test_packs_gaplessly_with_the_tokenizer_ids(spark):
    rng = random.Random(4)
    words = ["the", "of", "ça", "naïve", "12", "<|endoftext|>", "\n", "  ", "x" * 300, "日本"]
    texts = [None, "", "a"] + [" ".join(rng.choice(words) for _ in range(rng.choice([5, 50, 700, 9000]))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "z", 0, 0), (3, texts[3], 1, 2)], "doc_id long, text string, length int, rank int")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = packing.pack_documents(docs).collect()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)} | {None: [*tok.encode("z").ids, 0]}
    for i, ids in want.items():
        mine = sorted({(r.piece, r.start, bytes(r.ids)) for r in rows if r.doc_id == i})
        assert [s for _, s, _ in mine] == list(np.cumsum([0, *(len(b) // 4 for *_, b in mine)])[:-1])
        assert np.frombuffer(b"".join(b for *_, b in mine), "<u4").tolist() == ids
        assert all(len(b) == 8192 for _, _, b in mine[1:])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= total // 2048 + 2
    light = packing.pack_documents(docs, with_ids=False).collect()
    assert sorted((r.ids_crc32, r.length) for r in light) == sorted((zlib.crc32(bytes(r.ids)), r.length) for r in rows)
    joined = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packing.pack_documents(docs)).collect()}
    assert sum(joined.values()) == total
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_query_ids_are_the_tokenizer_files_at_its_defaults(spark, tmp_path):
    from rulewright.llm import queries

    texts = [None, "", "a<|endoftext|>b", " <|endoftext|> \n<|endoftext|><|endoftext|>", "<|endoftext|", "x <|endoftext|> y " * 900, "<|EndOfText|> plain", " " * 1_000_000, "a" + " " * 5000 + "b", "q7" * 40_000, "x" * 3000 + "<|endoftext|>" + "\n" * 9000 + "end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in queries.op5_best_fit_packing(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert ("<|endoftext|>" in (t or "")) == (50256 in ids)
        assert packing.has_long_run(t or "") == (i in (7, 8, 9, 10))
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want |= {(i, k): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert got == want
