"""The pipeline on made documents whose fate is known, and on rows without content."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
ITEM = "item_id long, text string"


def made():
    """Documents, and the texts that are left."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    line = lambda: " ".join(rng.choice(words) for _ in range(16))
    left = {i: [line() for _ in range(6)] for i in range(40)}
    item = " ".join(rng.choice(words) for _ in range(40))
    gone = {
        100: list(left[0]),  # an exact copy
        101: [" ".join(["other", *x.split()[1:]]) for x in left[1]],  # a near copy of every line
        102: [line(), line(), item, line()],  # a benchmark item
        103: [line()],  # too short
        104: [line()] * 9,  # repeats itself
    }
    texts = {i: "\n".join(x) for i, x in (left | gone).items()}
    texts[7] += "\n" + left[5][2]  # a line of an earlier document
    want = {i: "\n".join(x) for i, x in left.items()}
    return texts, want, item


def write(spark, folder, docs, labels, items):
    for name, rows, kind in (("documents", docs, DOCS), ("labels", labels, LABELS), ("benchmark", items, ITEM)):
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")


def test_known_fates(spark, tmp_path):
    texts, want, item = made()
    docs = [(i, t, "en", "web", len(t)) for i, t in texts.items()] + [(None, None, None, None, None), (200, None, "en", None, None), (201, "", "en", "web", 0), (201, "", "en", "web", 0)]
    # the copies are labelled too: in so few texts an unlabelled copy makes its pairs of words rarer in the target than in all
    write(spark, tmp_path, docs, [(i, 1, 0) for i in [*range(40), 100, 101]], [(1, item), (2, None), (3, "")])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # a fuzzy line that shares no block key with its copy stays, see the README: then that is all that is left of 101
    rest = [p for p in pieces if p.doc_id == 101]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in want.items()}
    assert sum(p.length for p in rest) < 0.5 * len(ids[1])
    assert sorted(p.doc_id for p in pieces if p.doc_id != 101) == sorted(want)
    assert {(p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id != 101} == {(i, 0, 0, len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in bins.values():
        places.sort()
        assert [a for a, _ in places] == [0, *(a + n for a, n in places[:-1])] and sum(places[-1]) <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 1


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_rows_without_content(spark, tmp_path, stage):
    write(spark, tmp_path, [(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "web", 0), (2, "", None, "web", 0), (3, " \n\t", "en", "web", 3)], [(None, None, None)], [(None, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    name, run = stage
    for rows in (docs, docs.limit(0)):
        out = run(spark, rows, str(tmp_path))
        found = out.collect()
        if name == "best_fit_packing":
            assert len(found) == rows.count()  # the closing id at least
        else:
            assert out.columns == docs.columns
            assert len(found) == (0 if name == "quality_rules" else rows.count()) or name == "minhash_near_dedup"
