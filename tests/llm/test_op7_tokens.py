import zlib

import numpy as np
import pytest

from textloom.llm import op7_tokens as T

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["It's a test, don't worry!", None, "", "Ünïcode ÀÉ 日本語 12345    x", "<|endoftext|> a <|startoftext|>", "word " * 3000, "a\x1cb\x85c", "İ ΑΣ ς ́x", "!!!  '''s 's"]


def expected(texts):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(10 * i, t, 3) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, start bigint").repartition(3)
    got = sorted(tuple(r) for r in T.tokenized(df, f"file://{tmp_path}/out").collect())
    assert [r[1:] for r in got] == expected(TEXTS) and [r[0] for r in got] == [10 * i for i in range(len(TEXTS))]


def test_sequences_are_slices_of_the_file(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words " * 700) for i in range(20)], "doc_id bigint, text string").coalesce(1)
    parts = T.write_tokens(df, f"file://{tmp_path}/out", PATH, size=64)
    total = sum(n for _, _, n in parts)
    count = 0
    for _, path, n in parts:
        file = T.TokenFile(path)
        for i in range(len(file)):
            ids, mask = file[i]
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
            count += mask.true_count
            assert mask.true_count == 64 or i == len(file) - 1
        assert n == sum(file[i][1].true_count for i in range(len(file)))
    assert count == total


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (None, "z"), (5, "a")], "doc_id bigint, text string")
    got = sorted((tuple(r) for r in T.tokenized(df).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 5, 5, 5] and [r[1:] for r in got] == expected(["z", "a", "a", "b"])


def test_empty(spark):
    assert T.tokenized(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_folder_opens_by_its_manifest(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id bigint, text string").repartition(3)
    folder = f"file://{tmp_path}/out"
    T.write_tokens(df, folder, PATH, size=64)
    # an attempt that was lost left files
    (tmp_path / "out" / "part-000000-99-deadbeef.arrows").write_bytes(b"half")
    (tmp_path / "out" / "part-000000-99-deadbeef.docs").write_bytes(b"")
    got = sorted(tuple(r) for r in T.open_tokens(spark, folder).collect())
    assert [r[1:] for r in got] == expected([f"some words {i}" for i in range(50)])
    told = T.manifest(folder)
    assert told["sequence"] == 64 and told["end_id"] == 1 and told["vocabulary"] == "word_bpe_49k.json" and sum(x["ids"] for x in told["files"]) == sum(r[2] for r in got)


def test_words_by_the_short_way_and_forgotten_ones(monkeypatch):
    import random

    import pyarrow as pa

    rng = random.Random(7)
    letters = "abcXYZéÉßØ'.,!#<|>0İſ日́ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(500)]
    monkeypatch.setattr(T, "REMEMBERED", 50)
    monkeypatch.setattr(T, "PIECE", 100)
    e = T.Encoder(PATH)
    assert e.plain is not None
    got, goes_on = [], False
    for some, on in T.pieces(pa.array([*texts, " ".join(texts), None])):
        ids, counts = e.texts(some, b"")
        each = [list(x) for x in __import__("numpy").split(ids, counts.cumsum()[:-1])]
        if goes_on:
            got[-1] += each.pop(0)
        got += each
        goes_on = on
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, " ".join(texts), ""]]
    assert got == want
