import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from textloom.llm import runs
from textloom.llm.op2_substring import FingerprintIndex, _RepeatedWindows, repeated_substrings
from textloom.llm.store import Scope

SCHEMA = "doc_id bigint, text string, lang string, digest string, copies bigint"


def brute(texts, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "d", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def made(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(50)]
    texts = [None, "", " \n ", "one two", " ".join(passage[:34]), " ".join(passage), "ab " * 36, "ab " * 35, "x y " * 40, "é ü " * 60]
    for _ in range(25):
        own = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own) + 1)
            a = rng.randrange(16)
            own[at:at] = passage[a : a + rng.choice([30, 34, 35, 36, 50])]
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    return texts + texts[8:14]


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = made(seed)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_substrings(frame(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)


def test_kept_texts(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = ["a b " + passage + " c", passage + " d"]
    got = {r.doc_id: r.kept for r in repeated_substrings(frame(spark, texts), texts=True).collect()}
    assert got == {0: "a b c", 1: "d"}


def test_empty_table(spark):
    assert repeated_substrings(frame(spark, ["a"]).limit(0)).count() == 0


def test_regular_texts_that_differ_stay(spark):
    """Windows of Thue-Morse words, which polynomial hashes modulo a power of two don't tell apart."""
    x = "a"
    while len(x) < 1024:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"r{i}" for i in range(34))
    texts = [f"{x} {rest}", f"{y} {rest}", " ".join(x[:40]) + " end", " ".join(y[:40]) + " fin"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_substrings(frame(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == brute(texts) and got[0][1] == 0


def test_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"x{i}" for i in range(600_000)) + " " + passage, "start " + passage]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeated_substrings(frame(spark, texts)).collect()}
    assert got == {0: (600_040, 40), 1: (41, 40)}


def batches_of(texts, sizes):
    at = 0
    for n in sizes:
        yield at, texts[at : at + n]
        at += n


def test_index_over_batches(spark, tmp_path):
    texts = made(5)
    index = FingerprintIndex(spark, f"file://{tmp_path}/index")
    seen = []
    for number, (first, batch) in enumerate(batches_of(texts, (12, 1, 10, len(texts) - 23))):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.add(frame(spark, batch, first)).collect()}
        # a batch is judged against what came before and itself
        assert [got[first + i] for i in range(len(batch))] == brute(seen + batch)[len(seen) :]
        seen += batch
        if number == 2:
            assert len(index.levels()) == 3
            index.compact()
            assert len(index.levels()) == 1
    # by now all is history: whatever has a window is repeated; history holds hashes and no texts
    got = [(r.n_words, r.n_removed) for r in index.add(frame(spark, texts)).collect()]
    assert all(removed == n for n, removed in got if n >= 35)
    columns = spark.read.parquet(index.levels()[0] + "/windows").columns
    assert columns == ["bucket", "keys", "more"]


def test_a_level_that_isnt_whole_is_not_read(spark, tmp_path):
    index = FingerprintIndex(spark, f"file://{tmp_path}/index")
    text = " ".join(f"w{i}" for i in range(50))
    index.add(frame(spark, [text]))
    (tmp_path / "index" / "level-00001-dead" / "prints").mkdir(parents=True)
    assert len(index.levels()) == 1
    assert index.add(frame(spark, [text])).first().n_removed == 50
    assert index.add(frame(spark, ["a"]).limit(0)).count() == 0


@pytest.fixture
def many_runs(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shares_of_the_runs_give_the_same(spark, monkeypatch, many_runs):
    monkeypatch.setattr(runs, "RUNS_AT_ONCE", 2)
    assert runs.runs(frame(spark, made(9)), lower=False).count() > 2
    texts = made(9)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_substrings(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_shares_with_history(spark, monkeypatch, many_runs, tmp_path):
    monkeypatch.setattr(runs, "RUNS_AT_ONCE", 1)
    texts = made(6)
    index = FingerprintIndex(spark, f"file://{tmp_path}/index")
    index.add(frame(spark, texts[:15]))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.add(frame(spark, texts[15:], 15)).collect()}
    assert [got[i] for i in range(15, len(texts))] == brute(texts)[15:]


def test_a_share_of_thousands_of_runs_is_dealt_at_once(spark, monkeypatch):
    """One bucket of 3,000 runs in two shares. Sorting a share anew for each of its runs took minutes."""
    rng = np.random.default_rng(1)
    # some keys are there again, with the same check or with another one
    pool, checks = rng.integers(0, 1 << 60, 300_000, dtype=np.uint64), rng.integers(0, 1 << 60, 3, dtype=np.uint64)
    rows = []
    for i in range(3000):
        keys = np.sort(rng.choice(pool, 150, replace=False))
        rows.append({"bucket": 0, "run_id": i, "keys": keys.tobytes(), "more": checks[rng.integers(0, 3, 150)].tobytes() + bytes(150)})
    expected = dict(zip((r["run_id"] for r in rows), _RepeatedWindows().found(rows), strict=True))
    assert 0 < np.unpackbits(np.frombuffer(b"".join(expected.values()), np.uint8)).sum() < 450_000
    monkeypatch.setattr(runs, "RUNS_AT_ONCE", 1500)
    pieces = spark.createDataFrame([tuple(r.values()) for r in rows], runs.PIECE)
    began = time.monotonic()
    with Scope(spark) as s:
        got = {r.run_id: bytes(r.found) for r in runs.merge(s, pieces, _RepeatedWindows(), 3000).collect()}
    assert got == expected and time.monotonic() - began < 40


def test_many_windows_of_one_key_are_told_apart():
    by = _RepeatedWindows()
    rows = [{"run_id": i, "bucket": 0, "keys": np.array([5, 7, 7, 7 + i], np.uint64).tobytes(), "more": np.array([1, i, 10 + i, 20], np.uint64).tobytes() + bytes(4)} for i in range(5)]
    keys, more = by.gathered(rows)
    whole = {"run_id": 0, "bucket": 0, "keys": keys, "more": more}
    assert by.dealt(whole, by.found([whole])[0], rows) == by.found(rows)
