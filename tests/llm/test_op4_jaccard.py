import random
import re

import pytest

from textloom.llm import op4_jaccard
from textloom.llm.op4_jaccard import near_duplicates

SCHEMA = "doc_id bigint, text string, lang string, uid bigint, digest string"


def brute(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], SCHEMA).repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families_with_frequent_tokens_match_all_pairs(spark, seed):
    """Families of over 32 texts have only frequent tokens, so their links come from token pairs."""
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = family(rng, 80, 60, 4) + family(rng, 50, 200, 9) + family(rng, 40, 16, 1) + family(rng, 6, 100, 3)
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 3, 30]))) for _ in range(60)]
    texts += ["a b c d e f g", "A B c d e f g", "a b", "a  b", "b a", "a", "aaa aaa aaa aaa", "aaa aaa aaa"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_nulls_empties_and_copies(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (9, "x y z w"), (8, "X y z\nw"), (10, "one"), (11, "one two")]
    assert run(spark, rows) == {5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (2, 8), 9: (2, 8), 10: (1, 10), 11: (1, 11)}


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(3, "x y z w"), (3, "x y z w"), (None, "x y z w"), (None, "q r s t")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == [(3, 3), (3, 3), (None, 3), (None, None)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_shares_of_the_runs_give_the_same(spark, monkeypatch):
    from textloom.llm import runs

    rng = random.Random(4)
    rows = list(enumerate(family(rng, 60, 40, 3) + family(rng, 20, 120, 6) + ["the same text " * 4] * 3))
    monkeypatch.setattr(runs, "RUNS_AT_ONCE", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[5000:])), (3, " ".join(words[:100_000]))]
    assert run(spark, rows) == {1: (199_998, 1), 2: (194_998, 1), 3: (99_998, 3)}


@pytest.mark.parametrize("variants", [10**9, 2])
def test_texts_just_apart_meet_once_and_few_are_verified(spark, monkeypatch, variants):
    """Of 1000 words, 30 texts of 2 to 4 edits link with the first, 30 of 18 to 20 with none. With edits that no other
    text has hardly any pair is left to verify; with shared ones the sketch can't tell, but a pair is made once."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(1000)]
    texts = [" ".join(base)]
    for edits in [rng.randrange(2, 5) for _ in range(30)] + [rng.randrange(18, 21) for _ in range(30)]:
        own = list(base)
        for k in rng.sample(range(5, 995, 5), edits):
            own[k] = f"e{k}x{rng.randrange(variants)}"
        texts.append(" ".join(own))
    verified, made = [], []
    verify, met = op4_jaccard._verified, op4_jaccard._met

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return verify(pairs, *rest)

    def counting(*given):
        pairs = met(*given)
        made.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(op4_jaccard, "_verified", counted)
    monkeypatch.setattr(op4_jaccard, "_met", counting, raising=False)
    rows = list(enumerate(texts))
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) == 31
    if variants > 2:
        assert sum(verified) < 120
    else:
        assert sum(m for m, _ in made) <= 3 * sum(d for _, d in made) and sum(d for _, d in made) > 100
