import random

import pytest

from textloom.llm import op10_licenses as L

SCHEMA = "doc_id bigint, text string, template string, w string, n bigint"


def brute(text, templates):
    out = {}
    words = [w for w in __import__("re").split(L.BETWEEN, (text or "").translate(str.maketrans(L.UPPER, L.LOWER))) if w]
    for c in L.classes(templates):
        inside = c.window - L.SHINGLE + 1
        for t in c.templates:
            best = None
            for i in range(0, max(0, len(words) - c.shortest) + 1, c.stride):
                shingles = {" ".join(words[j : j + L.SHINGLE]) for j in range(i, min(i + inside, len(words) - L.SHINGLE + 1))}
                shared = len(shingles & set(t.shingles))
                if shared >= t.needed and (best is None or shared > best[0]):
                    best = (shared, i)
            if best:
                out[t.name] = best
    return out


def test_against_every_window(spark):
    rng = random.Random(8)
    templates = L.parse(L.TEMPLATES)
    texts = [None, "", "short", "Released under the MIT License", "released UNDER the (MIT) license!!! licensed under cc by-nc 4.0"]
    for k in range(80):
        own = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(120))]
        notice = rng.choice(list(L.TEMPLATES.values())).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            notice[rng.randrange(len(notice))] = "changed"
        at = rng.randrange(len(own) + 1)
        texts.append(" ".join(own[:at] + notice + own[at:]) if k % 4 else " ".join(own))
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {}
    for r in L.licenses(df).collect():
        assert r.containment == r.shared / r.n_shingles
        got.setdefault(r.doc_id, {})[r.template] = (r.shared, r.start)
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t, templates))}


def test_a_joined_table_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "x", "y", 1)] * 2, SCHEMA)
    whole = sorted(map(tuple, L.licenses(df).collect()))
    monkeypatch.setattr(L, "BROADCAST", 0)
    assert sorted(map(tuple, L.licenses(df).collect())) == whole and len(whole) == 4


def test_hundreds_of_long_templates(spark):
    rng = random.Random(9)
    templates = {f"L{k}": " ".join(f"t{rng.randrange(3000)}" for _ in range(rng.randrange(20, 600))) for k in range(300)}
    names = rng.sample(sorted(templates), 12)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(200)) + " " + templates[n] + " the end" for n in names] + ["nothing of the kind " * 50]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)
    got = sorted((r.doc_id, r.template, r.containment) for r in L.licenses(df, templates).collect())
    assert got == [(i, n, 1.0) for i, n in enumerate(names)]


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "filler words of no use " * 100_000 + " Released under the MIT License.", "x", "y", 1)], SCHEMA)
    assert [(r.template, r.shared) for r in L.licenses(df).collect()] == [("MIT", 1)]


def test_bands_make_a_miss_unlikely():
    for c in L.classes(L.parse(L.TEMPLATES)):
        inside = c.window - L.SHINGLE + 1
        for t in c.templates:
            assert (1 - t.needed / (inside + len(t.shingles) - t.needed)) ** c.bands <= L.MISS * 1.0001


def test_short_templates_are_refused_and_empty_table(spark):
    with pytest.raises(ValueError):
        L.parse({"x": "too few words"})
    assert L.licenses(spark.createDataFrame([], SCHEMA)).count() == 0
