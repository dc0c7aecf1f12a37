import random
import re

from textloom.llm import op9_mixing as M

SCHEMA = "doc_id bigint, text string, source string, size string, s string"


def expected_targets(sizes):
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {x: (3, 1, 2)[i % 3] for i, x in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [x for x in names if x not in full]
        level = (total - sum(full.values())) / max(1e-9, sum(weight[x] for x in open_))
        over = [x for x in open_ if level * weight[x] > 2 * sizes[x]]
        if not over:
            return full | {x: level * weight[x] for x in open_}
        full |= {x: 2.0 * sizes[x] for x in over}


def made():
    rng = random.Random(7)
    rows = []
    for i in range(600):
        source = rng.choice(["hot"] * 6 + ["a", "B", "é", "tiny", None])
        text = rng.choice([None, "", " \n"]) if i % 40 == 0 else "w " * rng.randrange(1, 80)
        rows.append((i, text, source, "x", "y"))
    return rows + rows[:30] + [(9999, None, "void", "x", "y")]


def test_targets_and_taken(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [r.asDict() for r in M.mixed(df).collect()]
    assert len(got) == len(rows)
    count = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, s, *_ in rows}
    sizes = {}
    for i, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + count[i]
    wanted = expected_targets(sizes)
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == count[r["doc_id"]] and r["source_size"] == sizes[s] and abs(r["target"] - wanted[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 80, s
    again = [r.asDict() for r in M.mixed(df.repartition(7)).collect()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_selection_is_the_prefix_of_the_keys(spark):
    """The bins must choose what a sort of the whole source chooses."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3], "x", "y") for i in range(900)], SCHEMA)
    import math

    from pyspark.sql import functions as F

    weight = 1.0 + F.col("doc_id") % 5
    keyed = {r[0]: r[1] for r in df.select("doc_id", (F.pmod(F.xxhash64(F.lit(M.SEED), "doc_id", F.xxhash64("text")), F.lit(1 << 52)) + 0.5) / float(1 << 52)).collect()}
    got = {r.doc_id: r for r in M.mixed(df, weight).collect()}
    for k in range(3):
        own = sorted((-math.log(keyed[i]) / (1 + i % 5), i) for i in range(k, 900, 3))
        copies = [got[i].copies for _, i in own]
        assert copies == sorted(copies, reverse=True) and max(copies) - min(copies) <= 1
    # of the part that is drawn, the heavier are more often in
    drawn = [r for r in got.values() if 0 < sum(x.copies for x in got.values() if x.source_size == r.source_size)]
    low, high = ([r.copies for r in drawn if r.doc_id % 5 == w] for w in (0, 4))
    assert sum(high) > sum(low)


def test_quality_tells_junk(spark):
    clean = "The river rises in the hills and runs past the old town.\nIts water turns two mills below the bridge."
    texts = [clean, " ".join(w + "###" for w in clean.split()), "\n".join([clean.split("\n")[0]] * 12), "buy now " * 60, "", None]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.q for r in df.select("i", M.quality(M.words_of(F.lower("text")), F.col("text")).alias("q")).orderBy("i").collect()]
    assert got[0] == 1.0 and got[1] == got[3] == M.LEAST_WEIGHT and got[2] < 0.1 and all(M.LEAST_WEIGHT <= x <= 1 for x in got)


def test_a_very_long_text_and_ids_that_repeat(spark):
    rows = [(1, "long words " * 300_000, "a", "x", "y"), *((None, f"text {i}", "a", "x", "y") for i in range(40)), *((7, "same", "b", "x", "y") for _ in range(40))]
    got = M.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["size"] for r in got) == 600_000 + 80 + 40 and all(r.taken <= 2 * r["size"] and r.copies <= 2 for r in got)
    target = next(r.target for r in got if r.doc_id == 7)
    assert abs(sum(r.taken for r in got if r.doc_id == 7) - target) <= 1


def test_empty_and_sizeless(spark):
    df = spark.createDataFrame([(1, None, "a", "x", "y")], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in M.mixed(df).collect()] == [(0, 0.0, 0)]
    assert M.mixed(df.limit(0)).count() == 0
