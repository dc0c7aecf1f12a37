import random

import corpus_pipeline as P
from textloom.llm.op5_decontaminate import contaminated
from textloom.llm.op4_jaccard import near_duplicates

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randrange(20, 120))) for _ in range(80)]
    texts += texts[:10] + [t + " more" for t in texts[10:14] if len(t.split()) > 60]
    item = " ".join(word() for _ in range(25))
    texts += [texts[20] + " " + item, None, "", "123 456", " "]
    rows = [(i, t, "en", rng.choice("ab"), len(t or "")) for i, t in enumerate(texts)]
    return rows, [(1, item)]


def test_stages(spark, tmp_path):
    rows, items = made()
    root = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "tokens"]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = P.language(spark, docs, root)
    assert kept.columns == P.COLUMNS
    assert {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    once = P.near_duplicates(spark, kept, root)
    groups = {r.doc_id: r.component_id for r in near_duplicates(kept.select("doc_id", "text")).collect()}
    assert once.columns == P.COLUMNS and sorted(r.doc_id for r in once.collect()) == sorted(set(groups.values()))
    clean = P.decontamination(spark, once, root)
    hit = {r.doc_id for r in contaminated(once, spark.read.parquet(f"{root}/benchmark.parquet")).where("contaminated").collect()}
    assert hit and {r.doc_id for r in clean.collect()} == {r.doc_id for r in once.collect()} - hit
    mixed = P.mixture(spark, clean, root)
    assert mixed.columns == P.COLUMNS
    words = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    total = sum(words[r.doc_id] for r in mixed.collect())
    assert abs(total - 1.5 * sum(words.values())) < 240
    result = P.run(spark, root).orderBy("start").collect()
    assert len(result) == mixed.count()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(result, result[1:], strict=False))


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (None, "x y z w", "en", "s", 7), (2, "a b c d e", "en", "s", 9)], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, df, "").collect()), key=str) == [(1, "a b c d e"), (None, "x y z w")]


def test_clean_texts_under_an_id_that_copies_share_stay(spark):
    a, b, c = ("a b c d e f", "the only text of its kind", "another text that stands alone")
    rows = [(1, a), (2, a.upper()), (2, b), (3, b + " "), (None, c), (None, c), (None, a), (4, ""), (4, ""), (5, None), (2, b)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, c), (4, ""), (5, None)], key=str)


def test_empty_table_through_run(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_mixture_of_alike_rows_and_null_ids(spark):
    rows = [(1, "a b c d", "en", "s", 7)] * 4 + [(None, "x y z", None, None, 5), (2, None, "en", "s", 0), (3, "q " * 40, "en", "t", 80)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", row_key string, copies int")
    got = P.mixture(spark, df, "")
    assert got.columns == P.COLUMNS
    counts = {}
    for r in got.collect():
        counts[(r.doc_id, r.text)] = counts.get((r.doc_id, r.text), 0) + 1
    # sizes 16, 40 and 3 weigh 3, 1 and 2 of 88.5 words, at most 32, 80 and 6
    assert counts[(1, "a b c d")] == 8 and counts[(None, "x y z")] == 2 and counts[(3, "q " * 40)] in (1, 2)
    assert P.mixture(spark, df.limit(0), "").count() == 0


def test_copies_of_five_word_similarity_over_0_8_are_one(spark):
    def similarity(a, b, n):
        x, y = ({tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    words = [f"w{i}" for i in range(204)]
    near = [f"e{i}" if i in (50, 100, 150, 200) else w for i, w in enumerate(words)]
    far = [f"f{i}" if i % 35 == 20 else w for i, w in enumerate(words)]
    a, b, c = (" ".join(x) for x in (words, near, far))
    assert 0.81 < similarity(a, b, 5) < 0.83 and similarity(a, b, 3) < 0.9 and similarity(a, c, 5) < 0.8 and similarity(b, c, 5) < 0.8
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate((a, b, c))], SCHEMA)
    assert sorted(r.doc_id for r in P.near_duplicates(spark, df, "").collect()) == [0, 2]
