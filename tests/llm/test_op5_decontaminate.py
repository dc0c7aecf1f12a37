import hashlib
import random
import re

from textloom.llm import op5_decontaminate as O

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for _, t in docs:
        w, found = words(t), set()
        hit = [False] * len(w)
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[a : a + k]))) is not None:
                    found |= got
                    hit[a : a + k] = [True] * k
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((len(w), sum(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), sum(hit) > 0))
    return out


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "a1", "é", "x"]) + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 30])))) for i in range(40)]
    items += [(100, None), (101, "!!!"), (102, items[-1][1]), (9, "another text of item nine"), (103, "rep rep rep rep rep rep rep rep rep rep rep rep")]
    docs = [(0, None), (1, ""), (2, "rep " * 30), (2, "rep " * 30)]
    for i in range(60):
        own = [word() for _ in range(rng.randrange(40))]
        if rng.random() < 0.7:
            t = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(own) + 1)
            own[at:at] = t[rng.randrange(3) :]
        docs.append((10 + i, rng.choice([" ", ", ", "\n"]).join(own).upper() if i % 3 else " ".join(own)))
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "en", 5) for i, t in docs], "doc_id bigint, text string, lang string, n_words bigint").coalesce(1)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return [tuple(r)[1:] for r in O.contaminated(d, b).collect()]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, items = case(3)
    monkeypatch.setattr(O, "BLOCK_BYTES", 200)
    monkeypatch.setattr(O, "KEPT_BYTES", 1000)
    assert run(spark, docs, items) == brute(docs, items)


def test_spans_and_kept_columns(spark):
    d = spark.createDataFrame([("en", "x x one two three x")], "lang string, text string")
    b = spark.createDataFrame([(4, "One, two three!")], "item_id bigint, text string")
    r = O.contaminated(d, b, spans=True, keep=["lang", "text"]).first()
    assert (r.lang, r.n_hit, [tuple(h) for h in r.hits], r["items"]) == ("en", 3, [(2, 5)], ["4"])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[1:4] for r in O.contaminated(d, b).collect()] == [(2, 0, 0)]
    assert O.contaminated(d.limit(0), b).count() == 0


def test_item_ids_may_be_strings(spark):
    d = spark.createDataFrame([(1, "one two three four")], "doc_id bigint, text string")
    b = spark.createDataFrame([("a/2", "two three"), ("a/1", "one two"), (None, "four")], "item_id string, text string")
    r = O.contaminated(d, b).first()
    assert (r.n_hit, r.n_items, r.items_sha256) == (4, 3, hashlib.sha256(b"a/1,a/2").hexdigest())


def test_a_very_long_text(spark):
    d = spark.createDataFrame([(1, "filler words " * 400_000 + "one two three four")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "two three four")], "item_id bigint, text string")
    r = O.contaminated(d, b).first()
    assert (r.n_words, r.n_hit, r.n_items) == (800_004, 3, 1)
