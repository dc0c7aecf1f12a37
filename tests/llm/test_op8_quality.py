import random
import re
from collections import Counter

from textloom.llm import op8_quality as Q

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, w string"


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(hit), len(w) < 50 or 100 * sum(hit) > 50 * len(w)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], SCHEMA).repartition(3)
    return {r.doc_id: tuple(r)[1:8] for r in Q.judged(df).collect()}


def test_statistics_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "a b c", "a b c a b c", "a a a a a", "x\nx\n y\ny\n\n\nx", "é|ü <b>\r\n$%", " lead and trail ", "a\x0bb\x0cc\x85d e", "ab c " * 9000]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randrange(200))).replace(" a", "\na") for _ in range(60)]
    rows = [(i, t, None if i % 3 else "en", "s") for i, t in enumerate(texts)]
    got = run(spark, rows)
    assert {i: got[i][:6] for i in got} == {i: base(t) for i, t in enumerate(texts)}


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 400)))
    rows = [(i, prose(), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(x + "###" for x in prose().split()), "en", "a") for i in range(40)]
    rows += [(2000 + i, prose(), "fr", f"small{i}") for i in range(5)]
    got = run(spark, rows)
    assert all(got[i][6] for i in range(300)) and not any(got[1000 + i][6] for i in range(40)) and all(got[2000 + i][6] for i in range(5))


def test_consistency_factor():
    assert abs(Q._chi2_share(2, 2.0) - (1 - 2.718281828 ** -1.0)) < 1e-6
    assert 1.3 < Q.consistency(5, 0.75) < 1.5


def test_empty(spark):
    assert Q.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_third_of_copies_of_one_outlier_go(spark):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 400)))
    junk = " ".join(x + "###" for x in prose().split())
    rows = [(i, prose(), "en", "a") for i in range(200)] + [(1000 + i, junk, "en", "a") for i in range(95)]
    got = run(spark, rows)
    assert all(got[i][6] for i in range(200)) and not any(got[1000 + i][6] for i in range(95))


def test_repeated_lines_go_from_a_clean_group(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    lines = lambda n: [" ".join(word() for _ in range(14)) for _ in range(n)]
    rows = [(i, "\n".join(lines(10)), "en", "a") for i in range(100)]
    short = [word() + " " + word() for _ in range(4)]
    rows += [(1000 + i, "\n".join([*lines(4), *(x for x in short[:2] for _ in range(4))]), "en", "a") for i in range(3)]
    rows += [(2000, "\n".join([*(own := lines(9)), own[0].split()[0], own[0].split()[0]]), "en", "a")]
    got = run(spark, rows)
    assert [got[1000 + i][3] for i in range(3)] == [6] * 3 and not any(got[1000 + i][5] for i in range(3))
    assert not any(got[1000 + i][6] for i in range(3)) and got[2000][3] == 1
    assert all(got[i][6] for i in range(100)) and got[2000][6]


def test_cutoff_is_its_quantile():
    assert abs(Q._chi2_share(5, Q.CUTOFF) - (1 - 1e-6)) < 1e-9


def _brute_mcd(x, rng, starts=300):
    """The best of many random starts of the textbook algorithm, with the operator's floors and consistency factor."""
    import numpy as np

    floors = np.array([Q.FLOORS[n] * Q.UNIT for n in Q.NAMES]) ** 2
    h, scale = len(x) // 2, Q.consistency(len(Q.NAMES), Q.SHARE)

    def estimate(rows):
        c = np.cov(rows.T, bias=True) * scale
        c[np.diag_indices(len(c))] = np.maximum(np.diag(c), floors)
        return rows.mean(axis=0), c

    best = None
    for _ in range(starts):
        m, c = estimate(x[rng.choice(len(x), len(Q.NAMES) + 1, replace=False)])
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(c), x - m)
            m, c = estimate(x[np.argsort(d, kind="stable")[:h]])
        size = np.linalg.slogdet(c)[1]
        if best is None or size < best[0]:
            best = size, m, c
    return best


def test_estimates_and_verdicts_against_many_random_starts(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    spread = np.array([900, 600, 60, 150, 200])
    groups = {
        "clean": rng.normal(0, 1, (400, 5)) * spread,
        "tilted": (rng.normal(0, 1, (300, 5)) @ np.array([[1, 0.8, 0, 0, 0], [0, 0.6, 0, 0, 0], [0, 0, 1, 0.5, 0], [0, 0, 0, 0.9, 0], [0, 0, 0, 0, 1]])) * spread,
        "third": np.concatenate([rng.normal(0, 1, (200, 5)) * spread, rng.normal(0, 0.05, (95, 5)) * spread + 14 * spread]),
        "tail": np.concatenate([rng.normal(0, 1, (250, 5)) * spread, rng.normal(0, 1, (30, 5)) * spread + np.array([0, 0, 900, 2000, 0])]),
    }
    rows, whole = [], {}
    for name, x in groups.items():
        whole[name] = np.rint(x + 5000).astype(int)
        rows += [(name, *map(int, r), 1) for r in whole[name]]
    df = spark.createDataFrame(rows, "group string, " + ", ".join(f"{n} bigint" for n in Q.NAMES) + ", n bigint")
    with Q.Scope(spark) as s:
        got = {r.group: r for r in Q.estimated(s, df).collect()}
    for name, x in whole.items():
        r = got[name]
        factor = np.array([[r[f"l_{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        mean = np.array([r[f"m_{i}"] for i in range(5)])
        ours = (np.linalg.solve(factor, (x - mean).T) ** 2).sum(axis=0)
        if name == "third":
            # the least determinant of all would hold the copies and the few nearest others: it must not be found
            assert (ours[200:] > Q.CUTOFF).all() and (ours[:200] <= Q.CUTOFF).all()
            continue
        size, m, c = _brute_mcd(x.astype(float), rng)
        # no worse than the best of 300 starts, up to the bins of the distances
        assert 2 * np.log(np.diag(factor)).sum() <= size + 0.35, name
        theirs = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        clear = (theirs < 0.6 * Q.CUTOFF) | (theirs > 1.6 * Q.CUTOFF)
        assert ((ours > Q.CUTOFF) == (theirs > Q.CUTOFF))[clear].all() and clear.mean() > 0.95, name
    assert (np.abs(whole["third"][200:].mean(axis=0) - 5000) > 10 * spread).all()
