import numpy as np

from textloom.llm import words as W
from textloom.llm.op4_jaccard import exact_sets


def thue_morse(n):
    x = ["a"]
    while len(x) < n:
        x += ["b" if c == "a" else "a" for c in x]
    return "".join(x[:n])


def hashed(texts, seed=0):
    joined = [t.encode() for t in texts]
    w = W.words(np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in joined])]), W.NONSPACE)
    return w, w.hashes(seed)


def test_regular_words_differ():
    # of these, polynomials modulo a power of two give the same
    for n in (64, 200, 1024, 2048):
        a = thue_morse(n)
        b = a.translate(str.maketrans("ab", "ba"))
        for seed in (0, 1):
            assert len(set(hashed([a, b], seed)[1].tolist())) == 2


def test_regular_windows_differ():
    a = " ".join(thue_morse(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    w, h = hashed([a, b])
    for size in (32, 35, 512, 1024):
        got, at = W.window_hashes(h, w.doc, size)
        words = [(" ".join((a + " " + b).split()[i : i + size])) for i in at.tolist()]
        assert len(set(zip(words, got.tolist(), strict=True))) == len(set(words)) == len(set(got.tolist()))


def test_equal_sequences_are_equal_wherever_they_are():
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bb", "12345678", "123456789", "x" * 300, "é" * 9]) for _ in range(60)) for _ in range(30)]
    w, h = hashed(texts)
    every = " ".join(texts).split()
    assert len(set(zip(every, h.tolist(), strict=True))) == len(set(every)) == len(set(h.tolist()))
    for size in (1, 2, 3, 5, 12, 35):
        got, at = W.window_hashes(h, w.doc, size)
        same = {}
        for i, x in zip(at.tolist(), got.tolist(), strict=True):
            assert same.setdefault(x, tuple(every[i : i + size])) == tuple(every[i : i + size])


def test_exact_sets():
    a, b, c = exact_sets([b"a b c d", b"x b c d a b c", b"a b"], 3)
    assert len(a) == 2 and len(b) == 5 and len(np.intersect1d(a, b)) == 2 and len(c) == 1 and not np.isin(c, np.concatenate([a, b])).any()
    many = [" ".join(str(i * k % 9973) for i in range(9973)).encode() for k in (1, 2)]
    p, q = exact_sets(many, 6)
    assert len(np.intersect1d(p, q)) == len({tuple(many[0].split()[i : i + 6]) for i in range(9968)} & {tuple(many[1].split()[i : i + 6]) for i in range(9968)})
