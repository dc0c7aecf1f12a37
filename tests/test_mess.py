import pytest

from textloom.functions import characters as C
from textloom.functions import tables as T
from textloom.functions.mess import NAMES, many_details, mess_details, mess_ratio

ARABIC = "تقع المدينة القديمة على ضفة النهر، ويزورها الناس في كل صيف."
RUSSIAN = "Старый город стоит на берегу реки, и летом сюда приезжают люди."
POLISH = "Wyprzedaż książek: źródła, żółwie, ślimaki, łąki i pięć gęsi"
CHINESE = "老城在河边，夏天人们来这里看花，也有人坐船到下面的村子去。"


def misread(text, written, read):
    return text.encode(written).decode(read, "replace")


@pytest.mark.parametrize("text", [ARABIC, RUSSIAN, POLISH, CHINESE, "Ça y est, la forêt brûle déjà.", "Αυτή η πόλη είναι παλιά."])
def test_real_text_is_clean(text):
    assert mess_ratio(text, 1.0) <= 0.1


@pytest.mark.parametrize("text, written, read, least", [(ARABIC, "utf_8", "cp1252", 0.5), (RUSSIAN, "utf_8", "latin_1", 0.8), (RUSSIAN, "cp1251", "cp1252", 0.3), (ARABIC, "cp1256", "cp1254", 0.3), (POLISH, "cp1250", "latin_1", 0.2), (CHINESE, "gb18030", "cp1252", 0.3)])
def test_misread_text_is_noisy(text, written, read, least):
    assert mess_ratio(misread(text, written, read), 1.0) >= least


@pytest.mark.parametrize("text", ["red\x1b[0m and plain", "sprzeda¿ ksi¹¿ek", "ligaæn¹ here", "ｱｲｳｴ龘靐齉"])
def test_decisive(text):
    assert mess_ratio(text, 1.0) >= 1.0


@pytest.mark.parametrize("text", ["", "¿Quién vive?", "anæmia", "m²", "漢字ｱｲｳｴ", "plain text"])
def test_clean(text):
    assert mess_ratio(text, 1.0) == 0.0


def scalar(text):
    """The word and letter-run detectors, one character at a time."""
    bad = total = words = far = invalid = 0
    archaic = run = cur = 0
    buf = up = low = False
    plain = True
    word: list[str] = []
    symbols = 0
    final = 0
    for c in text + "\n":
        p = int(C.properties(C.codes_of(c))[0])
        if p & C.ALPHA:
            word.append(c)
            last = c
        elif word:
            if p & C.OPENING:
                invalid_now = True
            else:
                invalid_now = False
            if p & (C.SPACE | C.PUNCTUATION | C.SEPARATOR):
                q = [int(C.properties(C.codes_of(x))[0]) for x in word if x]
                letters = [x for x in q if x >= 0]
                n = len(word)
                acc = sum(bool(x & C.ACCENT) for x in letters)
                upp = sum(bool(x & C.UPPER) for x in letters)
                is_bad = invalid_now or symbols > 0
                last_mark = word[-1] == ""
                if n >= 4:
                    if acc / n >= 0.5:
                        is_bad = True
                    elif not last_mark and letters[-1] & C.ACCENT and letters[-1] & C.UPPER and upp != n:
                        is_bad, far = True, far + 1
                    elif sum(bool(x & C.GLYPH) for x in letters) == 1:
                        is_bad, far = True, far + 1
                    elif any(not x & C.ASCII for x in letters) and letters[0] & C.LOWER and upp == n - 1:
                        is_bad, far = True, far + 1
                foreign = any(not x & C.GLYPH and (not x & C.LATIN or x & C.ACCENT) for x in letters)
                if n >= 24 and foreign and not (upp and upp / n <= 0.3):
                    is_bad, far = True, far + 1
                words, total, bad, invalid = words + 1, total + n, bad + n * is_bad, invalid + invalid_now
                word, symbols = [], 0
            elif c not in "<>-=~|_" and not p & C.DIGIT and p & C.SYMBOL:
                word.append("")
                symbols += 1
        # runs of letters
        cased = bool(p & C.ALPHA) and bool(p & C.CASED)
        archaic += 1
        if not cased and run:
            if run <= 64 and not p & C.DIGIT and not plain:
                final += cur
            run, cur, buf, plain = 0, 0, False, True
            continue
        plain = plain and bool(p & C.ASCII)
        if run:
            if (p & C.UPPER and low) or (p & C.LOWER and up):
                cur, buf = (cur + 2, False) if buf else (cur, True)
            else:
                buf = False
        run, up, low = run + 1, bool(p & C.UPPER), bool(p & C.LOWER)
    word_ratio = 1.0 if invalid else 0.0 if words <= 10 and not far else bad / total
    return word_ratio, final / archaic


@pytest.mark.parametrize("seed", range(40))
def test_words_and_runs_against_one_character_at_a_time(seed):
    import random

    rng = random.Random(seed)
    text = "".join(rng.choice("aAbBéÉñçß ÀÈ  .,-1²$€µΩω我の한 \t¿!") for _ in range(rng.randrange(1, 400)))
    if text.isascii():
        text += "é"
    details = mess_details(text, float("inf"))[1]
    word, archaic = scalar(text)
    assert details[NAMES.index("SuperWeirdWord")] == pytest.approx(word)
    assert details[NAMES.index("ArchaicUpperLower")] == pytest.approx(archaic)


def test_reading_ends_at_the_block_that_reaches_the_limit():
    noisy = "$$€€" * 8 + " clean words follow here" * 40
    assert mess_ratio(noisy, 0.2) > mess_ratio(noisy, float("inf"))


@pytest.mark.parametrize("a, b, expected", [("Basic Latin", "Latin-1 Supplement", False), ("Basic Latin", "Cyrillic", True), ("Hiragana", "Katakana", False), (None, "Arabic", True), ("CJK Unified Ideographs", "Basic Latin", False), ("Emoticons", "Cyrillic", False)])
def test_range_pairs(a, b, expected):
    assert T.is_suspicious_pair(a, b) is T.is_suspicious_pair(b, a) is expected


def test_unknown_range():
    with pytest.raises(KeyError):
        T.is_suspicious_pair("Klingon", "Basic Latin")


def test_all_languages_at_once():
    import random

    from textloom.functions import coherence as K
    from textloom.functions import tables as T

    rng = random.Random(8)
    every = sorted(set("".join(T.LANGUAGES.values())) | set("0ßñ"))
    for _ in range(150):
        pool = rng.choice([every, list("eationsrhldcumfpgwybvkxjzqéèüäö"), list(T.LANGUAGES["Russian"]), list(T.LANGUAGES["Japanese"]), list("!?")])
        ordered = rng.sample(pool, rng.randrange(len(pool)))[: rng.choice([5, 20, 40, 64, 65, 90])]
        assert K.all_agreeing(ordered) == {name: K.agreeing(name, ordered) for name in T.LANGUAGES}


def test_texts_together_are_scored_as_alone():
    texts = ["", "a", "Àé " * 50, "$$ x%y ## " * 80, "AbCdé " * 90, "日本語龘 " * 30, "ｱｲｳｴ龘靐齉 ", "\x1b", "ÆªÆª", "aÉ", "é¿ ", "plain words " * 100, "ﻉ ﺍ ﺏ ﺕ ﺙ " * 9, " é.", "xYxYxé"]
    texts += [a + b for a in texts for b in texts]
    for limit in (0.2, float("inf")):
        assert many_details(texts, limit) == [mess_details(x, limit) for x in texts]
