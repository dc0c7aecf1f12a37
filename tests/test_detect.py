import pytest

from textloom import api
from textloom.functions import coherence as K
from textloom.functions import detect as D
from textloom.functions import tables as T

RUSSIAN = "Старый город стоит на берегу реки, и летом сюда приезжают люди. Они гуляют по набережной, едят мороженое и фотографируют лодки. " * 3
GREEK = "Η θάλασσα είναι γαλάζια και ο ήλιος λάμπει πάνω από τα νησιά του Αιγαίου. " * 5
SPANISH = "El niño comió piñas en la montaña; señor, ¿dónde está el baño? Ahí está. " * 5
JAPANESE = "日本の古い町は川の近くにあります。夏になると、大人も子どもも電車やバスに乗って、この町へ遊びに来ます。町のカフェでコーヒーを飲む人もいます。" * 6
CHINESE = "老城在河边，夏天人们来这里看花，也有人坐船到下面的村子去。" * 10
KOREAN = "오래된 도시는 강가에 있습니다. 여름이면 많은 사람들이 이곳에 놀러 옵니다. " * 10
BULGARIAN = "Старият град стои на брега на реката и през лятото тук идват много хора, за да се разхождат край водата."


@pytest.mark.parametrize(
    "text, encoding",
    [(RUSSIAN, "cp1251"), (RUSSIAN, "koi8_r"), (RUSSIAN, "utf_8"), (RUSSIAN, "mac_cyrillic"), (GREEK, "cp1253"), (SPANISH, "cp1252"), (JAPANESE, "shift_jis"), (JAPANESE, "euc_jp"), (JAPANESE, "iso2022_jp"), (CHINESE, "gb18030"), (CHINESE, "big5hkscs"), (KOREAN, "cp949"), (KOREAN, "iso2022_kr"), (BULGARIAN, "cp1251")],
)
def test_round_trip(text, encoding):
    try:
        payload = text.encode(encoding)
    except UnicodeEncodeError:
        pytest.skip("not in this encoding")
    assert D.detect(payload)[0][0].decoded() == text


@pytest.mark.parametrize("payload, encoding", [(b"", "utf_8"), (b"\xfe\xff", "utf_16"), ("﻿".encode("gb18030"), "gb18030"), (b"\xef\xbb\xbf", "utf_8"), (b"\x00\x00\xfe\xff", "utf_32")])
def test_nothing_but_a_mark(payload, encoding):
    found = D.detect(payload)[0]
    assert [m.encoding for m in found] == [encoding] and found[0].multi_byte_usage in (0.0, pytest.approx(found[0].multi_byte_usage))


@pytest.mark.parametrize("encoding", ["utf_32", "utf_16"])
def test_noisy_text_with_a_mark(encoding):
    assert D.detect("▶ noisy".encode(encoding))[0][0].encoding == encoding


@pytest.mark.parametrize("tail", [".testing", "-testing", "+testing"])
def test_utf7_mark_is_removed(tail):
    best = D.detect(("﻿" + tail).encode("utf_7"))[0][0]
    assert best.encoding == "utf_7" and best.decoded() == tail


def test_a_mark_beats_a_declaration():
    assert D.detect('<meta charset="cp1252">été'.encode("utf_8_sig"))[0][0].encoding == "utf_8"


def test_escape_sequences_fall_back():
    assert D.detect(b"\x1b[1mbold\x1b[22m and plain")[0][0].encoding == "utf_8"


@pytest.mark.parametrize("payload", [b"\x00\x5f\x2f\xff" * 50, bytes.fromhex("47494638396101000100800000000000ffffff21f90401000000002c00000000010001000002024401003b")])
def test_binary(payload):
    assert api.is_binary(payload) and not D.detect(payload, D.Options(fallback=False))[0]


@pytest.mark.parametrize(
    "payload, name",
    [(b'<?xml version="1.0" encoding="EUC-JP"?>', "euc_jp"), (b'<html><head><meta charset="utf-8"></head></html>', "utf_8"), (b'<meta charset="utf-57">', None), (b"# coding: utf-8", "utf_8"), (b"# -*- encoding: cp1252 -*-", "cp1252"), (b"nothing", None), ("é".encode() + b" charset=latin1", "latin_1")],
)
def test_declarations(payload, name):
    assert D.declared_encoding(payload) == name


def test_declaration_is_rewritten_in_output():
    m = D.detect('<?xml version="1.0" encoding="cp1252"?><a>été à la plage, très bien là-bas</a>'.encode("cp1252"))[0][0]
    assert b'encoding="utf-8"' in m.output() and "été".encode() in m.output()


def test_only_and_without():
    assert [m.encoding for m in D.detect(RUSSIAN.encode("cp1251"), D.Options(only=("windows-1251",)))[0]] == ["cp1251"]
    assert "cp1251" not in D.detect(RUSSIAN.encode("cp1251"), D.Options(without=("cp1251",)))[0][0].encoding


def test_large_payloads():
    assert D.detect(b"0" * 10_000_000)[0][0].encoding == "ascii"
    best = D.detect("hello simple ascii ".encode() * 600_000 + CHINESE.encode())[0][0]
    assert best.encoding == "utf_8"


def test_legacy():
    assert D.legacy("hello".encode("utf_8_sig"))["encoding"] == "UTF-8-SIG"
    assert set(D.legacy(b"abc")) == {"encoding", "language", "confidence"}
    with pytest.raises(TypeError):
        api.detect("text")


def test_matches_by_rank_and_name():
    found = api.from_bytes(RUSSIAN.encode("cp1251"))
    assert found[0] is found.best() is found["windows-1251"]
    with pytest.raises(KeyError):
        found["utf_8"]
    assert found.best().language in T.target_languages("cp1251") and "Cyrillic" in found.best().alphabets


def test_options_are_checked():
    with pytest.raises(ValueError):
        D.Options(steps=0)


def test_rank_sort_keeps_the_documented_order():
    def m(chaos, coherence):
        return D.Match(b"abc", "ascii", chaos, False, [("English", coherence)], None, "abc")

    items = [m(0.004, 0.5), m(0.0, 0.1), m(0.008, 0.9)]
    # the third ranks before the first but not before the second, and the list is a run that isn't falling
    assert D.ranks_before(items[2], items[0]) and not D.ranks_before(items[2], items[1])
    assert [x.chaos for x in D.ranked(items)] == [0.004, 0.0, 0.008]


def test_coherence_functions():
    assert K.popularity("English", ["e", "t", "a"]) >= 0
    assert K.popularity("English", []) != K.popularity("English", [])
    with pytest.raises(ValueError):
        K.popularity("Klingon", ["a"])
    assert K.merge([[("English", 0.2)], [("English", 0.4), ("French", 0.5)]]) == [("French", 0.5), ("English", 0.3)]
    assert K.fold_alternatives([("English", 0.5), ("English—", 0.8), ("French", 0.2)]) == [("English", 0.8), ("French", 0.2)]
    assert K.fold_alternatives([("English—", 0.8)]) == [("English—", 0.8)]
    assert K.language_features("French") == (True, True) and K.language_features("Russian") == (False, False)
    assert K.layers("aé Я") == ["aé", "я"]


def test_tables():
    assert len(T.candidates()) == 98 and sum(map(T.is_multi_byte, T.candidates())) == 32
    assert T.target_languages("cp1251")[:2] == ("Russian", "Ukrainian") and T.target_languages("cp1252") == ("Latin Based",)
    assert T.similarity("cp1252", "latin_1") > 0.8 and T.similarity("utf_8", "cp1252") == 0.0
    assert T.encoding_name("Windows-1252") == "cp1252" and "windows_1252" in T.aliases("cp1252")
    with pytest.raises(ValueError):
        T.encoding_name("utf-57")
    with pytest.raises(OSError):
        T.code_page("big5")
    for name in T.candidates():
        "".encode(name)


def test_matches_are_equal_by_name_and_text():
    found = api.from_bytes(BULGARIAN.encode("cp1251"))
    best = found.best()
    assert best == "windows-1251" and best == "CP1251" and best != "utf-8" and best == found[0] and best != 5
    other = D.Match(best.payload, "koi8_r", 0.9, False, [], None)
    assert best != other and best < other
    before = len(found)
    found.append(other)
    assert len(found) == before + 1 and found[0] == best
    alike = D.Match(best.payload, "kz1048" if best.encoding != "kz1048" else "cp1251", best.chaos, False, best.languages, None, best.decoded())
    found.append(alike)
    assert len(found) == before + 1 and alike.encoding in found[0].could_be_from
    best.add_submatch(other)
    assert other in best.submatches and best.take_submatches()[-1] is other and not best.submatches
    for wrong in (best, "cp1251"):
        with pytest.raises(ValueError):
            best.add_submatch(wrong)
    with pytest.raises(ValueError):
        found.append("cp1251")


def test_samples():
    payload = CHINESE[:60].encode("gb18030")
    text = payload.decode("gb18030")
    parts = list(D.cut_chunks(payload, "gb18030", range(0, len(payload), 7), 8, text=text))
    assert parts and all(p[:3] in text for p in parts)
    assert list(D.cut_chunks(b"abcdef", "cp1252", range(0, 6, 2), 2)) == ["ab", "cd", "ef"]
    with pytest.raises(UnicodeError):
        list(D.cut_chunks(b"ab\x81", "cp1252", range(0, 3), 3))
    marked = b"\xef\xbb\xbfabc"
    assert next(D.cut_chunks(marked, "utf_8", range(3, 6, 3), 3, b"\xef\xbb\xbf", True)) == "abc"


def test_character_flags():
    from textloom.functions import characters as C

    assert C.is_accentuated("é") and not C.is_accentuated("e") and C.is_latin("ß") and C.is_cjk("水") and C.is_hangul("한") and C.is_thai("ก")
    assert C.is_katakana("ｱ") and C.is_hiragana("ひ") and C.is_arabic("ع") and C.is_arabic_isolated_form("ﻉ") and not C.is_arabic_isolated_form("ع")
    names = list(T.LANGUAGES)
    assert T.language_mask("ß") == sum(1 << i for i, n in enumerate(names) if "ß" in T.LANGUAGES[n]) and T.language_mask("!") == 0
    assert T.language_mask("ж") & 1 << names.index("Russian") and not T.language_mask("ж") & 1 << names.index("English")


def test_explain_shows_what_is_noted(capsys):
    import logging

    level = api.logger.level
    api.from_bytes(BULGARIAN.encode("cp1251"), explain=True, only=("cp1251",))
    assert "cp1251" in capsys.readouterr().err and api.logger.level == level and not any(isinstance(h, logging.StreamHandler) for h in api.logger.handlers)


def test_errors():
    with pytest.raises(ImportError):
        T.code_page("no_such_page")
    with pytest.raises(OSError):
        T.code_page("utf_8")
    with pytest.raises(KeyError):
        T.is_suspicious_pair("Basic Latin", "No Such Range")
    with pytest.raises(TypeError):
        T.unicode_range("ab")
    with pytest.raises(ValueError):
        T.encoding_name("utf-57")
    with pytest.raises(ValueError):
        K.popularity("Klingon", "abc")
    with pytest.raises(LookupError):
        api.from_bytes(b"plain").best().output("no_such_codec")
    with pytest.raises(UnicodeDecodeError):
        D.strict(b"+2AA-", "utf_7")


def test_payloads_judged_side_by_side_are_judged_as_alone(monkeypatch):
    texts = ["Der alte Müller wohnt in der großen Straße, älter als früher. " * 60, "Ça été créé à l'époque où les élèves rêvaient. " * 90, "Привет мир, это проверка текста. " * 70, "日本語のテキストです。漢字もあります。" * 60, "plain words of ascii only " * 200]
    payloads = [(t + str(i)).encode(e, "ignore") for i in range(4) for t in texts for e in ("cp1252", "mac_roman", "utf_8", "utf_16", "koi8_r", "shift_jis", "utf_7")]
    payloads += [b"", b"\x00\x01\xff" * 50, b'<meta charset="latin1"> caf\xe9', b"\x81"]

    def shown(answer):
        return [(m.encoding, m.chaos, m.bom, m.languages, m.declared, m.could_be_from, m.decoded()) for m in answer[0]], answer[1]

    for options in (D.Options(), D.Options(fallback=False, threshold=0.1, steps=9, chunk_size=100), D.Options(only=("cp1252", "utf_8"), explain=True)):
        alone = [shown(D.detect(p, options)) for p in payloads]
        D.forget()
        calls, scored = [], D.many_details
        monkeypatch.setattr(D, "many_details", lambda x, limit, scored=scored: calls.append(len(x)) or scored(x, limit))
        assert [shown(x) for x in D.detect_many(payloads, options)] == alone
        monkeypatch.undo()
        assert len(calls) < len(payloads)


def test_languages_looked_for_together_are_those_found_alone():
    texts = ["Der alte Müller wohnt in der großen Straße, älter als früher. " * 8, "Les élèves rêvaient à l'école de la forêt. " * 9, "Привет мир, это проверка текста и букв. " * 9, "short", "", "日本語のテキストです。漢字もありますので、色々な文字を使います。" * 9]
    requests = [(t, limit, wanted) for t in texts for limit in (0.1, 0.4) for wanted in ((), ("Latin Based",), ("English", "German", "French"), ("Russian",))]
    alone = []
    for r in requests:
        K.forget()
        alone.append(K._coherence(*r))
    K.forget()
    K.prepare(requests)
    assert [K._known[r] for r in requests] == alone and any(alone)
    for letters in (K.ordered_letters(t.lower()) for t in texts[:3]):
        assert K.all_agreeing(letters) == {name: K.agreeing(name, letters) for name in T.LANGUAGES}
