from __future__ import annotations

import pytest

from stackroom.llm.mojibake import READ_AS, Garbled, character_patterns, garbled_fields, misread

LEXICON = {"café": 90, "fábrica": 50, "größe": 40, "verrät": 40, "этот": 80, "дневник": 60, "каждый": 50, "książka": 30, "światło": 30, "quién": 20, "forêt": 20}


@pytest.fixture(scope="module")
def g():
    return Garbled(LEXICON)


@pytest.mark.parametrize("encoding", [e for e in READ_AS if e not in ("koi8-r", "iso8859-5", "cp1253", "iso8859-7")])
@pytest.mark.parametrize("text", ["The old café’s door – closed", "Größe verrät die fábrica", "Mein “Zitat” geht über alles"])
def test_utf8_round_trip(g, text, encoding):
    assert g.check(misread(text.encode(), encoding)) == (True, text)


def test_twice_and_references(g):
    text = "Le café de l’été"
    assert g.check(misread(misread(text.encode(), "cp1252").encode(), "cp1252")) == (True, text)
    assert g.check("".join(c if c < "\x80" else f"&#{ord(c)};" for c in misread(text.encode(), "cp1252"))) == (True, text)


@pytest.mark.parametrize(("written", "read"), [("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "latin-1")])
def test_cyrillic_words(g, written, read):
    text = "этот дневник, каждый"
    assert g.check(misread(text.encode(written), read)) == (True, text)


@pytest.mark.parametrize(("text", "written", "read"), [("die Größe verrät", "cp1252", "cp1251"), ("Le café", "cp1252", "mac-roman"), ("la fábrica", "cp1252", "cp437"), ("ta książka i światło", "cp1250", "cp1252"), ("ta książka", "iso8859-2", "cp1252"), ("¿Quién?", "cp1252", "cp1253")])
def test_words(g, text, written, read):
    hit, fixed = g.check(misread(text.encode(written), read))
    assert hit and fixed.strip("¿?΅ΏÏ").lower() == text.strip("¿?").lower()


@pytest.mark.parametrize(
    "text",
    [
        "", "plain", "café – “ÂGE D’OR”", "Â is a letter", "letters Ä, Ö, Ü and ß", "Price £12 © Press – 20° west.", "½ leather «series»", "A ILUSÃO DE REZ E A ESTAÇÃO", "AMANHû, disse", "(«AMANHû)",
        "θάλασσα on every page", "дВА ГОДА, этот", "ЭТОТ ДНЕВНИК", "«КОМПАС»", "caf&#233;", "🙂 ★", "café", "naïve façade", "где кончается", "x" * 200_000,
    ],
)
def test_right_text_stays(g, text):
    assert g.check(text) == (False, text)


def test_mixed_text_keeps_its_right_part(g):
    good, bad = "Der Garten verrät die Größe. ", "La fábrica vieja."
    assert g.check(good + misread(bad.encode(), "cp1252")) == (True, good + bad)


def test_lost_characters(g):
    assert g.check("pri�re") == (True, "pri�re")


def test_patterns_are_garbled():
    assert all(k != v and not k.isascii() for k, v in character_patterns().items())


META = "file_id bigint, title string, description string, field string, text string, hit boolean"


def test_table(spark):
    rows = [(1, "cafÃ©", "fine café", "f", "t", True), (2, None, None, None, None, None), (3, "", "x" * 100_000 + "Ã©", None, None, None), (1, "cafÃ©", None, None, None, None)]
    got = garbled_fields(spark.createDataFrame(rows, META))
    assert sorted((r["file_id"], r["field"], r["restored"][-4:]) for r in got.collect()) == [(1, "title", "café"), (1, "title", "café"), (3, "description", "xxxé")]
    assert garbled_fields(spark.createDataFrame([], META)).count() == 0


def test_words_of_the_corpus_decide(spark):
    """A single-byte mix-up is found through the corpus's own words."""
    rows = [(i, "la fábrica", None, None, None, None) for i in range(30)] + [(99, misread("la fábrica".encode("cp1252"), "cp437"), None, None, None, None)]
    assert [r["file_id"] for r in garbled_fields(spark.createDataFrame(rows, META)).collect()] == [99]


def test_rare_words_decide_too(spark):
    """Clean words seen once or twice, and more of them than any capped list holds, are still found garbled."""
    from itertools import product

    many = ["".join(x) + "é" for x in product("abcdefghij", repeat=4)][:4500]
    rows = [(i, f"{w} {w} {w}", None, None, None, None) for i, w in enumerate(many)]
    texts = ["этот старый дневник", "новая книга каждый вечер", "дневной свет вечерний", "кажется, однажды ученик", "новый родник и бывший сад", "днём и ночью"]
    rows += [(10_000 + i, t, None, None, None, None) for i, t in enumerate(texts)]
    rows += [(20_000, misread("дневник каждый".encode("cp1251"), "koi8-r"), None, None, None, None), (20_001, misread("вечерний".encode("cp1251"), "cp1252"), None, None, None, None)]
    got = {r["file_id"]: r["restored"] for r in garbled_fields(spark.createDataFrame(rows, META)).collect()}
    assert got == {20_000: "дневник каждый", 20_001: "вечерний"}


@pytest.mark.parametrize("text", ["Un țăran și o școală", "tiếng Việt", "Ẁẁ"])
def test_further_latin_letters(g, text):
    assert g.check(misread(text.encode(), "cp1252")) == (True, text)


def test_lower_case_references_are_read(spark):
    rows = [(1, "Don&acirc;&euro;&trade;t go", None, None, None, None), (2, "Fish &amp; chips", None, None, None, None)]
    got = garbled_fields(spark.createDataFrame(rows, META))
    assert [(r["file_id"], r["restored"]) for r in got.collect()] == [(1, "Don’t go")]


@pytest.mark.parametrize("text", ["日本語の本", "한국어 책입니다", "Ein Buch: 図書館。", "中文书店"])
@pytest.mark.parametrize("encoding", ["cp1252", "latin-1"])
def test_ideographs(g, text, encoding):
    assert g.check(misread(text.encode(), encoding)) == (True, text)


@pytest.mark.parametrize(("text", "encoding"), [("ein café hier", "gbk"), ("The door’s old", "gbk"), ("un été ici", "shift_jis"), ("la fábrica", "euc_kr")])
def test_read_as_double_byte(g, text, encoding):
    assert g.check(text.encode().decode(encoding)) == (True, text)


@pytest.mark.parametrize("text", ["Il est «occupé…» là", "日本語 book", "ABC語", "Das Wort “é”…»", "本 café", "한국 Größe", "été… « oui »"])
def test_right_text_of_east_asia_stays(g, text):
    assert g.check(text) == (False, text)


@pytest.mark.parametrize(
    ("text", "fixed"),
    [
        ("&eacute;t&eacute; &ndash; cafÃ© &amp; th&#233;", "&eacute;t&eacute; &ndash; café &amp; th&#233;"),
        ("<p>R&eacute;  cafÃ&copy;\n&nbsp;</p>", "<p>R&eacute;  café\n&nbsp;</p>"),
    ],
)
def test_only_matched_spans_change(g, text, fixed):
    assert g.check(text) == (True, fixed)


def test_restored_places(g):
    hit, fixed, places = g.restored("Ré &eacute; cafÃƒÂ©s x")
    assert hit and fixed == "Ré &eacute; cafés x" and len(places) == len(fixed) + 1
    assert places[fixed.index("s x")] == "Ré &eacute; cafÃƒÂ©s x".index("s x") and places[-1] == len("Ré &eacute; cafÃƒÂ©s x")


def test_any_number_of_rounds(g):
    text = bad = "déjà"
    for _ in range(5):
        bad = misread(bad.encode(), "cp1252")
    assert g.check(bad) == (True, text)


def test_quick_tests_spare_no_pattern():
    import stackroom.llm.mojibake as m

    assert all(m._PAIR.search(g) for g in character_patterns())
    assert all(m._MIXED.search(g) for g in m.mixed_patterns()) and all(m._EAST.search(g) for g in m.wide_patterns())
    assert all(m._LEAD.search(g + g) and len(g) == 3 for g in m.ideograph_patterns())
