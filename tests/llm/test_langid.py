from __future__ import annotations

import random

import pytest

from stackroom.llm.langid import Embedder, language_spans, relabelled, sentences, stretches, train

PARTS = {
    "en": ("the old ship, each river, that quiet garden, one small window".split(", "), "hides follows guards measures".split(), "behind the house, between two wars, with great patience, near the water".split(", ")),
    "de": ("das alte Schiff, jeder Fluss, dieser stille Garten, ein kleines Fenster".split(", "), "verbirgt verfolgt bewacht vermisst".split(), "hinter dem Haus, zwischen zwei Kriegen, mit großer Geduld, nahe dem Wasser".split(", ")),
    "es": ("el barco viejo, cada río, aquel jardín tranquilo, una ventana pequeña".split(", "), "esconde sigue guarda mide".split(), "detrás de la casa, entre dos guerras, con mucha paciencia, cerca del agua".split(", ")),
    "ru": ("старый корабль, каждая река, этот тихий сад, одно малое окно".split(", "), "скрывает ведёт хранит мерит".split(), "за старым домом, между двумя войнами, с большим терпением, рядом с водой".split(", ")),
}


def sentence(rng, lang):
    noun, verb, place = PARTS[lang]
    s = f"{rng.choice(noun)} {rng.choice(verb)} {rng.choice(noun)} {rng.choice(place)}."
    return s[0].upper() + s[1:]


def text(rng, *langs):
    return " ".join(sentence(rng, x) for x in langs)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(400):
        lang = rng.choice(list(PARTS))
        label = rng.choice(["gl", *PARTS]) if i % 10 == 0 else lang  # a tenth of the labels is random
        out.append((text(rng, *[lang] * 3), label))
    return out


def test_held_out_accuracy(rows):
    m, e, rng = train(rows), Embedder(), random.Random(9)
    assert "gl" not in m.labels
    tests = [(x, text(rng, x, x)) for x in PARTS for _ in range(50)]
    right = sum([s[2] for s in stretches(t, m, e)] == [x] for x, t in tests)
    assert right >= 0.99 * len(tests)
    got = stretches(text(rng, "en", "en", "de", "es"), m, e)
    assert [s[2] for s in got] == ["en", "de", "es"] and all(0.5 < s[3] <= 1 for s in got)


def test_sentences():
    got = [s for _, _, s in sentences("<p>J. R. Smith wrote it. Then left!</p>No end (see «Das Schiff», 1999.) here<br/>Vol. 2 came")]
    assert got == ["j r smith wrote it", "then left", "no end here", "vol came"]
    assert sentences("") == [] and sentences("12 — ??") == []


META = "file_id bigint, description string, language string, spans string, code string, lang string"
LANGS = [("en", "eng", "English", "English"), ("de", "deu", "German", "Deutsch"), ("es", "spa", "Spanish", "español"), ("ru", "rus", "Russian", "русский")]


def test_table(spark, rows):
    rng = random.Random(5)
    langs = spark.createDataFrame(LANGS, "code string, code3 string, name string, native_name string")
    base = [(i, t, k, None, None, None) for i, (t, k) in enumerate(rows)]
    extra = [
        (1001, text(rng, "en", "en"), None, "s", "c", "l"), (1002, text(rng, "de", "de"), " ", None, None, None), (1003, text(rng, "es", "es"), "English.", None, None, None),
        (1004, text(rng, "en", "en", "ru"), "en-GB", None, None, None), (1005, text(rng, "en", "en"), "en_AU", None, None, None), (1006, None, None, None, None, None), (1007, "", "en", None, None, None),
        (1008, text(rng, "de", "de") + " («El barco viejo sigue cada río», 1999.)", "Deutsch", None, None, None), (1009, text(rng, *["es"] * 2000), "zz", None, None, None),
        (1010, text(rng, "ru", "ru").encode().decode("latin-1"), None, None, None, None), (1001, text(rng, "en", "en"), None, None, None, None),
    ]
    df = spark.createDataFrame(base + extra, META)
    got = sorted((r["file_id"], r["lang"]) for r in relabelled(df, langs).where("file_id > 1000").collect())
    assert got == [(1001, "en"), (1001, "en"), (1002, "de"), (1003, "es"), (1004, "en"), (1004, "ru"), (1009, "es"), (1010, "ru")]
    assert relabelled(spark.createDataFrame([], META), langs).count() == 0
    assert language_spans(df.where("language IS NULL"), langs).where("size(spans) > 0").count() == 0


def test_few_labels_in_a_large_table_still_teach(spark, rows):
    """Nearly all rows without a label: the sample is taken from those that have one."""
    rng = random.Random(6)
    langs = spark.createDataFrame(LANGS, "code string, code3 string, name string, native_name string")
    taught = [(i, t, k, None, None, None) for i, (t, k) in enumerate(rows)]
    tests = [(1000 + i, text(rng, x, x), None, x, None, None) for i, x in enumerate([*PARTS] * 3)]
    empty = spark.range(2000, 400_000).selectExpr("id AS file_id", *[f"CAST(NULL AS string) AS {c}" for c in META.replace(" string", "").split(", ")[1:]])
    df = spark.createDataFrame(taught + tests, META).unionByName(empty)
    got = {r["file_id"]: r["lang"] for r in relabelled(df, langs).where("file_id >= 1000").collect()}
    assert got == {t[0]: t[3] for t in tests}


def test_quotations_and_long_tags():
    assert [s for _, _, s in sentences("«The old ship hides the garden»")] == ["the old ship hides the garden"]
    assert [s for _, _, s in sentences("(The old ship hides)")] == ["the old ship hides"]
    assert [s for _, _, s in sentences("It ends. «The old ship hides.» Then left (see «Das Schiff», 1999.).")] == ["it ends", "the old ship hides", "then left"]
    assert [s for _, _, s in sentences(f'The old <a href="{"x" * 500}">ship</a> hides.')] == ["the old ship hides"]


def test_places_are_those_of_the_stored_text(spark, rows):
    """Stretches cut out of the text as stored, with garbled characters and references in it."""
    langs = spark.createDataFrame(LANGS, "code string, code3 string, name string, native_name string")
    rng = random.Random(12)
    first, second = text(rng, "de", "de"), text(rng, "es", "es")
    stored = "&ldquo;&amp;&nbsp;" + first.replace("ß", "ÃŸ").replace("e", "&#101;") + " " + second.replace("ñ", "Ã±").replace("í", "&iacute;")
    df = spark.createDataFrame([(i, t, k, None, None, None) for i, (t, k) in enumerate(rows)] + [(1000, stored, None, None, None, None)], META)
    got = language_spans(df, langs).where("file_id = 1000").first()["spans"]
    assert [s["lang"] for s in got] == ["de", "es"] and got[-1]["end"] == len(stored)
    assert stored[got[1]["start"] :] == second.replace("ñ", "Ã±").replace("í", "&iacute;")
