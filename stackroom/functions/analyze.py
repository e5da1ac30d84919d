"""Language analyzers: elision, stop words and light stemmers, applied to arrays of tokens.

The stemmers follow the published algorithms (Porter 1980 for English; Savoy's light stemmers for the others). They run in
an Arrow-batched function that stems each distinct token of a batch once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.functions.text import tokens

LANGUAGES = ("de", "en", "es", "fr", "it", "pt")

# The stop words of each language (folded).
STOP_WORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with he she his her i you we our your from have has had were been which who whom what so than too very can do does did",
    "es": "de la que el en y a los del se las por un para con no una su al lo como mas pero sus le ya o este si porque esta entre cuando muy sin sobre tambien me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mi antes algunos unos yo otro otras otra el tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros es son fue era ha",
    "de": "aber alle als also am an auch auf aus bei bin bis bist da damit das dass dem den der des die dies diese dieser dieses doch dort du durch ein eine einem einen einer eines er es fur hatte hier hinter ich ihr ihre im in ist ja jede jedem jeden jeder jedes jener jenes kann kein keine mein mit muss nach nicht noch nun oder ohne sehr sein seine sich sie sind so uber um und uns unter vom von vor war was wenn werden wie wieder wird wo zu zum zur zwischen",
    "fr": "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me meme mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l a m n s t y ete est sont etre cette les",
    "it": "ad al allo ai agli all agl alla alle con col coi da dal dallo dai dagli dall dalla dalle di del dello dei degli dell della delle in nel nello nei negli nell nella nelle su sul sullo sui sugli sull sulla sulle per tra contro io tu lui lei noi voi loro mio mia tuo suo sua mi ti ci vi lo la li le gli ne il un uno una ma ed se perche anche come dov dove che chi cui non piu quale quanto quanti quella quelle quello quelli questa queste questo questi si tutto tutti a c e i l o",
    "pt": "de a o que e do da em um para com nao uma os no se na por mais as dos como mas ao ele das a seu sua ou quando muito nos ja eu tambem so pelo pela ate isso ela entre depois sem mesmo aos seus quem nas me esse eles voce essa num nem suas meu as minha numa pelos elas qual nos lhe deles essas esses pelas este dele foi",
}
STOPS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
# What is elided before a vowel in French and Italian.
ELIDED = {
    "fr": frozenset("l m t qu n s j d c jusqu quoiqu lorsqu puisqu".split()),
    "it": frozenset("c l all dall dell nell sull coll pell gl agl dagl degl negl sugl un m t s v d".split()),
}


def _porter(w: str) -> str:
    """Porter's stemmer."""
    if len(w) <= 2:
        return w

    def cons(i: int) -> bool:
        c = w[i]
        return c not in "aeiou" and (c != "y" or i == 0 or not cons(i - 1))

    def form(stem: str) -> str:
        return "".join("c" if cons(i) else "v" for i in range(len(stem)))

    def measure(stem: str) -> int:
        return len(re.findall(r"v+c+", form(stem)))

    def double(stem: str) -> bool:
        return len(stem) > 1 and stem[-1] == stem[-2] and form(stem)[-1] == "c"

    def cvc(stem: str) -> bool:
        return len(stem) > 2 and form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in form(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif measure(w) == 1 and cvc(w):
                w += "e"
    if w.endswith("y") and "v" in form(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (
        "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log",
        "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:",
    ):
        for pair in pairs.split():
            end, new = pair.split(":")
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou".split():
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not cvc(stem)):
            w = stem
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _spanish(w: str) -> str:
    if len(w) < 5:
        return w
    if w[-1] in "oae":
        return w[:-1]
    if w[-1] == "s":
        if w.endswith("eses"):
            return w[:-2]
        if w.endswith("ces"):
            return w[:-3] + "z"
        if w[-2] in "oae":
            return w[:-2]
    return w


def _italian(w: str) -> str:
    if len(w) < 6:
        return w
    if w[-1] in "ei":
        return w[:-2] if w[-2] in "ih" else w[:-1]
    if w[-1] in "ao":
        return w[:-2] if w[-2] == "i" else w[:-1]
    return w


def _german(w: str) -> str:
    ends = "bdfghklmnt"
    if len(w) > 5 and w.endswith("ern"):
        w = w[:-3]
    elif len(w) > 4 and w[-2:] in ("em", "en", "er", "es"):
        w = w[:-2]
    elif len(w) > 3 and (w[-1] == "e" or (w[-1] == "s" and w[-2] in ends)):
        w = w[:-1]
    if len(w) > 5 and w.endswith("est"):
        return w[:-3]
    if len(w) > 4 and (w[-2:] in ("er", "en") or (w.endswith("st") and w[-3] in ends)):
        return w[:-2]
    return w


def _french(w: str) -> str:
    if len(w) > 5 and w[-1] == "x":
        if w.endswith("aux") and w[-4] != "e":
            w = w[:-2] + "l"
        else:
            w = w[:-1]
    elif len(w) > 3 and w[-1] == "x":
        w = w[:-1]
    if len(w) > 3 and w[-1] == "s":
        w = w[:-1]
    for end, new, least in (
        ("issement", "ir", 9), ("issant", "ir", 8), ("ement", "", 8), ("ficatrice", "fier", 11), ("ficateur", "fier", 10),
        ("catrice", "quer", 10), ("cateur", "quer", 9), ("atrice", "er", 8), ("ateur", "er", 7), ("trice", "teur", 7),
        ("ieme", "", 6), ("teuse", "ter", 7), ("teur", "ter", 6), ("euse", "eu", 5), ("ere", "er", 8), ("ive", "if", 7),
        ("folle", "fou", 4), ("molle", "mou", 4), ("nnelle", "n", 8), ("nnel", "n", 8), ("ete", "et", 4),
        ("ique", "", 8), ("esse", "", 8), ("inage", "", 7), ("isation", "", 9), ("isateur", "", 9), ("ation", "", 8), ("ition", "", 8),
    ):
        if len(w) >= least and w.endswith(end):
            w = w[: -len(end)] + new
            break
    if len(w) > 4:
        if w[-1] == "r":
            w = w[:-1]
        if w[-1] == "e":
            w = w[:-1]
        if w[-1] == "e":
            w = w[:-1]
        if len(w) > 2 and w[-1] == w[-2]:
            w = w[:-1]
    return w


def _portuguese(w: str) -> str:
    if len(w) < 4:
        return w
    if w[-1] == "s":
        if w.endswith("es") and w[-3] in "rsl":
            w = w[:-2]
        elif w.endswith("ns"):
            w = w[:-2] + "m"
        elif w.endswith("eis") or w.endswith("ais"):
            w = w[:-2] + "l"
        elif w.endswith("oes") or w.endswith("aes"):
            w = w[:-3] + "ao"
        else:
            w = w[:-1]
    if len(w) > 6 and w.endswith("mente"):
        w = w[:-5]
    if len(w) > 4 and w[-1] == "a":
        for end, new in (("inha", "inho"), ("iaca", "iaco"), ("eira", "eiro"), ("ona", "ao"), ("osa", "oso"), ("ora", "or"), ("esa", "es")):
            if w.endswith(end):
                w = w[: -len(end)] + new
                break
    if len(w) > 3 and w[-1] in "eao":
        w = w[:-1]
    return w


STEM = {"en": _porter, "es": _spanish, "it": _italian, "de": _german, "fr": _french, "pt": _portuguese}


def analyze_tokens(words: list[str], lang: str, keep_stop: bool) -> list[str]:
    """Tokens of one text through one language's analyzer."""
    if lang not in STEM:
        return words
    elided = ELIDED.get(lang, frozenset())
    out = []
    for i, w in enumerate(words):
        if w in elided and i + 1 < len(words) and words[i + 1][:1] in "aeiouh":
            continue
        if not keep_stop and w in STOPS[lang]:
            continue
        if lang == "en" and w == "s":
            continue
        out.append(STEM[lang](w))
    return out


def analyzed(text: Column, lang: Column | str, keep_stop: bool) -> Column:
    """The tokens of a text by the analyzer of a language (two letters; unknown ones get the default analyzer)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(words: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else analyze_tokens(list(w), (k or "")[:2], keep_stop) for w, k in zip(words, langs, strict=True)])

    return run(tokens(text), F.lit(lang) if isinstance(lang, str) else lang)
