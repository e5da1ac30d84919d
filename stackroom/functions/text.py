"""Text functions as column expressions: folding, tokens, slugs, names, HTML. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_pairs() -> tuple[str, str]:
    """Letters whose decomposition is one base letter and marks, by rule, with the stroked Latin letters besides."""
    src, dst = [], []
    for lo, hi in ((0xC0, 0x24F), (0x386, 0x3CE), (0x400, 0x45F), (0x1E00, 0x1EFF)):
        for cp in range(lo, hi + 1):
            c = chr(cp)
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c and c == c.lower():
                src.append(c)
                dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_pairs()
# Letters without a decomposition that fold to one or two plain letters.
FOLD_FROM += "łøđħıðŧ"
FOLD_TO += "lodhidt"
FOLD_PAIRS = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ĳ", "ij")]


def fold(c: Column) -> Column:
    """Lower case without accents: the default analyzer's character filter."""
    c = F.translate(F.lower(c), FOLD_FROM, FOLD_TO)
    for a, b in FOLD_PAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fold_sql(x: str) -> str:
    """The same expression in SQL."""
    out = f"translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}')"
    for a, b in FOLD_PAIRS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def tokens(c: Column) -> Column:
    """Default analyzer: folded words of letters and digits; NULL gives an empty array."""
    return F.filter(F.split(F.coalesce(fold(c), F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({fold_sql(x)}, ''), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


# What stands for an ampersand in a slug, by language; other languages use the English word.
AMPERSANDS = {"de": "und", "es": "y", "fr": "et", "it": "e", "pt": "e", "nl": "en", "pl": "i", "sv": "och"}


def slug(c: Column, language: Column | None = None) -> Column:
    """Transliterated lower case with single hyphens between runs of letters, digits and underscores."""
    word = F.lit("and")
    if language is not None:
        code = F.lower(F.substring(language, 1, 2))
        word = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in AMPERSANDS.items() for x in kv]), code), word)
    c = F.regexp_replace(F.replace(fold(c), F.lit("&"), F.concat(F.lit(" "), word, F.lit(" "))), r"['’]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9_-]+", "-"), r"-+", "-"), F.lit("-_"))


def slug_sql(x: str) -> str:
    f = fold_sql(x)
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(replace({f}, '&', ' and '), '[''’]', '', 'g'), "
        "'[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '-_')"
    )


def base_slug(authors: Column, title: Column, language: Column | None = None) -> Column:
    """Slug of the authors and the title."""
    kept = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    return slug(F.concat_ws("-", kept, title), language)


def base_slug_sql(authors: str, title: str) -> str:
    joined = f"array_to_string(list_concat(list_filter(coalesce({authors}, []), lambda a: trim(a) <> ''), list_filter([{title}], lambda t: t IS NOT NULL)), '-')"
    return slug_sql(joined)


def split_list(c: Column, marks: str) -> Column:
    """Trimmed, non-blank parts of a list written with any of `marks`."""
    return F.filter(F.transform(F.split(c, f"[{marks}]"), lambda x: F.trim(x)), lambda x: x != "")


def author_list(c: Column) -> Column:
    """Names parted by & , or ;. A blank list gives one empty name."""
    got = split_list(F.coalesce(c, F.lit("")), "&,;")
    return F.when(F.size(got) == 0, F.array(F.lit(""))).otherwise(got)


def subject_list(c: Column) -> Column:
    return split_list(F.coalesce(c, F.lit("")), ",;")


def subject_name(c: Column) -> Column:
    """A subject's display form: first letter upper case, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def word_count(c: Column) -> Column:
    """Words parted by white space after markup is dropped."""
    return F.size(F.filter(F.split(F.coalesce(strip_html(c), F.lit("")), r"\s+"), lambda w: w != ""))


def word_count_sql(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce(regexp_replace({x}, '<[^>]+>', ' ', 'g'), ''), '\\s+'), lambda w: w <> ''))"


# The elements a sanitized description keeps.
ALLOWED_TAGS = "a abbr b blockquote br cite code dd dl dt em i li ol p q small strike strong sub sup u ul h1 h2 h3 h4 h5 h6".split()


def sanitize_description(c: Column) -> Column:
    """Plain text becomes paragraphs; HTML keeps allowed elements without attributes, scripts and styles go with their content."""
    raw = F.trim(c)
    plain = F.concat(F.lit("<p>"), F.regexp_replace(raw, "\n", "</p><p>"), F.lit("</p>"))
    html = F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    names = "|".join(ALLOWED_TAGS)
    html = F.regexp_replace(html, rf"(?i)</?(?!(?:{names})\b)[a-z][^>]*>", "")
    html = F.regexp_replace(html, r"(?i)<(/?)([a-z][a-z0-9]*)\b[^>]*?(/?)>", "<$1$2$3>")
    return F.when(raw == "", "").when(raw.rlike(r"(?i)<[a-z][^>]*>"), html).otherwise(plain)


def file_title(title: Column, path: Column) -> Column:
    """The title, or the file's name without folder and extension where it is blank."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1))


def display_authors(authors: Column) -> Column:
    return F.concat_ws(", ", F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a != ""))


def comment_preview(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))
