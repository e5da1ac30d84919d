"""Functions over persons: roles, ages, names, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relator codes of illustrators and authors; entity codes of genders (male, female, intersex, trans female,
# trans male) and kinds (human, pseudonym, pen name, collective pseudonym, human of disputed existence).
ILLUSTRATOR_ROLES = ["ill", "art"]
AUTHOR_ROLES = ["aut"]
GENDERS = {"Q6581097": 1, "Q6581072": 2, "Q1097630": 3, "Q1052281": 4, "Q2449503": 5}
INSTANCES = {"Q5": 1, "Q61002": 2, "Q127843": 3, "Q16017119": 4, "Q21070568": 5}


def role_code(role: Column) -> Column:
    """A relator as its short code, whether bare, prefixed, spelled out or the last part of an address; '' for none."""
    r = F.substring_index(F.lower(F.trim(F.coalesce(role, F.lit("")))), "/", -1)
    r = F.regexp_replace(r, "^marc:", "")
    return F.when(r == "illustrator", "ill").when(r == "artist", "art").otherwise(r)


def is_illustrator(role: Column) -> Column:
    return role_code(role).isin(ILLUSTRATOR_ROLES)


def is_author(role: Column, creator: bool) -> Column:
    """An author by role; without a role only creators are."""
    code = role_code(role)
    return code.isin(AUTHOR_ROLES) | ((code == "") & F.lit(creator))


def birth_name_includes(birth: Column, name: Column) -> Column:
    return F.forall(F.split(name, " "), lambda p: F.contains(birth, p))


def birth_name(p1477: Column, p1559: Column, p1448: Column) -> Column:
    return F.coalesce(F.nullif(p1477, F.lit("")), F.nullif(p1559, F.lit("")), F.nullif(p1448, F.lit("")))


def pseudonyms(names: Column, own: Column) -> Column:
    return F.filter(names, lambda n: n != own)


def image_url(name: Column, base: str) -> Column:
    """The storage address of an image: by the digest of its name with underscores for blanks."""
    n = F.replace(name, F.lit(" "), F.lit("_"))
    h = F.md5(n.cast("binary"))
    escaped = F.replace(F.url_encode(n), F.lit("+"), F.lit("%20"))
    return F.concat_ws("/", F.lit(base), F.substring(h, 1, 1), F.substring(h, 1, 2), escaped)


def code_of(table: dict[str, int], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(0))


def password_hash(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("binary"), 256))
