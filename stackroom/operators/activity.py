"""Readings, highlights, users and invitations: latest state, lists joined with the catalogue, statistics, and changes.

Changes are pure functions from a table (and a table of changes) to the new table: plain Parquet has no MERGE, so a caller
writes the result as a new version. Equal timestamps are ties; they are broken by the remaining columns, so a result is the
same every time.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackroom.functions.dates import reading_time

NEVER = "0001-01-01 00:00:00"


def clamp_percentage(c: Column) -> Column:
    """0..100; NULL counts as 0."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(c, F.lit(0))))


def latest_readings(readings: DataFrame) -> DataFrame:
    """One row per (user, slug), the last state: map-side max_by over a struct, so a user with a tenth of the rows is no hot task."""
    cols = [c for c in readings.columns if c not in ("user_id", "slug")]
    order = F.struct(
        F.coalesce("updated_at", "created_at"), F.coalesce("completed_on", F.lit(NEVER).cast("timestamp")),
        F.coalesce("percentage", F.lit(-1)), F.coalesce("position", F.lit("")), F.coalesce("created_at", F.lit(NEVER).cast("timestamp")),
        F.coalesce("updated_at", F.lit(NEVER).cast("timestamp")),
    )
    last = readings.groupBy("user_id", "slug").agg(F.max_by(F.struct(*cols), order).alias("r"))
    return last.select("user_id", "slug", *[F.col(f"r.{c}").alias(c) for c in cols]).select(*readings.columns)


def latest_highlights(highlights: DataFrame) -> DataFrame:
    cols = [c for c in highlights.columns if c not in ("user_id", "slug")]
    order = F.struct(
        F.coalesce("updated_at", "created_at", F.lit(NEVER).cast("timestamp")), F.coalesce("created_at", F.lit(NEVER).cast("timestamp")),
        F.coalesce("shared_by_id", F.lit(-1)), F.coalesce("comment", F.lit("")), F.coalesce("updated_at", F.lit(NEVER).cast("timestamp")),
    )
    last = highlights.groupBy("user_id", "slug").agg(F.max_by(F.struct(*cols), order).alias("r"))
    return last.select("user_id", "slug", *[F.col(f"r.{c}").alias(c) for c in cols]).select(*highlights.columns)


def in_progress(readings: DataFrame, documents: DataFrame, user: int, offset: int = 0, size: int = 10) -> DataFrame:
    """A page of a user's unfinished readings, newest first, with their documents; a missing document drops out after paging."""
    mine = readings.where((F.col("user_id") == user) & F.col("completed_on").isNull())
    one = mine.orderBy(F.col("updated_at").desc_nulls_last(), "slug").offset(offset).limit(size)
    out = one.join(documents.select("slug", "title", "words"), "slug")
    return out.select("slug", "title", "words", clamp_percentage(F.col("percentage")).alias("percentage"), "updated_at")


def completed_page(readings: DataFrame, documents: DataFrame, user: int, start: str, end: str, newest: bool = True,
                   offset: int = 0, size: int = 10) -> DataFrame:
    """A page of readings completed from `start` to `end` (UTC, both inclusive) with their documents."""
    done = F.col("completed_on")
    mine = readings.where((F.col("user_id") == user) & done.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    one = mine.orderBy(done.desc() if newest else done.asc(), "slug").offset(offset).limit(size)
    return one.join(documents.select("slug", "title", "words"), "slug").select("slug", "title", "words", "completed_on")


def highlight_list(highlights: DataFrame, documents: DataFrame, users: DataFrame, user: int, kind: str = "all",
                   offset: int = 0, size: int = 10) -> DataFrame:
    """A page of a user's highlights: all, own or shared, with document and sharing user."""
    mine = highlights.where(F.col("user_id") == user)
    if kind == "own":
        mine = mine.where(F.col("shared_by_id").isNull())
    elif kind == "shared":
        mine = mine.where(F.col("shared_by_id").isNotNull())
    one = mine.orderBy(F.col("created_at").desc_nulls_last(), "slug").offset(offset).limit(size)
    by = users.select(F.col("id").alias("shared_by_id"), F.col("name").alias("shared_by"))
    out = one.join(documents.select("slug", "title"), "slug").join(by, "shared_by_id", "left")
    return out.select("slug", "title", "shared_by_id", "shared_by", "comment", "created_at")


def decorate(hits: DataFrame, highlights: DataFrame, readings: DataFrame, user: int) -> DataFrame:
    """Adds whether the user marked a hit and when they completed it; the hits are a page, the user's rows are filtered first."""
    marks = highlights.where(F.col("user_id") == user).select("slug", F.lit(True).alias("highlighted"))
    done = readings.where((F.col("user_id") == user) & F.col("completed_on").isNotNull()).select("slug", "completed_on")
    out = hits.join(marks, "slug", "left").join(done, "slug", "left")
    return out.withColumn("highlighted", F.coalesce("highlighted", F.lit(False)))


def activity_counts(readings: DataFrame, highlights: DataFrame) -> DataFrame:
    """(user_id, in_progress, completed, highlights, shared): counts per user, pre-aggregated on each side."""
    r = readings.groupBy("user_id").agg(
        F.sum(F.col("completed_on").isNull().cast("bigint")).alias("in_progress"),
        F.sum(F.col("completed_on").isNotNull().cast("bigint")).alias("completed"),
    )
    h = highlights.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("highlights"), F.sum(F.col("shared_by_id").isNotNull().cast("bigint")).alias("shared")
    )
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("in_progress", "completed", "highlights", "shared")}
    return r.join(h, "user_id", "full").select("user_id", *zero.values())


def completed_years(readings: DataFrame, user: int, this_year: int) -> DataFrame:
    """The distinct years with completions, without the current one."""
    y = F.year("completed_on")
    mine = readings.where((F.col("user_id") == user) & F.col("completed_on").isNotNull())
    return mine.select(y.alias("year")).where(F.col("year") != this_year).distinct()


def completed_stats(readings: DataFrame, documents: DataFrame, user: int, wpm: float) -> DataFrame:
    """(year, document_count, words, reading_time) per year of completion, and year 0 for all time, even without readings."""
    mine = readings.where((F.col("user_id") == user) & F.col("completed_on").isNotNull()).select("slug", F.year("completed_on").alias("year"))
    rows = mine.join(documents.select("slug", "words"), "slug", "left")
    per = [F.count(F.lit(1)).alias("document_count"), F.coalesce(F.sum("words"), F.lit(0.0)).alias("words")]
    years = rows.groupBy("year").agg(*per)
    ever = rows.agg(*per).select(F.lit(0).alias("year"), "document_count", "words")
    return years.unionByName(ever).withColumn("reading_time", reading_time(F.col("words"), F.lit(wpm)))


def recipients_by_language(users: DataFrame, supported: list[str]) -> DataFrame:
    """(language, emails) of the users with an address, English where theirs isn't supported.

    One row per language is the result's form, for the few users one message goes to; `recipients` has one row a user.
    """
    lang = F.when(F.col("language").isin(supported), F.col("language")).otherwise("en")
    return users.where(F.col("email").isNotNull()).groupBy(lang.alias("language")).agg(F.array_sort(F.collect_set("email")).alias("emails"))


def recipients(users: DataFrame, supported: list[str]) -> DataFrame:
    """(language, email): the addresses with the language to write in, one row each, whatever their number."""
    lang = F.when(F.col("language").isin(supported), F.col("language")).otherwise("en")
    return users.where(F.col("email").isNotNull()).select(lang.alias("language"), "email").distinct()


def filter_users(users: DataFrame, text: str) -> DataFrame:
    """Users whose name, e-mail or username holds the text, whatever its case; % and _ in it are wildcards."""
    hit = F.lit(False)
    for c in ("name", "email", "username"):
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return users.where(hit).orderBy(F.col("email").asc_nulls_first(), "id")


def share_recipients(users: DataFrame) -> DataFrame:
    """Users anyone may share with."""
    return users.where(F.col("private_profile") == 0).select("id", "username", "name")


def new_recipients(users: DataFrame, highlights: DataFrame, slug: str, sender: int) -> DataFrame:
    """Public users who don't hold the document yet, without the sender."""
    holders = highlights.where(F.col("slug") == slug).select(F.col("user_id").alias("id"))
    return share_recipients(users).where(F.col("id") != sender).join(holders, "id", "left_anti")


def has_document(highlights: DataFrame, documents: DataFrame, user: int) -> DataFrame:
    """The documents a user marked (semi-join)."""
    return documents.join(highlights.where(F.col("user_id") == user), "slug", "left_semi").select("slug", "title")


def distinct_keeping_order(items: Column, fold_case: bool) -> Column:
    """The first of each value in an array, in order, exact or whatever the case."""
    if not fold_case:
        return F.array_distinct(items)
    lowered = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


ADDRESS = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def user_problems(users: DataFrame, actions: list[str] | None = None, password_least: int = 0) -> DataFrame:
    """(id, problems): the violated rules of each user row. Rules on columns the table lacks don't apply."""
    rules = {
        "name": F.length(F.coalesce("name", F.lit(""))).between(1, 50),
        "username_length": F.length(F.coalesce("username", F.lit(""))).between(1, 20),
        "username_letters": F.coalesce("username", F.lit("")).rlike(r"^[A-z0-9_\-.]+$"),
        "words_per_minute": F.coalesce("words_per_minute", F.lit(0.0)).between(1, 999),
        "email": F.coalesce("email", F.lit("")).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.length(F.coalesce("email", F.lit(""))) <= 100),
        "role": F.col("role").isNotNull() & F.col("role").between(1, 2),
    }
    text = lambda c: F.coalesce(c, F.lit(""))
    if "send_to_email" in users.columns:
        send = text("send_to_email")
        rules["send_to_email"] = (send == "") | (send.rlike(ADDRESS) & (F.length(send) <= 100))
    if "default_action" in users.columns and actions is not None:
        rules["default_action"] = text("default_action").isin(actions)
    if "password" in users.columns:
        rules["password"] = F.length(text("password")).between(password_least, 50)
    found = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return users.select("id", found.alias("problems"))


def valid_invitations(invitations: DataFrame, now: str) -> DataFrame:
    return invitations.where(F.col("valid_until") > F.lit(now).cast("timestamp"))


def expired_invitations(invitations: DataFrame, now: str) -> DataFrame:
    """The invitations to delete: those no longer valid, or without a date."""
    return invitations.where(~F.coalesce(F.col("valid_until") > F.lit(now).cast("timestamp"), F.lit(False)))


def registered_invitees(invitees: DataFrame, users: DataFrame) -> DataFrame:
    """The invited addresses (column email) that belong to a user already, whatever their case."""
    have = users.where(F.col("email").isNotNull()).select(F.lower("email").alias("__e"))
    return invitees.join(have, F.lower(F.col("email")) == F.col("__e"), "left_semi")


def admins_left(users: DataFrame, gone: int, admin_role: int = 2) -> DataFrame:
    """(admins): the administrators that stay when a user goes; zero forbids the delete."""
    return users.where((F.col("role") == admin_role) & (F.col("id") != gone)).agg(F.count(F.lit(1)).alias("admins"))


# ---- changes


def upsert_positions(readings: DataFrame, changes: DataFrame) -> DataFrame:
    """Readings after position updates (user_id, slug, position, percentage NULL = keep, at).

    Position and time are always set; a percentage is clamped; without one the old stays, but an empty position resets it to 0.
    """
    last = changes.groupBy("user_id", "slug").agg(
        F.max_by(F.struct("position", "percentage", "at"), F.struct("at", F.coalesce("percentage", F.lit(-1)), F.coalesce("position", F.lit("")))).alias("n")
    )
    both = readings.join(last, ["user_id", "slug"], "full")
    new = F.col("n").isNotNull()
    pct = (
        F.when(~new, F.col("percentage")).when(F.col("n.percentage").isNotNull(), clamp_percentage(F.col("n.percentage")))
        .when(F.coalesce(F.col("n.position"), F.lit("")) == "", F.lit(0)).otherwise(F.coalesce("percentage", F.lit(0)))
    )
    cols = {
        "created_at": F.coalesce("created_at", "n.at"),
        "updated_at": F.when(new, F.col("n.at")).otherwise(F.col("updated_at")),
        "position": F.when(new, F.col("n.position")).otherwise(F.col("position")),
        "percentage": pct.cast("int"),
    }
    return both.withColumns(cols).select(*readings.columns)


def touch(readings: DataFrame, opened: DataFrame) -> DataFrame:
    """Adds readings (user_id, slug, at) that aren't there; existing ones stay as they are."""
    fresh = opened.groupBy("user_id", "slug").agg(F.min("at").alias("at")).join(readings, ["user_id", "slug"], "left_anti")
    empty = {c: F.lit(None).cast(t) for c, t in readings.dtypes}
    empty |= {"user_id": F.col("user_id"), "slug": F.col("slug"), "created_at": F.col("at"), "percentage": F.lit(0)}
    return readings.unionByName(fresh.select(*[empty[c].alias(c) for c in readings.columns]))


def _utc(stamp: str) -> datetime:
    """An ISO date or time; without a zone it is in UTC. ValueError if it is none."""
    at = datetime.fromisoformat(stamp)
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def set_completed(readings: DataFrame, user: int, slug: str, on: str | None, now: str) -> DataFrame:
    """Sets or clears a completion date without touching updated_at; a date in the future, or that is none, is refused."""
    if on is not None and _utc(on) > _utc(now):
        raise ValueError("a completion date can't lie in the future")
    here = (F.col("user_id") == user) & (F.col("slug") == slug)
    return readings.withColumn("completed_on", F.when(here, F.lit(on).cast("timestamp")).otherwise(F.col("completed_on")))


def toggle_completed(readings: DataFrame, user: int, slug: str, now: str) -> DataFrame:
    here = (F.col("user_id") == user) & (F.col("slug") == slug)
    flipped = F.when(F.col("completed_on").isNull(), F.lit(now).cast("timestamp"))
    return readings.withColumn("completed_on", F.when(here, flipped).otherwise(F.col("completed_on")))


def insert_highlights(highlights: DataFrame, new: DataFrame) -> DataFrame:
    """Adds highlights that aren't there (recipients above 0); repeated ones keep the earliest."""
    cols = [c for c in highlights.columns if c not in ("user_id", "slug")]
    order = F.struct(F.coalesce("created_at", F.lit(NEVER).cast("timestamp")), F.coalesce("comment", F.lit("")))
    one = new.where("user_id > 0").groupBy("user_id", "slug").agg(F.min_by(F.struct(*cols), order).alias("r"))
    one = one.select("user_id", "slug", *[F.col(f"r.{c}").alias(c) for c in cols])
    return highlights.unionByName(one.join(highlights, ["user_id", "slug"], "left_anti").select(*highlights.columns))


def without(df: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """`df` without the rows whose key is in `gone`: deletes and their cascades."""
    return df.join(gone.select(*on).distinct(), on, "left_anti")


def find_user(users: DataFrame, by: str, value: str) -> DataFrame:
    """The users of an id, uuid, e-mail or username; the last two whatever their case."""
    c = F.col(by)
    return users.where(c == value) if by in ("id", "uuid") else users.where(F.lower(c) == value.lower())


def delete_documents(documents: DataFrame, readings: DataFrame, highlights: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return without(documents, slugs, ["slug"]), without(readings, slugs, ["slug"]), without(highlights, slugs, ["slug"])


def delete_users(users: DataFrame, readings: DataFrame, highlights: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = ids.select(F.col("id").alias("user_id"))
    return without(users, ids, ["id"]), without(readings, gone, ["user_id"]), without(highlights, gone, ["user_id"])


def replace_by(df: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Upsert: rows of `new` replace those of the same key; of several new ones the last by `at` counts."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *[c for c in new.columns if c not in (*keys, at)]))
    last = new.withColumn("__r", rank).where("__r = 1").drop("__r")
    return without(df, last, keys).unionByName(last.select(*df.columns))
