"""Mixed timestamp notations, precisions and zones in one normal form (problem 7).

`stamp_parts` takes a stamp apart by a list of patterns, all built-in expressions. Notations that say
themselves what is what have one reading; the others have several, and which one a source means is settled by
expectation-maximisation over a mixture of notations per source:

* numeric dates may put the day first, the month first or, with years of two digits, the year first; a value adds likelihood
  under each reading that is a valid date;
* the weights of a source's notations start at their prior and are re-estimated `rounds` times from the counts of values by
  the set of readings that are valid. An order the source declares is a prior of `prior_weight` values only, so enough
  values that contradict it overrule it;
* each value takes the reading of largest posterior; one that is no larger than one half plus `margin` is marked 'ambiguous'.

Zone names that stand for several offsets take the one that the source's own zone has at that time; where it has none of
them the usual one is taken, marked 'ambiguous'. So are years of two digits, which leave the century open: up to `PIVOT` they
are read as 20.., beyond as 19...

The counts are pre-aggregated per source (seven numbers each), so a source holding a third of all rows costs no more
than any other, and the iteration is an `aggregate` over those numbers inside the plan: no driver loop, no collect.

Defined results: NULL, blank, wordy and impossible stamps are 'invalid' with a NULL norm; a source without a zone is read in
UTC; a source without a declared order relies on its values alone. The session time zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.operators.joins import broadcast_checked
from stackroom.session import ensure_checkpoint_dir

# Month names (en, fr, de, es, it, pt) by number; abbreviations are their first three letters in English.
MONTHS = {
    1: "january jan janvier januar enero gennaio janeiro",
    2: "february feb février fevrier februar febrero febbraio fevereiro",
    3: "march mar mars märz maerz marzo março marco",
    4: "april apr avril abril aprile",
    5: "may mai mayo maggio maio",
    6: "june jun juin juni junio giugno junho",
    7: "july jul juillet juli julio luglio julho",
    8: "august aug août aout agosto",
    9: "september sep sept septembre septiembre settembre setembro",
    10: "october oct octobre oktober octubre ottobre outubro",
    11: "november nov novembre noviembre novembro",
    12: "december dec décembre decembre dezember diciembre dicembre dezembro",
}

# Zone abbreviations and their offsets in minutes.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "AST": -240, "ADT": -180, "GST": 240, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "COT": -300,
}

# Zone names in use for several offsets, in minutes, the usual one first.
SHARED_ZONES = {"IST": [330, 120, 60], "CST": [-360, 480], "BST": [60, 360], "AST": [-240, 180], "ADT": [-180, 240], "GST": [240, -120], "PST": [-480, 480]}
PIVOT = 30

ZONE = r"(Z|[+-]\d\d:?'?\d\d'?|[+-]\d\d'?|[A-Z]{2,5})"
CLOCK = rf"(\d{{1,2}}):(\d\d)(?::(\d\d)(?:[.,]\d+)?)?\s*((?i:[ap]\.?m\.?))?\s*{ZONE}?"
WORD = r"(\p{L}+)\.?"

#: (pattern, where year, month, day, hour, minute, second, am/pm, zone stand among its groups; 0 = absent, -1 = slash part).
PATTERNS: list[tuple[str, tuple[int, ...]]] = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T\s]+{CLOCK})?$", (1, 2, 3, 4, 5, 6, 7, 8)),
    (r"^(\d{4})[-/.](\d{1,2})$", (1, 2, 0, 0, 0, 0, 0, 0)),
    (rf"^(?:D:)?(\d{{4}})(\d\d)(\d\d)[T ]?(\d\d)(\d\d)(\d\d)?(?:[.,]\d+)?{ZONE}?$", (1, 2, 3, 4, 5, 6, 0, 7)),
    (r"^(?:D:)?(\d{4})(\d\d)(\d\d)$", (1, 2, 3, 0, 0, 0, 0, 0)),
    (r"^D:(\d{4})(\d\d)?$", (1, 2, 0, 0, 0, 0, 0, 0)),
    (rf"^(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}})(?:,?[T\s]+{CLOCK})?$", (3, 2, 1, 4, 5, 6, 7, 8)),
    (r"^(\d{1,2})[/.-](\d{4})$", (2, 1, 0, 0, 0, 0, 0, 0)),
    (
        rf"^(?:\p{{L}}+\.?,\s*)?(\d{{1,2}})(?:\.|st|nd|rd|th|er|º)?[\s-]+(?:de\s+)?{WORD},?[\s-]+(?:de\s+)?(\d{{4}})(?:,?\s+{CLOCK})?$",
        (3, 2, 1, 4, 5, 6, 7, 8),
    ),
    (rf"^(?:\p{{L}}+\.?,\s*)?{WORD}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+{CLOCK})?$", (3, 1, 2, 4, 5, 6, 7, 8)),
]
SHORT = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d\d)(?:,?[T\s]+{CLOCK})?$"
SLASH = rf"^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})(?:,?[T\s]+{CLOCK})?$"
MONTH_YEAR = rf"^{WORD}[\s-]+(?:de\s+)?(\d{{4}})$"
NAMED_MONTH_YEAR = MONTH_YEAR.replace(WORD, rf"(?iu:{'|'.join(n for names in MONTHS.values() for n in names.split())})\.?")
YEAR = r"^(?:(?i:anno|cop\.|copyright|circa|ca\.|c\.|c|p|©|℗|\(c\)))?\s*[\[(]?\s*(\d{4})\s*[\])]?\.?$"
ROMAN = r"^(?:(?i:anno)\s+)?(M{1,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))\.?$"
EPOCH = r"^(\d{9,10}|\d{12,13})$"


def _lookup(pairs: dict[str, int], c: Column) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), c)


def _month(word: Column) -> Column:
    return _lookup({w: n for n, names in MONTHS.items() for w in names.split()}, F.lower(word))


def _int(c: Column) -> Column:
    return F.expr("NULL").cast("int") if c is None else F.nullif(c, F.lit("")).cast("int")


def _offset_minutes(z: Column) -> Column:
    """Minutes east of UTC; NULL for none, -9999 for a name that isn't known."""
    digits = F.regexp_replace(z, r"[^0-9]", "")
    hm = F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")), F.lit("0")).cast("int")
    return (
        F.when(z == "", F.lit(None).cast("int"))
        .when(z.rlike(r"^[+-]"), F.when(z.startswith("-"), -hm).otherwise(hm))
        .otherwise(F.coalesce(_lookup(ZONES, z), F.lit(-9999)))
    )


def _shared_offsets(z: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in SHARED_ZONES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), z)


NUMBERS = ["y", "m", "d", "h", "mi", "s", "m2", "d2", "y3", "m3", "d3"]


def _parts(**found: Column) -> Column:
    """What a pattern finds, as it stands: numbers, and the words for the month, am or pm, and the zone."""
    number = [F.coalesce(found[k].cast("int"), F.lit(None).cast("int")).alias(k) if k in found else F.lit(None).cast("int").alias(k) for k in NUMBERS]
    return F.struct(*number, *[(found[k] if k in found else F.lit("")).alias(k) for k in ("word", "half", "zone")], F.lit("y3" in found).alias("short"))


def _read(p: Column) -> Column:
    """The parts with the words read: the month, the hour of the day, the offset and the offsets of a shared zone name."""
    month, pm = F.when(p["word"] == "", p["m"]).otherwise(_month(p["word"])), F.lower(p["half"]).startswith("p")
    hour = F.when(p["half"] == "", p["h"]).when(p["h"] == 12, F.when(pm, 12).otherwise(0)).otherwise(p["h"] + F.when(pm, 12).otherwise(0))
    given = {k: p[k] for k in NUMBERS} | {"m": month, "h": hour, "off": _offset_minutes(p["zone"])}
    out = F.struct(*[c.cast("int").alias(k) for k, c in given.items()], _shared_offsets(p["zone"]).alias("offs"), p["short"].alias("short"))
    return F.when((p["word"] == "") | month.isNotNull(), out)


def stamp_parts(stamp: Column) -> Column:
    """The parts of a stamp by the first pattern it meets; m2 d2 and y3 m3 d3 are the readings with the month and the year
    first where they are possible; short, a year of two digits. NULL if it meets none."""
    s = F.regexp_replace(stamp, r"^[\s ]+|[\s ]+$", "")
    out: Column | None = None

    def also(pattern: str, *places: int, test: Column | None = None, **more: Column) -> None:
        """`places` are the groups of year, month, day, hour, minute, second, am/pm and zone; 0 = absent."""
        nonlocal out
        names = ["y", "word" if pattern.count(WORD) else "m", "d", "h", "mi", "s", "half", "zone"]
        group = {k: F.regexp_extract(s, pattern, i) for k, i in zip(names, places, strict=False) if i}
        value = _parts(**{k: c if k in ("word", "half", "zone") else _int(c) for k, c in group.items()}, **more)
        test = s.rlike(pattern) if test is None else test
        out = F.when(test, value) if out is None else out.when(test, value)

    for pattern, at in PATTERNS:
        also(pattern, *at)
    g = lambda i: _int(F.regexp_extract(s, SLASH, i))
    also(SLASH, 3, 2, 1, 4, 5, 6, 7, 8, m2=g(1), d2=g(2))
    g2 = lambda i: _int(F.regexp_extract(s, SHORT, i))
    other = lambda c: F.when(F.regexp_extract(s, SHORT, 2) != ".", c)  # noqa: E731  dots put the day first
    year = lambda c: c + F.when(c <= PIVOT, 2000).otherwise(1900)
    also(SHORT, 0, 3, 1, 5, 6, 7, 8, 9, y=year(g2(4)), m2=other(g2(1)), d2=other(g2(3)), y3=other(year(g2(1))), m3=other(g2(3)), d3=other(g2(4)))
    also(MONTH_YEAR, 2, 1, test=s.rlike(NAMED_MONTH_YEAR))
    also(YEAR, 1)
    digit = lambda ch: _lookup({"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}, ch)
    letters = F.filter(F.split(F.regexp_extract(s, ROMAN, 1), ""), lambda x: x != "")
    roman = F.aggregate(
        F.reverse(letters),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, x: F.struct(
            (a["sum"] + F.when(digit(x) < a["last"], -digit(x)).otherwise(digit(x))).alias("sum"), digit(x).alias("last")
        ),
        lambda a: a["sum"],
    )
    also(ROMAN, y=roman)
    n = F.regexp_extract(s, EPOCH, 1)
    t = F.timestamp_seconds(F.when(F.length(n) >= 12, F.substring(n, F.lit(1), F.length(n) - 3)).otherwise(n).cast("bigint"))
    also(EPOCH, y=F.year(t), m=F.month(t), d=F.dayofmonth(t), h=F.hour(t), mi=F.minute(t), s=F.second(t).cast("int"), zone=F.lit("Z"))
    return out


def _held(df: DataFrame, *names: str, **made: Column) -> DataFrame:
    """Columns that are there (`names`) or made here, each computed once a row.

    They pass through a generator of one row, so that the optimiser neither repeats them in each place that names them nor
    moves filters on them below.
    """
    one = F.struct(*[F.col(n) for n in names if n not in made], *[c.alias(n) for n, c in made.items()])
    kept = [c for c in df.columns if c not in names and c not in made]
    return df.select(*kept, F.inline(F.array(one)))


def _valid(y: Column, m: Column, d: Column) -> Column:
    """A calendar date; a month or day of zero is not stated."""
    month, day = F.coalesce(m, F.lit(0)), F.coalesce(d, F.lit(0))
    exact = F.try_make_timestamp(y, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).isNotNull()
    return (y > 0) & F.when(month == 0, F.lit(True)).when(day == 0, month.between(1, 12)).otherwise(exact)


def _with_norm(df: DataFrame) -> DataFrame:
    """Adds norm, and open: whether a zone name could have meant another offset. `df` has p, r (the date taken) and time_zone.

    One step a projection: what a later step names several times is then computed once.
    """
    p, y, m, d = F.col("p"), F.col("r.y"), F.coalesce("r.m", F.lit(0)), F.coalesce("r.d", F.lit(0))
    seconds = F.coalesce(p["s"], F.lit(0))
    clocked = (p["h"] < 24) & (p["mi"] < 60) & (seconds < 60)
    df = df.withColumn("__local", F.when(clocked, F.try_make_timestamp(y, m, d, p["h"], p["mi"], seconds.cast("decimal(16,6)"))))
    df = df.withColumn("__own", F.to_utc_timestamp("__local", F.coalesce("time_zone", F.lit("UTC"))))
    # the source's own offset at that time, if the zone name may stand for it
    meant = ((F.unix_seconds("__local") - F.unix_seconds("__own")) / 60).cast("int")
    df = df.withColumn("__known", F.coalesce(F.array_contains(p["offs"], meant), F.lit(False)))
    utc = F.when(p["off"].isNull() | F.col("__known"), F.col("__own")).when(p["off"] > -9999, F.timestamp_seconds(F.unix_seconds("__local") - p["off"] * 60))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year = F.lpad(y.cast("string"), 4, "0")
    norm = (
        F.when(~_valid(y, m, d), F.lit(None).cast("string"))
        .when(m == 0, year)
        .when(d == 0, F.concat_ws("-", year, two(m)))
        .when(p["h"].isNull(), F.concat_ws("-", year, two(m), two(d)))
        .otherwise(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return df.withColumns({"norm": norm, "open": p["offs"].isNotNull() & p["h"].isNotNull() & ~F.col("__known")})


# the sets of readings that are valid: d = day first, m = month first, y = year first
SETS = ["d", "m", "y", "dm", "dy", "my", "dmy"]
DECLARED = 0.9


def mixture_weights(counts: DataFrame, source: str, prior: str, rounds: int = 40, prior_weight: float = 10.0) -> DataFrame:
    """EM: (source, w_d, w_m, w_y), the weights of the notations in each source.

    `counts` has per source the values n_d, n_m ... n_dmy by the set of their valid readings, and `prior` (1 = day first
    declared, 0 = month first, NULL = unknown: one pseudo-value each way). The year first has one pseudo-value where any value
    can be read so.
    """
    share = F.when(F.col(prior) >= 0.5, DECLARED).otherwise(1 - DECLARED)
    declared = F.col(prior).isNotNull()
    c = counts.select(source, prior, *[F.coalesce(f"n_{k}", F.lit(0)).cast("double").alias(f"n_{k}") for k in SETS])
    c = c.withColumns(
        {
            "a_d": F.when(declared, prior_weight * share).otherwise(1.0), "a_m": F.when(declared, prior_weight * (1 - share)).otherwise(1.0),
            "a_y": F.when(sum((F.col(f"n_{k}") for k in SETS if "y" in k), F.lit(0.0)) > 0, 1.0).otherwise(0.0),
        }
    )
    own = F.col("a_d") + F.col("a_m") + F.col("a_y")
    c = c.withColumns({"own": own, "total": own + sum((F.col(f"n_{k}") for k in SETS), F.lit(0.0))})

    def step(w: Column, _: Column) -> Column:
        """What each notation gets of every set, by the weights so far."""
        within = {k: sum((w[x] for x in k[1:]), w[k[0]]) for k in SETS}
        part = lambda x: sum((F.col(f"n_{k}") * w[x] / F.greatest(within[k], F.lit(1e-300)) for k in SETS if x in k), F.col(f"a_{x}"))
        return F.struct(*[(part(x) / F.col("total")).alias(x) for x in "dmy"])

    start = F.struct(*[(F.col(f"a_{x}") / F.col("own")).alias(x) for x in "dmy"])
    got = c.select(source, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("w"))
    return got.select(source, *[F.col(f"w.{x}").alias(f"w_{x}") for x in "dmy"])


def notation_weights(counts: DataFrame, source: str, prior: str, rounds: int = 40, prior_weight: float = 10.0) -> DataFrame:
    """(source, w_day): the weight of the day first, from the counts n_day, n_month and n_both of dates with full years."""
    named = {"n_d": F.col("n_day"), "n_m": F.col("n_month"), "n_dm": F.col("n_both")}
    sets = counts.withColumns({f"n_{k}": named.get(f"n_{k}", F.lit(0)) for k in SETS})
    return mixture_weights(sets, source, prior, rounds, prior_weight).select(source, F.col("w_d").alias("w_day"))


def normalise_stamps(
    df: DataFrame, key: str, stamp: str, source: str, sources: DataFrame | None = None, margin: float = 0.05, prior_weight: float = 10.0
) -> DataFrame:
    """(key, stamp, norm, status, p_day, p) for every row of `df`.

    `sources` holds (source, time_zone, day_first); of a source named twice the smallest zone and order count. It is
    broadcast after its size was checked. status: 'ok', 'ambiguous' or 'invalid'; p_day is the posterior of the day first, p
    that of the reading taken (NULL for notations of one reading).
    """
    rows = df.select(F.col(key).alias("__k"), F.col(stamp).alias("__s"), F.col(source).alias("__src"), stamp_parts(F.col(stamp)).alias("q"))
    rows = _held(_held(rows, "q"), "q", p=_read(F.col("q"))).drop("q")
    p = F.col("p")
    several = p["d2"].isNotNull()
    dates = {"d": (p["y"], p["m"], p["d"]), "m": (p["y"], p["m2"], p["d2"]), "y": (p["y3"], p["m3"], p["d3"])}
    valid = {x: F.coalesce(dates[x][2].isNotNull() & _valid(*dates[x]), F.lit(False)) for x in "dmy"}
    rows = _held(rows, set=F.when(several, F.concat(*[F.when(valid[x], x).otherwise("") for x in "dmy"])))
    counts = rows.groupBy("__src").agg(*[F.sum((F.col("set") == k).cast("bigint")).alias(f"n_{k}") for k in SETS])
    if sources is None:
        known = counts.select("__src", F.lit(None).cast("string").alias("time_zone"), F.lit(None).cast("double").alias("prior"))
    else:
        known = sources.groupBy(F.col(sources.columns[0]).alias("__src")).agg(
            F.min("time_zone").alias("time_zone"), F.min(F.col("day_first").cast("int")).cast("double").alias("prior")
        )
    # one row per source: a table of sources, its size is checked before it is broadcast
    weights = mixture_weights(counts.join(broadcast_checked(known), "__src", "left"), "__src", "prior", prior_weight=prior_weight)
    ensure_checkpoint_dir(df.sparkSession)
    # one row per source, else its counts are made again below
    per_source = known.join(weights, "__src", "full").select("__src", "time_zone", *[F.coalesce(f"w_{x}", F.lit(0.0)).alias(f"w_{x}") for x in "dmy"]).checkpoint()
    out = rows.join(broadcast_checked(per_source), "__src", "left")
    out = out.withColumns({f"s_{x}": F.when(F.contains("set", F.lit(x)), F.col(f"w_{x}")).otherwise(0.0) for x in "dmy"})
    out = out.withColumn("total", F.col("s_d") + F.col("s_m") + F.col("s_y"))
    out = out.withColumn("best", F.greatest("s_d", "s_m", "s_y"))
    taken = F.when((F.col("total") == 0) | (F.col("s_d") == F.col("best")), "d").when(F.col("s_m") == F.col("best"), "m").otherwise("y")
    out = out.withColumn("taken", taken)
    as_date = lambda x: F.struct(*[c.alias(n) for n, c in zip("ymd", dates[x], strict=True)])
    out = out.withColumn("r", F.when(F.col("taken") == "m", as_date("m")).when(F.col("taken") == "y", as_date("y")).otherwise(as_date("d")))
    out = _held(_with_norm(out), "norm", "open")
    sure = F.col("total") > 0
    best, p_day = F.when(sure, F.col("best") / F.col("total")), F.when(sure, F.col("s_d") / F.col("total"))
    unclear = F.coalesce((best <= 0.5 + margin) & (p["m"] != p["d"]), F.lit(False)) | F.coalesce(p["short"] | F.col("open"), F.lit(False))
    status = F.when(F.col("norm").isNull(), "invalid").when(unclear, "ambiguous").otherwise("ok")
    return out.select(F.col("__k").alias(key), F.col("__s").alias("stamp"), "norm", status.alias("status"), p_day.alias("p_day"), best.alias("p"))


def epub_publication_stamps(epub: DataFrame) -> DataFrame:
    """(info_id, stamp, shelf): the first date entry with event 'publication' or ''; records without one are left out."""
    entry = F.get(F.filter("date", lambda e: e["event"].isin("publication", "")), F.lit(0))
    return epub.select(
        "info_id", entry["stamp"].alias("stamp"), F.substring_index("path", "/", 1).alias("shelf")
    ).where(F.col("stamp").isNotNull())
