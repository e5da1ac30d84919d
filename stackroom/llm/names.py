"""Variant spellings of person and organisation names linked to one entity (problem 5).

Distinct names are parsed into a metric key ('given surname', or an organisation's folded words), then linked:

1. Typos, by metric-space partitioning of the distinct words of all keys: every word is at home with its nearest pivot under the
   bag metric, which never exceeds the edit metric, and replicated to pivots whose distance is at most 2r larger, of each two
   cells one way (triangle inequality: of two words within r edits one stands in the other's home cell); an exact radius join
   under the true edit metric runs inside each cell, with r = 1. Keys are near only if their words are, and are joined by equal
   strings of near words, then compared. Keys of `LETTERS[0]` letters or more are linked within one edit, keys of `LETTERS[1]` or more within two
   (one in each of two words); shorter ones must be equal. Connected components are taken (min-label rounds with pointer jumping until no label moves,
   cut with checkpoint()).
2. Nicknames and abbreviations ('Paddy', 'Phil.') link to the one component of that surname they can stand for.
3. Initials ('P. Surname') link to the one component of that surname with that initial; a second initial decides ties.
4. Two different middle initials keep two persons of one given name and surname apart.

A form that could stand for two entities stays on its own: a shared surname alone doesn't make one person.

Scale: names are made distinct with partial aggregation before anything else; pivots are a bounded sample; cells above
`CELL_ROWS` are split by deletion-neighbourhood hash (every pair within r shares a neighbour, so no pair is lost; by its last
`ENDS` letters unless too many words end alike) into parts of about as many rows; aliases are resolved by equi-joins on (surname, alias) against pre-aggregated label ranges, never by pairs
within a surname. `named_entities` gives one row a name; only `variant_pairs` writes all pairs of an entity.

Defined results: NULL and blank names are ignored; a name of one word is an entity of its own key; strings that differ
only in case, blanks or marks are spellings of one; repeated rows change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.llm.edit import edit_distance
from stackroom.session import ensure_checkpoint_dir

LETTERS = (5, 16)
LONG = 64
CELL_ROWS = 20_000
ENDS = 3
MAX_PIVOTS = 128

# Short forms of given names in common use.
NICKNAMES = {
    "adelaide": "addie ada", "alexander": "alex sasha sandy al xander", "anastasia": "nastya stacy ana", "anthony": "tony",
    "bartholomew": "bart", "beatrice": "bea trixie", "benedict": "ben", "benjamin": "ben benny", "cecilia": "celia cissy",
    "charles": "charlie chuck", "charlotte": "lotte lottie charlie", "christopher": "chris kit", "daniel": "dan danny",
    "david": "dave", "dmitri": "dima mitya", "dorothea": "dora dot thea", "edward": "ted ned ed eddie",
    "eleanor": "nell ellie nora", "elizabeth": "liz beth betty lizzie", "emil": "milo", "fernando": "nando",
    "francisco": "paco", "françoise": "fanny", "frederick": "fred freddy fritz", "gabriela": "gabi", "george": "georgie",
    "gregory": "greg", "gwendolyn": "gwen", "henrietta": "etta hettie", "henry": "harry hank", "hildegard": "hilde hilda",
    "ignacio": "nacho", "isabella": "bella izzy", "james": "jim jimmy", "johann": "hans", "john": "jack johnny",
    "jonathan": "jon jonny", "josé": "pepe", "joseph": "joe", "josephine": "jo josie", "jürgen": "jorg",
    "katherine": "kate kitty kathy kat", "konstantin": "kostya", "lawrence": "larry laurie", "leopold": "poldi leo",
    "ludmila": "mila lyuda", "margaret": "peggy meg maggie greta", "matilda": "tilda tilly mattie", "maximilian": "max maxi",
    "michael": "mike mick", "nathaniel": "nat nate", "nikolai": "kolya nick", "oskar": "ossi", "ottilie": "otti tilly",
    "patrick": "paddy pat", "penelope": "penny", "peter": "pete", "philippa": "pippa pip", "quentin": "quin",
    "raphaël": "rafa raf", "richard": "dick rick", "robert": "bob rob bobby", "rosalind": "roz rosa", "rudolf": "rudi rolf",
    "samuel": "sam sammy", "sebastian": "seb bastian", "stéphanie": "steffi steph", "teresa": "tess terry",
    "theodore": "theo ted", "thomas": "tom tommy", "tobias": "toby tobi", "umberto": "berto", "ursula": "uschi",
    "valentina": "tina valya", "victoria": "vicky tori", "vincent": "vince vinnie", "wilhelmina": "mina minnie",
    "william": "will bill billy liam", "xavier": "xavi", "yvonne": "vonnie", "zoë": "zo",
}
# Particles, titles, and words of organisations with the short forms they are cut to.
PARTICLES = {"de", "del", "der", "den", "da", "di", "du", "la", "le", "van", "von", "zu", "ter", "dos", "das"}
TITLES = {"dr", "prof", "sir", "mr", "mrs", "ms", "rev", "dame", "lord", "lady", "st", "hon", "phd", "jr", "sr"}
BODIES = (
    "university institute academy society association museum library college school press company council foundation "
    "committee department union club league publishers publishing office ministry laboratory"
).split()
# Words of organisations in other languages (folded, never cut short), and legal forms at the end of a name.
FOREIGN_BODIES = set(
    "universitat universite universidad universita universidade institut instituto istituto akademie academie academia accademia "
    "gesellschaft societe sociedad societa sociedade verein verband museo musee bibliothek bibliotheque biblioteca verlag editions "
    "editorial editora edizioni fundacion fondation fondazione stiftung ministerium ministere ministerio ecole escuela scuola schule "
    "corporation".split()
)
LEGAL_FORMS = {"gmbh", "ag", "inc", "incorporated", "ltd", "limited", "llc", "plc", "corp", "corporation", "sarl", "srl", "kg", "ohg", "bv", "nv"}
CUT_BODIES = {"mus", "inst", "acad", "assoc", "soc", "univ"}
SMALL_WORDS = {"the", "of", "for", "and", "a", "an", "in", "at"}


def fold(text: str) -> str:
    if text.isascii():
        text = text.lower()
        return text if text.isalnum() else "".join(c for c in text if c.isalnum())
    text = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if c.isalnum())



def clean(name: str) -> str:
    text = unicodedata.normalize("NFKC", name).replace("_", " ")
    text = re.sub(r"\s", " ", text) if text.isascii() else "".join(" " if c.isspace() else c for c in text if unicodedata.category(c) != "Cf")
    return re.sub(r" +", " ", text).strip(" ;,\"'[]()")


def _tokens(text: str) -> list[tuple[str, bool]]:
    """(folded word, whether a dot follows), without titles."""
    if not text.isupper():
        text = re.sub(r"(?<!\w)([^\W\d_a-z])([^\W\d_a-z])(?!\w)", lambda m: f"{m[1]} {m[2]}" if m[0].isupper() else m[0], text)
    out = [(fold(w), bool(dot)) for w, dot in re.findall(r"([^\W_]+(?:['’-][^\W_]+)*)(\.?)", text)]
    return [(w, d) for w, d in out if w and w not in TITLES]


def _body(word: str, dot: bool) -> str | None:
    """The full organisation word a token is or shortens."""
    if word in BODIES or word in FOREIGN_BODIES:
        return word
    if (dot or word in CUT_BODIES) and len(word) >= 3:
        return next((b for b in BODIES if b.startswith(word)), None)
    return None


def organisation_key(name: str) -> str | None:
    """The folded words of an organisation's name in their usual order without its legal form, or None if it is a person's."""
    head, comma, tail = clean(name).partition(",")
    last = (tail or head).split()[-1:]
    if last and fold(last[0]) in LEGAL_FORMS and not last[0].islower() and (len((tail or "x y").split()) == 1 or not comma):
        bare = head if comma else head.rsplit(" ", 1)[0] if " " in head else ""
        return " ".join((_body(w, d) or w) for w, d in _tokens(bare) if w not in SMALL_WORDS | LEGAL_FORMS) or None
    tokens = _tokens(f"{tail} {head}" if comma else head)
    if not any(_body(w, d) for w, d in tokens):
        return None
    return " ".join((_body(w, d) or w) for w, d in tokens if w not in SMALL_WORDS) or None


def evidence(name: str) -> list[tuple[str, int]]:
    """(word, +1 seen as a given name, -1 seen as a surname) where the spelling shows it."""
    if organisation_key(name):
        return []
    head, comma, tail = clean(name).partition(",")
    if comma:
        given = [w for w, _ in _tokens(tail) if len(w) > 1 and w not in PARTICLES][:1]
        last = [w for w, _ in _tokens(head) if len(w) > 1 and w not in PARTICLES][-1:]
        return [(w, 1) for w in given] + [(w, -1) for w in last]
    words = [w for w, _ in _tokens(head) if w not in PARTICLES]
    if len(words) >= 3 and any(len(w) == 1 for w in words[1:-1]) and len(words[-1]) > 1:
        return [(w, 1) for w in words[:1] if len(w) > 1] + [(words[-1], -1)]
    if len(words) >= 2 and len(words[0]) == 1 and len(words[-1]) > 1:
        return [(words[-1], -1)]
    return []


def parse(name: str, given_names: frozenset[str]) -> tuple[str, str, str, bool, str]:
    """(kind, given, surname, whether the given name is dotted, middle initials)."""
    if (org := organisation_key(name)) is not None:
        return "org", "", org, False, ""
    head, comma, tail = clean(name).partition(",")
    if comma:
        last = [w for w, _ in _tokens(head) if w not in PARTICLES] or [w for w, _ in _tokens(head)]
        first = [(w, d) for w, d in _tokens(tail) if w not in PARTICLES]
        surname = " ".join(last)
    else:
        words = _tokens(head)
        lone = [i for i, (w, _) in enumerate(words) if w in PARTICLES and 0 < i]
        words = [x for i, x in enumerate(words) if i not in lone and not (i == 0 and x[0] in PARTICLES and len(words) > 2)]
        if len(words) > 2:  # a short lower-case word before the surname is a mistyped particle
            raw = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", head)
            small = {fold(w) for w in raw if w.islower() and len(w) <= 4} if not head.islower() else set()
            words = [words[0], *[x for x in words[1:-1] if x[0] not in small], words[-1]]
        if not words:
            return "person", "", fold(name), False, ""
        turned = len(words) >= 2 and words[-1][0] in given_names and words[0][0] not in given_names and len(words[0][0]) > 1
        if turned:
            surname, first = words[0][0], words[-1:] + words[1:-1]
        else:
            surname, first = words[-1][0], words[:-1]
    if not surname:
        return "person", "", fold(name), False, ""
    if not first:
        return "person", "", surname, False, ""
    middle = "".join(w[0] for w, _ in first[1:])
    return "person", first[0][0], surname, first[0][1], middle


def neighbours(word: str, radius: int = 1) -> set[str]:
    """Keys of which two words within `radius` edits share one.

    Words up to `LONG` letters: the word and all words up to `radius` deletions shorter. Longer ones, which have too many of
    these: `radius` edits leave one of 2 * radius + 1 pieces of a word as it is, at most `radius` places away in the other; so
    the pieces a word of each near length would have, at each near place, are the keys.
    """
    n, out = len(word), set()
    if n <= LONG + radius:
        out = last = {word}
        for _ in range(radius):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            out = out | last
    if n > LONG:
        k, near = 2 * radius + 1, range(-radius, radius + 1)
        for size in (n + x for x in near):
            for i in range(k):
                a, b = i * size // k, (i + 1) * size // k
                out |= {f"{size}:{i}:{word[a + x : b + x]}" for x in near if a + x >= 0 and b + x <= n}
    return out


class Pivots:
    """The pivots under the bag distance, the larger of what either string has of letters that the other lacks.

    It is a metric on letter counts and never exceeds the edit distance, so the triangle inequality holds for it at the
    same radius, and one matrix step gives a batch's distances to all pivots.
    """

    def __init__(self, words: list[str]):
        self.letters = {c: i for i, c in enumerate(sorted({c for w in words for c in w}))}
        self.bags = self._bags(words)
        self.sizes = self.bags.sum(axis=1)

    def _bags(self, words: list[str]) -> np.ndarray:
        """Letter counts; letters no pivot has share the last place."""
        out = np.zeros((len(words), len(self.letters) + 1), dtype=np.int16)
        for i, w in enumerate(words):
            for c in w:
                out[i, self.letters.get(c, -1)] += 1
        return out

    def cells(self, words: list[str], radius: int) -> list[list[int]]:
        """For each word every pivot at most 2 * radius farther away than the nearest, of each two cells one way only, and the
        nearest one, its home, at the end."""
        out, places = [], np.arange(len(self.bags))
        for k in range(0, len(words), 256):
            bags = self._bags(words[k : k + 256])
            shared = np.minimum(bags[:, None, :-1], self.bags[None, :, :-1]).sum(axis=2)
            d = np.maximum(bags.sum(axis=1)[:, None], self.sizes[None, :]) - shared
            near = d <= d.min(axis=1, keepdims=True) + 2 * radius
            home = d.argmin(axis=1)[:, None]
            # words go from the later cell to the earlier one or, where their sum is odd, the other way: cells stay even in size
            near &= (places != home) & ((places < home) == ((places + home) % 2 == 0))
            out += [[*np.nonzero(row)[0].tolist(), int(h)] for row, h in zip(near, home[:, 0], strict=True)]
        return out


def near_distance(a: str, b: str, radius: int) -> int:
    """`edit_distance` where it is at most `radius`, else some number above: what both begin and end with costs nothing."""
    if abs(len(a) - len(b)) > radius:
        return radius + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    k, n = 0, n - i
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[i : len(a) - k], b[i : len(b) - k]
    if radius == 1 and max(len(a), len(b)) > 1:
        return 1 if len(a) == 2 and a == b[::-1] else 2
    return edit_distance(a, b)


def _by_part(word: str, radius: int, parts: int, ends: int) -> list[dict]:
    """The hashes of a word's neighbours, by the part they fall in: a part gets its own ones only. Neighbours that agree in their
    last `ends` letters (0: in all) fall in one part, so a word is in few of them."""
    out: dict[int, set[int]] = defaultdict(set)
    for v in neighbours(word, radius):
        out[crc32(v[-ends:].encode()) % parts].add(crc32(v.encode()))
    return [{"part": k, "near": list(v)} for k, v in out.items()]


def placed_words(words: DataFrame, radius: int) -> DataFrame:
    """(word, cell, home): each string of the one column `word` in its cells, the last of which is its home."""
    spark = words.sparkSession
    want = int(min(MAX_PIVOTS, max(8, words.count() // 500)))
    chosen = [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(want).collect()]
    shared = spark.sparkContext.broadcast(Pivots(chosen))

    @F.pandas_udf("array<int>")
    def cells(w: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(w.tolist(), radius), dtype=object)

    cores = max(2, spark.sparkContext.defaultParallelism)
    # few small rows, much work each: the partition counts are fixed, else adaptive execution merges them into one task
    placed = words.repartition(2 * cores, "word").select("word", cells("word").alias("cells"))
    return placed.select("word", F.element_at("cells", -1).alias("last"), F.explode("cells").alias("cell")).select("word", "cell", (F.col("cell") == F.col("last")).alias("home"))


def radius_pairs(words: DataFrame, radius: int = 1) -> DataFrame:
    """(a, b, d), a < b: all pairs of distinct strings of the one column `word` within `radius` edits of each other."""
    cores = max(2, words.sparkSession.sparkContext.defaultParallelism)
    placed = placed_words(words, radius).checkpoint()
    # a cell too large for one task is split by its words' neighbourhoods; there is one size a pivot
    split = F.col("n") > CELL_ROWS
    each = F.col("letters") + 1 if radius == 1 else F.pow("letters", F.lit(radius)) / 2 + F.col("letters") + 1
    # by the last letters of the neighbours, of which a word has few, unless too many words of a cell share theirs
    size = placed.count()
    crowd = placed.groupBy("cell", F.expr(f"right(word, {ENDS})")).count().where(F.col("count") > CELL_ROWS)
    ends = 0 if size > CELL_ROWS and crowd.limit(1).count() else ENDS
    each = F.least(each, F.lit(float((ENDS + radius) ** radius))) if ends else each
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("word")).alias("letters"))
    sizes = F.broadcast(sizes.select("cell", F.when(split, F.ceil(F.col("n") * each / CELL_ROWS)).otherwise(1).cast("int").alias("parts")))

    @F.pandas_udf("array<struct<part:int,near:array<bigint>>>")
    def parts_of(w: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([[{"part": 0, "near": None}] if k <= 1 else _by_part(x, radius, k, ends) for x, k in zip(w, parts, strict=True)], dtype=object)

    rows = placed.join(sizes, "cell").select("word", "cell", "home", F.explode(parts_of("word", "parts")).alias("p")).select("word", "cell", "home", "p.*")

    def join_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str | int, list[str]] = defaultdict(list)
        out = []
        # of a pair one is at home here: replicas are looked up among the words at home, not among each other
        pdf = pdf.sort_values("home", ascending=False, kind="stable")
        for w, home, given in zip(pdf["word"], pdf["home"], pdf["near"], strict=True):
            around = neighbours(w, radius) if given is None else given.tolist()
            seen: set[str] = set()
            for v in around:
                for x in near[v] if v in near else ():
                    if x not in seen and (d := near_distance(w, x, radius)) <= radius:
                        out.append((min(w, x), max(w, x), d))
                    seen.add(x)
            if home:
                for v in around:
                    near[v].append(w)
        return pd.DataFrame(out, columns=["a", "b", "d"])

    rows = rows.repartition(max(4 * cores, size // CELL_ROWS), "cell", "part")
    return rows.groupBy("cell", "part").applyInPandas(join_cell, "a string, b string, d int").distinct()


def _meeting(node: str, above: list[list[str]], parts: list[list[str]], changing: bool, letters: int) -> dict[str, int]:
    """The strings at which a node meets those near it, with the words replaced: two nodes meet where these are two at most.

    Of two nodes of as many words each word is near its counterpart, and both reach the string of the higher words. A node with
    a blank more than another is reached by it, one word in two parts. Edits that move a blank leave the same letters after it
    and at most one more letter are left out; they change two words, or three of those where only two may change.
    """
    words = node.split(" ")
    out = {node: 0}
    long = len(node) - node.rfind(":") > letters
    for i, more in enumerate(above):
        for w in more:
            out.setdefault(" ".join([*words[:i], w, *words[i + 1 :]]), 1)
    for i, more in enumerate(parts):
        for w in more:
            out.setdefault(" ".join([*words[:i], w, *words[i + 1 :]]), 2)
    for i, more in enumerate(above if long else ()):
        for j in range(i + 1, len(words)):
            for w in more:
                for v in above[j]:
                    out.setdefault(" ".join([*words[:i], w, *words[i + 1 : j], v, *words[j + 1 :]]), 2)
    if not long or changing:
        at = -1
        for w in words[:-1]:
            at += len(w) + 1
            bare = node[:at] + node[at + 1 :]
            out[f"\t{bare}"] = 1
            if long:
                out |= {f"\t{bare[:k]}{bare[k + 1 :]}": 1 for k in range(node.find(":") + 1, len(bare))}
    return out


def near_words(used: DataFrame) -> DataFrame:
    """(word, above, parts): of each string of (word, n) the words within one edit that are in use more often, or as often and later
    in order, and 'a b' for any two words that it is with or without a letter between them; words that have neither, but are
    above others, have empty lists; all others are left out."""
    pairs = radius_pairs(used.select("word")).select("a", "b")
    pairs = pairs.join(used.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(used.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    rises = F.col("n_a") <= F.col("n_b")
    pairs = pairs.select(F.when(rises, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(rises, F.col("b")).otherwise(F.col("a")).alias("high"))
    above = pairs.select(F.explode(F.array(F.struct(F.col("low").alias("word"), F.col("high").alias("other")), F.struct(F.col("high").alias("word"), F.lit(None).cast("string").alias("other")))).alias("p"))
    above = above.select("p.word", F.col("p.other").alias("above"), F.lit(None).cast("string").alias("parts"))
    # a first part and what may follow it
    cuts = used.where("length(word) > 1").select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    cuts = cuts.select("word", F.expr("substring(word, 1, k)").alias("first"), F.expr("array(substring(word, k + 1), substring(word, k + 2))").alias("rest"))
    cuts = cuts.join(used.select(F.col("word").alias("first")), "first").select("word", "first", F.explode("rest").alias("rest")).where("rest <> ''")
    parts = cuts.join(used.select(F.col("word").alias("rest")), "rest").select("word", F.lit(None).cast("string").alias("above"), F.concat_ws(" ", "first", "rest").alias("parts"))
    return above.unionByName(parts).groupBy("word").agg(F.collect_set("above").alias("above"), F.collect_set("parts").alias("parts"))


def typo_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes 'kind:key' that are near enough for their length.

    Nodes that are near have words that are near, so the radius join runs over the distinct words, which are shorter and fewer
    and need one edit only; nodes are then joined by equal strings made of these words (`_meeting`) and compared.
    """
    nodes = nodes.where(F.length(F.substring_index("node", ":", -1)) >= LETTERS[0])
    words = nodes.select("node", F.posexplode(F.split("node", " ")).alias("pos", "word"))
    used = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    letters = LETTERS[1]
    around = words.join(near_words(used), "word").groupBy("node").agg(F.collect_list(F.struct("pos", "above", "parts")).alias("around"))

    @F.pandas_udf("array<struct<s:string,r:int>>")
    def meeting(n: pd.Series, around: pd.Series) -> pd.Series:
        out = []
        for node, found in zip(n, around, strict=True):
            above: list[list[str]] = [[] for _ in range(node.count(" ") + 1)]
            parts: list[list[str]] = [[] for _ in above]
            for x in found if found is not None else ():
                above[x["pos"]], parts[x["pos"]] = list(x["above"]), list(x["parts"])
            out.append([{"s": s, "r": r} for s, r in _meeting(node, above, parts, found is not None and len(found) > 2, letters).items()])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("boolean")
    def near_enough(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_near_enough(x, y, letters) for x, y in zip(a, b, strict=True)], dtype=bool)

    met = nodes.join(around, "node", "left").select("node", F.explode(meeting("node", "around")).alias("m")).select("node", F.xxhash64("m.s").alias("h"), F.col("m.r").alias("r"))
    other = met.select(F.col("node").alias("b"), "h", F.col("r").alias("s"))
    pairs = met.withColumnRenamed("node", "a").join(other, "h").where("a < b AND r + s <= 2").select("a", "b").distinct()
    return pairs.where(near_enough("a", "b"))


def _near_enough(a: str, b: str, letters: int) -> bool:
    """Whether two nodes are within one edit or, both of `letters` letters or more, within two, one in each of two words."""
    d = near_distance(a, b, 2)
    if d != 2 or min(len(x) - x.rfind(":") for x in (a, b)) <= letters:
        return d < 2
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) and all(near_distance(v, w, 1) <= 1 for v, w in zip(x, y, strict=True))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node is connected to.

    Rounds until no label moves: the smaller label of an edge goes to the node and to the node's label, then every label is
    replaced by its own label (pointer jumping), so a chain halves in a round and long chains take a few more of them.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    ).checkpoint()
    # only linked nodes take part in the rounds
    labels = both.select("node").distinct().withColumn("label", F.col("node")).checkpoint()
    moved = 1
    while moved:
        near = both.join(labels.withColumnRenamed("node", "other").withColumnRenamed("label", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        near = near.join(labels, "node").where(F.col("near") < F.col("label"))
        # what a node learns its label learns too
        told = near.select(F.explode(F.array("node", "label")).alias("node"), "near").groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(told, "node", "left").select("node", "label", F.least("label", "near").alias("next")).checkpoint()
        above = hooked.select(F.col("node").alias("next"), F.col("next").alias("above"))
        new = hooked.join(above, "next").select("node", F.col("above").alias("label"), (F.col("above") < F.col("label")).alias("moved")).checkpoint()
        moved = new.where("moved").limit(1).count()
        labels = new.drop("moved")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def distinct_names(df: DataFrame, columns: list[str]) -> DataFrame:
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
    return (
        df.select(F.explode(F.flatten(F.array(*arrays))).alias("name"))
        .where(F.col("name").rlike(r"[\p{L}\p{N}]")).distinct()
    )


def _with_given(names: DataFrame) -> DataFrame:
    """(name, known): each name with those of its words that are seen more often as given name than as surname."""

    @F.pandas_udf("array<struct<word:string,vote:int>>")
    def votes(n: pd.Series) -> pd.Series:
        return pd.Series([[{"word": w, "vote": v} for w, v in evidence(x)] for x in n], dtype=object)

    @F.pandas_udf("array<string>")
    def words(n: pd.Series) -> pd.Series:
        return pd.Series([[] if "," in (c := clean(x)) else sorted({w for w, _ in _tokens(c)}) for x in n], dtype=object)

    seen = names.select(F.explode(votes("name")).alias("v")).groupBy("v.word").agg(F.sum("v.vote").alias("n")).where("n > 0")
    known = names.select("name", F.explode(words("name")).alias("word")).join(seen.select("word"), "word")
    return names.join(known.groupBy("name").agg(F.collect_set("word").alias("known")), "name", "left")


def _aliases(nicknames: dict[str, str]) -> Column:
    """What a given name may be shortened to: its prefixes and its nicknames."""
    by_formal = {fold(f): v.split() for f, v in nicknames.items()}
    nick = F.create_map(*[x for f, v in by_formal.items() for x in (F.lit(f), F.array(*[F.lit(fold(n)) for n in v]))])
    prefixes = F.transform(F.sequence(F.lit(1), F.length("given") - 1), lambda i: F.substring(F.col("given"), F.lit(1), i))
    return F.array_distinct(F.concat(prefixes, F.coalesce(F.try_element_at(nick, F.col("given")), F.array().cast("array<string>"))))


def entities(df: DataFrame, columns: list[str], nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """(name, entity) for every distinct name. `nicknames` maps a given name to its short forms, parted by blanks."""
    ensure_checkpoint_dir(df.sparkSession)
    names = distinct_names(df, columns).checkpoint()

    @F.pandas_udf("struct<kind:string,given:string,surname:string,dotted:boolean,middle:string>")
    def parsed(n: pd.Series, known: pd.Series) -> pd.DataFrame:
        got = [parse(x, frozenset(() if k is None else k)) for x, k in zip(n, known, strict=True)]
        return pd.DataFrame(got, columns=["kind", "given", "surname", "dotted", "middle"])

    p = _with_given(names).select("name", parsed("name", "known").alias("p")).select("name", "p.*")
    p = p.withColumn("key", F.concat_ws(" ", F.nullif("given", F.lit("")), "surname"))
    p = p.withColumn("node", F.concat_ws(":", "kind", "key")).checkpoint()
    full = (F.col("kind") == "org") | (F.length("given") > 1)
    nodes = p.where(full).select("node").distinct().checkpoint()
    labels = components(nodes, typo_pairs(nodes)).checkpoint()
    p = p.join(labels, "node", "left")

    # nicknames and dotted abbreviations: the one label of that surname, itself no short form, that they can stand for
    persons = p.where((F.col("kind") == "person") & (F.length("given") > 1)).groupBy("label", "surname", "given").agg(F.max("dotted").alias("dotted"))
    known = F.array(*[F.lit(n) for n in sorted({fold(n) for n in chain(*(v.split() for v in nicknames.values()))})])
    short = F.col("dotted") | F.array_contains(known, F.col("given"))
    alias = persons.select("surname", F.col("label").alias("formal"), F.explode(_aliases(nicknames)).alias("alias")).where(F.length("alias") > 1)
    parents = (
        persons.where(short).join(alias, (persons["surname"] == alias["surname"]) & (F.col("given") == F.col("alias")))
        .where(F.col("label") != F.col("formal")).select("label", "formal").distinct()
    )
    roots = parents.join(parents.select(F.col("label").alias("formal")).distinct(), "formal", "left_anti")
    moved = roots.groupBy("label").agg(F.min("formal").alias("lo"), F.max("formal").alias("hi")).where("lo = hi").select("label", F.col("lo").alias("root"))
    p = p.join(moved, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root").checkpoint()

    # two middle initials under one label are two persons
    people = p.where((F.col("kind") == "person") & (F.length("given") > 1))
    middles = people.where(F.col("middle") != "").groupBy("label").agg(
        F.min(F.substring("middle", 1, 1)).alias("m_lo"), F.max(F.substring("middle", 1, 1)).alias("m_hi")
    )
    p = p.join(middles, "label", "left")
    split = F.col("m_lo") != F.col("m_hi")
    p = p.withColumn(
        "entity", F.when(split, F.concat_ws("/", "label", F.substring("middle", 1, 1))).when(F.col("label").isNotNull(), F.col("label"))
    )

    # initials: the one entity of that surname and initial; with a second initial, the one that has it or none other
    surnames = p.where((F.col("kind") == "person") & F.col("label").isNotNull() & (F.length("given") > 1))
    # a surname's own spelling counts, so a mistyped one doesn't make an initial ambiguous
    heads = surnames.groupBy("surname", F.substring("given", 1, 1).alias("initial"), "entity").agg(F.max(F.substring("middle", 1, 1)).alias("m"))
    one = heads.groupBy("surname", "initial").agg(F.min("entity").alias("e_lo"), F.max("entity").alias("e_hi"), F.max("m").alias("e_m"))
    two = heads.where(F.col("m") != "").groupBy("surname", "initial", "m").agg(F.min("entity").alias("t_lo"), F.max("entity").alias("t_hi"))
    lone = p.where((F.col("kind") == "person") & (F.length("given") <= 1)).select(
        "name", "node", "surname", F.col("given").alias("initial"), F.substring("middle", 1, 1).alias("m")
    )
    lone = lone.join(one, ["surname", "initial"], "left").join(two, ["surname", "initial", "m"], "left")
    only = (F.col("e_lo") == F.col("e_hi")) & ((F.col("m") == "") | (F.col("e_m") == "") | (F.col("m") == F.col("e_m")))
    entity = F.when(F.col("t_lo") == F.col("t_hi"), F.col("t_lo")).when(only, F.col("e_lo")).otherwise(F.concat_ws("/", "node", "m"))
    lone = lone.where(F.col("initial") != "").select("name", entity.alias("entity")).unionByName(
        lone.where(F.col("initial") == "").select("name", F.col("node").alias("entity"))
    )
    return p.where(F.col("entity").isNotNull()).select("name", "entity").unionByName(lone)


def named_entities(df: DataFrame, columns: list[str], nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """(name, representative, spellings): every distinct name, the smallest spelling of its entity, and how many it has."""
    e = entities(df, columns, nicknames).checkpoint()
    one = e.groupBy("entity").agg(F.min("name").alias("representative"), F.count(F.lit(1)).alias("spellings"))
    return e.join(one, "entity").select("name", "representative", "spellings")


def variant_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name_a, name_b), name_a < name_b: every pair of different spellings of one entity."""
    e = entities(df, columns).checkpoint()
    a = e.select("entity", F.col("name").alias("name_a"))
    b = e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
