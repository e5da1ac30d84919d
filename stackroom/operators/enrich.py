"""Author entries resolved from entity records of an external knowledge base.

Input are the JSON answers of its search (name -> ids) and entity requests, read with `spark.read.json`, as tables:
search (name, ids ARRAY<STRING>) and entities (id, claims MAP<STRING, ARRAY<STRUCT<rank, value, precision>>>, descriptions
MAP, links MAP). A live source can feed the same tables.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions.dates import precision_date
from stackroom.functions.people import GENDERS, INSTANCES, birth_name, code_of, image_url

# Claim properties.
INSTANCE_OF, BIRTH_NAME, NATIVE_NAME, OFFICIAL_NAME = "P31", "P1477", "P1559", "P1448"
GENDER, BORN, DIED, WEBSITE, PSEUDONYM, IMAGE = "P21", "P569", "P570", "P856", "P742", "P18"
RANKS = ["preferred", "normal", "deprecated"]
IMAGE_TYPES = r"(?i)\.(png|jpe?g|tiff?)$"


CLAIMS = "array<struct<rank:string,value:string,precision:int>>"


def _claims(p: str) -> Column:
    return F.coalesce(F.try_element_at("claims", F.lit(p)), F.array().cast(CLAIMS))


def _first(p: str) -> Column:
    return F.get(_claims(p), F.lit(0))["value"]


def best_claim(claims: Column) -> Column:
    """The first claim of the best rank present."""
    of = lambda r: F.get(F.filter(claims, lambda c: c["rank"] == r), F.lit(0))
    return F.coalesce(*[of(r) for r in RANKS])


def valid_ids(ids: Column) -> Column:
    return F.forall(ids, lambda i: (i == "") | i.rlike(r"^[Qq]\d+$"))


class EntitySource(Protocol):
    """Where entity records come from: anything that answers these two with the tables described above."""

    def search(self, names: DataFrame) -> DataFrame:
        """(name, ids) for a table of names."""

    def entities(self, ids: DataFrame) -> DataFrame:
        """(id, claims, descriptions, links) for a table of ids."""


class JsonFolders:
    """A source of answers stored as JSON: `search` and `entities` below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def search(self, names: DataFrame) -> DataFrame:
        found = self.spark.read.schema("name string, ids array<string>").json(f"{self.folder}/search")
        return found.join(names.select("name"), "name", "left_semi")

    def entities(self, ids: DataFrame) -> DataFrame:
        known = self.spark.read.schema(f"id string, claims map<string,{CLAIMS}>, descriptions map<string,string>, links map<string,string>")
        return known.json(f"{self.folder}/entities").join(ids.select("id"), "id", "left_semi")


def authors_from(source: EntitySource, names: DataFrame, image_base: str) -> DataFrame:
    """The author entries a source knows for (slug, name)."""
    found = source.search(names.select("name").distinct())
    ids = found.select(F.explode("ids").alias("id")).distinct()
    return resolve_authors(names, found, source.entities(ids), image_base)


def resolve_authors(names: DataFrame, search: DataFrame, entities: DataFrame, image_base: str) -> DataFrame:
    """(slug, name, entity_id, instance_of, ...) for each name with a match.

    Of a name's hits the first whose kind is known wins, best rank of that claim first. A hit list with an invalid id is refused.
    """
    hits = names.join(search, "name").where(valid_ids(F.col("ids")))
    hits = hits.select("slug", "name", F.posexplode("ids").alias("pos", "id"))
    kind = F.get(_claims(INSTANCE_OF), F.lit(0))
    known = entities.withColumn("instance_of", code_of(INSTANCES, kind["value"])).withColumn(
        "r", F.array_position(F.array(*[F.lit(r) for r in RANKS]), kind["rank"])
    )
    both = hits.join(known, "id").where((F.col("instance_of") > 0) & (F.col("r") > 0))
    picked = both.groupBy("slug", "name").agg(
        F.min_by(F.struct("id", "instance_of", "claims", "descriptions", "links"), F.struct("r", "pos")).alias("e")
    ).select("slug", "name", "e.*")
    born, died, image = best_claim(_claims(BORN)), best_claim(_claims(DIED)), _first(IMAGE)
    return picked.select(
        "slug", "name", F.col("id").alias("entity_id"), "instance_of",
        birth_name(_first(BIRTH_NAME), _first(NATIVE_NAME), _first(OFFICIAL_NAME)).alias("birth_name"),
        code_of(GENDERS, _first(GENDER)).alias("gender"),
        precision_date(born["value"], born["precision"]).alias("date_of_birth"),
        precision_date(died["value"], died["precision"]).alias("date_of_death"),
        _first(WEBSITE).alias("website"),
        F.transform(_claims(PSEUDONYM), lambda c: c["value"]).alias("pseudonyms"),
        F.when(image.rlike(IMAGE_TYPES), image_url(image, image_base)).alias("image"),
        F.col("descriptions").alias("description"), F.col("links").alias("wikipedia_link"),
    )
