"""Windows from JSON and CSV documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_filled, last_segment, parse_date, party_label
from ..operators.spells import choose_label, merge_consecutive, number_terms
from ..schema import TERMS
from .documents import read_elements

OPEN_END = "9999-12-31"


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of windows, typed; a blank label is Other."""
    t = spark.read.schema(TERMS).csv(path, header=True, dateFormat="yyyy-MM-dd")
    return t.withColumn("party_abbrev", F.coalesce(first_filled(F.col("party_abbrev")), F.lit("Other")))


def read_legislators(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """People with nested terms: those of type ``prez`` with a start, one row each."""
    fields = {"wikidata": "id.wikidata", "govtrack": "id.govtrack", "official": "name.official_full", "first": "name.first", "last": "name.last", "terms": "terms"}
    people = read_elements(spark, path, "", fields, lines)
    terms = F.from_json("terms", "array<struct<type string, start string, end string, party string>>")
    t = people.withColumn("t", F.explode(terms)).where("t.type = 'prez' AND coalesce(t.start, '') <> ''")
    person = F.coalesce(first_filled(F.col("wikidata")), F.concat(F.lit("govtrack:"), F.col("govtrack")), F.lit(""))
    name = F.coalesce(first_filled(F.col("official")), F.trim(F.concat_ws(" ", "first", "last")))
    return t.select(person.alias("person"), name.alias("president"), F.coalesce("t.party", F.lit("")).alias("party"), party_label(F.lit(None), F.col("t.party")).alias("label"), parse_date(F.col("t.start")).alias("start"), F.coalesce(parse_date(F.col("t.end")), F.lit(OPEN_END).cast("date")).alias("end"))


def read_bindings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SPARQL result documents; of several parties of one person and window D, then R, then the first is taken."""
    names = {"person": "person", "president": "personLabel", "party": "party", "start": "start", "end": "end"}
    t = read_elements(spark, path, "results.bindings", {n: f"{p}.value" for n, p in names.items()}, lines).where("person > '' AND start > ''")
    rows = t.select("pos", last_segment(F.col("person")).alias("person"), "president", party_label(last_segment(F.col("party")), F.lit(None)).alias("label"), parse_date(F.col("start")).alias("start"), F.coalesce(parse_date(F.col("end")), F.lit(OPEN_END).cast("date")).alias("end"))
    names = rows.groupBy("person", "start", "end").agg(F.min_by("president", "pos").alias("president"))
    return choose_label(rows, ["person", "start", "end"], "label", "pos").join(names, ["person", "start", "end"])


def windows(terms: DataFrame, granularity: str = "tenure") -> DataFrame:
    """Numbered windows: as they are (``term``), or with those that follow one another merged (``tenure``)."""
    return merge_consecutive(terms) if granularity == "tenure" else number_terms(terms)
