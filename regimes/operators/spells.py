"""Construction of windows: numbering, merging of consecutive ones, and choice of a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_terms(df: DataFrame, person: str = "person", start: str = "start") -> DataFrame:
    """Add ``term_number``: each person's windows by start, from 1."""
    return df.withColumn("term_number", F.row_number().over(Window.partitionBy(person).orderBy(start)))


def merge_consecutive(df: DataFrame, person: str = "person", label: str = "label", label_id: str | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """``person, label, start, end, n_merged, term_number``: windows of a person that follow without gap and have one label become one.

    With ``label_id`` the ids must be equal too, or both be blank.
    """
    order = Window.partitionBy(person).orderBy(start)
    same = (F.lag(label).over(order) == F.col(label)) & (F.lag(end).over(order) == F.col(start))
    if label_id:
        same = same & (F.coalesce(F.lag(label_id).over(order), F.lit("")) == F.coalesce(label_id, F.lit("")))
    df = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    merged = df.groupBy(person, "_island").agg(F.min_by(label, start).alias(label), F.min(start).alias(start), F.max_by(end, start).alias(end), F.count(F.lit(1)).alias("n_merged"))
    return number_terms(merged, person, start).drop("_island")


def choose_label(df: DataFrame, by: list[str], label: str, pos: str, preferred: tuple[str, ...] = ("D", "R")) -> DataFrame:
    """One ``label`` for each group: a preferred one in their order, else the first that isn't blank, else blank."""
    filled = F.nullif(F.trim(F.coalesce(label, F.lit(""))), F.lit(""))
    rank = F.lit(len(preferred))
    for i, p in reversed(list(enumerate(preferred))):
        rank = F.when(filled == p, i).otherwise(rank)
    best = F.min_by(filled, F.when(filled.isNotNull(), F.struct(rank.alias("rank"), F.col(pos).alias("pos"))))
    return df.groupBy(*by).agg(F.coalesce(best, F.lit("")).alias(label))
