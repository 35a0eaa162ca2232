"""Joins of summaries, tests, provenance and details for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_even
from ..functions.scalars import clean_label, first_filled, frequency_label, interval_text, md_escape, round6
from ..tables import kept
from . import ranges
from .inference import site_tier

#: Provenance fields that every input must have.
REQUIRED = ("label", "publisher", "program", "access_provider", "url")


def last_rows(df: DataFrame, *keys: str, keep_pos: bool = False) -> DataFrame:
    """A keyed table as read from a file: keys are trimmed, rows with a blank one go, and of duplicates the last by ``pos`` stays.

    Tables without ``pos`` have no order and stay as they are.
    """
    if "pos" not in df.columns:
        return df
    for k in keys:
        df = df.withColumn(k, F.trim(k)).where(F.col(k) != "")
    # An aggregation with partial maxima: a key with very many rows is no single task's work.
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "pos").alias("_last")).select(*keys, "_last.*")
    return last if keep_pos else last.drop("pos")


def placed(board: DataFrame, first: DataFrame) -> DataFrame:
    """Add ``place``: rows by ``q`` (missing last), equal ones by first appearance (``first``: ``metric_id, pos``, missing last), then by id."""
    t = kept(board.join(first.select("metric_id", "pos"), "metric_id", "left"))
    order = [F.col("q").isNull(), F.col("q"), F.col("pos").isNull(), F.col("pos"), F.col("metric_id")]
    return ranges.numbered(t, order, "place").withColumn("place", F.col("place").cast("int")).drop("pos", "_range")


def contrast(summary: DataFrame) -> DataFrame:
    """One row for each metric of a party summary: D and R side by side, and the difference of their rounded means."""
    pick = lambda p, c: F.max(F.when(F.col("party_abbrev") == p, F.col(c)))
    text = lambda c: F.coalesce(pick("D", c), pick("R", c)).alias(c)
    t = last_rows(summary, "party_abbrev", "metric_id").where(F.col("party_abbrev").isin("D", "R")).groupBy("metric_id").agg(
        *[text(c) for c in ("metric_label", "metric_family", "agg_kind", "units")],
        pick("D", "n_terms").alias("n_d"), pick("R", "n_terms").alias("n_r"), round6(pick("D", "mean")).alias("d_mean"), round6(pick("R", "mean")).alias("r_mean"),
    )
    return t.withColumn("diff", round6(F.col("d_mean") - F.col("r_mean")))


def scoreboard(summary: DataFrame, tests: DataFrame) -> DataFrame:
    """The report's rows, to be sorted by ``q`` (missing last) and ``metric_id``. Metrics without a test keep blanks."""
    t = last_rows(tests, "metric_id").select("metric_id", round6(F.col("p")).alias("p"), round6(F.col("q")).alias("q"), round6(F.col("ci_low")).alias("ci_low"), round6(F.col("ci_high")).alias("ci_high"))
    out = contrast(summary).join(t, "metric_id", "left")
    return out.withColumn("metric_label", clean_label(F.col("metric_label"))).withColumn("ci", interval_text(F.col("ci_low"), F.col("ci_high"))).withColumn("tier", site_tier(F.col("q")))


def markdown(board: DataFrame) -> list[str]:
    """The scoreboard as lines of a table, in order: one line for each metric reaches the driver."""
    cell = lambda c: F.coalesce(md_escape(F.col(c).cast("string")), F.lit(""))
    names = ["metric_label", "d_mean", "r_mean", "diff", "n_d", "n_r", "ci", "q", "tier"]
    rows = board.orderBy(F.col("q").asc_nulls_last(), "metric_id").select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in names]), F.lit(" |")).alias("line"))
    return ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *(r["line"] for r in rows.collect())]


def term_details(t: DataFrame) -> DataFrame:
    """``metric_id, terms``: the windows with a value and a D or R label, in order of time."""
    rows = t.where(F.col("party_abbrev").isin("D", "R") & (F.coalesce("error", F.lit("")) == "") & F.col("value").isNotNull())
    item = F.struct(F.col("term_start").cast("string").alias("term_start"), F.col("term_end").cast("string").alias("term_end"), F.col("party_abbrev").alias("party"), round_even(round6(F.col("value")), 4).alias("value"))
    return rows.groupBy("metric_id").agg(F.array_sort(F.collect_list(item)).alias("terms"))


def provenance(metrics: DataFrame, inputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each metric's numbers come from: facts of its input over those of the input's source.

    ``metrics``: ``metric_id, series_key``; ``inputs``: ``series_key, source, series_id, dataset, frequency, units, facts``
    (a map); ``sources``: ``source, facts``. A blank required field stops the job.
    """
    s = sources.select("source", F.col("facts").alias("common"))
    t = metrics.join(inputs, "series_key").join(s, "source", "left")
    fact = lambda k: first_filled(F.try_element_at("facts", F.lit(k)), F.try_element_at("common", F.lit(k)))
    need = lambda k: F.coalesce(fact(k), F.raise_error(F.concat(F.lit(f"missing {k}: "), F.col("series_key")))).alias(k)
    url = F.replace(F.coalesce(fact("url"), F.raise_error(F.concat(F.lit("missing url: "), F.col("series_key")))), F.lit("{series_id}"), F.coalesce("series_id", F.lit("")))
    access = first_filled(fact("access_id"), F.col("series_id"), F.col("dataset"), F.col("series_key"))
    return t.select("metric_id", *[need(k) for k in REQUIRED if k != "url"], url.alias("url"), access.alias("access_id"), frequency_label(F.col("frequency")).alias("frequency"), F.coalesce("units", F.lit("")).alias("units"))


def site(board: DataFrame, sources: DataFrame, details: DataFrame) -> DataFrame:
    """``metric_id, q, payload``: each metric's entry in the export, as JSON."""
    facts = sources.select("metric_id", F.struct(*[c for c in sources.columns if c != "metric_id"]).alias("source"))
    t = board.join(facts, "metric_id", "left").join(details, "metric_id", "left")
    entry = F.struct(
        F.col("metric_label").alias("metric"), F.col("metric_family").alias("family"), F.col("agg_kind").alias("agg"), "units", "source", "d_mean", "r_mean", "diff", "n_d", "n_r", "p", "q", "ci_low", "ci_high", "tier",
        F.coalesce("terms", F.array().cast(dict(details.dtypes)["terms"])).alias("terms"),
    )
    return t.select("metric_id", "q", F.to_json(entry).alias("payload"))
