"""One value for each metric and window, with its error, and summaries by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept
from . import ranges
from .attribution import PERIOD_KEYS, before_boundaries, term_of_period
from .percentiles import percentiles
from .transforms import apply_transforms

BOUNDARY_KINDS = ("end_minus_start", "end_minus_start_per_year", "pct_change_from_levels", "cagr_from_levels")
YEAR_DAYS = 365.25
TOLERANCE = 1e-9
PARAMS = ["freq", "period_kind", "fy_month", "fy_day", "transform", "lag", "scale", "annualize", "threshold", "agg_kind", "agg_scale", "post_scale", "ppy", "from_value", "to_value"]


def _or(col: str, default: float) -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit(0.0)), F.lit(default))


def known_only(metrics: DataFrame, inputs: DataFrame) -> DataFrame:
    """``metrics``, of which one that names no input of ``inputs`` (``series_key``) stops the job that reads it."""
    named = inputs.select(F.col("series_key").alias("_known")).distinct()
    unknown = F.raise_error(F.concat_ws(" ", F.lit("unknown input"), F.coalesce("series_key", F.lit("(none)")), F.lit("of metric"), "metric_id"))
    return metrics.join(named, F.col("series_key") == F.col("_known"), "left").withColumn("series_key", F.when(F.col("_known").isNull(), unknown.cast("string")).otherwise(F.col("series_key"))).drop("_known")


def observe(series: DataFrame, metrics: DataFrame, inputs: DataFrame | None = None, parts: int | None = None, lags: list | None = None) -> DataFrame:
    """The transformed observations of each metric: ``metric_id, pos, d, v`` with the metric's parameters.

    ``inputs`` (``series_key``) are the registry's inputs: a metric that names another one stops the job. Without it an
    input is known by its name alone, and one without any observation is an empty series. ``parts``: see ``ranges``;
    ``lags``: those of the metrics, if they are at hand.
    """
    if inputs is not None:
        metrics = known_only(metrics, inputs)
    if lags is None:
        lags = [r[0] for r in metrics.select("lag").collect()]
    rows = series.join(metrics.select("metric_id", "series_key", *PARAMS), "series_key")
    return apply_transforms(rows, lags, parts=parts or ranges.parts_for(series))


def attribute(obs: DataFrame, windows: DataFrame, tie: str = "period_end", dates: DataFrame | None = None) -> DataFrame:
    """``obs`` with ``wid``; what no window gets is left out. ``dates``: the kinds and dates that occur, if they can be had cheaper."""
    spans = term_of_period(obs if dates is None else dates, windows, tie).select(*[F.col(k).alias(f"_{k}") for k in PERIOD_KEYS], "wid")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in PERIOD_KEYS[1:4]] + [F.col(k) == F.col(f"_{k}") for k in ("freq", "d")]
    return obs.join(spans, same).select(*obs.columns, "wid")


def _values() -> tuple[Column, Column]:
    """Value and error of each kind, the error checks in the order in which they count; the value is null wherever one fails."""
    kind, n, ppy, scale = F.col("agg_kind"), F.col("n"), _or("ppy", 0.0), _or("agg_scale", 100.0)
    s, e, often = F.col("sv"), F.col("ev"), F.when(ppy > 0, ppy)
    years = F.date_diff("ed", "sd") / F.lit(YEAR_DAYS)
    positive = F.when(years > 0, years)
    growth = F.when((s > 0) & (e > 0), F.when(e > 0, e) / F.when(s > 0, s))
    some, ok_ppy, two, both = n >= 1, ppy > 0, n >= 2, s.isNotNull() & e.isNotNull()
    root = F.sqrt(F.when(ppy > 0, ppy))
    grown = F.when(F.col("product") > 0, F.pow(F.when(F.col("product") > 0, F.col("product")), often / F.nullif(n, F.lit(0)))).when((F.col("product") == 0) & ok_ppy, 0.0)
    kinds = {
        "mean": ([(~some, "empty window")], F.col("mean") * _or("post_scale", 1.0)),
        "last": ([(~some, "empty window")], e),
        "end_minus_start": ([(~both, "missing boundary observation")], e - s),
        "pct_change_from_levels": ([(~both, "missing boundary observation"), (s == 0, "start value is 0")], scale * (e / F.nullif(s, F.lit(0.0)) - 1)),
        "end_minus_start_per_year": ([(~both, "missing boundary observation"), (years <= 0, "non-positive elapsed time")], (e - s) / positive),
        "cagr_from_levels": ([(~both, "missing boundary observation"), (years <= 0, "non-positive elapsed time"), ((s <= 0) | (e <= 0), "non-positive level for CAGR")], scale * (F.pow(growth, 1 / positive) - 1)),
        "mean_times_periods_per_year": ([(~ok_ppy, "periods_per_year required"), (~some, "empty window")], F.col("mean") * often),
        "compound_total": ([(~some, "empty window")], F.when(some, scale * (F.col("product") - 1))),
        "compound_annualized": ([(~ok_ppy, "periods_per_year required"), (~some, "empty window"), (F.col("product") < 0, "negative base for compounding")], F.when(some, scale * (grown - 1))),
        "count_transitions": ([], F.col("transitions").cast("double")),
        "annualized_std": ([(~ok_ppy, "periods_per_year required"), (~two, "need at least 2 observations")], F.col("sd_samp") * root),
        "sharpe_ratio_annualized": ([(~ok_ppy, "periods_per_year required"), (~two, "need at least 2 observations"), (F.col("sd_samp") == 0, "zero std")], F.col("mean") * often / F.nullif(F.col("sd_samp") * root, F.lit(0.0))),
    }
    # One flat CASE each: the first check of a row's kind that fails, and the value if none did.
    failed, value = F.when(F.lit(False), ""), F.when(F.lit(False), None)
    for name, (checks, v) in kinds.items():
        for cond, message in checks:
            failed = failed.when((kind == name) & cond, message)
        value = value.when(kind == name, v)
    known = kind.isin(*kinds)
    return value, failed.when(known, "").otherwise(F.concat(F.lit("Unsupported term_aggregation.kind: '"), kind, F.lit("'")))


def term_metrics(series: DataFrame, metrics: DataFrame, windows: DataFrame, tie: str = "period_end", inputs: DataFrame | None = None) -> DataFrame:
    """The term-metric table: every metric for every window, observed or not.

    ``windows`` has ``wid, label, start, end``; ``inputs`` is as in ``observe``. All accumulators of a metric and window
    come from one aggregation with partial sums on the map side; no group is gathered. Levels of daily series are
    compared at the last values before the window's start and end. Only metrics that count transitions have their
    observations in a window sorted. Errors are texts beside null values. The observations and the accumulators (a
    row for each metric and window) are kept in the shared folder, so that whatever reads the table plans little.
    """
    if inputs is not None:
        metrics = known_only(metrics, inputs)
    parts = ranges.parts_for(series)
    # Dates, windows, levels and presence are all taken from the observations: these are worked out once.
    registry = metrics.select("agg_kind", "freq", "lag").collect()
    kinds = {(r.agg_kind, r.freq == "D") for r in registry}
    obs = kept(observe(series, metrics, parts=parts, lags=[r.lag for r in registry]))
    placed = attribute(obs, windows, tie).withColumn("turn", F.lit(0))
    if any(k == "count_transitions" for k, _ in kinds):
        counted = F.col("agg_kind").eqNullSafe("count_transitions")
        before = F.lag("v").over(Window.partitionBy("metric_id", "wid").orderBy("d", "pos"))
        turn = (F.abs(before - F.coalesce("from_value", F.lit(0.0))) < TOLERANCE) & (F.abs(F.col("v") - F.coalesce("to_value", F.lit(1.0))) < TOLERANCE)
        placed = placed.where(~counted).unionByName(placed.where(counted).withColumn("turn", F.coalesce(turn, F.lit(False)).cast("int")))
    at, seen = F.when(F.col("v").isNotNull(), F.struct("d", "pos")), F.when(F.col("v").isNotNull(), F.struct("d", "v"))
    sums = placed.groupBy("metric_id", "wid").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd_samp"), F.product(1 + F.col("v") / _or("agg_scale", 100.0)).alias("product"),
        F.sum("turn").alias("transitions"), F.min_by(seen, at).alias("first"), F.max_by(seen, at).alias("last"), F.min("d").alias("first_d"), F.max("d").alias("last_d"),
    )
    # Every metric and window: each window lists the metrics' ids, which are few; no join is needed to pair them.
    has = obs.select("metric_id").distinct().withColumn("any_obs", F.lit(1))
    ids = metrics.select("metric_id", "metric_family", "metric_label", "units", "series_key", *PARAMS).join(has, "metric_id", "left")
    t = pair_up(ids, windows.select("wid", "label", "start", "end"))

    bounded, daily = F.col("agg_kind").isin(*BOUNDARY_KINDS), F.col("freq").eqNullSafe("D")
    daily = daily & bounded
    if any(k in BOUNDARY_KINDS and d for k, d in kinds):
        marks = t.where(daily).select("metric_id", "wid", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("start").alias("mark")), F.struct(F.lit("e").alias("side"), F.col("end").alias("mark")))).alias("m")).select("metric_id", "wid", "m.*")
        edge = before_boundaries(obs.where(daily).select("metric_id", "pos", "d", "v"), marks, "metric_id", parts)
        side = lambda x: F.max(F.when(F.col("side") == x, F.struct("d", "v")))
        t = t.join(edge.groupBy("metric_id", "wid").agg(side("s").alias("b_start"), side("e").alias("b_end")), ["metric_id", "wid"], "left")
    else:
        none = F.lit(None).cast("struct<d:date,v:double>")
        t = t.withColumns({"b_start": none, "b_end": none})
    t = t.join(sums, ["metric_id", "wid"], "left")
    complete = F.col("b_start").isNotNull() & F.col("b_end").isNotNull()
    kind = F.col("agg_kind")
    s = F.when(daily, F.when(complete, F.col("b_start"))).when(bounded, F.col("first"))
    e = F.when(daily, F.when(complete, F.col("b_end"))).when(bounded | (kind == "last"), F.col("last"))
    t = t.withColumn("s", s).withColumn("e", e).withColumns({"sd": F.col("s.d"), "sv": F.col("s.v"), "ed": F.col("e.d"), "ev": F.col("e.v"), "n": F.coalesce("n", F.lit(0)), "transitions": F.coalesce("transitions", F.lit(0))})
    t = kept(t)
    value, error = _values()
    t = t.withColumn("error", F.when(daily & F.col("any_obs").isNull(), "empty series").otherwise(error)).withColumn("value", value)
    n_obs = F.when(kind == "last", F.when(F.col("n") > 0, 1)).when(bounded, None).otherwise(F.nullif(F.col("n"), F.lit(0))).cast("long")
    return t.select(
        "metric_id", "metric_family", "metric_label", F.col("wid").alias("term_id"), F.col("label").alias("party_abbrev"), F.col("start").alias("term_start"), F.col("end").alias("term_end"), "freq", "agg_kind",
        F.when(F.isnan("value") | F.abs("value").isin(float("inf")), None).otherwise(F.col("value")).alias("value"), "units", n_obs.alias("n_obs"),
        F.coalesce("sd", "first_d").alias("start_obs_date"), F.coalesce("ed", "last_d").alias("end_obs_date"), F.col("sv").alias("start_obs_value"), F.col("ev").alias("end_obs_value"), "error",
    )


def pair_up(left: DataFrame, right: DataFrame, parts: int = 16) -> DataFrame:
    """Every row of one small table with every row of another, by a key of ``parts`` values: the left rows are dealt
    over it, the right ones are copied to each, so that the result, not a task, grows with both."""
    a = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns[:1]), F.lit(parts)))
    b = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    return a.join(b, "_part").drop("_part")


def party_summary(t: DataFrame) -> DataFrame:
    """Number, mean and median of the values by label and metric, from values of six decimals. Medians are exact, of groups of any size."""
    rows, by = t.where("value IS NOT NULL").withColumn("value", F.round("value", 6)), ["party_abbrev", "metric_id"]
    facts = rows.groupBy(*by).agg(
        F.first("metric_family").alias("metric_family"), F.first("metric_label").alias("metric_label"), F.first("agg_kind").alias("agg_kind"), F.first("units").alias("units"),
        F.count("value").alias("n_terms"), F.avg("value").alias("mean"),
    )
    medians = percentiles(rows, by, "value", [0.5], "_q").select(F.col("party_abbrev").alias("_label"), F.col("metric_id").alias("_metric"), F.col("_q")[0].alias("median"))
    return facts.join(medians, F.col("party_abbrev").eqNullSafe(F.col("_label")) & F.col("metric_id").eqNullSafe(F.col("_metric"))).drop("_label", "_metric")


def diff_of_means(df: DataFrame, by: list[str], label: str = "party_abbrev", value: str = "value") -> DataFrame:
    """``n_d, n_r, diff``: the mean of D less that of R; null if either has none."""
    d, r = (F.when(F.col(label) == x, F.col(value)) for x in "DR")
    return df.groupBy(*by).agg(F.count(d).alias("n_d"), F.count(r).alias("n_r"), (F.avg(d) - F.avg(r)).alias("diff"))
