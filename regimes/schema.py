"""Schemas of the tables that pass between stages."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DateType(), "f": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType()}
    out = T.StructType()
    for part in spec.split():
        name, kind = part.split(":")
        out.add(name, kinds[kind])
    return out


#: One row for each observation; ``pos`` keeps the order of rows with equal dates.
SERIES = _struct("series_key:s pos:l d:d v:f")
TERMS = _struct("term_id:s person_qid:s president:s party_qid:s party:s party_abbrev:s term_number_for_person:i term_start:d term_end:d")
TERM_METRICS = _struct(
    "metric_id:s metric_family:s metric_label:s term_id:s president:s party_abbrev:s term_start:d term_end:d freq:s agg_kind:s "
    "value:f units:s n_obs:l start_obs_date:d end_obs_date:d start_obs_value:f end_obs_value:f error:s"
)
PARTY_SUMMARY = _struct("party_abbrev:s metric_id:s metric_family:s metric_label:s agg_kind:s units:s n_terms:l mean:f median:f")
ISSUES = _struct("level:s check_id:s message:s")
#: The registry: one row for each metric; null parameters take the defaults of their kind.
METRICS = _struct(
    "metric_id:s metric_family:s metric_label:s units:s series_key:s freq:s period_kind:s fy_month:i fy_day:i "
    "transform:s lag:i scale:f annualize:f threshold:f agg_kind:s agg_scale:f post_scale:f ppy:f from_value:f to_value:f"
)
