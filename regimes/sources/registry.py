"""The declarative registry of sources, series and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import METRICS

#: Names that registry files use.
TRANSFORMS = {"identity", "pct_change", "growth_rate", "indicator_lt"}
FREQUENCIES = {"D", "M", "Q", "A"}


def load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def metrics(spark: SparkSession, spec: dict, attribution: dict | None = None) -> DataFrame:
    """The registry's metrics, one row each (schema ``METRICS``). What can't be run is refused here."""
    series, overrides, rows = spec.get("series") or {}, (attribution or {}).get("series_overrides") or {}, []
    for m in spec.get("metrics") or []:
        if not m.get("id"):
            raise ValueError("metric without id")
        inputs, t, a = m.get("inputs") or {}, m.get("period_transform") or {}, m.get("term_aggregation") or {}
        key = inputs.get("series") or inputs.get("table")
        if not key:
            raise ValueError(f"{m['id']}: no input")
        if key not in series:
            raise KeyError(f"{m['id']}: unknown input {key}")
        if inputs.get("table") and not inputs.get("column"):
            raise ValueError(f"{m['id']}: no column")
        freq = str(series[key].get("frequency") or "")
        if freq not in FREQUENCIES:
            raise ValueError(f"{key}: unsupported frequency {freq!r}")
        kind = str(t.get("kind") or "identity")
        if kind not in TRANSFORMS or (kind == "growth_rate" and (t.get("method") or "logdiff") != "logdiff"):
            raise ValueError(f"{m['id']}: unsupported transform {kind}")
        over = overrides.get(key) or {}
        fiscal = over.get("period") == "us_fiscal_year"
        if fiscal and not (over.get("fiscal_year_start_month") and over.get("fiscal_year_start_day")):
            raise ValueError(f"{key}: fiscal year without start")
        number = lambda d, k: None if d.get(k) is None else float(d[k])
        rows.append((
            m["id"], m.get("family"), m.get("label"), m.get("units") or m.get("output_units"), f"{key}.{inputs['column']}" if inputs.get("table") else key, freq,
            "us_fiscal_year" if fiscal else None, over.get("fiscal_year_start_month") if fiscal else None, over.get("fiscal_year_start_day") if fiscal else None,
            kind, int(t["lag"]) if t.get("lag") else None, number(t, "scale"), number(t, "annualize_periods_per_year"), number(t, "threshold"),
            str(a.get("kind") or "mean"), number(a, "scale"), number(a, "post_scale"), number(a, "periods_per_year"), number(a, "from_value"), number(a, "to_value"),
        ))
    return spark.createDataFrame(rows, METRICS)
