"""SQL for attribution and term metrics: what the catalogue's queries are held against."""

from __future__ import annotations

from .inputs import daily_sql, periodic_sql, windows_sql

PERIODS = {
    "M": ("CAST(date_trunc('month', d) AS DATE)", "CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE)"),
    "Q": ("CAST(date_trunc('quarter', d) AS DATE)", "CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH AS DATE)"),
    "A": ("make_date(year(d), 1, 1)", "make_date(year(d) + 1, 1, 1)"),
    "FY": ("make_date(year(d) - 1, 10, 1)", "make_date(year(d), 10, 1)"),
}

SERIES = {
    "daily": daily_sql(), "daily_nulls": daily_sql(True), "monthly": periodic_sql("M"), "monthly_nulls": periodic_sql("M", True),
    "quarterly": periodic_sql("Q"), "yearly": periodic_sql("A"),
}


def transformed(series: str, kind: str = "identity", lag: int = 1, annualize: float = 1, scale: float = 100, threshold: float = 0) -> str:
    base = f"lag(v, {lag}) OVER (ORDER BY d)"
    v = {
        "identity": "v",
        "pct_change": f"CASE WHEN {base} <> 0 THEN {scale}::DOUBLE * (v / {base} - 1) END",
        "growth_rate": f"CASE WHEN v > 0 AND {base} > 0 THEN {scale}::DOUBLE * {annualize} * ln(v / {base}) END",
        "indicator_lt": f"CASE WHEN v IS NOT NULL THEN CASE WHEN v < {threshold} THEN 1.0::DOUBLE ELSE 0.0 END END",
    }[kind]
    return f"SELECT d, {v} AS v FROM ({SERIES[series]})"


def attributed(series_sql: str, freq: str, windows: str, tie: str = "period_end") -> str:
    """``d, v, wid``."""
    if freq == "D":
        return f'SELECT d, v, wid FROM ({series_sql}) JOIN ({windows}) ON d >= "start" AND d < "end"'
    ps, pe = PERIODS[freq]
    holder = f'(SELECT wid FROM ({windows}) h WHERE h."start" <= pe - 1 AND pe - 1 < h."end")' if tie == "period_end" else "last"
    return f"""SELECT d, v, wid FROM (SELECT d, any_value(v) AS v, CASE WHEN count(*) = 1 THEN any_value(last) ELSE any_value({'holder' if tie == 'period_end' else 'last'}) END AS wid FROM (
  SELECT d, v, {holder} AS holder, last FROM (
    SELECT d, v, pe, wid, days, max(days) OVER (PARTITION BY d) AS most, arg_max(wid, "start") OVER (PARTITION BY d, days) AS last FROM (
      SELECT d, v, pe, wid, "start", date_diff('day', greatest(ps, "start"), least(pe, "end")) AS days
      FROM (SELECT d, v, {ps} AS ps, {pe} AS pe FROM ({series_sql})) p JOIN ({windows}) w ON w."start" < pe AND w."end" > ps))
    WHERE days = most) GROUP BY d) WHERE wid IS NOT NULL"""


def metric(m: dict, windows: str | None = None) -> str:
    """One metric of the catalogue's registry for every window: ``metric_id, term_id, label, value, n_obs, error``."""
    windows = windows or windows_sql()
    kind, freq = m["agg_kind"], m.get("freq", "M")
    s = transformed(m["series_key"], m.get("transform", "identity"), m.get("lag") or 1, m.get("annualize") or 1, m.get("scale") or 100, m.get("threshold") or 0)
    scale, ppy, post = m.get("agg_scale") or 100, m.get("ppy") or 0, m.get("post_scale") or 1
    daily = freq == "D" and kind in ("end_minus_start", "end_minus_start_per_year", "pct_change_from_levels", "cagr_from_levels")
    edge = lambda what, at: f'(SELECT arg_max({what}, s.d) FROM s WHERE s.v IS NOT NULL AND s.d < w."{at}")'
    names = {"sv": "v", "sd": "d", "ev": "v", "ed": "d"}
    if daily:
        ends = ", ".join(f"{edge(names[n], 'start' if n[0] == 's' else 'end')} AS {n}" for n in names)
        both = "sv IS NOT NULL AND ev IS NOT NULL"
        ends = f"SELECT wid AS k, {ends} FROM w"
    else:
        pick = lambda n: f"{'arg_min' if n[0] == 's' else 'arg_max'}({names[n]}, d) FILTER (v IS NOT NULL) AS {n}"
        ends = f"SELECT wid AS k, {', '.join(map(pick, names))} FROM o GROUP BY wid"
        both = "sv IS NOT NULL AND ev IS NOT NULL"
    years = "(date_diff('day', sd, ed) / 365.25::DOUBLE)"
    no_ppy = [(f"{ppy} <= 0", "periods_per_year required")]
    empty, missing, two = [("n < 1", "empty window")], [(f"NOT ({both})", "missing boundary observation")], [("n < 2", "need at least 2 observations")]
    time = [(f"{years} <= 0", "non-positive elapsed time")]
    checks, value = {
        "mean": (empty, f"mean * {post}"), "last": (empty, "ev"),
        "end_minus_start": (missing, "ev - sv"), "pct_change_from_levels": (missing + [("sv = 0", "start value is 0")], f"{scale} * (ev / sv - 1)"),
        "end_minus_start_per_year": (missing + time, f"(ev - sv) / {years}"), "cagr_from_levels": (missing + time + [("sv <= 0 OR ev <= 0", "non-positive level for CAGR")], f"{scale} * (pow(ev / sv, 1 / {years}) - 1)"),
        "mean_times_periods_per_year": (no_ppy + empty, f"mean * {ppy}"), "compound_total": (empty, f"{scale} * (prod - 1)"), "compound_annualized": (no_ppy + empty, f"{scale} * (pow(prod, {ppy}::DOUBLE / n) - 1)"),
        "count_transitions": ([], "coalesce(turns, 0)::DOUBLE"), "annualized_std": (no_ppy + two, f"sdev * sqrt({ppy})"),
        "sharpe_ratio_annualized": (no_ppy + two + [("sdev = 0", "zero std")], f"mean * {ppy} / (sdev * sqrt({ppy}))"),
    }[kind]
    error = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in checks) + " ELSE '' END" if checks else "''"
    n_obs = {"last": "CASE WHEN n > 0 THEN 1 END"}.get(kind, "NULL" if kind.startswith(("end_", "pct_", "cagr_")) else "nullif(n, 0)")
    turn = f"abs(p - {m.get('from_value') or 0}) < 1e-9 AND abs(v - {m.get('to_value') if m.get('to_value') is not None else 1}) < 1e-9"
    return f"""(WITH w AS ({windows}), s AS ({s}), o AS ({attributed('SELECT * FROM s', m.get('period_kind') and 'FY' or freq, 'SELECT * FROM w')}),
a AS (SELECT wid AS k, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sdev, product(1 + v / {scale}::DOUBLE) AS prod, count(*) FILTER ({turn}) AS turns FROM (SELECT *, lag(v) OVER (PARTITION BY wid ORDER BY d) AS p FROM o) GROUP BY wid),
e AS ({ends}), r AS (SELECT wid, label, coalesce(n, 0) AS n, mean, sdev, prod, turns, sv, sd, ev, ed FROM w LEFT JOIN a ON w.wid = a.k LEFT JOIN e ON w.wid = e.k),
x AS (SELECT *, {error} AS error FROM r)
SELECT '{m['metric_id']}' AS metric_id, wid AS term_id, label AS party_abbrev, CASE WHEN error = '' THEN round(({value})::DOUBLE, 6) END AS value, CAST({n_obs} AS BIGINT) AS n_obs, error FROM x)"""
