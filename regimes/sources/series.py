"""Long series from CSV, JSON and text files. Files are read by Spark; each reader keeps the order of rows in ``pos``."""

from __future__ import annotations

import csv
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_date, parse_number
from .documents import read_elements


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    if first is None or not first[0].strip():
        raise ValueError(f"no header: {path}")
    return [c.strip() for c in next(csv.reader([first[0].removeprefix("\ufeff")]))]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with all columns as texts, named by its header, and ``pos``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _header(spark, path)])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True).withColumn("pos", F.monotonically_increasing_id())


def read_series(spark: SparkSession, path: str, key: str, date_col: str = "date", value_col: str = "value") -> DataFrame:
    """A CSV file of dates and values as a long series. Rows without date are left out; missing tokens are null."""
    t = read_table(spark, path)
    return t.where(F.trim(F.coalesce(F.col(date_col), F.lit(""))) != "").select(F.lit(key).alias("series_key"), "pos", parse_date(F.col(date_col)).alias("d"), parse_number(F.col(value_col)).alias("v"))


def read_wide(spark: SparkSession, path: str, key: str, date_col: str = "date") -> DataFrame:
    """A CSV file with a column for each series as one long table: ``key.column`` names each."""
    t = read_table(spark, path)
    names = [c for c in t.columns if c not in (date_col, "pos")]
    long = t.where(F.trim(F.coalesce(F.col(date_col), F.lit(""))) != "").unpivot(["pos", date_col], names, "name", "text")
    return long.select(F.concat(F.lit(f"{key}."), "name").alias("series_key"), "pos", parse_date(F.col(date_col)).alias("d"), parse_number(F.col("text")).alias("v"))


def read_dated_csv(spark: SparkSession, path: str, key: str, date_col: str, value_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A published CSV file: both columns must be there, blank rows are left out, both date limits are inclusive.

    A value that isn't a number stops the job, and so does an empty result.
    """
    missing = [c for c in (date_col, value_col) if c not in _header(spark, path)]
    if missing:
        raise ValueError(f"missing CSV columns: {missing}")
    t = read_table(spark, path).where((F.trim(F.coalesce(F.col(date_col), F.lit(""))) != "") & (F.trim(F.coalesce(F.col(value_col), F.lit(""))) != ""))
    out = t.select(F.lit(key).alias("series_key"), "pos", parse_date(F.col(date_col)).alias("d"), F.trim(value_col).cast("double").alias("v"))
    if start:
        out = out.where(F.col("d") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("d") <= F.lit(end).cast("date"))
    if out.isEmpty():
        raise ValueError(f"no rows: {path}")
    return out


def read_graph_csv(spark: SparkSession, path: str, key: str, series_id: str, api_params: dict | None = None) -> DataFrame:
    """The published CSV file of one series, with columns ``DATE`` and the series' own name.

    It is the series as published: one that is asked for with ``api_params`` (a frequency, a resampling) is refused, as
    the file would hold other values.
    """
    if api_params:
        raise ValueError(f"{key}: the published file can't answer parameters: {sorted(api_params)}")
    missing = [c for c in ("DATE", series_id) if c not in _header(spark, path)]
    if missing:
        raise ValueError(f"missing CSV columns: {missing}")
    return read_series(spark, path, key, "DATE", series_id)


def read_observations_json(spark: SparkSession, path: str, key: str, start: str | None = None, end: str | None = None, lines: bool = False, **options) -> DataFrame:
    """Observations documents (``{"observations": [{"date", "value", "realtime_start", "realtime_end"}]}``) as a long series with ``rt_start, rt_end``.

    A file is one document, or has one in each line (``lines``). Both date limits are inclusive and reach the tasks that read.
    """
    names = ["date", "value", "realtime_start", "realtime_end"]
    rows = read_elements(spark, path, "observations", {n: n for n in names}, lines, strip=True, **options)
    if start:
        rows = rows.where(F.col("date") >= start)
    if end:
        # Times of the last day follow it as texts.
        rows = rows.where(F.col("date") < (date.fromisoformat(end) + timedelta(days=1)).isoformat())
    return rows.select(F.lit(key).alias("series_key"), "pos", parse_date(F.col("date")).alias("d"), parse_number(F.col("value")).alias("v"), parse_date(F.col("realtime_start")).alias("rt_start"), parse_date(F.col("realtime_end")).alias("rt_end"))


def read_series_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Metadata documents (``{"seriess": [{...}]}``): ``series_id, title, frequency, units, seasonal_adjustment``, one row for each series."""
    names = {"series_id": "id", "title": "title", "frequency": "frequency_short", "units": "units", "seasonal_adjustment": "seasonal_adjustment_short"}
    return read_elements(spark, path, "seriess", names, lines, strip=True).drop("pos")


def read_factor_text(spark: SparkSession, path: str, key: str, names: list[str], missing: tuple[str, ...] = ("-99.99", "-999")) -> DataFrame:
    """The first table of a text file with a preamble: from the first line that starts with six digits to the next blank one.

    ``YYYYMM`` is the first of that month; rows with too few values are left out; sentinels are missing.
    """
    return factor_lines(spark.read.text(path, wholetext=True), key, names, missing)


def read_zip_factor(spark: SparkSession, path: str, key: str, names: list[str], inner: str = r"(?i)\.csv$", encoding: str = "latin-1", **options) -> DataFrame:
    """As :func:`read_factor_text`, of the first file in a zip archive whose name matches ``inner``."""
    import re
    import zipfile
    from io import BytesIO

    import pandas as pd

    def unpack(batches):
        for batch in batches:
            texts = []
            for data in batch["content"]:
                with zipfile.ZipFile(BytesIO(data)) as z:
                    texts.append(z.read(next(n for n in sorted(z.namelist()) if re.search(inner, n))).decode(encoding))
            yield pd.DataFrame({"value": texts})

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")
    return factor_lines(text, key, names, **options)


def factor_lines(text: DataFrame, key: str, names: list[str], missing: tuple[str, ...] = ("-99.99", "-999")) -> DataFrame:
    """:func:`read_factor_text` for texts that were read already (column ``value``)."""
    lines = F.transform(F.split(F.replace(F.col("value"), F.lit("\r"), F.lit("")), "\n", -1), lambda x: F.trim(x))
    t = text.select(lines.alias("l")).withColumn("s", F.expr("array_position(transform(l, x -> x rlike '^[0-9]{6}([^0-9]|$)'), true)").cast("int"))
    t = t.where("s > 0").withColumn("l", F.expr("slice(l, s, size(l))"))
    stop = F.array_position("l", "").cast("int")
    t = t.select(F.posexplode(F.when(stop > 0, F.slice("l", 1, stop - 1)).otherwise(F.col("l"))).alias("pos", "line"))
    cells = t.select("pos", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("c")).where(F.size("c") > len(names))
    month = F.try_to_timestamp(F.concat(F.col("c")[0], F.lit("01")), F.lit("yyyyMMdd")).cast("date")
    wide = cells.select("pos", month.alias("d"), *[F.col("c")[i + 1].alias(n) for i, n in enumerate(names)]).where("d IS NOT NULL")
    number = F.when(~F.col("text").isin(*missing), parse_number(F.col("text")))
    return wide.unpivot(["pos", "d"], names, "name", "text").select(F.concat(F.lit(f"{key}."), "name").alias("series_key"), F.col("pos").cast("long").alias("pos"), "d", number.alias("v"))
