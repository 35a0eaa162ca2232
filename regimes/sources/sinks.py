"""Writers: tables as CSV, windows, and the export document."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import fixed_text
from ..operators.reports import markdown
from .artefacts import write_atomic
from .single_file import write_lines

QUOTE = '"'


def fixed6(v: Column) -> Column:
    """Six decimals as text, rounded from the exact binary value; missing and infinite values are blank."""
    return fixed_text(v, 6)


def _cells(df: DataFrame) -> list[Column]:
    return [fixed6(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """``df`` as a folder of CSV files with a header, numbers with six decimals; Spark's committer makes them appear at once."""
    out = df.orderBy(*order) if order else df
    out.select(*_cells(df)).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def write_csv_file(df: DataFrame, path: str, order: list[str], overwrite: bool = True) -> None:
    """``df`` as one CSV file with a header, numbers with six decimals, rows in the order of ``order``; it appears whole or not at all."""
    line = F.to_csv(F.struct(*_cells(df)), {"emptyValue": "", "nullValue": "", "escape": '"'})
    keys = {f"_k{i}": F.col(f"`{c}`") for i, c in enumerate(order)}
    rows = df.select(*[v.alias(k) for k, v in keys.items()], line.alias("_line"))
    names = ",".join(f'"{c.replace(QUOTE, QUOTE * 2)}"' if any(x in c for x in (",", QUOTE)) else c for c in df.columns)
    write_lines(rows, "_line", path, list(keys), names, overwrite)


def write_terms(terms: DataFrame, path: str) -> None:
    """Windows by start; commas in names become spaces, so that nothing is quoted."""
    plain = [F.translate(c, ",", " ").alias(c) if t == "string" else F.col(c) for c, t in terms.dtypes]
    terms.select(*plain).orderBy("term_start").write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_markdown(board: DataFrame, path: str | Path) -> None:
    write_atomic(path, ("\n".join(markdown(board)) + "\n").encode())


def write_site(entries: DataFrame, path: str | Path, updated: str) -> None:
    """The export document: entries by q, missing last. One entry for each metric reaches the driver."""
    rows = entries.orderBy(F.col("q").asc_nulls_last(), "metric_id").select("payload").collect()
    write_atomic(path, json.dumps({"updated": updated, "metrics": [json.loads(r[0]) for r in rows]}, sort_keys=True).encode())
