"""Versioned raw documents. Fetching them is no query work and is left out."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_atomic(path: str | Path, data: bytes) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".tmp")
    part.write_bytes(data)
    os.replace(part, path)


def latest(files: DataFrame, path: str = "path") -> DataFrame:
    """``folder, path``: of each folder's documents (side files left out) the last by name."""
    name, folder = F.element_at(F.split(path, "/"), -1), F.regexp_replace(path, "/[^/]*$", "")
    return files.where(~F.endswith(path, F.lit(".meta.json"))).groupBy(folder.alias("folder")).agg(F.max_by(path, name).alias("path"))
