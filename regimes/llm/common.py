"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_folder, shared_dir

#: A-Z and a-z, for lower-casing that leaves every other letter alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once all that is read from them has been written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, to be worked on in small batches where Python is needed."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column | str) -> Column:
    """The UTF-8 bytes of a text; of null, none."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand texts to Python in batches of ``rows``, unless the session already asks for fewer: that bounds a worker's memory.

    The session's setting stays so, as results are computed later than they are asked for. Batches of long texts end
    earlier, at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless set otherwise); a longer text is a batch.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


__all__ = ["ascii_lower", "discard", "new_folder", "partitions", "shared_dir", "small_batches", "table", "utf8", "written"]
