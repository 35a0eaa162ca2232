"""A corpus pipeline over ``documents``: language, near duplicates, benchmark passages, mix, shards.

``STAGES`` lists its stages. Each takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and
returns rows with the columns of ``documents`` (the last one adds the shard and the slot); what it returns is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimes.llm import decontaminate, language_id, mixing, near_dup, queries, sharding
from regimes.llm.common import new_folder, small_batches, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are like no learned language go, among them those without any letter; a missing ``lang`` is filled in.

    Null and empty texts have no letter. Repeated rows are judged alike, rows with a null id are rows like others;
    null sources stay null. Texts too short to tell stay.
    """
    small_batches(spark)
    model = language_id.fit(docs, learn=~language_id.held_out(F.col("doc_id")))
    found = docs.withColumn("_found", language_id.predict(model, F.col("text")))
    kept = found.where(~language_id.unlike(model, F.col("_found")))
    return kept.select(*[F.when(F.col("_found.lang") == language_id.UNKNOWN, F.col("lang")).otherwise(F.coalesce("lang", "_found.lang")).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest id, or, in a group without ids, with the smallest hash of its text.

    Rows of one id and one text are one document, and one of them stays. Texts without words are no duplicates of
    anything and all stay.
    """
    small_batches(spark)
    return near_dup.representatives(docs, k=5, per_cent=75)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document of which no word is left goes.

    Documents without a hit stay as they are, those without text among them. Repeated rows are cut alike.
    """
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), window=10, rest=True)
    hit = F.size("_found.spans") > 0
    left = F.aggregate("_found.spans", F.col("_found.n_words"), lambda n, s: n - s["end"] + s["start"])
    rest = found.where(~hit | (left > 0)).withColumn("_cut", F.when(hit, F.col("_found.rest")).otherwise(F.col("text")))
    changed = {"text": F.col("_cut"), "n_chars": F.when(hit, F.char_length("_cut").cast("long")).otherwise(F.col("n_chars"))}
    return rest.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken so that the domains have the shares of tokens that the target weights give them.

    The budget is the largest with which every domain holds its share if its documents are taken up to twice; a
    language or source that falls short inside a domain is made up for by its siblings. A document that is taken in
    two epochs is two rows. The document in which a leaf's token prefix ends stays whole, so that shares are met but
    for one document a leaf. Documents without tokens take no room and come with their leaf's whole epochs or prefix.
    Null languages and sources are leaves of their own; rows with a null id are known by their text; repeated rows
    are taken alike.
    """
    levels = {"domain": queries.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    taken = mixing.mix(docs, levels, queries.WEIGHTS, share=None, max_epochs=2)
    # Rows of one key are taken once for each epoch in which it is, however many of them the key stands for.
    taken = written(taken.select(F.col("key").alias("_key"), "epoch").distinct(), "taken")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mixing.row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    return keyed.join(taken, "_key").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in random order in 40 shards whose counts are at most one apart; repeated rows and nulls are rows like others."""
    out = sharding.shuffled(docs, shards=40)
    return out.select(*docs.columns, F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage's vectors can't be had in SQL; the tests hold each stage against a plain Python version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
