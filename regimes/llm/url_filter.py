"""Block and allow rules over URLs, looked up by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Hex digits of the SHA-256 digest that serve as join key; the whole digest is confirmed after the join.
SHORT = 8
#: Places in which a rule is looked up, as very many URLs may ask for one.
SALTS = 16


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def _folder(path: Column) -> Column:
    """A path up to its last slash, with it; empty if there is none."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _slashes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with the columns ``host, path, rule, verdict`` added (columns of those names are replaced).

    ``rules`` has ``host, path, action``. A rule fits its host and all subdomains where the URL's path starts
    with the rule's. The rule with the longest ``host + path`` wins; of equally long ones ``block`` wins, then
    the smaller text. URLs that no rule fits get ``default``.

    Null URLs and URLs without ``://`` have an empty host and path and fit no rule. Rules with a null or empty
    host fit nothing, and repeated rules count once. Repeated pages are each judged. Hosts and paths are
    expanded only as deep as some rule goes, so that long URLs stay cheap.
    """
    r = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("action").alias("r_action"))
    r = r.where(F.coalesce(F.length("r_host"), F.lit(0)) > 0).distinct()
    # A rule is looked up by its host and the folder part of its path; what follows the last slash is confirmed later.
    r = r.withColumn("r_key", F.concat("r_host", _folder(F.col("r_path"))))
    deepest = r.agg(F.max(_labels(F.col("r_host"))), F.max(_slashes(F.col("r_path")))).first()
    labels, depth = deepest[0] or 0, deepest[1] or 0
    r = r.select("*", F.sha2(F.col("r_key").cast("binary"), 256).alias("r_digest"))
    r = r.withColumn("short", F.substring("r_digest", 1, SHORT))

    cols = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*[F.col(f"`{c}`") for c in cols], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))

    # Each distinct host and path is looked up once: pages of a hot site don't meet in one task. Hosts that can't
    # match (empty ones) take no part at all.
    seen = judged.select("host", "path").where("host <> ''").distinct()
    parts = F.split("host", r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - (labels - 1)), n), lambda i: F.concat_ws(".", F.slice(parts, i, n)))
    # The first folders of the path: its start up to the first slash, the second, and so on; and the empty one.
    steps = F.split(F.regexp_extract("path", r"(?s)^(?:[^/]*/){0,%d}" % depth, 0), "/", -1)
    folders = F.concat(F.array(F.lit("")), F.transform(F.slice(steps, 1, F.size(steps) - 1), lambda _, i: F.concat(F.array_join(F.slice(steps, 1, i + 1), "/"), F.lit("/"))))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(folders, lambda p: F.concat(h, p))))
    asked = seen.select("host", "path", F.explode(keys).alias("key"))
    asked = asked.select("host", "path", F.sha2(F.col("key").cast("binary"), 256).alias("digest"), F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    asked = asked.withColumn("short", F.substring("digest", 1, SHORT))
    # A rule that very many URLs ask for (a top-level domain's) is laid out once for each salt.
    laid = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = asked.join(laid, ["short", "salt"]).where("digest = r_digest AND startswith(path, r_path)")
    name = F.concat("r_host", "r_path")
    best = F.min_by(F.struct(name.alias("rule"), F.col("r_action").alias("action")), F.struct(F.negate(F.length(name)), (F.col("r_action") != "block").cast("int"), name, "r_action"))
    won = fits.groupBy("host", "path").agg(best.alias("won"))
    # URLs without host skip the join. What won is written first, so that both sides are dealt anew for the join and
    # Spark can split the pages of one very common URL over many tasks.
    won = written(won, "won").hint("merge")  # grows with the URLs, so it isn't broadcast at any size
    rest = judged.where("host = ''").withColumn("won", F.lit(None).cast(won.schema["won"].dataType))
    out = judged.where("host <> ''").join(won, ["host", "path"], "left").select(*judged.columns, "won").unionByName(rest)
    return out.select(*[F.col(f"`{c}`") for c in cols], "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))
