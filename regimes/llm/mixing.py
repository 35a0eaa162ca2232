"""Mixing sources to target weights: budgets down a domain-language-source tree, and seeded token prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a leaf that one task puts in order at most, about.
BUCKET_ROWS = 1000
SALTS = 16
NONE = "(none)"
#: Orders are whole numbers below this.
_SPAN = 1 << 60


def word_count(text: Column) -> Column:
    """Tokens of a text, counted as runs of characters that aren't white space; of null, none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _order(seed: int, epoch: Column, key: Column) -> Column:
    """A row's place in an epoch: 60 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key).cast("binary")), 1, 15), 16, 10).cast("long")


def allocate(leaves: DataFrame, levels: list[str], budget: int) -> DataFrame:
    """Add ``budget`` to ``leaves`` (a column for each level, ``w_<level>`` with its weight, and ``capacity``).

    From the root down, a node's budget is shared out among its children by weight. A child whose whole subtree
    holds less gets what it holds, and the rest goes to its siblings by weight; as capacities are those of whole
    subtrees, a shortage reaches other branches only after everything beneath the nearest ancestor is used. Children
    of weight 0 get nothing. The shares come from running sums over each node's children, sorted by capacity over
    weight: no loop over nodes.
    """
    given = None
    for d, level in enumerate(levels):
        path, above = levels[: d + 1], levels[:d]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").cast("double").alias("c"), F.max(f"w_{level}").cast("double").alias("w"))
        nodes = nodes.join(given, above) if above else nodes.withColumn("b", F.lit(float(budget)))
        parent = Window.partitionBy(*[F.col(c) for c in above] or [F.lit(1)])
        by = parent.orderBy(F.when(F.col("w") > 0, F.col("c") / F.col("w")).asc_nulls_last(), level)
        before = F.coalesce(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        full = (F.col("w") > 0) & (before + F.col("c") * left / F.nullif("w", F.lit(0.0)) <= F.col("b"))
        nodes = nodes.withColumn("full", F.coalesce(full, F.lit(False)))
        used, open_w = F.sum(F.when(F.col("full"), F.col("c")).otherwise(0.0)).over(parent), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(parent)
        share = F.when(F.col("full"), F.col("c")).when(F.col("w") > 0, F.greatest(F.col("b") - used, F.lit(0.0)) * F.col("w") / F.nullif(open_w, F.lit(0.0))).otherwise(0.0)
        given = nodes.select(*path, share.alias("b"))
    return leaves.join(given.select(*levels, F.floor(F.col("b") + 1e-6).cast("long").alias("budget")), levels)


def largest_met(leaves: DataFrame, level: str) -> int:
    """The largest budget of which every value of ``level`` holds its share by weight."""
    held = leaves.groupBy(level).agg(F.sum("capacity").alias("c"), F.max(f"w_{level}").alias("w")).where("w > 0")
    all_w = held.agg(F.sum("w")).first()[0]
    return int(held.agg(F.min(F.col("c") * F.lit(float(all_w)) / F.col("w"))).first()[0]) if all_w else 0


def weight_of(column: Column, weights: dict[str, float], default: float) -> Column:
    """The weight of each value; values that aren't named get ``default``."""
    if not weights:
        return F.lit(float(default))
    named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(named, column), F.lit(float(default)))


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row is known by: its id, or a digest of its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], share: float | None = 0.9, max_epochs: int = 2, seed: int = 13, default_weight: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows to train on: ``key, doc_id, <levels>, epoch, tokens, taken``, one for each row and epoch taken.

    ``levels`` names the tree's levels from the root, each with the column that gives it; ``weights`` has the
    weights of the values at each level. The whole budget is ``share`` of all tokens; with None it is the largest with
    which the targets at the top level are met, none of its values running short (those of weight 0 aside). A leaf can give each of its
    tokens ``max_epochs`` times; its budget is met by whole epochs and by the prefix of one more, in an order that
    seed and epoch decide. The row that the prefix ends in is taken in part: ``taken`` of its ``tokens``.

    Large leaves are ordered by parts: sums over ranges of the order come first, so that only the rows of the one
    range in which a prefix ends are sorted together. Null values of a level are the value ``(none)``. Rows
    without tokens take no room, and are taken in whole epochs and within the prefix. Repeated rows count each.
    Rows with a null id are ordered by their text. An empty table gives no rows.
    """
    names = list(levels)
    body = F.col(f"`{text}`").cast("string")
    key = row_key(F.col(f"`{doc_id}`"), body)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()], word_count(body).alias("tokens"))
    # Texts are read and counted once; all else works on this narrow table.
    rows = written(rows, "tokens")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("rows"))
    total = leaves.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    leaves = leaves.withColumn("capacity", F.col("held") * max_epochs)
    for n in names:
        leaves = leaves.withColumn(f"w_{n}", weight_of(F.col(n), weights.get(n, {}), default_weight))
    plan = allocate(leaves, names, int(total * share) if share is not None else largest_met(leaves, names[0]))
    whole = F.when(F.col("held") > 0, F.expr("budget div held")).otherwise(0)
    plan = plan.select(*names, whole.cast("int").alias("whole"), F.when(F.col("held") > 0, F.expr("budget % held")).otherwise(0).alias("rest"), F.ceil(F.col("rows") / BUCKET_ROWS).cast("long").alias("ranges"))

    # Leaves are few beside rows, but their number isn't bounded: Spark broadcasts the plan only if it is small, and
    # else deals rows by leaf and salt, so that a hot leaf's rows don't meet in one task.
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    planned = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, [*names, "salt"]).drop("salt")
    complete = planned.where("whole > 0").select("key", "doc_id", *names, "tokens", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch")).withColumn("taken", F.col("tokens"))
    partial = planned.where("rest > 0").withColumn("at", _order(seed, F.col("whole"), F.col("key")))
    partial = partial.withColumn("range", F.expr(f"at div ({_SPAN}L div ranges)"))
    sums = partial.groupBy(*names, "range").agg(F.sum("tokens").alias("n"), F.max("rest").alias("rest"))
    running = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).where("before < rest").select(*names, "range", "before", (F.col("before") + F.col("n") > F.col("rest")).alias("cut"))
    near = partial.join(ends, [*names, "range"])
    inside = near.where("NOT cut").withColumn("taken", F.col("tokens"))
    within = Window.partitionBy(*names).orderBy("at", "key", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = near.where("cut").withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).where("before < rest")
    edge = edge.withColumn("taken", F.least("tokens", F.col("rest") - F.col("before")))
    cols = ["key", "doc_id", *names, F.col("whole").alias("epoch"), "tokens", "taken"]
    return complete.select("key", "doc_id", *names, "epoch", "tokens", "taken").unionByName(inside.select(*cols)).unionByName(edge.select(*cols))
