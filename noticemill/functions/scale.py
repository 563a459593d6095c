"""Skew-safe building blocks shared by the operators.

A key may own a third of all rows, so nothing here puts one key's rows into a
single task: lookups spread the large side over salts, and running totals work
on bounded blocks of the order column plus a small per-block carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticemill.session import ROWS_PER_PARTITION

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
# Frequent keys a sketch tells apart at most, and rows below which no key is worth salting.
MOST_HOT = 1000
HOT_ROWS = 10_000


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure the text size of a table; one aggregate over a dimension."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 24 for c in df.columns), F.lit(0))
    total = df.agg(F.sum(size.cast("long")).alias("b")).first()["b"]
    return (total or 0) <= limit


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join where many fact rows share a key: facts are salted by ``spread``
    (columns that vary within a key) and each dim row is repeated per salt.
    By default the salts follow the shuffle partitions, an eighth of them: a
    key with a third of the rows is then spread over tasks in that proportion."""
    if salts is None:
        salts = max(SALTS, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_facts.join(salted_dim, on + ["_salt"], how).drop("_salt")


def hot_keys(facts: DataFrame, on: list[str], parts: int | None = None) -> list[int]:
    """Hashes of the keys that hold more than a quarter of a shuffle partition's share of the rows.

    A top-k sketch merged map-side; at most four times as many keys as there are partitions can be that frequent, so
    the list is bounded.  The sketch may overstate a count: a key salted without need costs a few copies of one row.
    """
    if parts is None:
        parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(4 * parts, MOST_HOT)
    hashed = facts.where(" and ".join(f"{c} is not null" for c in on)).select(F.xxhash64(*on).alias("_h"))
    found = hashed.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {most}, {10 * most})").alias("top")).first()
    return [item["item"] for item in found["top"] or [] if item["count"] * most > found["n"] and item["count"] > HOT_ROWS]


def hot_join(
    facts: DataFrame, dim: DataFrame, on: list[str], spread: list[str], how: str = "left", hot: list[int] | None = None,
) -> DataFrame:
    """Join where a few keys hold very many fact rows: only rows of the hot keys are salted, and only the dim rows of
    these keys are repeated.  All other rows of ``dim`` are shuffled once.  facts should be cheap to read twice."""
    if hot is None:
        hot = hot_keys(facts, on)
    if not hot:
        return facts.join(dim, on, how)
    salts = max(SALTS, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    is_hot = F.xxhash64(*on).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_dim = dim.withColumn("_salt", F.explode(copies))
    return facts.withColumn("_salt", salt).join(salted_dim, on + ["_salt"], how).drop("_salt")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread: list[str],
    small: bool,
    how: str = "left",
) -> DataFrame:
    """``small`` is the outcome of :func:`fits_broadcast` for the dimension."""
    if small:
        return facts.join(F.broadcast(dim), on, how)
    return salted_join(facts, dim, on, spread, how)


def block_of(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    value: Column,
    name: str,
    exclusive: bool = False,
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``, without one task per key.

    ``block`` must be non-decreasing in ``order`` and bound the rows of one key
    that share it.  Totals per (key, block) are pre-aggregated, carried forward
    over the few blocks of a key, and added to the running sum inside a block.
    """
    rows = df.withColumn("_block", block)
    totals = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    last = -1 if exclusive else 0
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(carry, keys + ["_block"], "inner")
    return joined.withColumn(name, F.col("_local") + F.col("_carry")).drop("_local", "_carry", "_block")


def spread(df: DataFrame, rows: int = ROWS_PER_PARTITION) -> DataFrame:
    """Give a scan at least one partition per core, and one per ``rows`` rows, before work that makes rows large.

    A short row can become a record of kilobytes, and a file's row groups bound how far a scan splits: a table is dealt
    out anew if it has fewer splits than that. A table whose splits are as many is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // rows))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
