"""Sharding by a two-pass external shuffle: seeded scatter into memory-sized buckets, Fisher-Yates within each bucket.

Law of a shard: `key`. The shard of a row is the one whose seeded hash of (shard, doc_id) is largest, so doc_id and the
number of shards decide, and one more shard takes rows only into itself. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticemill.llm.tables import stage

BUCKET_BYTES = 16 << 20
# The table of bucket sizes is broadcast; this bounds it to some 30 MB. Beyond 16 TB of text the buckets grow instead.
MOST_BUCKETS = 1 << 20
# Beyond so many buckets a shuffle partition holds several of them, one after the other.
MOST_PARTITIONS = 1 << 15


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """0-based number of the shard with the largest seeded hash of the key; null is a key like any other."""
    weights = F.array(*[F.xxhash64(F.lit(seed), F.lit(k), key) for k in range(shards)])
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def write_shards(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Shuffle whole records into shards, write them, and return the written records with their place.

    Takes doc_id and text; other columns are left behind. Returns doc_id, text, shard, bucket, place (position within
    the bucket) and slot (gapless position within the shard). Files hold (shard, bucket) sorted by place.

    The first pass deals rows to buckets by a seeded hash of doc_id and text, so a hot source or group of copies is
    spread, and a bucket has about `bucket_bytes` of text. The second pass gathers one bucket at a time, puts it into a
    defined order and applies the seeded shuffle() (Fisher-Yates). Every number follows from rows and seed: a task
    repeated after the loss of an executor gives the same result.
    Null text has no bytes and stays null; an empty table gives an empty result; repeated rows are kept, each with a
    slot of its own; a text larger than a bucket makes its bucket as large as itself.
    """
    records = docs.select("doc_id", "text")
    size = records.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    per_shard = max(1, math.ceil(min(size / bucket_bytes, MOST_BUCKETS) / shards))
    count = per_shard * shards
    scattered = records.withColumn("shard", shard_of(F.col("doc_id"), shards, seed)).withColumn(
        "bucket", (F.col("shard") * per_shard + F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(per_shard))).cast("int"))
    # Shuffle partitions of their own, which adaptive execution leaves as they are: shuffle() starts from the seed and
    # the partition number, so both stay fixed.
    gathered = scattered.repartition(min(count, MOST_PARTITIONS), "bucket").groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct(
            F.xxhash64(F.lit(seed + 2), "doc_id", "text").alias("rank"), "doc_id", "text"))).alias("rows"))
    mixed = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    written, _ = stage(mixed.select("bucket", F.posexplode("rows").alias("place", "row")).select(
        "row.doc_id", "row.text", F.floor(F.col("bucket") / per_shard).cast("int").alias("shard"), "bucket", "place"), "shards")
    sizes = written.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return written.join(F.broadcast(starts), "bucket").select(
        "doc_id", "text", "shard", "bucket", "place", (F.col("start") + F.col("place")).alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Digest of every written record: size, checksum, shard, slot, and the shard with one more shard."""
    return write_shards(docs, shards, seed, bucket_bytes).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
        "bucket",
    )
