"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# SQL settings every job relies on; they can be set on a running session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A record has hundreds of nested fields; the default of 100 would switch
    # whole-stage code generation off for every stage that handles one.
    "spark.sql.codegen.maxFields": "5000",
    # Lists and timers per key need this state store.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "noticemill", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Rows of the largest input that one partition of a shuffle should stand for.
ROWS_PER_PARTITION = 25_000
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def prepare(spark: SparkSession, rows: int = 0) -> SparkSession:
    """Apply the SQL settings to a session somebody else created.

    rows: size of the largest input. Shuffles start with partitions in proportion, and adaptive execution merges small
    ones, so what a task holds does not grow with the input.
    """
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    wanted, usual = -(-rows // ROWS_PER_PARTITION), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > usual:
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))
    else:
        spark.conf.unset(INITIAL_PARTITIONS)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, named by the cluster in spark.checkpoint.dir.

    Only a local session without that setting (tests, a laptop) gets a temporary
    folder of its own; on a cluster a missing setting is an error, because a
    machine-local folder would lose data together with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-noticemill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
