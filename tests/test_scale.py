from noticemill.functions.scale import spread
from noticemill.session import ROWS_PER_PARTITION, prepare

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_many_short_rows_in_few_splits_are_dealt_by_rows(spark, tmp_path):
    rows = 12 * ROWS_PER_PARTITION
    path = str(tmp_path / "short")
    spark.range(rows).repartition(9).write.parquet(path)
    # A partition per core would hold more rows than a task should make records of.
    table = spark.read.parquet(path)
    assert spark.sparkContext.defaultParallelism < 12
    sizes = spread(table).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == rows and max(sizes) <= 1.1 * ROWS_PER_PARTITION
    assert spread(table, rows).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, table.rdd.getNumPartitions())


def test_shuffles_start_with_partitions_by_rows(spark):
    prepare(spark, 100 * ROWS_PER_PARTITION)
    assert spark.conf.get(INITIAL) == "100"
    prepare(spark, ROWS_PER_PARTITION)
    assert spark.conf.get(INITIAL, None) is None
