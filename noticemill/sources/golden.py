"""The golden (reference) table: loader, uniqueness audit and lookup form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.text import IDENTIFIER_NORMALIZERS, strip

UNIQUE_IDENTIFIERS = ["isin", "cnpj", "ticker"]


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden CSV -> seven trimmed, renamed columns; bad files raise ValueError."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    # A byte-order mark sticks to the first header cell.
    raw = raw.toDF(*[name.replace("﻿", "") for name in raw.columns])
    missing = sorted(set(vocab.GOLDEN_CSV_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError("golden records missing columns: " + ", ".join(missing))
    golden = raw.select(
        *[strip(F.coalesce(F.col(src), F.lit(""))).alias(dst) for src, dst in vocab.GOLDEN_CSV_COLUMNS.items()]
    )
    if golden.isEmpty():
        raise ValueError("golden records file is empty")
    check_golden(golden)
    return golden


def golden_duplicates(golden: DataFrame) -> DataFrame:
    """(field, normalized, n) for every identifier value used by several rows."""
    pairs = [
        F.struct(F.lit(field).alias("field"), IDENTIFIER_NORMALIZERS[field](F.col(field)).alias("normalized"))
        for field in UNIQUE_IDENTIFIERS
    ]
    return (
        golden.select(F.inline(F.array(*pairs)))
        .where("normalized is not null")
        .groupBy("field", "normalized")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def check_golden(golden: DataFrame) -> DataFrame:
    duplicate = golden_duplicates(golden).orderBy("field", "normalized").limit(1).collect()
    if duplicate:
        row = duplicate[0]
        raise ValueError(f"duplicate {row.field} in golden records: {row.normalized}")
    return golden
