"""Page table: one row per document page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.functions.text import strip, without_spaces

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("document_id", T.StringType(), False),
        T.StructField("page_number", T.IntegerType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("native_text_length", T.IntegerType()),
        T.StructField("ocr_applied", T.BooleanType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages of a columnar or JSON table, text stripped, numbered from 1."""
    raw = spark.read.format(fmt).schema(PAGE_SCHEMA).load(path)
    return raw.where("page_number >= 1").withColumn("text", strip(F.coalesce("text", F.lit(""))))


def as_pages(df: DataFrame, document_id: str, page_number: str, text: str) -> DataFrame:
    """Give any (document, page, text) table the page layout, as native text."""
    clean = strip(F.coalesce(F.col(text), F.lit("")))
    return df.select(
        F.col(document_id).cast("string").alias("document_id"),
        F.col(page_number).cast("int").alias("page_number"),
        clean.alias("text"),
        F.lit("NATIVE_TEXT").alias("extraction_method"),
        F.length(without_spaces(clean)).alias("native_text_length"),
        F.lit(False).alias("ocr_applied"),
        F.array().cast("array<string>").alias("warnings"),
    )
