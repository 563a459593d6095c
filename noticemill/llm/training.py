"""What the trained operators share: the rule for held-out rows and a bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from: crc32 of doc_id as text, modulo 3, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int) -> tuple[DataFrame, int]:
    """About `most` rows, chosen by a seeded hash of their key; all rows if there are no more than that.

    The share is set a little low, so that the bound holds but for chance. rows: small columns only, unique keys.
    Also returns the number of rows to expect.
    """
    count = rows.count()
    if count <= most:
        return rows, count
    limit = int((1 << 30) * (most / count) * 0.98)
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < limit), most
