"""Evidence grounding: a source counts only if its page really says so.

Page text is normalised once per page before the join, and evidence meets its
page by an equi join on (document, page); no page is compared with evidence
that does not cite it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.sqltext import in_list
from noticemill.functions.text import normalize_text, strip

GROUNDED = "struct<page:int,evidence:string,extraction_method:string>"


def _cited(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """sources (document_id, page, evidence, ...) + method when grounded."""
    readable = pages.select(
        "document_id",
        F.col("page_number").alias("page"),
        normalize_text(F.col("text")).alias("_page_text"),
        F.col("extraction_method").alias("_method"),
    )
    keyed = sources.withColumn("_evidence", normalize_text(F.col("evidence")))
    joined = keyed.join(readable, ["document_id", "page"], "left")
    found = F.col("_page_text").contains(F.col("_evidence"))
    return joined.withColumn("extraction_method", F.when(found, F.col("_method"))).drop(
        "_evidence", "_page_text", "_method"
    )


def ground(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, path, value, status, origin, sources) with surviving sources.

    ``fields`` is the long form with sources array<struct<page, evidence>>.
    A field whose sources all fail becomes AMBIGUOUS.
    """
    sources = fields.select("document_id", "path", F.posexplode("sources").alias("pos", "s")).select(
        "document_id", "path", "pos", F.col("s.page").alias("page"), F.col("s.evidence").alias("evidence")
    )
    checked = _cited(sources, pages).groupBy("document_id", "path").agg(
        F.expr("count_if(extraction_method is null)").alias("_bad"),
        F.collect_list(
            F.when(
                F.col("extraction_method").isNotNull(),
                F.struct("pos", "page", strip(F.col("evidence")).alias("evidence"), "extraction_method"),
            )
        ).alias("_good"),
    )
    joined = fields.drop("sources").join(checked, ["document_id", "path"], "left")
    status = "if(_bad > 0 and size(_good) = 0, 'AMBIGUOUS', status)"
    good = "transform(array_sort(_good), g -> named_struct('page', g.page, 'evidence', g.evidence, 'extraction_method', g.extraction_method))"
    return (
        joined.withColumn("status", F.expr(status))
        .withColumn(
            "origin", F.expr(f"if(status in {in_list(vocab.DOCUMENT_STATUSES)}, 'DOCUMENT', 'UNKNOWN')")
        )
        .withColumn("sources", F.expr(f"coalesce({good}, array())").cast(f"array<{GROUNDED}>"))
        .select("document_id", "path", "value", "status", "origin", "sources")
    )


def ground_signals(signals: DataFrame, pages: DataFrame) -> DataFrame:
    """Signals (document_id, ..., page, evidence) whose evidence is on the page."""
    return _cited(signals, pages).where("extraction_method is not null")


def ground_conflicts(conflicts: DataFrame, pages: DataFrame) -> DataFrame:
    """Conflicts keep their grounded signals; one with fewer than two is dropped.

    ``conflicts``: (document_id, conflict_no, description, signal_no, supports,
    rationale, page, evidence), one row per signal.
    """
    kept = ground_signals(conflicts, pages)
    return kept.groupBy("document_id", "conflict_no", "description").agg(
        F.count(F.lit(1)).alias("signals"),
        F.array_sort(
            F.collect_list(F.struct("signal_no", "supports", "rationale", "page", "evidence", "extraction_method"))
        ).alias("signal_list"),
    ).where("signals >= 2")


def widen(fields: DataFrame) -> DataFrame:
    """Long grounded fields -> one record per document with a struct per field."""
    struct = "struct(value, status, origin, sources)"
    empty = (
        "named_struct('value', cast(null as string), 'status', 'UNKNOWN', 'origin', 'UNKNOWN', "
        f"'sources', cast(array() as array<{GROUNDED}>))"
    )
    grouped = fields.groupBy("document_id").agg(
        *[F.expr(f"any_value({struct}) filter (where path = '{path}')").alias(name) for name, path in vocab.FIELDS]
    )
    return grouped.select("document_id", *[F.expr(f"coalesce({n}, {empty})").alias(n) for n, _ in vocab.FIELDS])
