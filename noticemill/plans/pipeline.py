"""End-to-end notice processing, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.operators import confidence, consensus, extraction, fuzzy, grounding, pages as page_ops, reconciliation, routing, rules


def pattern_records(pages: DataFrame) -> DataFrame:
    """Records from page text alone, with their single extraction attempt."""
    records = extraction.extract_notice(pages).withColumn("_missing", F.expr(consensus.unresolved_of_record()))
    return records.withColumns(
        {
            "extraction_attempts": F.expr(consensus.pattern_attempt("_missing")),
            "preliminary_checks": F.expr(f"cast(array() as array<{consensus.CHECK}>)"),
        }
    ).drop("_missing")


def pass_records(
    passes: DataFrame,
    pages: DataFrame,
    golden: reconciliation.Golden,
    failures: DataFrame | None = None,
    verdict: DataFrame | None = None,
    signals: DataFrame | None = None,
    conflicts: DataFrame | None = None,
) -> DataFrame:
    """Records from extraction passes: merged, adjudicated by a strong pass,
    grounded on the pages, with attempts and preliminary checks.

    passes and verdict: document_id, (pass_no,) path, value, status, sources;
    signals and conflicts as in consensus.merge_signals and
    grounding.ground_conflicts; failures: document_id, pass_no, error.
    """
    merged = consensus.merge_passes(passes)
    fields = consensus.adjudicate(merged, verdict) if verdict is not None else merged
    records = grounding.widen(grounding.ground(fields, pages))
    seen = extraction.extract_notice(pages).select("document_id", "page_count", "extraction_methods", "error")
    records = seen.join(records, "document_id")
    signal_type, conflict_type = extraction.SIGNALS, extraction.CONFLICTS
    if signals is not None:
        kept = consensus.merge_signals(grounding.ground_signals(signals, pages))
        records = records.join(kept, "document_id", "left").withColumn(
            "classification_evidence", F.expr(f"coalesce(cast(classification_evidence as {signal_type}), array())"))
    else:
        records = records.withColumn("classification_evidence", F.array().cast(signal_type))
    if conflicts is not None:
        listed = grounding.ground_conflicts(conflicts, pages).groupBy("document_id").agg(F.expr(
            "transform(array_sort(collect_list(struct(conflict_no, description, signal_list))), c -> struct(c.description, "
            "transform(c.signal_list, s -> struct(s.supports, s.rationale, struct(s.page, s.evidence, s.extraction_method) as source)) as signals))"
        ).cast(conflict_type).alias("classification_conflicts"))
        records = records.join(listed, "document_id", "left").withColumn(
            "classification_conflicts", F.expr(f"coalesce(classification_conflicts, cast(array() as {conflict_type}))"))
    else:
        records = records.withColumn("classification_conflicts", F.array().cast(conflict_type))
    attempted = consensus.attempt_list(consensus.attempts(passes, failures))
    records = records.join(attempted, "document_id", "left")
    said = consensus.disagreements(passes).select("document_id", "responses", F.col("paths").alias("disagreements"))
    weak = page_ops.weak_ocr(pages).groupBy("document_id").agg(F.array_sort(F.collect_list("page_number")).alias("weak_ocr_pages"))
    # The checks see what the golden table says, but nothing is enriched yet.
    names = records.columns
    staged = rules.coherence_results(reconciliation.reconcile(records, golden)).join(said, "document_id").join(weak, "document_id", "left")
    staged = staged.withColumns({
        "unresolved": F.expr(consensus.unresolved_of_record()),
        "weak_ocr_pages": F.coalesce("weak_ocr_pages", F.array().cast("array<int>")),
    })
    return consensus.preliminary_checks(staged).select(*names, "preliminary_checks")


def decide(records: DataFrame, golden: reconciliation.Golden, agreement: str | None = None, suggest: bool = False) -> DataFrame:
    """Reconcile, enrich, validate, score and route; no shuffle of its own
    while the golden table is below the broadcast bound.

    suggest: put the most similar golden rows into unconfirmed records, which
    compares the distinct unconfirmed names with the golden names.
    """
    reconciled = reconciliation.reconcile(records, golden, keep_key=suggest)
    if suggest:
        reconciled = fuzzy.attach_suggestions(reconciled, golden).drop("key_issuer")
    enriched = reconciliation.enrich(reconciled)
    checked = rules.attach(rules.validate(enriched))
    scored = confidence.document_confidence(confidence.field_confidence(checked, agreement))
    return routing.route(scored)


def with_file_names(records: DataFrame, prefix: str = "notice_") -> DataFrame:
    return records.withColumn("file_name", F.concat(F.lit(prefix), "document_id", F.lit(".pdf")))


def process(
    pages: DataFrame,
    golden: reconciliation.Golden,
    passes: DataFrame | None = None,
    failures: DataFrame | None = None,
    suggest: bool = False,
    **more: DataFrame | None,
) -> DataFrame:
    """Pages + golden table -> routed records, one row per document.

    With passes, documents that have a valid pass are built from these, the
    others from the text of their pages; agreement of the passes counts in the
    confidence. ``more``: verdict, signals and conflicts of pass_records.
    """
    if passes is None:
        return with_file_names(decide(pattern_records(pages), golden, suggest=suggest))
    known = pass_records(passes, pages, golden, failures, **more)
    chosen = consensus.choose_extraction(known, pattern_records(pages), passes)
    scores = consensus.agreement_map(consensus.agreement(passes))
    routed = decide(chosen.join(scores, "document_id", "left"), golden, "agreement", suggest)
    return with_file_names(routed.drop("agreement"))


def store(records: DataFrame, path: str) -> DataFrame:
    """Write records and continue from the table.

    Decisions are deep expressions over the extracted fields.  A filter on a
    decision would be pushed down and re-evaluate them; whoever selects by
    status, reason or score reads the written records instead, which also
    prunes columns and partitions.
    """
    records.write.mode("overwrite").parquet(path)
    return records.sparkSession.read.parquet(path)
