"""Routing decision of a record, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.sqltext import array_of, compact, in_list, q

REASON = "struct<code:string,category:string,message:string>"
_T = vocab.CONFIDENCE_THRESHOLD


def _reason(code: str, message: str | None = None) -> str:
    category, default = vocab.REASONS[code]
    return (
        f"named_struct('code', {q(code)}, 'category', {q(category)}, 'message', "
        f"{message if message is not None else q(default)})"
    )


def _critical() -> list[tuple[str, str, str]]:
    """(condition, name, column) of the critical fields."""
    return [
        *[("true", n, c) for n, c in vocab.CRITICAL_ALWAYS],
        (f"event_type.value in {in_list(vocab.CASH_EVENTS)}", *vocab.CRITICAL_CASH),
        (f"event_type.value in {in_list(vocab.RATIO_EVENTS)}", *vocab.CRITICAL_RATIO),
    ]


def critical_fields(records: DataFrame) -> DataFrame:
    items = compact([
        (when, f"named_struct('name', {q(name)}, 'status', {column}.status, 'confidence', {column}.confidence)")
        for when, name, column in _critical()
    ])
    return records.select("document_id", F.expr(f"posexplode_outer({items}) as (ord, c)")).select(
        "document_id", "ord", "c.*"
    )


def route(records: DataFrame) -> DataFrame:
    """Add review, follow_up, exceptions and processing_status.

    ``records`` carries extraction_attempts, validations, document_confidence,
    reference_validation and scored fields.  Rows with ``error`` set failed
    technically: they keep one technical reason and status FAILED.
    """
    event = "event_type.value"
    single = compact(
        [
            ("size(extraction_attempts) > 0 and element_at(extraction_attempts, -1).outcome <> 'SUFFICIENT' "
             "and size(element_at(extraction_attempts, -1).unresolved_fields) > 0",
             _reason("EXTRACTION_CASCADE_EXHAUSTED")),
            (f"{event} is null or {event} = 'UNKNOWN'", _reason("EVENT_CLASSIFICATION_AMBIGUOUS")),
            ("size(classification_conflicts) > 0", _reason("TITLE_BODY_CLASSIFICATION_CONFLICT")),
            (f"document_confidence.score < {_T}", _reason(
                "DOCUMENT_CONFIDENCE_BELOW_THRESHOLD",
                f"concat({q(vocab.REASONS['DOCUMENT_CONFIDENCE_BELOW_THRESHOLD'][1])}, document_confidence.score, '%.')",
            )),
            ("reference_validation.reference_record is null", _reason("REFERENCE_NOT_FOUND")),
            ("size(reference_validation.conflicts) > 0", _reason("REFERENCE_IDENTIFIER_CONFLICT")),
        ]
    )
    rules = (
        "transform(filter(validations, v -> v.status = 'FAIL' and "
        "(startswith(v.rule, 'DATE_') or startswith(v.rule, 'FIN_'))), v -> if(startswith(v.rule, 'DATE_'), "
        f"{_reason('DATE_SEQUENCE_INCONSISTENT', 'v.message')}, {_reason('FINANCIAL_VALUES_INCONSISTENT', 'v.message')}))"
    )
    unreadable = q(vocab.REASONS["DOCUMENT_PARTIALLY_UNREADABLE"][1])
    low = q(vocab.REASONS["CRITICAL_FIELD_CONFIDENCE_BELOW_THRESHOLD"][1])
    critical = compact([
        (
            f"{when} and ({c}.status = 'UNREADABLE' or {c}.confidence < {_T})",
            f"if({c}.status = 'UNREADABLE', "
            + _reason("DOCUMENT_PARTIALLY_UNREADABLE", f"concat({unreadable}, {q(name)}, '.')")
            + ", "
            + _reason(
                "CRITICAL_FIELD_CONFIDENCE_BELOW_THRESHOLD",
                f"concat({low}, {q(name)}, ' (', {c}.confidence, '%).')",
            )
            + ")",
        )
        for when, name, c in _critical()
    ])
    follow = compact([("payment_date.status = 'NOT_DISCLOSED'", _reason("PAYMENT_DATE_NOT_DISCLOSED"))])
    technical = (
        f"array(named_struct('code', {q(vocab.TECHNICAL_DEFAULT)}, 'category', 'TECHNICAL_ERROR', 'message', error))"
    )
    none = f"cast(array() as array<{REASON}>)"
    staged = records.withColumns(
        {
            # A category is a function of the code, so equal structs are equal (code, message).
            "_review": F.expr(f"if(error is null, array_distinct(concat({single}, {rules}, {critical})), {none})"),
            "_follow": F.expr(f"if(error is null, {follow}, {none})"),
        }
    )
    return staged.withColumns(
        {
            "review": F.expr("named_struct('required', size(_review) > 0, 'reasons', _review)"),
            "follow_up": F.expr("named_struct('required', size(_follow) > 0, 'reasons', _follow)"),
            "exceptions": F.expr(f"if(error is null, concat(_review, _follow), {technical})"),
            "processing_status": F.expr(
                "case when error is not null then 'FAILED' when size(_review) > 0 then 'REVIEW_REQUIRED' "
                "when size(_follow) > 0 then 'PENDING_INFORMATION' else 'ACCEPTED' end"
            ),
            "manual_review": F.expr(
                "named_struct('approved', false, 'approved_at', cast(null as timestamp), "
                f"'previous_status', cast(null as string), 'acknowledged_reasons', {none})"
            ),
        }
    ).drop("_review", "_follow")


def apply_approvals(records: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated records, refused approvals with the reason).

    ``approvals`` has document_id and approved_at; the earliest one counts.
    """
    first = approvals.groupBy("document_id").agg(F.min("approved_at").alias("_approved_at"))
    joined = records.join(first, "document_id", "left")
    go = "_approved_at is not null and processing_status = 'REVIEW_REQUIRED'"
    updated = joined.withColumn("_go", F.expr(go)).withColumns(
        {
            "manual_review": F.expr(
                "if(_go, named_struct('approved', true, 'approved_at', _approved_at, "
                "'previous_status', processing_status, 'acknowledged_reasons', review.reasons), manual_review)"
            ),
            "review": F.expr("if(_go, named_struct('required', false, 'reasons', review.reasons), review)"),
            "processing_status": F.expr("if(_go, 'ACCEPTED', processing_status)"),
        }
    ).drop("_go", "_approved_at")
    refused = (
        first.join(records.select("document_id", "processing_status"), "document_id", "left")
        .where("processing_status is null or processing_status <> 'REVIEW_REQUIRED'")
        .select(
            "document_id",
            F.expr(
                f"if(processing_status is null, {q(vocab.APPROVAL_NOT_FOUND)}, {q(vocab.APPROVAL_REFUSED)}) as reason"
            ),
        )
    )
    return updated, refused


def record_overview(records: DataFrame) -> DataFrame:
    """The four controls an operator sees first, plus the failed-rule count."""
    return records.select(
        "document_id",
        F.expr(
            "if(size(extraction_attempts) > 0, element_at(extraction_attempts, -1).outcome = 'SUFFICIENT', true) "
            "as read_ok"
        ),
        F.expr("reference_validation.exact_match as reference_ok"),
        F.expr("not exists(validations, v -> v.status = 'FAIL') as rules_ok"),
        F.expr("processing_status = 'ACCEPTED' as routing_ok"),
        F.expr("size(filter(validations, v -> v.status = 'FAIL')) as failed_rules"),
    )
