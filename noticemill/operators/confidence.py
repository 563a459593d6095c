"""Field and document confidence, as projections of a record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.sqltext import array_of, case_of, compact, in_list, q

FIELD_NAMES = [name for name, _ in vocab.FIELDS]


def _codes(rules: str) -> str:
    """Codes of some rule results as one text, each behind a comma: a look for ',<prefix>' needs no loop over results."""
    return f"concat(',', array_join({rules}.rule, ','))"


def _has_rule(name: str, codes: str) -> str:
    """Whether a text of codes has a rule that is about the field."""
    prefixes = [p for p, fields in vocab.RULE_PREFIXES.items() if name in fields]
    return "(" + (" or ".join(f"contains({codes}, {q(',' + p)})" for p in prefixes) or "false") + ")"


def quality(f: str) -> str:
    """Quality of a usable field before blending with agreement."""
    return (
        f"case when {f}.status = 'NOT_APPLICABLE' then 100 "
        f"when {f}.status = 'NOT_DISCLOSED' then if(size({f}.sources) > 0, 95, 60) "
        f"when {f}.origin = 'REFERENCE' then if(reference_validation.exact_match, 95, 75) "
        f"when {f}.origin = 'DERIVED' then "
        f"if({_has_rule(f, '_seen_codes')} and not {_has_rule(f, '_open_codes')}, 95, 75) "
        f"when {f}.origin = 'DOCUMENT' and size({f}.sources) > 0 then "
        f"if(exists({f}.sources, s -> s.extraction_method = 'OCR'), 78, 92) else 20 end"
    )


def score(f: str, agreement: str) -> str:
    blended = f"cast(bround({quality(f)} * 0.7D + {agreement} * 0.3D, 0) as int)"
    return (
        f"case when {f}.status in ('AMBIGUOUS', 'CONFLICT', 'UNREADABLE') then 10 "
        f"when {f}.status = 'UNKNOWN' then 0 "
        f"when {_has_rule(f, '_failed_codes')} then 15 "
        f"when {agreement} is null or {f}.origin <> 'DOCUMENT' then {quality(f)} else {blended} end"
    )


def field_confidence(records: DataFrame, agreement: str | None = None) -> DataFrame:
    """Add agent_agreement and confidence to every field struct of :func:`rules.attach`.

    ``agreement`` names a map column path -> 0..100; without it no pass was
    compared and agreement stays null.
    """
    # A field's own results are those of the record with its prefixes, so the
    # lists copied to the fields need not be built for a score.
    staged = records.withColumns({
        "_seen_codes": F.expr(_codes("validations")),
        "_open_codes": F.expr(_codes("filter(validations, v -> not (v.status <=> 'PASS'))")),
        "_failed_codes": F.expr(_codes("filter(validations, v -> v.status = 'FAIL')")),
    })
    columns = {}
    for name, path in vocab.FIELDS:
        agreed = f"try_element_at({agreement}, {q(path)})" if agreement else "cast(null as int)"
        columns[name] = F.expr(
            f"named_struct('value', {name}.value, 'status', {name}.status, 'origin', {name}.origin, "
            f"'confidence', {score(name, agreed)}, 'agent_agreement', {agreed}, "
            f"'sources', {name}.sources, 'validation', {name}.validation)"
        )
    return staged.withColumns(columns).drop("_seen_codes", "_open_codes", "_failed_codes")


def _material(f: str) -> str:
    """Score of a material field."""
    resolved = f"{f}.value is not null or ({f}.status = 'NOT_DISCLOSED' and size({f}.sources) > 0)"
    return f"case when {f}.status = 'NOT_APPLICABLE' then 100 when {resolved} then {f}.confidence else 0 end"


def document_confidence(records: DataFrame) -> DataFrame:
    """Mean confidence and coverage over the material fields of the event."""
    always, by_event = vocab.MATERIAL_ALWAYS, vocab.MATERIAL_BY_EVENT
    names = always + [n for n in FIELD_NAMES if any(n in more for more in by_event.values()) and n not in always]
    scores = {n: f"_score_{n}" for n in names}

    def over(each: Callable[[list[str]], str], none: str, join: str) -> str:
        """Something of the material fields: of those that always are, then of those of the event."""
        more = case_of("event_type.value", {e: each(listed) for e, listed in by_event.items()}, none)
        return join.format(each(always), more)

    def listed(when: str) -> str:
        return over(lambda some: compact([(when.format(scores[n]), q(vocab.PATH_OF[n])) for n in some]), "array()", "concat({}, {})")

    def summed(what: str) -> str:
        return over(lambda some: "(" + " + ".join(what.format(scores[n]) for n in some) + ")", "0", "{} + {}")

    staged = records.withColumns({column: F.expr(_material(n)) for n, column in scores.items()}).withColumns({
        "_n": F.expr(over(lambda some: str(len(some)), "0", "{} + {}")),
        "_total": F.expr(summed("{}")),
        "_resolved": F.expr(summed("if({} > 0, 1, 0)")),
    })
    result = F.struct(
        F.expr("cast(bround(cast(_total as double) / _n, 0) as int) as score"),
        F.expr("cast(bround(_resolved * 100D / _n, 0) as int) as completion_percentage"),
        F.expr(listed("true") + " as required_fields"),
        F.expr(listed("{} > 0") + " as resolved_fields"),
        F.expr(listed("not {} > 0") + " as missing_fields"),
        F.expr(f"concat(_resolved, ' de ', _n, {q(vocab.CONFIDENCE_RATIONALE)}) as rationale"),
    )
    return staged.withColumn("document_confidence", result).drop("_n", "_total", "_resolved", *scores.values())


def confidence_band(confidence: str) -> str:
    return f"case when {confidence} >= 90 then 'strong' when {confidence} >= 75 then 'attention' else 'critical' end"


def long_fields(records: DataFrame) -> DataFrame:
    """(document_id, ord, path, value, status, origin, confidence, ...) rows."""
    structs = [
        f"named_struct('ord', {i}, 'path', {q(path)}, 'value', {n}.value, 'status', {n}.status, "
        f"'origin', {n}.origin, 'confidence', {n}.confidence, 'agent_agreement', {n}.agent_agreement, "
        f"'sources', {n}.sources, 'validation', {n}.validation)"
        for i, (n, path) in enumerate(vocab.FIELDS)
    ]
    return records.select("document_id", F.expr(f"inline_outer({array_of(structs)})"))


def confidence_reason(fields: DataFrame) -> DataFrame:
    """Explain each field's confidence; ``fields`` is :func:`long_fields`."""
    labels = case_of("status", {k: q(v) for k, v in vocab.FIELD_STATUS_LABELS.items()}, "status")
    why = (
        f"case when exists(validation, v -> v.status = 'FAIL') then {q(vocab.WHY_RULE_FAILED)} "
        f"when status in {in_list(vocab.UNRESOLVED_STATUSES)} then "
        f"concat({q(vocab.WHY_STATUS[0])}, {labels}, {q(vocab.WHY_STATUS[1])}) "
        f"when status = 'NOT_DISCLOSED' then "
        f"if(size(sources) > 0, {q(vocab.WHY_NOT_DISCLOSED)}, {q(vocab.WHY_PENDING)}) "
        f"when origin = 'REFERENCE' then {q(vocab.WHY_REFERENCE)} "
        f"when origin = 'DERIVED' then {q(vocab.WHY_DERIVED)} "
        f"when exists(sources, s -> s.extraction_method = 'OCR') then "
        f"concat({q(vocab.WHY_OCR[0])}, confidence, {q(vocab.WHY_OCR[1])}) "
        f"when origin = 'DOCUMENT' and size(sources) > 0 then "
        f"concat({q(vocab.WHY_DOCUMENT[0])}, confidence, {q(vocab.WHY_DOCUMENT[1])}) "
        f"else {q(vocab.WHY_NONE)} end"
    )
    return fields.withColumn("reason", F.expr(why))
