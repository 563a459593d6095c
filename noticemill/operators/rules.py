"""Coherence rules: dates, money and events, as pure projections of a record.

Each rule is a condition and a struct; a document's results are those whose
condition holds, in fixed order.  Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.numbers import MONEY, RATE, decimal_text, scale_of, stripped
from noticemill.functions.sqltext import case_of, compact, in_list, q
from noticemill.operators.reconciliation import reference_results

RESULT = "struct<rule:string,status:string,message:string,expected:string,observed:string>"
_CASH = in_list(vocab.CASH_EVENTS)


Rule = tuple[str, str]  # (condition, result struct)


def _result(when: str, rule: str, status: str, message: str, expected: str = "null", observed: str = "null") -> Rule:
    return when, (
        f"named_struct('rule', {rule}, 'status', {status}, 'message', {message}, "
        f"'expected', cast({expected} as string), 'observed', cast({observed} as string))"
    )


def _ordered(when: str, valid: str, rule: str, ok: str, bad: str, expected: str, observed: str) -> Rule:
    return _result(
        when, q(rule), f"if({valid}, 'PASS', 'FAIL')", f"if({valid}, {q(ok)}, {q(bad)})", q(expected), observed
    )


def _typed(records: DataFrame) -> DataFrame:
    """Typed scratch columns the rules share (dates, decimals, ratio)."""
    dates = {f"_{n}": F.expr(f"try_cast({n}.value as date)") for n in
             ("approval_date", "record_date", "ex_date", "payment_date")}
    money = {
        "_gross": F.expr(f"try_cast(gross_amount_per_share.value as {MONEY})"),
        "_net": F.expr(f"try_cast(net_amount_per_share.value as {MONEY})"),
        "_rate": F.expr(f"try_cast(tax_rate_percent.value as {RATE})"),
        "_ratio": F.expr(
            "from_json(ratio.value, 'kind string, numerator string, denominator string, percentage string')"
        ),
        "_net_text": decimal_text(F.col("net_amount_per_share.value")),
    }
    typed = records.withColumns({**dates, **money})
    exact = F.expr("_gross * (1 - _rate / 100)")
    scale = scale_of(F.col("gross_amount_per_share.value")) + F.greatest(
        scale_of(F.col("tax_rate_percent.value")), scale_of(stripped(F.expr("cast(_rate / 100 as string)")))
    )
    typed = typed.withColumns({"_expected": exact, "_scale": scale})
    text = F.expr(
        "if(_scale = 0, substring_index(cast(_expected as string), '.', 1), "
        "substr(cast(_expected as string), 1, instr(cast(_expected as string), '.') + _scale))"
    )
    return typed.withColumn("_expected_text", text).withColumn("_expected_text", decimal_text(F.col("_expected_text")))


_SCRATCH = [
    "_approval_date", "_record_date", "_ex_date", "_payment_date", "_gross", "_net", "_rate", "_ratio",
    "_net_text", "_expected", "_scale", "_expected_text",
]


def date_rules() -> list[Rule]:
    event = "event_type.value is not null"
    cash = f"event_type.value in {_CASH}"
    open_ = "payment_date.status = 'NOT_DISCLOSED'"
    return [
        _ordered(
            f"{event} and _approval_date is not null and _record_date is not null",
            "_approval_date <= _record_date", "DATE_APPROVAL_AFTER_RECORD",
            vocab.MSG_APPROVAL_OK, vocab.MSG_APPROVAL_BAD, "approval_date <= record_date",
            "concat(_approval_date, ' > ', _record_date)",
        ),
        _ordered(
            f"{event} and _record_date is not null and _ex_date is not null",
            "_record_date < _ex_date", "DATE_RECORD_NOT_BEFORE_EX",
            vocab.MSG_RECORD_OK, vocab.MSG_RECORD_BAD, "record_date < ex_date",
            "concat(_record_date, ' / ', _ex_date)",
        ),
        _result(
            f"{cash} and {open_}", "'DATE_PAYMENT_NOT_DISCLOSED'", "'WARN'", q(vocab.MSG_PAYMENT_OPEN),
            q("A disclosed payment date"),
        ),
        _ordered(
            f"{cash} and not {open_} and _record_date is not null and _payment_date is not null",
            "_payment_date >= _record_date", "DATE_PAYMENT_BEFORE_RECORD",
            vocab.MSG_PAYMENT_OK, vocab.MSG_PAYMENT_BAD, "payment_date >= record_date",
            "concat(_payment_date, ' / ', _record_date)",
        ),
    ]


def financial_rules() -> list[Rule]:
    beneficiary = "tax_treatment.value <=> 'TAX_DEPENDS_ON_BENEFICIARY'"
    has_net = "net_amount_per_share.value is not null"
    disclosed = "net_amount_per_share.origin = 'DOCUMENT' and size(net_amount_per_share.sources) > 0"
    all_three = "_gross is not null and _net is not null and _rate is not null"
    valid = f"abs(_net - _expected) <= {vocab.MONEY_TOLERANCE}BD"
    money = " or ".join(
        f"{n}.value is not null"
        for n in ("gross_amount_per_share", "net_amount_per_share", "attributed_cost_per_share")
    )
    positive = (
        "coalesce(try_cast(_ratio.numerator as decimal(38,10)) > 0 "
        "and try_cast(_ratio.denominator as decimal(38,10)) > 0, false)"
    )
    return [
        _result(beneficiary, "'FIN_TAX_DEPENDS_ON_BENEFICIARY'", "'WARN'", q(vocab.MSG_TAX_BENEFICIARY),
                observed="_net_text"),
        _result(f"{beneficiary} and {has_net} and {disclosed}", "'FIN_TAX_CONDITIONAL_NET_DISCLOSED'", "'WARN'",
                q(vocab.MSG_NET_CONDITIONAL), q(vocab.EXPECT_NET_CONDITIONAL), "_net_text"),
        _result(
            f"{all_three} and (not ({beneficiary}) or ({disclosed}))",
            f"if({valid}, 'FIN_GROSS_NET_TAX_CONSISTENT', 'FIN_GROSS_NET_TAX_MISMATCH')",
            f"if({valid}, 'PASS', 'FAIL')",
            f"if({valid}, {q(vocab.MSG_TAX_OK)}, {q(vocab.MSG_TAX_BAD)})",
            "_expected_text", "_net_text",
        ),
        _result(f"{beneficiary} and {has_net} and not ({disclosed})", "'FIN_UNIVERSAL_NET_NOT_APPLICABLE'", "'FAIL'",
                q(vocab.MSG_NET_UNIVERSAL), observed="_net_text"),
        _result(f"({money}) and currency.value is null", "'FIN_CURRENCY_MISSING'", "'FAIL'", q(vocab.MSG_CURRENCY),
                q("ISO 4217 currency code")),
        _result(
            "ratio.value is not null",
            f"if({positive}, 'FIN_RATIO_VALID', 'FIN_RATIO_INVALID')",
            f"if({positive}, 'PASS', 'FAIL')",
            f"if({positive}, {q(vocab.MSG_RATIO_OK)}, {q(vocab.MSG_RATIO_BAD)})",
            q("numerator > 0 and denominator > 0"),
            "concat(_ratio.numerator, ':', _ratio.denominator, ' (', _ratio.kind, ')')",
        ),
    ]


def event_rules() -> list[Rule]:
    event = "event_type.value"
    unknown = f"({event} is null or {event} = 'UNKNOWN')"
    conflict = "size(classification_conflicts) > 0"
    rules = [
        _result(unknown, "'EVENT_UNKNOWN'", "'FAIL'", q(vocab.MSG_EVENT_UNKNOWN),
                q("A supported event type or OTHER"), event),
        _result(f"not {unknown} and {conflict}", "'EVENT_CLASSIFICATION_CONFLICT'", "'FAIL'",
                q(vocab.MSG_EVENT_CONFLICT), q("Consistent classification evidence"),
                "to_json(transform(classification_conflicts, c -> c.description))"),
        _result(f"not {unknown} and not {conflict}", "'EVENT_CLASSIFICATION_SUPPORTED'", "'PASS'",
                q(vocab.MSG_EVENT_OK), event, event),
    ]
    # Required fields in list order; every event lists a field at most once.
    order = ["record_date", "ex_date", "gross_amount_per_share", "currency", "ratio"]
    for name in order:
        events = in_list([e for e, names in vocab.RULE_REQUIRED_BY_EVENT.items() if name in names])
        missing = f"{name}.value is null and {name}.status not in ('NOT_DISCLOSED', 'NOT_APPLICABLE')"
        rules.append(
            _result(f"{event} in {events} and {missing}", "'EVENT_REQUIRED_FIELD_MISSING'", "'FAIL'",
                    f"concat('Required field is missing for ', {event}, ': {name}.')", q(name))
        )
    return rules


def coherence_results(records: DataFrame, groups: tuple[str, ...] = ("dates", "financial", "event")) -> DataFrame:
    """records + one array column of results per group (validations_<group>)."""
    makers = {"dates": date_rules, "financial": financial_rules, "event": event_rules}
    typed = _typed(records) if {"dates", "financial"} & set(groups) else records
    return typed.select(
        *records.columns,
        *[F.expr(f"cast({compact(makers[g]())} as array<{RESULT}>)").alias(f"validations_{g}") for g in groups],
    )


def validate(records: DataFrame) -> DataFrame:
    """records + validations: reference, dates, financial, event, in order."""
    groups = ["reference", "dates", "financial", "event"]
    checked = coherence_results(reference_results(records))
    return checked.withColumn(
        "validations", F.concat(*[F.col(f"validations_{g}") for g in groups])
    ).drop(*[f"validations_{g}" for g in groups])


def explode_results(records: DataFrame, column: str) -> DataFrame:
    """(document_id, ord, rule, status, message, expected, observed) rows.

    The outer form keeps Spark from inferring a size filter, which would
    evaluate the whole rule expression a second time below the generator.
    """
    rows = records.select("document_id", F.posexplode_outer(column).alias("ord", "r"))
    return rows.where("r is not null").select("document_id", "ord", "r.*")


def attach(records: DataFrame) -> DataFrame:
    """Copy each result to the fields its rule code is about."""
    columns = {}
    for name, _ in vocab.FIELDS:
        prefixes = [p for p, fields in vocab.RULE_PREFIXES.items() if name in fields]
        matching = " or ".join(f"startswith(v.rule, {q(p)})" for p in prefixes)
        found = f"filter(validations, v -> {matching})" if prefixes else f"cast(array() as array<{RESULT}>)"
        columns[name] = F.expr(
            f"named_struct('value', {name}.value, 'status', {name}.status, 'origin', {name}.origin, "
            f"'sources', {name}.sources, 'validation', {found})"
        )
    return records.withColumns(columns)
