"""Pattern extraction: pages -> one record of 20 fields per document.

Every page is scanned once.  "First page with a hit wins" is a minimum over
(page, ...) structs, so the fold over pages becomes ordinary partial
aggregation: each map task reduces its pages before the only shuffle, and a
document with very many pages never has to fit in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.numbers import parse_amount
from noticemill.functions.text import blank_to_null, caseless, fold_latin, strip

P = vocab.PATTERNS
SOURCES = "array<struct<page:int,evidence:string,extraction_method:string>>"
SIGNALS = f"array<struct<supports:string,rationale:string,source:struct<page:int,evidence:string,extraction_method:string>>>"
CONFLICTS = f"array<struct<description:string,signals:{SIGNALS}>>"

BAD_YEAR = "year 0 is out of range"
BAD_MONTH = "month must be in 1..12"
BAD_DAY = "day is out of range for month"


def _hit(evidence: str, value: Column | str, status: str = "EXTRACTED") -> Column:
    """Candidate for a field on this page, null when the pattern did not match."""
    if isinstance(value, str):
        value = F.expr(value)
    return F.when(
        F.expr(f"{evidence} is not null"),
        F.struct(
            F.expr("page_number as page"),
            value.cast("string").alias("value"),
            F.expr(f"'{status}' as status"),
            F.expr(f"{evidence} as evidence"),
            F.expr("extraction_method as method"),
        ),
    )


def _date_error(day: Column, month: Column, year: Column) -> Column:
    """Why a matched date cannot exist."""
    return (
        F.when(year.try_cast("int") == 0, BAD_YEAR)
        .when(~month.try_cast("int").between(1, 12), BAD_MONTH)
        .otherwise(BAD_DAY)
    )


# Fields -> patterns whose evidence they need.
_NEEDS = {
    "issuer_name": ["company_line"],
    "issuer_cnpj": ["cnpj"],
    "isin": ["isin"],
    "ticker": ["ticker"],
    "share_class": ["share_words", "share_letters"],
    "event_type": ["event"],
    "approval_date": ["approval_date", "narrative_approval"],
    "record_date": ["record_date"],
    "ex_date": ["ex_date"],
    "payment_date": ["payment_date", "payment_not_disclosed"],
    "credit_date": ["credit_date"],
    "fraction_period_start": ["fraction_period"],
    "fraction_period_end": ["fraction_period"],
    "gross_amount_per_share": ["gross_amount_per_share"],
    "net_amount_per_share": ["net_amount_per_share"],
    "attributed_cost_per_share": ["attributed_cost_per_share"],
    "currency": ["gross_amount_per_share", "net_amount_per_share", "attributed_cost_per_share"],
    "tax_rate_percent": ["tax_rate_percent"],
    "tax_treatment": ["tax_by_beneficiary", "tax_uniform"],
    "ratio": ["ratio_colon", "ratio_words", "event"],
}
# Dates: capture column -> (pattern, group, position in the order of evaluation).
_DATES = {
    "approval_date": ("approval_date", 1, 1),
    "record_date": ("record_date", 1, 2),
    "ex_date": ("ex_date", 1, 3),
    "payment_date": ("payment_date", 1, 4),
    "credit_date": ("credit_date", 1, 5),
    "fraction_period_start": ("fraction_period", 1, 7),
    "fraction_period_end": ("fraction_period", 2, 8),
}
_NARRATIVE_ORDER = 6
# Captured text of the non-date fields: column -> (pattern, group).
_CAPTURES = {
    "share_words_kind": ("share_words", 1),
    "share_letters_kind": ("share_letters", 1),
    "narrative_day": ("narrative_approval", 1),
    "narrative_month": ("narrative_approval", 2),
    "narrative_year": ("narrative_approval", 3),
    "gross_amount_per_share": ("gross_amount_per_share", 1),
    "net_amount_per_share": ("net_amount_per_share", 1),
    "attributed_cost_per_share": ("attributed_cost_per_share", 1),
    "tax_rate_percent": ("tax_rate_percent", 1),
    "ratio_colon_a": ("ratio_colon", 1),
    "ratio_colon_b": ("ratio_colon", 2),
    "ratio_words_a": ("ratio_words", 1),
    "ratio_words_b": ("ratio_words", 2),
    "ratio_words_percent": ("ratio_words", 3),
}


# Patterns whose match may begin or end with white space.
_OPEN_ENDED = {"company_line", "payment_not_disclosed", "tax_uniform"}


def _guarded(name: str, pattern: str) -> Column:
    """Match of a pattern, tried only on pages holding its literal part."""
    literals = vocab.PATTERN_LITERALS.get(name)
    match = F.regexp_extract("text", pattern, 0)
    if not literals:
        return match
    haystack = F.col("text") if name in vocab.CASE_SENSITIVE else F.col("_caseless")
    present = reduce(or_, [haystack.contains(literal) for literal in literals])
    return F.when(present, match)


def _evidence(pattern: str) -> Column:
    if pattern == "company_line":
        # First non-blank line; line ends are the Unicode line breaks.
        return F.regexp_extract(
            "text", r"(?U)[^\s\x1c-\x1f][^\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]*", 0
        )
    if pattern == "event":
        return F.coalesce(*[blank_to_null(_guarded(e, p)) for e, p in vocab.EVENT_PATTERNS])
    return _guarded(pattern, P[pattern])


def page_candidates(pages: DataFrame, names: list[str]) -> DataFrame:
    """One struct column per requested field, plus the first bad date.

    Three projections, so that no regular expression runs twice: matched text,
    then captured groups of the (short) matches, then field candidates.
    """
    needed = sorted({p for n in names for p in _NEEDS[n]})
    base = ["document_id", "page_number", "extraction_method"]
    lowered = pages.select(*base, "text", caseless(F.col("text")).alias("_caseless"))
    matched = lowered.select(*base, *[_evidence(p).alias(f"e_{p}") for p in needed])
    matched = matched.select(
        *base,
        *[
            blank_to_null(strip(F.col(f"e_{p}")) if p in _OPEN_ENDED else F.col(f"e_{p}")).alias(f"e_{p}")
            for p in needed
        ],
    )
    if "company_line" in needed:
        is_company = F.col("e_company_line").rlike(P["company_line"])
        matched = matched.withColumn("e_company_line", F.when(is_company, F.col("e_company_line")))
    dates = {n: d for n, d in _DATES.items() if n in names}
    captures = {n: c for n, c in _CAPTURES.items() if c[0] in needed}
    captured = matched.select(
        "*",
        *[F.regexp_extract(f"e_{p}", P[p], g).alias(f"c_{n}") for n, (p, g) in captures.items()],
        *[
            F.translate(F.regexp_extract(f"e_{p}", P[p], g), "-", "/").alias(f"c_{n}")
            for n, (p, g, _) in dates.items()
        ],
    )
    parsed = captured.select("*", *[F.try_to_date(f"c_{n}", "d/M/yyyy").alias(f"d_{n}") for n in dates])
    if "narrative_approval" in needed:
        months = F.create_map(*[F.lit(x) for pair in vocab.MONTHS.items() for x in pair])
        folded = fold_latin(F.col("c_narrative_month"))
        parsed = parsed.withColumn("c_narrative_month", folded).withColumn(
            "n_month", F.try_element_at(months, F.col("c_narrative_month")).cast("string")
        ).withColumn(
            "d_narrative",
            F.try_to_date(
                F.concat("c_narrative_day", F.lit("/"), "n_month", F.lit("/"), "c_narrative_year"), "d/M/yyyy"
            ),
        )

    def e(pattern: str) -> Column:
        return F.col(f"e_{pattern}")

    def plain(pattern: str) -> Column:
        return _hit(f"e_{pattern}", f"e_{pattern}")

    def dated(name: str) -> Column:
        return _hit(f"e_{_DATES[name][0]}", f"d_{name}")

    def amount(name: str) -> Column:
        return _hit(f"e_{name}", parse_amount(F.col(f"c_{name}")))

    build = {
        "issuer_name": lambda: plain("company_line"),
        "issuer_cnpj": lambda: plain("cnpj"),
        "isin": lambda: plain("isin"),
        "ticker": lambda: plain("ticker"),
        "share_class": lambda: F.coalesce(
            _hit("e_share_words", "case when lower(substr(c_share_words_kind, 1, 1)) = 'o' then 'ON' else 'PN' end"),
            _hit("e_share_letters", "c_share_letters_kind"),
        ),
        "approval_date": lambda: F.coalesce(dated("approval_date"), _hit("e_narrative_approval", "d_narrative")),
        "payment_date": lambda: F.coalesce(
            dated("payment_date"), _hit("e_payment_not_disclosed", "null", "NOT_DISCLOSED")
        ),
        "currency": lambda: _hit(
            "coalesce(e_gross_amount_per_share, e_net_amount_per_share, e_attributed_cost_per_share)", "'BRL'"
        ),
        "tax_treatment": lambda: F.coalesce(
            _hit("e_tax_by_beneficiary", "'TAX_DEPENDS_ON_BENEFICIARY'"), _hit("e_tax_uniform", "'TAX_RULE_UNIFORM'")
        ),
        # 'a:b:percent'; the orientation waits for the event type.
        "ratio": lambda: F.coalesce(
            _hit("e_ratio_colon", "concat_ws(':', c_ratio_colon_a, c_ratio_colon_b, '')"),
            _hit(
                "e_ratio_words",
                F.concat_ws(":", "c_ratio_words_a", "c_ratio_words_b", parse_amount(F.col("c_ratio_words_percent"))),
            ),
        ),
    }
    build.update({n: (lambda n=n: dated(n)) for n in _DATES if n not in build})
    build.update({n: (lambda n=n: amount(n)) for n in vocab.DECIMAL_FIELDS})
    columns = [build[n]().alias(n) for n in names if n != "event_type"]
    if "event" in needed:
        # Stronger patterns match nowhere on the page, so not in the match either.
        kind = F.coalesce(*[F.when(e("event").rlike(p), F.lit(name)) for name, p in vocab.EVENT_PATTERNS])
        columns.append(_hit("e_event", kind).alias("page_event"))
    error_type = "struct<page:int,ord:int,message:string>"
    errors = []
    for name, (pattern, _, order) in dates.items():
        day, month, year = (F.split(f"c_{name}", "/")[i] for i in range(3))
        bad = e(pattern).isNotNull() & F.col(f"d_{name}").isNull()
        message = _date_error(day, month, year)
        errors.append(
            F.when(bad, F.struct(F.col("page_number").alias("page"), F.lit(order).alias("ord"), message.alias("message")))
        )
    columns.append(F.coalesce(*errors, F.lit(None).cast(error_type)).alias("explicit_error"))
    if "approval_date" in names:
        # A bad narrative date only matters when the narrative is the candidate.
        month = F.col("c_narrative_month")
        message = F.when(F.col("n_month").isNull(), F.concat(F.lit("'"), month, F.lit("'"))).otherwise(
            _date_error(F.col("c_narrative_day"), F.col("n_month"), F.col("c_narrative_year"))
        )
        bad = e("approval_date").isNull() & e("narrative_approval").isNotNull() & F.col("d_narrative").isNull()
        columns.append(
            F.when(e("approval_date").isNotNull() | e("narrative_approval").isNotNull(),
                   F.struct(F.col("page_number").alias("page"), F.when(bad, message).alias("message"))
                   ).alias("approval_error")
        )
    return parsed.select(*base, *columns)


# -- fold over pages ---------------------------------------------------------------


def _first(name: str) -> Column:
    return F.min(name).alias(name)


def fold_pages(candidates: DataFrame, names: list[str]) -> DataFrame:
    """First page with a hit wins; a JCP page later on overrides the event."""
    aggregates: list[Column] = []
    for name in names:
        if name not in ("event_type",):
            aggregates.append(_first(name))
    if set(names) & {"event_type", "ratio"}:
        is_jcp = F.col("page_event")["value"] == "JCP"
        aggregates += [
            F.min("page_event").alias("first_event"),
            F.min(F.when(is_jcp, F.col("page_number"))).alias("first_jcp"),
            F.max(F.when(is_jcp, F.col("page_event"))).alias("last_jcp"),
        ]
    grouped = candidates.groupBy("document_id").agg(
        F.count(F.lit(1)).cast("int").alias("page_count"),
        F.min(F.when(F.col("extraction_method") == "NATIVE_TEXT", F.col("page_number"))).alias("_native"),
        F.min(F.when(F.col("extraction_method") == "OCR", F.col("page_number"))).alias("_ocr"),
        F.min("explicit_error").alias("explicit_error"),
        *([F.min("approval_error").alias("approval_error")] if "approval_date" in names else []),
        *aggregates,
    )
    derived: dict[str, Column] = {"extraction_methods": methods_in_order("_native", "_ocr")}
    if "event_type" in names:
        derived["event_type"] = F.coalesce("last_jcp", "first_event")
    if "ratio" in names:
        at = F.col("ratio")["page"]
        event = F.when(F.col("first_jcp") <= at, F.lit("JCP")).when(
            F.col("first_event")["page"] <= at, F.col("first_event")["value"]
        )
        parts = F.split(F.col("ratio")["value"], ":")
        swap = F.coalesce(event == "REVERSE_SPLIT", F.lit(False))
        value = F.struct(
            F.when(event == "BONUS_SHARES", "NEW_PER_EXISTING").otherwise("RESULTING_PER_EXISTING").alias("kind"),
            F.when(swap, parts[1]).otherwise(parts[0]).alias("numerator"),
            F.when(swap, parts[0]).otherwise(parts[1]).alias("denominator"),
            blank_to_null(parts[2]).alias("percentage"),
        )
        derived["ratio"] = F.when(
            F.col("ratio").isNotNull(),
            F.col("ratio").withField("value", F.to_json(value, {"ignoreNullFields": "false"})),
        )
    errors = [F.col("explicit_error")]
    if "approval_date" in names:
        approval = F.col("approval_error")
        errors.append(
            F.when(
                approval["message"].isNotNull(),
                F.struct(
                    approval["page"].alias("page"),
                    F.lit(_NARRATIVE_ORDER).alias("ord"),
                    approval["message"].alias("message"),
                ),
            )
        )
    derived["error"] = (F.least(*errors) if len(errors) > 1 else errors[0])["message"]
    return grouped.withColumns(derived).drop("_native", "_ocr", "explicit_error", "approval_error")


def methods_in_order(native_page: str, ocr_page: str) -> Column:
    """Extraction methods in first-seen order, from the first page of each."""
    found = F.array(
        F.struct(F.col(native_page).alias("page"), F.lit("NATIVE_TEXT").alias("method")),
        F.struct(F.col(ocr_page).alias("page"), F.lit("OCR").alias("method")),
    )
    seen = F.array_sort(F.filter(found, lambda x: x["page"].isNotNull()))
    return F.transform(seen, lambda x: x["method"])


def extract(pages: DataFrame, names: list[str]) -> DataFrame:
    """Folded candidates (page, value, status, evidence, method) per document."""
    return fold_pages(page_candidates(pages, names), names)


def extract_field(pages: DataFrame, name: str) -> DataFrame:
    """(document_id, value, status, page, evidence) of one field.

    Only the patterns this field needs are evaluated.
    """
    found = F.col(name)
    return extract(pages, [name]).select(
        "document_id",
        found["value"].alias("value"),
        F.coalesce(found["status"], F.lit("UNKNOWN")).alias("status"),
        found["page"].alias("page"),
        found["evidence"].alias("evidence"),
    )


_EMPTY = f"named_struct('value', cast(null as string), 'status', 'UNKNOWN', 'origin', 'UNKNOWN', 'sources', cast(array() as {SOURCES}))"
_FILLED = (
    "if({c} is null, " + _EMPTY + ", named_struct('value', {c}.value, 'status', {c}.status, 'origin', 'DOCUMENT', "
    "'sources', array(named_struct('page', {c}.page, 'evidence', {c}.evidence, 'extraction_method', {c}.method))))"
)


def extract_notice(pages: DataFrame) -> DataFrame:
    """Pages -> records: 20 field structs, classification signals, error.

    Evidence is cut out of the page text itself, so it is grounded by
    construction and carries the page's extraction method.
    """
    folded = extract(pages, vocab.EXTRACTED_FIELDS)
    first = F.col("first_event")
    signal = F.struct(
        first["value"].alias("supports"),
        F.lit(vocab.EVENT_SIGNAL_RATIONALE).alias("rationale"),
        F.struct(
            first["page"].alias("page"),
            first["evidence"].alias("evidence"),
            first["method"].alias("extraction_method"),
        ).alias("source"),
    )
    return folded.select(
        "document_id",
        "page_count",
        "extraction_methods",
        "error",
        *[
            F.expr(_EMPTY if n in vocab.REFERENCE_ONLY_FIELDS else _FILLED.format(c=n)).alias(n)
            for n, _ in vocab.FIELDS
        ],
        F.when(first.isNotNull(), F.array(signal)).otherwise(F.array()).cast(SIGNALS).alias("classification_evidence"),
        F.array().cast(CONFLICTS).alias("classification_conflicts"),
    )
