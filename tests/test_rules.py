import itertools

import pytest
from helpers import given, golden_frame, jcp_fields, record_frame, records_frame
from noticemill.functions import text
from noticemill.operators import confidence, reconciliation as rc, routing, rules
from noticemill.plans import pipeline
from pyspark.sql import functions as F

REF = (
    "named_struct('exact_match', {exact}, 'matched_by', array('isin'), 'reference_record', named_struct('issuer', 'x'), "
    "'conflicts', cast(array() as array<struct<code:string,field:string,expected:string,observed:string>>), "
    "'possible_matches', array())"
)


UNSET = (None, "UNKNOWN", "UNKNOWN", 0)
BENEFICIARY = given("TAX_DEPENDS_ON_BENEFICIARY")
OPEN = given(None, status="NOT_DISCLOSED")
RULE_CASES = {
    "good": jcp_fields(),
    "late": jcp_fields(approval_date=given("2026-06-20"), ex_date=given("2026-06-16"), payment_date=given("2026-06-01")),
    "open": jcp_fields(payment_date=OPEN),
    "open split": jcp_fields(payment_date=OPEN, event_type=given("STOCK_SPLIT")),
    "no event": jcp_fields(event_type=UNSET),
    "edge": jcp_fields(net_amount_per_share=given("0.1434201500")),
    "over": jcp_fields(net_amount_per_share=given("0.1434201501")),
    "short": jcp_fields(gross_amount_per_share=given("0.173842"), net_amount_per_share=given("0.14341965")),
    "ten": jcp_fields(gross_amount_per_share=given("2"), net_amount_per_share=given("1.8"), tax_rate_percent=given("10")),
    "disclosed": jcp_fields(tax_treatment=BENEFICIARY),
    "derived": jcp_fields(tax_treatment=BENEFICIARY, net_amount_per_share=("0.1434196500", "DERIVED", "DERIVED", 0)),
    "ratio": jcp_fields(
        currency=UNSET, net_amount_per_share=UNSET,
        ratio=given('{"kind":"NEW_PER_EXISTING","numerator":"0","denominator":"1","percentage":null}')),
    "missing": jcp_fields(ex_date=UNSET, currency=(None, "NOT_APPLICABLE", "UNKNOWN", 0)),
    "conflict": jcp_fields(_conflicts=["title"]),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = rules.coherence_results(records_frame(spark, RULE_CASES)).select(
        "document_id", "validations_dates", "validations_financial", "validations_event").collect()
    return {
        (r.document_id, g): [(v.rule, v.status, v.expected, v.observed) for v in r[f"validations_{g}"]]
        for r in rows for g in ("dates", "financial", "event")
    }


def test_dates_in_order_pass(results):
    assert [r[:2] for r in results["good", "dates"]] == [
        ("DATE_APPROVAL_AFTER_RECORD", "PASS"), ("DATE_RECORD_NOT_BEFORE_EX", "PASS"), ("DATE_PAYMENT_BEFORE_RECORD", "PASS")]


def test_dates_out_of_order_fail(results):
    got = results["late", "dates"]
    assert [r[1] for r in got] == ["FAIL"] * 3
    assert got[0][3] == "2026-06-20 > 2026-06-16" and got[1][3] == "2026-06-16 / 2026-06-16"


def test_payment_date_rules_only_for_cash_events(results):
    assert ("DATE_PAYMENT_NOT_DISCLOSED", "WARN") in [r[:2] for r in results["open", "dates"]]
    assert len(results["open split", "dates"]) == 2
    assert results["no event", "dates"] == []


def test_money_tolerance_is_inclusive(results):
    for case, rule, status in (("good", "CONSISTENT", "PASS"), ("edge", "CONSISTENT", "PASS"), ("over", "MISMATCH", "FAIL")):
        got = results[case, "financial"]
        assert [r[:3] for r in got] == [(f"FIN_GROSS_NET_TAX_{rule}", status, "0.1434196500000")]


def test_expected_net_is_printed_with_its_own_scale(results):
    assert results["short", "financial"][0][2:] == ("0.143419650", "0.14341965")
    assert results["ten", "financial"][0][2] == "1.8"


def test_beneficiary_tax(results):
    assert [r[0] for r in results["disclosed", "financial"]] == [
        "FIN_TAX_DEPENDS_ON_BENEFICIARY", "FIN_TAX_CONDITIONAL_NET_DISCLOSED", "FIN_GROSS_NET_TAX_CONSISTENT"]
    assert [r[:2] for r in results["derived", "financial"]] == [
        ("FIN_TAX_DEPENDS_ON_BENEFICIARY", "WARN"), ("FIN_UNIVERSAL_NET_NOT_APPLICABLE", "FAIL")]


def test_currency_and_ratio(results):
    got = results["ratio", "financial"]
    assert [r[0] for r in got] == ["FIN_CURRENCY_MISSING", "FIN_RATIO_INVALID"]
    assert got[1][3] == "0:1 (NEW_PER_EXISTING)"


def test_event_rules(results):
    assert [r[0] for r in results["no event", "event"]] == ["EVENT_UNKNOWN"]
    got = results["missing", "event"]
    assert [r[0] for r in got] == ["EVENT_CLASSIFICATION_SUPPORTED", "EVENT_REQUIRED_FIELD_MISSING"]
    assert got[1][2] == "ex_date"
    assert results["conflict", "event"][0][3] == '["title"]'


def test_rounding_of_every_quality_and_agreement(spark):
    qualities = [100, 95, 92, 78, 75, 60, 20]
    cells = list(itertools.product(qualities, range(101)))
    frame = spark.createDataFrame(cells, "q int, a int").select(
        "q", "a", F.expr("cast(bround(q * 0.7D + a * 0.3D, 0) as int) as r"))
    assert all(r.r == round(r.q * 0.7 + r.a * 0.3) for r in frame.collect())


def test_field_confidence(spark):
    fields = jcp_fields(
        ticker=given("ALFA3", method="OCR"), record_date=given("2026-06-16", status="CONFLICT"),
        payment_date=given(None, 0, status="NOT_DISCLOSED"), credit_date=(None, "NOT_APPLICABLE", "UNKNOWN", 0),
        listing_segment=("n", "REFERENCE_ENRICHED", "REFERENCE", 0), share_class=("ON", "REFERENCE_ENRICHED", "UNKNOWN", 0),
    )
    record = rules.attach(
        record_frame(spark, fields, reference_validation=REF.format(exact="true"),
                     validations=f"cast(array(named_struct('rule', 'FIN_CURRENCY_MISSING', 'status', 'FAIL', 'message', 'm', "
                                 f"'expected', null, 'observed', null)) as array<{rules.RESULT}>)",
                     agreement="map('issuer.name', 50, 'security.share_class', 50)"))
    r = confidence.field_confidence(record, "agreement").first()
    assert r.issuer_name.confidence == round(92 * 0.7 + 50 * 0.3) and r.issuer_name.agent_agreement == 50
    assert (r.isin.confidence, r.ticker.confidence, r.record_date.confidence) == (92, 78, 10)
    assert (r.payment_date.confidence, r.credit_date.confidence, r.currency.confidence) == (60, 100, 15)
    assert (r.listing_segment.confidence, r.share_class.confidence, r.ratio.confidence) == (95, 20, 0)


EXHAUSTED = [("STRONG_LLM", "INSUFFICIENT", 1, None, ["x"], None)]
CASES = {
    "good": jcp_fields(),
    "open": jcp_fields(payment_date=OPEN),
    "late": jcp_fields(approval_date=given("2026-06-20")),
    "exhausted": jcp_fields(ticker=given("ZZZZ3"), _attempts=EXHAUSTED),
    "unknown": {"isin": given("BRALFAACNOR1")},
    "failed": jcp_fields(_error="day is out of range for month"),
    "inactive": jcp_fields(isin=given("BRGAMAACNOR3"), issuer_cnpj=given("11.111.111/0001-11"), ticker=given("GAMA3"),
                           issuer_name=given("Gama Inativa S.A.")),
}


@pytest.fixture(scope="module")
def decided(spark, tmp_path_factory):
    golden = rc.prepare_golden(golden_frame(spark))
    records = pipeline.decide(records_frame(spark, CASES), golden)
    return pipeline.store(records, str(tmp_path_factory.mktemp("records") / "t"))


@pytest.fixture(scope="module")
def rows(decided):
    return {r.document_id: r for r in decided.collect()}


def test_complete_notice_is_accepted(rows):
    r = rows["good"]
    assert r.processing_status == "ACCEPTED" and r.exceptions == []
    assert r.document_confidence.score == 92 and r.document_confidence.missing_fields == []


def test_open_payment_date_is_pending(rows):
    assert rows["open"].processing_status == "PENDING_INFORMATION"
    assert [e.code for e in rows["open"].exceptions] == ["PAYMENT_DATE_NOT_DISCLOSED"]


def test_date_failure_gives_rule_and_confidence_reasons(rows):
    got = rows["late"].exceptions
    assert [e.code for e in got] == ["DATE_SEQUENCE_INCONSISTENT"] + ["CRITICAL_FIELD_CONFIDENCE_BELOW_THRESHOLD"] * 2
    assert got[1].message == "Critical field confidence is below 75%: dates.approval_date (15%)."


def test_exhausted_attempts_conflict_and_unknown_event(rows):
    codes = [e.code for e in rows["exhausted"].exceptions]
    assert codes[:2] == ["EXTRACTION_CASCADE_EXHAUSTED", "REFERENCE_IDENTIFIER_CONFLICT"]
    assert rows["unknown"].processing_status == "REVIEW_REQUIRED"
    assert rows["unknown"].exceptions[0].code == "EVENT_CLASSIFICATION_AMBIGUOUS"


def test_technical_failure(rows):
    assert rows["failed"].processing_status == "FAILED"
    assert [(e.code, e.category) for e in rows["failed"].exceptions] == [("PROCESSING_FAILED", "TECHNICAL_ERROR")]


def test_inactive_asset_is_a_rule_without_a_reason(rows):
    assert "REF_ASSET_INACTIVE" in [v.rule for v in rows["inactive"].validations]
    assert rows["inactive"].processing_status == "ACCEPTED" and rows["inactive"].asset_status.confidence == 15


def test_approval_only_for_reviews(spark, decided):
    ids = [("exhausted",), ("good",), ("nope",)]
    approvals = spark.createDataFrame(ids, "document_id string").withColumn("approved_at", F.current_timestamp())
    updated, refused = routing.apply_approvals(decided, approvals)
    r = updated.where("document_id = 'exhausted'").first()
    assert r.processing_status == "ACCEPTED" and r.manual_review.approved and not r.review.required
    assert r.manual_review.previous_status == "REVIEW_REQUIRED"
    assert r.manual_review.acknowledged_reasons == r.review.reasons and r.exceptions
    assert sorted(x.document_id for x in refused.collect()) == ["good", "nope"]


def test_decision_lists_are_generated_code(spark):
    # A filter of nulls out of a built array is evaluated as a tree of objects for every record.
    golden = rc.prepare_golden(golden_frame(spark))
    decided = pipeline.decide(records_frame(spark, CASES), golden).select("exceptions", "document_confidence")
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(" in plan
    assert "filter(array(" not in plan and "filter(CASE" not in plan and "filter(concat(array(" not in plan


def test_material_fields_of_a_score(rows):
    for r in rows.values():
        known = r.document_confidence
        assert sorted([*known.resolved_fields, *known.missing_fields]) == sorted(known.required_fields)
        assert known.completion_percentage == round(100 * len(known.resolved_fields) / len(known.required_fields))
    assert len(rows["good"].document_confidence.required_fields) == 10
    assert rows["unknown"].document_confidence.missing_fields[:1] == ["corporate_action.event_type"]


def test_case_partners_outside_ascii(spark):
    words = spark.createDataFrame([("\u0130\u0131\u017f\u212aK A\u00c7\u00c3O",)], ["w"])
    assert words.select(text.caseless(F.col("w"))).first()[0] == "iiskk a\u00e7\u00e3o"
