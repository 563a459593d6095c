"""Extraction passes through to routed records."""

import pytest
from helpers import golden_frame, pages_frame
from noticemill import vocab
from noticemill.operators import reconciliation as rc
from noticemill.plans import pipeline
from pyspark.sql import functions as F

TEXT = "Companhia Alfa S.A.\nCNPJ/ME nº 12.345.678/0001-90\nAviso de Dividendos\nALFA3 (ISIN BRALFAACNOR1)\nData-base 02/03/2026\nData ex 03/03/2026"
PASS = ("document_id string, pass_no int, path string, value string, status string, sources array<struct<page:int,evidence:string>>")


def said(document, number, **values):
    return [(document, number, vocab.PATH_OF[name], value, "EXTRACTED", [(1, evidence)]) for name, (value, evidence) in values.items()]


@pytest.fixture(scope="module")
def processed(spark):
    pages = pages_frame(spark, [("both", 1, TEXT), ("none", 1, TEXT), ("wild", 1, TEXT), ("odd", 1, "Gamma Energetica SA", "OCR")])
    pages = pages.withColumn("warnings", F.array().cast("array<string>"))
    rows = []
    for n in (1, 2, 3):
        rows += said("both", n, isin=("BRALFAACNOR1", "ISIN BRALFAACNOR1"), event_type=("DIVIDEND", "Aviso de Dividendos"),
                     ticker=("ALFA3", "alfa3"), issuer_name=("Companhia Alfa S.A.", "COMPANHIA ALFA S.A."))
        # What no page says is not evidence; the third pass contradicts the ISIN.
        rows += said("wild", n, event_type=("JCP", "never written"), ticker=("ZZZZ9", "nor this"), isin=("BRALFAACNOR1" if n < 3 else "BRBETAACNPR2", "BRALFAACNOR1"))
    rows += said("odd", 1, issuer_name=("Betta Energetica SA", "Gamma Energetica SA"))
    failures = spark.createDataFrame([("both", 4, "provider down")], "document_id string, pass_no int, error string")
    signals = spark.createDataFrame(
        [("both", 1, 0, "DIVIDEND", "term", 1, "Aviso de Dividendos"), ("both", 2, 0, "DIVIDEND", "term", 1, "Aviso de Dividendos"),
         ("both", 2, 1, "JCP", "term", 1, "juros sobre capital")],
        "document_id string, pass_no int, idx int, supports string, rationale string, page int, evidence string")
    records = pipeline.process(pages, rc.prepare_golden(golden_frame(spark)), spark.createDataFrame(rows, PASS), failures, suggest=True, signals=signals)
    return {r.document_id: r for r in records.collect()}


def test_one_record_for_each_document(processed):
    assert set(processed) == {"both", "none", "wild", "odd"}


def test_merged_passes_are_grounded_and_compared(processed):
    r = processed["both"]
    assert (r.isin.value, r.isin.status, r.isin.agent_agreement) == ("BRALFAACNOR1", "EXTRACTED", 100)
    assert r.isin.sources[0].extraction_method == "NATIVE_TEXT" and len(r.isin.sources) == 1
    assert r.reference_validation.exact_match and r.issuer_cnpj.status == "REFERENCE_ENRICHED"
    assert [a.strategy for a in r.extraction_attempts][:3] == ["BASIC_LLM"] * 3
    assert r.extraction_attempts[3].outcome == "ERROR" and r.extraction_attempts[3].error == "provider down"
    assert [s.supports for s in r.classification_evidence] == ["DIVIDEND"]
    checks = {c.code: c.passed for c in r.preliminary_checks}
    assert checks["AGENT_CONSENSUS"] and checks["EVIDENCE_GROUNDING"] and not checks["REQUIRED_FIELDS"]


def test_contradictions_and_unfounded_values(processed):
    r = processed["wild"]
    assert r.isin.status == "CONFLICT" and r.isin.agent_agreement == 67
    assert r.event_type.status == "AMBIGUOUS" and r.event_type.sources == []
    # The golden row of the ISIN has another ticker.
    assert r.ticker.status == "CONFLICT" and r.ticker.sources == []
    assert not {c.code: c.passed for c in r.preliminary_checks}["AGENT_CONSENSUS"]


def test_documents_without_passes_fall_back_to_patterns(processed):
    r = processed["none"]
    assert r.isin.value == "BRALFAACNOR1" and [a.strategy for a in r.extraction_attempts] == ["PYTHON"]
    assert r.preliminary_checks == [] and r.isin.agent_agreement is None


def test_similar_names_are_suggested(processed):
    assert [x.issuer for x in processed["odd"].reference_validation.possible_matches] == ["Beta Energética S.A."]
    assert processed["both"].reference_validation.possible_matches == []
