import json

from helpers import pages_frame
from noticemill import vocab
from noticemill.operators.extraction import extract_field, extract_notice

HEAD = """VALE DO IPÊ ENERGIA S.A.
Companhia aberta, CNPJ 07.318.254/0001-90
O conselho propõe dividendos intercalares aos titulares de VIPE3, código ISIN BRVIPEACNOR1."""

TERMS = """Data de aprovação pelo conselho: 09/04/2025
Data-base para o direito
12/05/2025
Valor líquido por ação ordinária: R$ 1,37
Data de pagamento prevista 30/05/2025"""


def notices(spark, *pages):
    return {r.document_id: r for r in extract_notice(pages_frame(spark, list(pages))).collect()}


def test_fields_of_two_pages_inline_and_on_separate_lines(spark):
    r = notices(spark, ("a", 1, HEAD), ("a", 2, TERMS))["a"]
    first = {"issuer_name": "VALE DO IPÊ ENERGIA S.A.", "issuer_cnpj": "07.318.254/0001-90", "event_type": "DIVIDEND",
             "ticker": "VIPE3", "isin": "BRVIPEACNOR1"}
    second = {"approval_date": "2025-04-09", "record_date": "2025-05-12", "payment_date": "2025-05-30",
              "net_amount_per_share": "1.37", "share_class": "ON"}
    for page, fields in ((1, first), (2, second)):
        for name, value in fields.items():
            assert (r[name].value, r[name].sources[0].page) == (value, page), name
    assert r.currency.value == "BRL" and r.page_count == 2 and r.error is None
    assert {r[name].status for name in ("ex_date", "gross_amount_per_share", "ratio")} == {"UNKNOWN"}


def test_narrative_approval_and_upper_case(spark):
    text = "VALE DO IPÊ ENERGIA S.A.\nFica deliberado em REUNIÃO realizada em 19 de AGOSTO de 2025:\nVALOR LÍQUIDO POR AÇÃO R$ 2.075,40"
    r = notices(spark, ("a", 1, text))["a"]
    assert r.approval_date.value == "2025-08-19"
    assert r.net_amount_per_share.value == "2075.40"


def test_first_page_wins_but_jcp_overrides(spark):
    r = notices(
        spark,
        ("a", 1, "Aviso de Dividendos\nData-base 01/02/2026", "OCR"),
        ("a", 2, "Juros sobre capital próprio\nData-base 03/02/2026\nData de pagamento será oportunamente divulgada."),
        ("a", 3, "juros sobre o capital proprio\nData de pagamento 09/09/2026"),
    )["a"]
    assert r.event_type.value == "JCP" and r.event_type.sources[0].page == 3
    assert r.classification_evidence[0].supports == "DIVIDEND" and len(r.classification_evidence) == 1
    assert r.record_date.value == "2026-02-01" and r.record_date.sources[0].extraction_method == "OCR"
    assert r.payment_date.status == "NOT_DISCLOSED" and r.payment_date.value is None
    assert r.extraction_methods == ["OCR", "NATIVE_TEXT"] and r.page_count == 3


def test_ratio_orientation_follows_the_event_known_so_far(spark):
    found = notices(
        spark,
        ("rev", 1, "Grupamento de ações\nProporção 10:1"),
        ("late", 1, "Proporção 10:1"),
        ("late", 2, "Grupamento de ações"),
        ("bonus", 1, "Bonificação em ações\nProporção 1 ação nova para cada 20 ações (5,5%)"),
    )
    assert json.loads(found["rev"].ratio.value) == {
        "kind": "RESULTING_PER_EXISTING", "numerator": "1", "denominator": "10", "percentage": None}
    assert json.loads(found["late"].ratio.value)["numerator"] == "10"
    assert json.loads(found["bonus"].ratio.value) == {
        "kind": "NEW_PER_EXISTING", "numerator": "1", "denominator": "20", "percentage": "5.5"}


def test_impossible_dates_fail_the_document(spark):
    found = notices(
        spark,
        ("day", 1, "Data-base 31/02/2024"),
        ("month", 1, "Data de pagamento 01/13/2024"),
        ("second", 1, "Data-base 01/02/2024"),
        ("second", 2, "Data-base 31/02/2024"),
        ("name", 1, "em reunião realizada em 2 de foo de 2024"),
        ("unused", 1, "Data de aprovação 01/02/2024"),
        ("unused", 2, "em reunião realizada em 2 de foo de 2024"),
    )
    assert found["day"].error == "day is out of range for month"
    assert found["month"].error == "month must be in 1..12"
    assert found["second"].error == "day is out of range for month"
    assert found["name"].error == "'foo'"
    assert found["unused"].error is None


def test_tax_credit_fraction_and_cost(spark):
    text = (
        "Crédito das ações bonificadas 05/06/2026\nPeríodo de ajuste de frações\n01/07/2026 a 31/07/2026\n"
        "Custo atribuído R$ 7,82\nA alíquota depende\nda condição do beneficiário. Retenção de Imposto de Renda na fonte \n"
        "IRRF na fonte 17,5%"
    )
    r = notices(spark, ("a", 1, text))["a"]
    assert r.credit_date.value == "2026-06-05"
    assert (r.fraction_period_start.value, r.fraction_period_end.value) == ("2026-07-01", "2026-07-31")
    assert r.attributed_cost_per_share.value == "7.82" and r.currency.value == "BRL"
    assert r.tax_treatment.value == "TAX_DEPENDS_ON_BENEFICIARY"
    assert r.tax_rate_percent.value == "17.5"


def test_pattern_literals_are_necessary(spark):
    """A page holding a match always holds one of the pattern's literals."""
    import re

    text = (HEAD + "\n" + TERMS + "\nJuros sobre o capital próprio (PN)\nData ex-direito 13/05/2025\nValor bruto por ação R$ 2,00\nCrédito das ações bonificadas 05/06/2026\nProporção 2:1\n"
            "Valor líquido por ação R$ 0,10\nIRRF na fonte 15%").upper()
    for name, literals in vocab.PATTERN_LITERALS.items():
        if name in vocab.CASE_SENSITIVE or name not in vocab.PATTERNS:
            continue
        pattern = vocab.PATTERNS[name].replace("U)", ")", 1)
        if re.search(pattern, text, re.I):
            assert any(literal in text.lower() for literal in literals), name


def test_single_field_uses_only_its_patterns(spark):
    frame = extract_field(pages_frame(spark, [("a", 1, HEAD)]), "isin")
    row = frame.first()
    assert (row.value, row.status, row.page) == ("BRVIPEACNOR1", "EXTRACTED", 1)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 2
