"""Literal inputs shared by the tests."""

from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.operators.consensus import ATTEMPT
from noticemill.operators.extraction import CONFLICTS, SIGNALS, SOURCES

GOLDEN_ROWS = [
    (0, "Companhia Alfa S.A.", "12.345.678/0001-90", "BRALFAACNOR1", "ALFA3", "ON", "Novo Mercado", "ativo"),
    (1, "Beta Energética S.A.", "98.765.432/0001-10", "BRBETAACNPR2", "BETA4", "PN", "Nível 1", "ativo"),
    (2, "Gama Inativa S.A.", "11.111.111/0001-11", "BRGAMAACNOR3", "GAMA3", "ON", "Nível 2", "inativo"),
]


def golden_frame(spark, rows=GOLDEN_ROWS):
    return spark.createDataFrame(rows, ["position", *vocab.GOLDEN_COLUMNS])


def pages_frame(spark, rows):
    """rows: (document_id, page_number, text[, method])."""
    full = [(r[0], r[1], r[2], r[3] if len(r) > 3 else "NATIVE_TEXT") for r in rows]
    return spark.createDataFrame(full, "document_id string, page_number int, text string, extraction_method string")


FIELD = f"struct<value:string,status:string,origin:string,sources:{SOURCES}>"
ATTEMPTS = f"array<{ATTEMPT}>"
RECORD_SCHEMA = (
    "document_id string, " + ", ".join(f"{n} {FIELD}" for n, _ in vocab.FIELDS)
    + f", classification_evidence {SIGNALS}, classification_conflicts {CONFLICTS}, error string, "
    f"extraction_attempts {ATTEMPTS}"
)
SIGNAL = ("JCP", "term", (1, "juros", "NATIVE_TEXT"))


def records_frame(spark, cases):
    """One record per case; fields: name -> (value, status, origin, n_sources[, method]).

    Extra keys: _error, _conflicts (descriptions), _attempts (rows).
    """
    rows = []
    for document, fields in cases.items():
        row = [document]
        for name, _ in vocab.FIELDS:
            value, status, origin, n, *method = fields.get(name, (None, "UNKNOWN", "UNKNOWN", 0))
            row.append((value, status, origin, [(1, "e", method[0] if method else "NATIVE_TEXT")] * n))
        conflicts = [(c, [SIGNAL, SIGNAL]) for c in fields.get("_conflicts", [])]
        rows.append((*row, [], conflicts, fields.get("_error"), fields.get("_attempts", [])))
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def record_frame(spark, fields, **extra):
    return records_frame(spark, {"doc": fields}).withColumns({k: F.expr(v) for k, v in extra.items()})


def given(value, n=1, method="NATIVE_TEXT", status="EXTRACTED"):
    return (value, status, "DOCUMENT", n, method)


def jcp_fields(**changes):
    fields = {
        "issuer_name": given("Companhia Alfa S.A."),
        "issuer_cnpj": given("12.345.678/0001-90"),
        "isin": given("BRALFAACNOR1"),
        "ticker": given("ALFA3"),
        "share_class": given("ON"),
        "event_type": given("JCP"),
        "approval_date": given("2026-06-02"),
        "record_date": given("2026-06-16"),
        "ex_date": given("2026-06-17"),
        "payment_date": given("2026-07-01"),
        "gross_amount_per_share": given("0.1738420000"),
        "net_amount_per_share": given("0.1434196500"),
        "tax_rate_percent": given("17.5"),
        "currency": given("BRL"),
    }
    fields.update(changes)
    return fields
