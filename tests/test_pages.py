from helpers import pages_frame
from noticemill import vocab
from noticemill.operators import grounding, pages as page_ops
from noticemill.sources.pages import as_pages
from pyspark.sql import functions as F


def test_gate_counts_without_any_whitespace(spark):
    frame = pages_frame(spark, [("a", 1, "x" * 79 + " \n"), ("b", 1, "x " * 80)])
    got = {r.document_id: r.extraction_method for r in page_ops.native_text_gate(frame).collect()}
    assert got == {"a": "OCR", "b": "NATIVE_TEXT"}


def test_best_variant(spark):
    rows = [("a", 1, 1, "ab cde", "n"), ("a", 1, 2, "abcde", "n"), ("a", 1, 3, "abcde �", "n"), ("b", 1, 1, " ", " native "),
            ("c", 1, 1, "same", "n"), ("c", 1, 2, "emas", "n")]
    frame = spark.createDataFrame(rows, "document_id string, page_number int, variant_no int, text string, native_text string")
    got = {r.document_id: r for r in page_ops.best_variant(frame).collect()}
    assert got["a"].text == "ab cde" and got["c"].text == "same"
    assert got["b"].text == "native" and got["b"].warnings == ["Page 1 remained unreadable after OCR."]


def test_rollup_and_assembly(spark):
    frame = pages_frame(spark, [("a", 2, "second ", "NATIVE_TEXT"), ("a", 1, "first", "OCR"), ("a", 3, "t", "OCR")]).withColumn(
        "warnings", F.array(F.concat(F.lit("w"), F.col("page_number"))))
    r = page_ops.rollup_pages(frame).first()
    assert (r.page_count, r.extraction_methods, r.warnings) == (3, ["OCR", "NATIVE_TEXT"], ["w1", "w2", "w3"])
    assert page_ops.assemble_text(frame).first().text == (
        "--- PAGE 1 [OCR] ---\nfirst\n\n--- PAGE 2 [NATIVE_TEXT] ---\nsecond\n\n--- PAGE 3 [OCR] ---\nt")


def budgeted(texts, start, end, budget):
    end = end or len(texts)
    pages, remaining, truncated = [], budget, False
    for n in range(start, end + 1):
        text = texts[n - 1]
        if len(text) > remaining:
            text, truncated = text[:remaining], True
        pages.append((n, text))
        remaining -= len(text)
        if remaining <= 0:
            truncated = n < end or truncated
            break
    return pages, truncated


def test_budget_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(page_ops, "PAGE_BLOCK", 3)
    documents = {str(d): ["x" * ((d * 7 + p * 5) % 13) for p in range(1, 9)] for d in range(20)}
    frame = pages_frame(spark, [(d, i + 1, t) for d, ts in documents.items() for i, t in enumerate(ts)])
    for start, end, budget in ((1, 0, 20), (2, 5, 14), (1, 8, 48), (3, 3, 6)):
        rows = page_ops.slice_pages(frame, start, end, budget).collect()
        for d, texts in documents.items():
            mine = sorted((r.page_number, r.text) for r in rows if r.document_id == d)
            pages, truncated = budgeted(texts, start, end, budget)
            assert mine == pages, (d, start, end, budget)
            assert {r.truncated for r in rows if r.document_id == d} == {truncated}


def test_bad_ranges_are_reported(spark):
    frame = pages_frame(spark, [("a", 1, "x"), ("a", 2, "y")])
    assert page_ops.slice_pages(frame, 1, 3).first().error == "Página 3 inválida; o PDF possui 2 página(s)"
    assert page_ops.slice_pages(frame, 2, 1).first().error == "page_end deve ser maior ou igual a page_start"


def test_words_and_weak_pages(spark):
    frame = pages_frame(spark, [("a", 1, " one two\tthree "), ("b", 1, "short", "OCR")]).withColumn(
        "warnings", F.array().cast("array<string>"))
    got = page_ops.page_words(frame.where("document_id = 'a'"), 2).first()
    assert got.words == ["one", "two"] and got.truncated
    assert [r.document_id for r in page_ops.weak_ocr(frame).collect()] == ["b"]


def fields(spark, rows):
    return spark.createDataFrame(
        rows, "document_id string, path string, value string, status string, sources array<struct<page:int,evidence:string>>")


def test_grounding(spark):
    pages = pages_frame(spark, [("d", 1, "Companhia ÁGUAS do Norte\nTicker ABCD3", "OCR")])
    rows = fields(spark, [
        ("d", "issuer.name", "x", "EXTRACTED", [(1, " aguas  do norte "), (1, "invented"), (2, "aguas")]),
        ("d", "security.isin", "x", "EXTRACTED", [(1, "invented")]),
        ("d", "security.ticker", None, "UNKNOWN", []),
        ("d", "issuer.cnpj", None, "NOT_APPLICABLE", [(1, "---")]),
    ])
    got = {r.path: r for r in grounding.ground(rows, pages).collect()}
    assert [(s.page, s.evidence, s.extraction_method) for s in got["issuer.name"].sources] == [(1, "aguas  do norte", "OCR")]
    assert (got["issuer.name"].status, got["issuer.name"].origin) == ("EXTRACTED", "DOCUMENT")
    assert (got["security.isin"].status, got["security.isin"].sources) == ("AMBIGUOUS", [])
    assert (got["security.ticker"].status, got["security.ticker"].origin) == ("UNKNOWN", "UNKNOWN")
    assert got["issuer.cnpj"].status == "AMBIGUOUS"
    wide = grounding.widen(grounding.ground(rows, pages)).first()
    assert wide.issuer_name.value == "x" and wide.ratio.status == "UNKNOWN"


def test_conflicts_need_two_grounded_signals(spark):
    pages = pages_frame(spark, [("d", 1, "dividendo e juros")])
    schema = ("document_id string, conflict_no int, description string, signal_no int, supports string, rationale string, "
              "page int, evidence string")
    rows = [("d", 1, "a", 1, "DIVIDEND", "r", 1, "Dividendo"), ("d", 1, "a", 2, "JCP", "r", 1, "JUROS"),
            ("d", 2, "b", 1, "DIVIDEND", "r", 1, "dividendo"), ("d", 2, "b", 2, "JCP", "r", 1, "invented")]
    assert [r.conflict_no for r in grounding.ground_conflicts(spark.createDataFrame(rows, schema), pages).collect()] == [1]


def test_pages_are_stripped(spark):
    frame = as_pages(spark.createDataFrame([(1, 1, "  a b ")], "d long, p int, t string"), "d", "p", "t")
    r = frame.first()
    assert (r.text, r.native_text_length) == ("a b", 2)
