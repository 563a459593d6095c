import unicodedata

from pyspark.sql import functions as F

from noticemill.functions import numbers, text


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in rows.select("i", expression(F.col("s")).alias("o")).orderBy("i").collect()]


def test_issuer_ignores_accents_case_and_suffix_spelling(spark):
    got = column(
        spark,
        ["Energética Vale do Tietê S.A.", "ENERGETICA VALE DO TIETE SA", "Foo Ltda.", "S . A . Bar", None, "  "],
        text.normalize_issuer,
    )
    assert got == ["energetica vale do tiete sa"] * 2 + ["foo ltda", "sa bar", None, None]


def test_cnpj_keeps_leading_zeros(spark):
    assert column(spark, ["08.777.666/0001-33", "--", None], text.normalize_cnpj) == ["08777666000133", None, None]


def test_codes_are_upper_case_letters_and_digits(spark):
    assert column(spark, [" br tiet-3 ", "é"], text.normalize_code) == ["BRTIET3", None]


def test_share_class_aliases(spark):
    got = column(spark, ["Ação Ordinária", "pn", "Preferencial B", "units", "classe x"], text.normalize_share_class)
    assert got == ["ON", "PN", "PNB", "UNIT", "CLASSE_X"]


def test_text_matches_unicode_rule_for_every_code_point(spark):
    points = [chr(c) for c in range(0x20, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    points += [chr(c) for c in range(0xFB00, 0xFB07)] + ["𝐀", "𝟗", "ｋ", "①", "㎏"]

    def rule(value):
        plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).casefold()
        words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split()
        return " ".join(words) or None

    values = [f"x{p}y" for p in points]
    assert column(spark, values, text.normalize_text) == [rule(v) for v in values]


def test_strip_accents(spark):
    values = ["Ação", "ﬁm ½", "éx", "plain", "ª º"]
    expected = ["".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values]
    assert column(spark, values, text.strip_accents) == expected


def test_strip_removes_unicode_space(spark):
    assert column(spark, ["  a b \n"], text.strip) == ["a b"]


def test_safe_file_name(spark):
    got = column(spark, ["Ação (1).PDF", "..pdf", "日本.pdf", "a" * 200 + ".pdf"], text.safe_file_name)
    # A name that is only a suffix keeps it as its stem.
    assert got == ["Acao_1.pdf", "document.pdf", "pdf.pdf", "a" * 100 + ".pdf"]


def test_decimal_text(spark):
    from decimal import Decimal

    values = ["0.000000850", "0.0000000", "1.50", "0.000001", "-0.00000001", "12", "0"]
    assert column(spark, values, numbers.decimal_text) == [str(Decimal(v)) for v in values]


def test_plain_text_writes_exponents_out(spark):
    from decimal import Decimal

    values = ["0.000000850", "0.0000000", "1.50", "-0.00000001", "12", "0", "2:1 (NEW_PER_EXISTING)"]
    printed = [v if "(" in v else str(Decimal(v)) for v in values]
    assert "0E-7" in printed and column(spark, printed, numbers.plain_text) == values
