import pytest

from helpers import golden_frame
from noticemill.sources.golden import check_golden, golden_duplicates, read_golden

HEADER = "emissor,cnpj,isin,ticker,classe,segmento_listagem,status\n"


def write(tmp_path, text):
    path = tmp_path / "golden.csv"
    path.write_text(text, encoding="utf-8-sig")
    return str(path)


def test_reads_trimmed_rows_with_byte_order_mark(spark, tmp_path):
    path = write(tmp_path, HEADER + " Alfa S.A. ,1,BRA,ALFA3,ON,Novo, ativo\n")
    row = read_golden(spark, path).first()
    assert row.issuer == "Alfa S.A." and row.status == "ativo" and row.listing_segment == "Novo"


def test_missing_columns_are_listed_sorted(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns: classe, segmento_listagem, status"):
        read_golden(spark, write(tmp_path, "emissor,cnpj,isin,ticker\na,b,c,d\n"))


def test_empty_file(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        read_golden(spark, write(tmp_path, HEADER))


def test_duplicates_after_normalisation(spark):
    rows = golden_frame(spark).collect()
    twice = golden_frame(spark, [tuple(r) for r in rows] + [(9, "X", "1", " bralfaacnor1", "XXXX3", "ON", "n", "ativo")])
    assert [tuple(r) for r in golden_duplicates(twice).collect()] == [("isin", "BRALFAACNOR1", 2)]
    with pytest.raises(ValueError, match="duplicate isin"):
        check_golden(twice)
