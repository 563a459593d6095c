"""Registered queries against their SQL statement, smallest test set."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
# The flagship, the heavy operators and one query per operator family; check.py runs all of them.
CHOSEN = [
    "scan_golden", "golden_duplicates", "unique_file_name", "upload_disposition", "registry_replay", "selection_dedup",
    "page_range_slice", "normalize_text", "canonical_value", "extract_isin", "agreement_scores", "reference_lookup",
    "process_notices", "extract_notice", "merge_passes", "ground_evidence", "stream_registry", "rule_gross_net_tax",
    "admission_batch_gate", "field_confidence", "fuzzy_candidates", "reference_matches", "stream_report",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


def test_every_query_has_a_statement():
    own = {name for name in queries() if not name.startswith("op") and name != "pipeline"}
    assert own <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, SF, name).startswith("ok")


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["rule_gross_net_tax", "rule_beneficiary_tax", "validate_records"])
def test_amounts_of_zero_and_below_a_millionth_equal_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for table, rows in (("orders", f"(select * from '{SF}/orders.parquet' order by o_orderkey limit 3)"), ("supplier", f"'{SF}/supplier.parquet'")):
        price = "replace (cast(10000 + o_orderkey / 100 as double) as o_totalprice)" if table == "orders" else ""
        con.execute(f"copy (select * {price} from {rows}) to '{tmp_path}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    assert compare(spark, con, str(tmp_path), name).startswith("ok")
