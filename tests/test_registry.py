"""A sample of registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from verify import rows_of
from thermograph.plans.adapters import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["E19_evaluate_scenarios", "E5_orientation_loads", "F9_validate_scenarios", "N2_parse_value_unit", "C1_fine_classify", "C2_thermal_hit_classify", "W2_merge_collinear",
          "W6_exterior_gaps", "J5_dimension_line_match", "J9_intersections", "A16_scale_calibration", "M1_upsert", "M3_insert_ignore", "S6_html_links", "X8_items_from_table_rows"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 200


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    got = rows_of(E.queries()[name](spark, SF).toArrow())
    want = rows_of(con.execute(E.oracle_sql()[name]).to_arrow_table())
    assert got == want


def test_entry(spark):
    assert E.entry(spark).limit(5).count() == 5
