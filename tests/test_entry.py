import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
QUICK = ["t5_align_by_begin", "t10_gap_ranges", "a1_noise_mad", "v3_discontinuities", "q2_segment_qc", "p2_raw_peaks", "p7_refractory_dedup", "r11_previous_main", "g5_clean_summary"]


def test_contract(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as E
    from oracle_check import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert compare(E.queries()[name](spark, SF), con.execute(E.oracle_sql()[name]).df()) == "ok"
