"""A sample of registered queries beside their SQL; check_oracle.py runs all of them."""

import duckdb
import pytest

import check_oracle
from netloom.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["A07_A08_A09_wiring_metrics", "J26_same_family_overlaps", "J04_match_boxes", "J14_O04_nearest_junction", "J15_port_fallback",
          "J19_sight_lines", "G06_final_groups", "F14_first_json", "W11_exact_split", "J08_nearest_text"]


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert check_oracle.rows_of(df.collect(), df.columns) == check_oracle.rows_of(cur.fetchall(), names)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
