"""Registered queries against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from conftest import DATA
from tieline.plans.queries import ORACLE, QUERIES

CHEAP = ["p2_code_roundtrip", "p3_hash_sample", "t1_fold", "t3_tokens", "t8_lexicon", "t9_core", "t15_numbers", "t16_deletes", "t11_name_bag", "t13_addr_bag", "j3_vector_topk", "l4_lexicon_counts", "l5_noise_counts"]


def rows_of(columns, rows):
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return Counter(tuple(clean(r[columns[c]]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer", "part", "nation", "region", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = {d[0]: k for k, d in enumerate(want.description)}
    found = QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert rows_of({c: k for k, c in enumerate(found.columns)}, found.collect()) == rows_of(columns, want.fetchall())


def test_entry_and_registry(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).where("segment = 'ALL'").first()["f05"] > 0.5
