"""Every query with SQL gives the same rows as DuckDB on the smallest tables, in one partition or many."""

import duckdb
import pytest
from ledgerloom import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    want = duck.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows_of(df) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["g1_multiset_dedupe", "v1_row_findings", "c5_offer_months", "g6_payment_cadence", "j2_reciprocal_transfers"])
def test_number_of_partitions_does_not_matter(spark, name):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(rows_of(registry.QUERIES[name](spark, SMALL)))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert out[0] == out[1]
