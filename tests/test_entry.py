import duckdb
import pytest

import __spark_entry__ as entry
from driftline.plans import queries as plans

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.ORACLES) <= set(plans.QUERIES)


#: Every query with SQL, less those that do the same as another one at a higher price.
SLOW = {"greedy_lazy", "greedy_alpha", "components", "component_sizes", "initial_influence", "graph_supp_part", "graph_cust_supp", "weights_uic", "load_bin_two_block"}


@pytest.mark.parametrize("name", sorted(set(plans.ORACLES) - SLOW))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
