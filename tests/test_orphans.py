"""Every query beside its SQL on tables whose foreign keys are broken."""

import pandas as pd
import pytest

from oracle.compare import compare, connect
from oracle.sql import SQL
from orderlens.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "part", "orders", "lineitem", "supplier"]
# Reading back a folder costs as much as the rest of a question; one of them is enough.
SLOW = {"append_stored", "batch_audit", "place_ids", "scan_clean", "scan_star_filtered", "write_clean"}


@pytest.fixture(scope="module")
def broken(spark, tmp_path_factory):
    """Lines of unknown products and orders, an order of an unknown customer, a customer of
    an unknown nation, and a nation of an unknown region.
    """
    folder = tmp_path_factory.mktemp("broken")
    tables = {t: pd.read_parquet(f"{SF_DIR}/{t}.parquet")
              for t in TABLES}
    tables["lineitem"].loc[[0, 7, 11, 500, 501], "l_partkey"] = 10 ** 9
    tables["lineitem"].loc[[3, 20, 21, 900, 901, 902, 903], "l_orderkey"] = 10 ** 9 + 1
    tables["orders"].loc[[5, 6], "o_custkey"] = 10 ** 9
    tables["customer"].loc[[9], "c_nationkey"] = 99
    tables["nation"].loc[[4], "n_regionkey"] = 77
    for name, frame in tables.items():
        for column in frame.columns:
            if str(frame[column].dtype).startswith("datetime"):
                frame[column] = frame[column].astype("datetime64[us]")
        frame.to_parquet(f"{folder}/{name}.parquet", index=False)
    return str(folder)


@pytest.fixture(scope="module")
def con(broken):
    return connect(broken, TABLES)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - SLOW))
def test_same_population(spark, broken, con, name):
    assert compare(all_queries()[name](spark, broken), con, SQL[name]) == []


def test_orphans_are_counted(spark, broken):
    rows = all_queries()["constraint_violations"](spark, broken).collect()
    found = {r.rule: r.n_violations for r in rows if "references" in r.rule}
    assert found["order_items.product_id references products"] == 5
    assert found["order_items.order_id references orders"] == 7
    assert found["orders.customer_id references customers"] == 2
    assert found["customers.location_id references locations"] == 1
    assert found["locations.region_id references regions"] == 1
