"""The load-time gate: found once, used while the tables stay as they are, and never after."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import kpi
from orderlens.session import shared_folder
from orderlens.sources import gate
from orderlens.sources.warehouse import Warehouse

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    """Base tables of a few rows: two lines of an unknown product, one without a product, lines
    of an unknown order and of one whose customer has no known place.
    """
    day = pd.Timestamp("1997-03-01")
    ints = lambda *x: pd.array(x, dtype="Int64")
    tables = {
        "region": {"r_regionkey": pd.array([0], dtype="Int32"), "r_name": ["ASIA"]},
        "nation": {"n_nationkey": pd.array([0, 1], dtype="Int32"), "n_name": ["A", "B"],
                   "n_regionkey": pd.array([0, 7], dtype="Int32")},
        "customer": {"c_custkey": ints(1, 2), "c_name": ["x", "y"], "c_nationkey": pd.array([0, 1], dtype="Int32"),
                     "c_acctbal": [0.0, 0.0], "c_mktsegment": ["S", "S"]},
        "part": {"p_partkey": ints(1), "p_name": ["p"], "p_brand": ["b"], "p_type": ["t"],
                 "p_size": pd.array([1], dtype="Int32"), "p_retailprice": [1.0]},
        "orders": {"o_orderkey": ints(1, 2, 3), "o_custkey": ints(1, 2, None), "o_orderstatus": ["F"] * 3,
                   "o_totalprice": [0.0] * 3, "o_orderdate": [day] * 3, "o_orderpriority": ["5-LOW"] * 3},
        "lineitem": {"l_orderkey": ints(1, 1, 1, 2, 9, 1), "l_partkey": ints(1, 8, 8, 1, 1, None),
                     "l_suppkey": ints(*[0] * 6), "l_linenumber": pd.array(range(6), dtype="Int32"),
                     "l_quantity": [1.0] * 6, "l_extendedprice": [100.0, 10, 10, 10, 10, 10],
                     "l_discount": [0.0] * 6, "l_tax": [0.0] * 6, "l_returnflag": ["N"] * 6,
                     "l_linestatus": ["O"] * 6, "l_shipdate": [day] * 6},
    }
    for name, columns in tables.items():
        frame = pd.DataFrame(columns)
        for c in frame.columns:
            if str(frame[c].dtype).startswith("datetime"):
                frame[c] = frame[c].astype("datetime64[us]")
        frame.to_parquet(f"{tmp_path}/{name}.parquet", index=False)
    return str(tmp_path)


def opened(spark, folder):
    return Warehouse.gated(spark, folder)


def test_sets_hold_the_keys_without_a_parent(spark, folder):
    found = opened(spark, folder).gate
    keys = {n: {r.key: r.n_rows for r in found.keys(n).collect()} for n in gate.SETS}
    assert keys == {"line_product": {8: 2}, "line_order": {2: 1, 9: 1}, "order_customer": {2: 1}}
    assert {n: s.n_missing for n, s in found.sets.items()} == {
        "line_product": 1, "line_order": 0, "order_customer": 1}
    report = {r.key_set: (r.n_keys, r.n_rows) for r in gate.gate_report(found).collect()}
    assert report == {"line_product": (1, 3), "line_order": (2, 2), "order_customer": (1, 2)}


def test_population_with_orphans(spark, folder, one):
    for w in (opened(spark, folder), Warehouse(spark, folder)):
        assert float(one(kpi.total_revenue(w.lines("sales")))["total_revenue"]) == 100.0
        assert [r.order_id for r in w.orders("order_id").collect()] == [1]
        assert [tuple(r) for r in w.lines("customer_id", "segment").collect()] == [(1, "S")]
        assert [r.order_id for r in w.orders("order_id", "ship_date").collect()] == [1]


def test_without_a_shared_folder_the_tables_are_joined(spark, folder, monkeypatch, one):
    from orderlens import catalog
    from orderlens.sources import warehouse
    want = {r.rule: r.n_violations for r in catalog.all_queries()["constraint_violations"](spark, folder).collect()}
    monkeypatch.setattr(warehouse, "set_folder", lambda _: None)
    w = opened(spark, folder)
    assert w.gate is None and float(one(kpi.total_revenue(w.lines("sales")))["total_revenue"]) == 100.0
    found = {r.rule: r.n_violations for r in catalog.all_queries()["constraint_violations"](spark, folder).collect()}
    assert found == want and want["order_items.product_id references products"] == 2


def test_a_second_question_finds_the_gate(spark, folder, monkeypatch):
    first = opened(spark, folder).gate
    monkeypatch.setattr(gate, "missing_parents", None)  # would fail if it was made again
    assert opened(spark, folder).gate == first


def test_a_gate_of_other_tables_is_not_used(spark, folder):
    before = opened(spark, folder).gate
    part = pd.read_parquet(f"{folder}/part.parquet")
    more = part.assign(p_partkey=pd.array([8], dtype="Int64"))
    pd.concat([part, more]).to_parquet(f"{folder}/part.parquet", index=False)
    after = opened(spark, folder).gate
    assert after.path != before.path and after.sets["line_product"].n_keys == 0
    assert opened(spark, folder).lines("sales").count() == 3


def test_an_append_makes_the_gate_stale(spark, tmp_path):
    """Tables written by Spark change their commit marker even where nothing else shows."""
    source = Warehouse(spark, SF_DIR)
    folder = str(tmp_path / "tables")
    for t in gate.CHECKED:
        source.table(t).limit(300).write.parquet(f"{folder}/{t}.parquet")
    names = {gate.gate_folder(spark, folder)}
    source.table("lineitem").limit(1).withColumn("l_partkey", F.lit(10 ** 9).cast("long")).write.mode(
        "append").parquet(f"{folder}/lineitem.parquet")
    names.add(gate.gate_folder(spark, folder))
    assert len(names) == 2
    assert 10 ** 9 in {r.key for r in opened(spark, folder).gate.keys("line_product").collect()}


def test_an_interrupted_gate_is_made_again(spark, folder):
    made = opened(spark, folder).gate
    home = gate.gate_folder(spark, folder)
    assert made.path.startswith(home) and home.startswith(shared_folder(spark))
    where, fs = gate.hadoop_path(spark, f"{home}/marker.json")
    kept = json.loads(open(home.removeprefix("file:") + "/marker.json").read())
    assert kept["keys"] == made.path
    fs.delete(where, False)
    assert opened(spark, folder).gate.path != made.path


def test_hot_keys_meet_their_parents_as_one_row(spark, folder):
    """Where the parents are too many to broadcast, the anti join stands above the count per key."""
    tables = {t: Warehouse(spark, folder).table(t) for t in gate.CHECKED}
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        plan = gate.missing_parents(tables)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert plan.index("LeftAnti") < plan.index("Aggregate")


def test_lines_are_counted_without_being_multiplied(spark, folder):
    """Each key column is counted on its own; a line is not turned into a row per set."""
    tables = {t: Warehouse(spark, folder).table(t) for t in gate.CHECKED}
    plan = gate.missing_parents(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("l_partkey") and plan.count("l_orderkey")
    found = {(r.name, r.key): r.n_rows for r in gate.missing_parents(tables).collect()}
    assert found == {("line_product", 8): 2, ("line_product", None): 1, ("line_order", 2): 1, ("line_order", 9): 1,
                     ("order_customer", 2): 1, ("order_customer", None): 1}
