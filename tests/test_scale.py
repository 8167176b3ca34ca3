"""Hot keys, plan shapes and the settings that keep jobs within bounds."""

import re
from hashlib import md5

import pyarrow as pa
import pyarrow.parquet as pq
import numpy as np
import pytest

from oracle.sql import SQL
from orderlens.catalog import all_queries as queries
from oracle.compare import compare, connect
from orderlens import session
from orderlens.operators import commerce, findings, profile, quadrant, rollup
from orderlens.operators.filters import NO_FILTERS, Filters
from orderlens.plans import reuse
from orderlens.sources.warehouse import Warehouse

SF_DIR = "/root/testdata/sf0.001"
WRITES_FILES = {"append_stored", "batch_audit", "clean_and_report", "load_audit", "load_batches", "place_ids", "refreshed_orders",
                "scan_star_filtered", "scan_star_view", "scan_raw_csv", "write_clean", "scan_clean"}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """Base tables in which one order, one part and one customer hold a third each."""
    folder = tmp_path_factory.mktemp("skewed")
    rng = np.random.default_rng(7)
    n, n_orders, n_parts, n_customers = 30_000, 4_000, 500, 300

    def hot(size, keys, key):
        values = rng.integers(0, keys, size)
        values[rng.permutation(size)[: size // 3]] = key
        return values

    def save(name, **columns):
        pq.write_table(pa.table(columns), folder / f"{name}.parquet", row_group_size=4_000)

    days = np.datetime64("1996-01-01", "us") + np.arange(0, 1500).astype("timedelta64[D]")
    save("region", r_regionkey=pa.array([0, 1], pa.int32()), r_name=["ASIA", "AFRICA"])
    save("nation", n_nationkey=pa.array(range(6), pa.int32()), n_name=[f"N{i}" for i in range(6)],
         n_regionkey=pa.array([i % 2 for i in range(6)], pa.int32()))
    save("supplier", s_suppkey=[0], s_name=["s"], s_nationkey=pa.array([0], pa.int32()),
         s_acctbal=[0.0])
    save("customer", c_custkey=np.arange(n_customers), c_name=[f"C{i}" for i in range(n_customers)],
         c_nationkey=pa.array(rng.integers(0, 6, n_customers), pa.int32()),
         c_acctbal=np.zeros(n_customers),
         c_mktsegment=[f"S{i % 3}" for i in range(n_customers)])
    save("part", p_partkey=np.arange(n_parts), p_name=[f"thing {i % 40}" for i in range(n_parts)],
         p_brand=[f"B{i % 9}" for i in range(n_parts)], p_type=[["SMALL", "ECONOMY", "LARGE"][i % 3] for i in range(n_parts)],
         p_size=pa.array(np.ones(n_parts), pa.int32()),
         p_retailprice=np.round(900 + rng.random(n_parts) * 100, 2))
    save("orders", o_orderkey=np.arange(n_orders), o_custkey=hot(n_orders, n_customers, 5),
         o_orderstatus=rng.choice(["F", "O", "P"], n_orders), o_totalprice=np.zeros(n_orders),
         o_orderdate=days[rng.integers(0, 1500, n_orders)],
         o_orderpriority=rng.choice(["1-URGENT", "2-HIGH", "5-LOW"], n_orders))
    save("lineitem", l_orderkey=hot(n, n_orders, 17), l_partkey=hot(n, n_parts, 3),
         l_suppkey=np.zeros(n, dtype="int64"), l_linenumber=pa.array(np.arange(n) % 1000, pa.int32()),
         l_quantity=rng.integers(1, 50, n).astype(float),
         l_extendedprice=np.round(rng.random(n) * 60_000, 2),
         l_discount=np.round(rng.integers(0, 11, n) / 100, 2), l_tax=np.zeros(n),
         l_returnflag=["N"] * n, l_linestatus=["O"] * n, l_shipdate=days[rng.integers(0, 1500, n)])
    return str(folder)


@pytest.fixture
def sort_merge(spark):
    """Joins as they run on tables too large to broadcast, skew limits scaled down."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.files.maxPartitionBytes": "64KB",
    }
    with_settings = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in with_settings.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(set(queries()) - WRITES_FILES))
def test_hot_keys_give_the_same_results(sort_merge, skewed, name):
    frame = queries()[name](sort_merge, skewed)
    assert compare(frame, connect(skewed), SQL[name]) == []


@pytest.mark.parametrize("columns", [("profit",), ("order_date", "sales"), ("delivery_days", "profit")])
def test_hot_keys_are_split(sort_merge, skewed, columns):
    session.tune(sort_merge)
    frame = Warehouse(sort_merge, skewed).lines(*columns)
    frame.collect()
    assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()


def plans(spark, monkeypatch, name):
    """Physical plans of a query, each frame that it computes once shown once."""
    found = []

    def record(frame):
        found.append(own_plan(frame))  # as it is before it is kept
        return reuse.compute_once(frame)

    for module in (commerce, findings, quadrant):
        monkeypatch.setattr(module, "compute_once", record)
    found.append(own_plan(queries()[name](spark, SF_DIR)))
    return "\n".join(found)


def own_plan(frame):
    """The frame's plan without the plans of kept frames it reads, and without the plan that
    an executed one started from.
    """
    text = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    kept, inside = [], None
    for line in text.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth > inside:
            continue
        inside = depth if "InMemoryRelation" in line else None
        kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize("name", sorted(set(queries()) - WRITES_FILES))
def test_no_cross_join_and_no_python_in_any_plan(sort_merge, monkeypatch, name):
    text = plans(sort_merge, monkeypatch, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert node not in text


@pytest.mark.parametrize("name, scans", [
    ("kpi_summary", 1), ("location_performance", 1), ("bottleneck_segments", 1),
    ("delivery_performance", 1), ("discount_vs_rest", 1), ("revenue_share", 1), ("findings", 2),
    ("loss_by_discount_band", 1), ("category_month_trend", 1), ("value_counts", 1),
    ("filter_domains", 1), ("quality_flag", 1), ("correlation_matrix", 1), ("constraint_violations", 2)])
def test_facts_are_read_once_per_grain(spark, monkeypatch, name, scans):
    assert len(re.findall(r"FileScan parquet \[l_", plans(spark, monkeypatch, name))) == scans


@pytest.mark.parametrize("name, most", [("scan_star_view", 2), ("load_audit", 2)])
def test_star_reads_the_facts_once_per_grain(spark, monkeypatch, name, most):
    """Counted where the base table is opened and a job writes what was read."""
    Warehouse.gated(spark, SF_DIR)  # made once for the tables as they are
    reads = []
    table = Warehouse.table
    monkeypatch.setattr(Warehouse, "table", lambda w, t: reads.append(t) or table(w, t))
    queries()[name](spark, SF_DIR)
    assert reads.count("lineitem") <= most


@pytest.mark.parametrize("name", sorted(set(queries()) - WRITES_FILES))
def test_building_a_query_runs_no_job(spark, name):
    Warehouse.gated(spark, SF_DIR)  # made once for the tables as they are
    spark.sparkContext.setJobGroup("building", name)
    queries()[name](spark, SF_DIR)
    spark.sparkContext.setJobGroup("other", "")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")


def test_scans_read_only_the_columns_asked_for(spark):
    plan = queries()["total_revenue"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["l_extendedprice:double,l_discount:double"]


@pytest.mark.parametrize("name", ["total_orders", "total_revenue", "average_order_value", "range_checks",
                                  "duplicate_keys", "histogram_sales"])
def test_questions_about_lines_alone_join_nothing(sort_merge, monkeypatch, name):
    """Where every key has a parent, lines are not held against products or orders."""
    text = plans(sort_merge, monkeypatch, name)
    assert "Join" not in text
    for key in ("l_partkey", "product_id"):
        assert not re.search(rf"Exchange hashpartitioning\({key}#", text)


@pytest.mark.parametrize("columns", [("sales",), ("customer_id", "sales"), ("segment", "profit"),
                                     ("region", "quantity"), ("delivery_days", "discount")])
def test_gate_keeps_the_same_lines_as_the_joins(spark, columns):
    rows = lambda w: sorted(map(tuple, w.lines("order_id", *columns).collect()))
    assert rows(Warehouse.gated(spark, SF_DIR)) == rows(Warehouse(spark, SF_DIR))


def test_filters_reach_the_scans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = queries()["filter_lines"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    pushed = " ".join(re.findall(r"PushedFilters: (.*?), ReadSchema", plan))
    for part in ("In(r_name", "In(p_type", "In(o_orderpriority", "GreaterThanOrEqual(o_orderdate",
                 "LessThan"):
        assert part in pushed, part


def test_only_summaries_pass_a_single_partition_window(sort_merge, monkeypatch):
    """An unpartitioned window may only follow an aggregate with a bounded key."""
    allowed = {"category_performance", "rank_divergence", "peak_months", "sample_lines"}
    for name in ("orders_by_location", "delivery_performance", "location_performance",
                 "bottleneck_segments", "revenue_share", "discount_vs_rest", *allowed):
        text = plans(sort_merge, monkeypatch, name)
        single = re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*SinglePartition", text)
        assert bool(single) == (name in allowed), name


@pytest.mark.parametrize("filters", [
    NO_FILTERS,
    Filters(regions=("ASIA",), ship_modes=("2-HIGH", "5-LOW")),
    Filters(categories=("ECONOMY",)),
])
def test_order_frame_equals_the_rollup_of_the_lines(spark, filters):
    w = Warehouse(spark, SF_DIR)
    measures = ["n_lines", "sum_sales", "sum_profit", "n_loss_lines", "sum_discount"]
    header = ["order_id", "order_date", "ship_date", "delivery_days", "ship_mode", "customer_id",
              "segment", "state", "region"]
    by_order = w.orders(*header, *measures, filters=filters)
    by_line = rollup.order_rollup(w.lines(
        *header, "sales", "profit", "discount", filters=filters))
    rows = lambda f: sorted(map(tuple, f.select(*header, *measures).collect()))
    assert rows(by_order) == rows(by_line)
    few = w.orders("order_id", "sum_sales", filters=filters)
    assert few.count() == by_line.count()


@pytest.mark.parametrize("filters", [NO_FILTERS, Filters(categories=("SMALL",), regions=("ASIA",))])
def test_order_parts_equal_the_parts_of_the_lines(spark, filters):
    w = Warehouse(spark, SF_DIR)
    columns = ["order_id", "state", "sub_category", "n_lines", "sum_sales", "sum_profit",
               "n_loss_lines", "sum_discount"]
    by_order = w.orders(*[c for c in columns if c != "sub_category"], by=("sub_category",),
                        filters=filters)
    by_line = rollup.order_parts(
        w.lines("order_id", "state", "sub_category", "sales", "profit", "discount",
                filters=filters), "state", "sub_category")
    assert sorted(map(tuple, by_order.select(*columns).collect())) == sorted(
        map(tuple, by_line.select(*columns).collect()))
    with pytest.raises(ValueError):
        w.orders("ship_date", by=("category",))


def test_no_query_sets_shuffle_partitions(spark):
    settings = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = [spark.conf.get(k, None) for k in settings]
    for name in ("kpi_summary", "constraint_violations"):
        queries()[name](spark, SF_DIR)
    assert [spark.conf.get(k, None) for k in settings] == before
    try:
        session.tune(spark, initial_partitions=390_000)
        assert spark.conf.get(settings[1]) == "390000"
    finally:
        spark.conf.unset(settings[1])


def test_sampler_sorts_no_more_than_it_keeps(spark):
    """One row holds a third of all, and everything shares one leading group of digits."""
    frame = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS x")
    sample = profile.sample_lines(frame, 50)
    assert sample.count() == 50
    assert profile.sample_lines(frame, 40_000).count() == 30_000
    hot = profile.sample_lines(spark.range(9000).selectExpr("0 AS x"), 50)
    assert hot.count() == 50
    plan = sample._jdf.queryExecution().executedPlan()
    sample.collect()
    rows = [int(m) for m in re.findall(r"rows output: ([0-9]+)", plan.toString())]
    assert all(m <= 30_000 for m in rows)


def test_scratch_tables_live_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark).startswith(("file:" + folder, folder))
    assert session.scratch_path(spark, "x").startswith(session.shared_folder(spark) + "/")


def test_kept_frames_are_released(spark):
    frame = reuse.compute_once(spark.range(5).groupBy().count())
    assert frame.is_cached and frame.collect()[0][0] == 5
    reuse.release()
    assert not frame.is_cached and not reuse.KEPT


def test_shared_frames_are_released(spark):
    frame = spark.range(10).selectExpr("id * 2 AS x")
    with reuse.shared(frame) as cached:
        assert cached.is_cached and cached.count() == 10
    assert not frame.is_cached


def test_the_sample_is_drawn_by_whole_lines(spark, skewed):
    """The digest is one of all columns returned, also those of the product."""
    columns = ["order_id", "line_number", "product_id", "quantity", "discount", "sales", "category", "profit"]
    rows = [tuple(r) for r in Warehouse.gated(spark, skewed).lines(*columns).collect()]
    digest = lambda row: md5("|".join(map(str, ("1", *row))).encode()).hexdigest()
    want = [tuple(map(float, (row[:6] + row[7:]))) for row in sorted(rows, key=lambda row: (digest(row), row))[:2000]]
    got = [tuple(map(float, (*r[:6], *r[7:]))) for r in queries()["sample_lines"](spark, skewed).select(*columns).collect()]
    assert sorted(got) == sorted(want)
