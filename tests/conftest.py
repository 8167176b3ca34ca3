from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlens.schema import RAW_SCHEMA  # noqa: E402
from orderlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    session = build_session(cpus=8, app="tests", **{"spark.checkpoint.dir": folder})
    yield session
    session.stop()


RAW_DEFAULTS = {
    "Row ID": 1, "Order ID": "O-1", "Order Date": "11/8/2016", "Ship Date": "11/11/2016",
    "Ship Mode": "Second", "Customer ID": "C-1", "Customer Name": "Ada", "Segment": "Consumer",
    "Country": "Land", "City": "Town", "State": "North", "Postal Code": "02101",
    "Region": "West", "Product ID": "P-1", "Category": "Office", "Sub-Category": "Paper",
    "Product Name": "Pad", "Sales": "10", "Quantity": 1, "Discount": "0", "Profit": "1",
}


@pytest.fixture
def raw(spark):
    """Raw lines from partial rows; what a row leaves out takes a default."""
    def build(*rows: dict):
        data = []
        for i, row in enumerate(rows):
            full = RAW_DEFAULTS | {"Row ID": i + 1} | row
            data.append([
                Decimal(full[f.name]) if f.name in ("Sales", "Discount", "Profit")
                and full[f.name] is not None else full[f.name] for f in RAW_SCHEMA])
        return spark.createDataFrame(data, RAW_SCHEMA)
    return build


LINE_SCHEMA = (
    "order_id STRING, order_date DATE, ship_date DATE, delivery_days INT, ship_mode STRING, "
    "customer_id STRING, segment STRING, state STRING, region STRING, product_name STRING, "
    "category STRING, sub_category STRING, sales DECIMAL(14,4), quantity INT, "
    "discount DECIMAL(4,2), profit DECIMAL(14,4)")
LINE_DEFAULTS = {
    "order_id": "o1", "order_date": date(2024, 1, 5), "ship_date": date(2024, 1, 8),
    "delivery_days": 3, "ship_mode": "slow", "customer_id": "c1", "segment": "A", "state": "S",
    "region": "R", "product_name": "thing", "category": "cat", "sub_category": "sub",
    "sales": "100", "quantity": 1, "discount": "0", "profit": "10",
}


@pytest.fixture
def lines(spark):
    """Clean lines from partial rows."""
    def build(*rows: dict):
        data = []
        for row in rows:
            full = LINE_DEFAULTS | row
            data.append([
                Decimal(v) if k in ("sales", "discount", "profit") and v is not None else v
                for k, v in full.items()])
        return spark.createDataFrame(data, LINE_SCHEMA)
    return build


@pytest.fixture
def one():
    """The single row of a frame as a dict."""
    def read(frame):
        rows = frame.collect()
        assert len(rows) == 1
        return rows[0].asDict()
    return read
