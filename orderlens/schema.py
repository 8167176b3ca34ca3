"""Column sets and types of the order-line data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 4)
RATE = T.DecimalType(4, 2)

# Headings of the raw order-line export.
RAW_COLUMNS = [
    "Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode",
    "Customer ID", "Customer Name", "Segment", "Country", "City", "State",
    "Postal Code", "Region", "Product ID", "Category", "Sub-Category",
    "Product Name", "Sales", "Quantity", "Discount", "Profit",
]

# Declared, never inferred: a postal code keeps its leading zero and a bad
# date stays visible as text until the cleaning step has counted it.
RAW_TYPES = {
    "Row ID": T.IntegerType(),
    "Sales": MONEY,
    "Quantity": T.IntegerType(),
    "Discount": RATE,
    "Profit": MONEY,
}
RAW_SCHEMA = T.StructType(
    [T.StructField(c, RAW_TYPES.get(c, T.StringType())) for c in RAW_COLUMNS]
)

CLEAN_SCHEMA = T.StructType([
    T.StructField("row_id", T.IntegerType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("ship_date", T.DateType()),
    T.StructField("ship_mode", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("postal_code", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sub_category", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("sales", MONEY),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("discount", RATE),
    T.StructField("profit", MONEY),
    T.StructField("delivery_days", T.IntegerType()),
    T.StructField("data_quality_flag", T.StringType()),
    T.StructField("is_loss_line", T.BooleanType()),
])

# A load needs everything of the clean table except the two derived flags.
LOAD_COLUMNS = [
    f.name for f in CLEAN_SCHEMA if f.name not in ("data_quality_flag", "is_loss_line")
]

CATEGORICAL = ["region", "category", "sub_category", "ship_mode", "segment"]
NUMERIC = ["sales", "quantity", "discount", "profit", "delivery_days"]

# Attributes that hold one value per order (checked by quality.order_fd_check).
ORDER_ATTRIBUTES = [
    "order_date", "ship_date", "delivery_days", "ship_mode",
    "customer_id", "segment", "state", "region",
]

# Star schema: columns of each table, key columns first.
STAR_TABLES = {
    "locations": ["location_id", "city", "state", "region", "country", "postal_code"],
    "customers": ["customer_id", "customer_name", "segment"],
    "products": ["product_id", "product_name", "category", "sub_category"],
    "orders": ["order_id", "customer_id", "location_id", "order_date", "ship_date",
               "ship_mode", "delivery_days"],
    "order_items": ["row_id", "order_id", "product_id", "sales", "quantity",
                    "discount", "profit"],
}
STAR_KEYS = {
    "locations": ["location_id"], "customers": ["customer_id"], "products": ["product_id"],
    "orders": ["order_id"], "order_items": ["row_id"],
}
# Longest text a column may hold.
TEXT_LENGTHS = {
    "city": 100, "state": 100, "region": 50, "country": 100, "postal_code": 20,
    "customer_id": 20, "customer_name": 150, "segment": 50,
    "product_id": 30, "product_name": 255, "category": 50, "sub_category": 50,
    "order_id": 20, "ship_mode": 30,
}


def star_schema(table: str) -> T.StructType:
    """Declared types of a star table; only the postal code may be missing."""
    types = {f.name: f.dataType for f in CLEAN_SCHEMA} | {"location_id": T.LongType()}
    return T.StructType([
        T.StructField(c, types[c], c == "postal_code") for c in STAR_TABLES[table]])
