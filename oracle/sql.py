"""The registered questions as SQL over the base tables, for an independent engine.

Every text inlines the adapter, so it stands alone. Sums of money are exact
decimals until they are shown; ratios are taken in double precision.
"""

from __future__ import annotations

LINES = """
priced AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_discount AS DECIMAL(4,2)) AS discount,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2))
              * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(14,4)) AS sales,
         CAST(CAST(0.8 AS DECIMAL(2,1)) * CAST(p_retailprice AS DECIMAL(9,2))
              * CAST(l_quantity AS INTEGER) AS DECIMAL(14,4)) AS cost,
         CAST(l_shipdate AS DATE) AS line_ship_date,
         p_name AS product_name, p_type AS category, p_brand AS sub_category
  FROM lineitem JOIN part ON p_partkey = l_partkey),
placed AS (
  SELECT priced.*, CAST(sales - cost AS DECIMAL(14,4)) AS profit,
         CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS ship_mode,
         o_orderstatus AS order_status, c_custkey AS customer_id, c_name AS customer_name,
         c_mktsegment AS segment, n_name AS state, r_name AS region,
         MAX(line_ship_date) OVER (PARTITION BY order_id) AS ship_date
  FROM priced
  JOIN orders ON o_orderkey = order_id
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey),
lines AS (
  SELECT *, profit < 0 AS is_loss_line, date_diff('day', order_date, ship_date) AS delivery_days
  FROM placed)"""

ORDERS = """
per_order AS (
  SELECT order_id, order_date, ship_mode, segment, state, region, delivery_days,
         COUNT(*) AS n_lines, SUM(sales) AS order_sales, SUM(profit) AS order_profit,
         SUM(CASE WHEN is_loss_line THEN 1 ELSE 0 END) AS n_loss_lines
  FROM lines
  GROUP BY order_id, order_date, ship_mode, segment, state, region, delivery_days)"""

SELECTION = """
chosen AS (
  SELECT * FROM lines
  WHERE region IN ('ASIA', 'EUROPE') AND category IN ('ECONOMY', 'SMALL')
    AND ship_mode IN ('1-URGENT', '2-HIGH', '5-LOW')
    AND order_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')"""

RAW = """
raw AS (
  SELECT order_id, line_number, strftime(order_date, '%-m/%-d/%Y') AS order_date,
         CASE WHEN order_status = 'P' THEN 'pending'
              ELSE strftime(ship_date, '%-m/%-d/%Y') END AS ship_date,
         ship_mode, customer_id, customer_name, segment, state, ' ' || region AS region,
         category || '  ' AS category, sub_category, product_id, product_name, sales, quantity,
         discount, profit
  FROM lines)"""

CLEAN = """
clean AS (
  SELECT DISTINCT order_id, line_number, order_date,
         CASE WHEN order_status <> 'P' THEN ship_date END AS ship_date,
         ship_mode, customer_id, customer_name, segment, state, region, category, sub_category,
         product_id, product_name, sales, quantity, discount, profit,
         CASE WHEN order_status <> 'P' THEN delivery_days END AS delivery_days,
         CASE WHEN order_status <> 'P' AND ship_date < order_date
              THEN 'ship_before_order' ELSE 'ok' END AS data_quality_flag,
         is_loss_line
  FROM lines)"""


def text(select: str, *ctes: str) -> str:
    return "WITH" + ",".join((LINES, *ctes)) + "\n" + select.strip()


def money(x: str) -> str:
    return f"CAST(ROUND(SUM({x}), 2) AS DOUBLE)"


def ratio(num: str, den: str, places: int = 2, times: str = "") -> str:
    return (f"ROUND(CAST({times}({num}) AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0), {places})")


def pct(num: str, den: str, places: int = 2) -> str:
    return ratio(num, den, places, "100 * ")


def n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


LOSS = "SUM(CASE WHEN is_loss_line THEN 1 ELSE 0 END)"
ORDER_LOSS = "SUM(CASE WHEN order_profit < 0 THEN 1 ELSE 0 END)"
QUADRANT = """CASE WHEN {v} >= median_volume AND {r} >= mean_rate THEN 'High Volume / Poor Performance - PRIORITY'
         WHEN {v} >= median_volume THEN 'High Volume / Good Performance - BENCHMARK'
         WHEN {r} >= mean_rate THEN 'Low Volume / Poor Performance - INVESTIGATE'
         ELSE 'Low Volume / Good Performance - LOW PRIORITY' END"""

SQL: dict[str, str] = {}

# -- KPIs -----------------------------------------------------------------------------

SQL["total_orders"] = text("SELECT COUNT(DISTINCT order_id) AS total_orders FROM lines")
SQL["total_revenue"] = text(f"SELECT {money('sales')} AS total_revenue FROM lines")
SQL["total_profit"] = text(f"SELECT {money('profit')} AS total_profit FROM lines")
SQL["average_order_value"] = text(f"""
SELECT COALESCE({ratio('SUM(sales)', 'COUNT(DISTINCT order_id)')}, 0) AS average_order_value
FROM lines""")
SQL["profit_margin_pct"] = text(f"""
SELECT COALESCE({pct('SUM(profit)', 'SUM(sales)')}, 0) AS profit_margin_pct FROM lines""")
SQL["loss_making_line_rate"] = text(f"""
SELECT COALESCE({pct(LOSS, 'COUNT(*)')}, 0) AS loss_making_line_rate FROM lines""")
SQL["loss_making_order_rate"] = text(f"""
SELECT COALESCE({pct(ORDER_LOSS, 'COUNT(*)')}, 0) AS loss_making_order_rate FROM per_order""", ORDERS)
SQL["average_delivery_days"] = text("""
SELECT ROUND(AVG(delivery_days), 2) AS average_delivery_days FROM lines""")
SQL["kpi_summary"] = text(f"""
SELECT COUNT(DISTINCT order_id) AS total_orders, COUNT(*) AS total_order_lines,
       {money('sales')} AS total_revenue, {money('profit')} AS total_profit,
       {ratio('SUM(sales)', 'COUNT(DISTINCT order_id)')} AS avg_order_value,
       ROUND(AVG(delivery_days), 2) AS avg_delivery_days,
       {pct(LOSS, 'COUNT(*)')} AS loss_making_line_pct,
       (SELECT {pct(ORDER_LOSS, 'COUNT(*)')} FROM per_order) AS loss_making_order_pct,
       {pct('SUM(profit)', 'SUM(sales)')} AS overall_profit_margin_pct
FROM lines""", ORDERS)
SQL["headline_metrics"] = text(f"""
SELECT COUNT(DISTINCT order_id) AS total_orders, {money('sales')} AS total_revenue,
       COALESCE({ratio('SUM(sales)', 'COUNT(DISTINCT order_id)')}, 0) AS average_order_value,
       (SELECT COALESCE({pct('SUM(CASE WHEN p < 0 THEN 1 ELSE 0 END)', 'COUNT(*)')}, 0)
        FROM (SELECT SUM(profit) AS p FROM chosen GROUP BY order_id)) AS loss_making_order_rate,
       ROUND(AVG(delivery_days), 2) AS average_delivery_days
FROM chosen""", SELECTION)

# -- rollups and rankings ---------------------------------------------------------------

SQL["orders_by_location"] = text(f"""
SELECT region, state, COUNT(DISTINCT order_id) AS total_orders, {money('sales')} AS total_revenue,
       RANK() OVER (PARTITION BY region ORDER BY SUM(sales) DESC) AS rank_within_region
FROM lines GROUP BY region, state""")
SQL["aov_by_segment_region"] = text(f"""
SELECT segment, region, COUNT(*) AS total_orders,
       {ratio('SUM(order_sales)', 'COUNT(*)')} AS avg_order_value,
       {money('order_sales')} AS total_revenue
FROM per_order GROUP BY segment, region""", ORDERS)
SQL["revenue_by_category_margin"] = text(f"""
SELECT category, sub_category, COUNT(*) AS total_line_items, {money('sales')} AS total_revenue,
       {money('profit')} AS total_profit, {pct('SUM(profit)', 'SUM(sales)')} AS profit_margin_pct,
       {ratio('SUM(discount)', 'COUNT(*)', 3)} AS avg_discount
FROM lines GROUP BY category, sub_category""")


def revenue_by(key: str, source: str = "lines") -> str:
    return f"""
SELECT {key}, COUNT(DISTINCT order_id) AS total_orders, {money('sales')} AS total_revenue,
       {money('profit')} AS total_profit,
       {pct('ROUND(SUM(profit), 2)', 'ROUND(SUM(sales), 2)')} AS profit_margin_pct
FROM {source} GROUP BY {key}"""


for key in ("category", "sub_category", "segment", "region", "state", "ship_mode"):
    SQL[f"revenue_by_{key}"] = text(revenue_by(key))

# A rank is one more than the number of better rows; a missing figure is worse than any.
RANKED = f"""
taxonomy AS (
  SELECT sub_category, category, {money('sales')} AS total_revenue, {money('profit')} AS total_profit,
         {pct('SUM(profit)', 'SUM(sales)')} AS margin_pct
  FROM lines GROUP BY ALL),
ranked AS (
  SELECT t.*,
         1 + (SELECT COUNT(*) FROM taxonomy o WHERE o.total_revenue > t.total_revenue
              OR (t.total_revenue IS NULL AND o.total_revenue IS NOT NULL)) AS revenue_rank,
         1 + (SELECT COUNT(*) FROM taxonomy o WHERE o.margin_pct < t.margin_pct
              OR (t.margin_pct IS NULL AND o.margin_pct IS NOT NULL)) AS margin_rank_worst_first
  FROM taxonomy t)"""
SQL["category_performance"] = text("SELECT * FROM ranked", RANKED)
SQL["rank_divergence"] = text("""
SELECT * FROM ranked WHERE revenue_rank <= 40 AND margin_rank_worst_first <= 40""", RANKED)
SQL["top_products"] = text(f"""
SELECT product_name, {money('sales')} AS total_revenue, {n('SUM(quantity)')} AS total_quantity,
       CAST(SUM(profit) AS DOUBLE) AS total_profit
FROM lines GROUP BY product_name ORDER BY SUM(sales) DESC, product_name LIMIT 10""")
SQL["revenue_share"] = text(f"""
SELECT category, {money('sales')} AS total_revenue,
       ROUND(CAST(SUM(sales) AS DOUBLE) / CAST(SUM(SUM(sales)) OVER () AS DOUBLE), 6) AS revenue_share
FROM lines GROUP BY category""")
SQL["worst_margin_subcategory"] = text(
    revenue_by("sub_category") + " ORDER BY profit_margin_pct ASC NULLS LAST, sub_category LIMIT 1")

# -- discounts ----------------------------------------------------------------------------

BAND = """CASE WHEN discount = 0 THEN '0% (no discount)' WHEN discount <= 0.04 THEN '1-4%'
            WHEN discount <= 0.08 THEN '5-8%' ELSE '9%+' END"""


def bands(keys: str) -> str:
    return f"""
SELECT {keys}{BAND} AS discount_band, COUNT(*) AS total_line_items,
       {n(LOSS)} AS loss_making_lines, {pct(LOSS, 'COUNT(*)')} AS loss_making_line_rate_pct,
       {money('profit')} AS net_profit
FROM lines GROUP BY ALL"""


SQL["loss_by_discount_band"] = text(bands("segment, "))
SQL["loss_by_discount_band_total"] = text(bands(""))
SQL["deep_discount_loss"] = text(f"""
SELECT COUNT(*) FILTER (WHERE discount > 0.08) AS n_lines,
       COALESCE({pct('SUM(CASE WHEN is_loss_line AND discount > 0.08 THEN 1 ELSE 0 END)',
                     'SUM(CASE WHEN discount > 0.08 THEN 1 ELSE 0 END)')}, 0) AS loss_line_rate,
       COALESCE({pct(LOSS, 'COUNT(*)')}, 0) AS baseline_loss_line_rate
FROM lines""")
SQL["deep_discount_concentration"] = text("""
SELECT sub_category, COUNT(*) AS n_lines,
       ROUND(CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 6) AS share
FROM lines WHERE discount > 0.08 GROUP BY sub_category""")
SQL["avg_discount_by_state"] = text(f"""
SELECT state, {ratio('SUM(discount)', 'COUNT(*)', 4)} AS avg_discount FROM lines GROUP BY state""")
SQL["discount_vs_rest"] = text(f"""
SELECT s.state,
       {ratio('SUM(CASE WHEN l.state = s.state THEN discount END)',
              'COUNT(CASE WHEN l.state = s.state THEN 1 END)', 4)} AS avg_discount,
       {ratio('SUM(CASE WHEN l.state <> s.state THEN discount END)',
              'COUNT(CASE WHEN l.state <> s.state THEN 1 END)', 4)} AS other_states_avg_discount
FROM (SELECT DISTINCT state FROM lines) s, lines l GROUP BY s.state""")

# -- quadrants ----------------------------------------------------------------------------


def by_state(rate: str, weight: str) -> str:
    """States with the thresholds beside them: the middle volume and the mean rate of all."""
    return f"""
by_state AS (
  SELECT *, MEDIAN(total_orders) OVER () AS median_volume, AVG({rate}) OVER () AS mean_rate
  FROM (SELECT state, region, COUNT(*) AS total_orders, {money('order_sales')} AS total_revenue,
               {pct(ORDER_LOSS, 'COUNT(*)')} AS {rate},
               {ratio(f'SUM({weight} * delivery_days)', f'SUM({weight})')} AS avg_delivery_days
        FROM per_order GROUP BY ALL))"""


BY_ORDER = by_state("order_loss_rate_pct", "1")
BY_LINE = by_state("loss_rate_pct", "n_lines")
STATE_COLUMNS = "state, region, total_orders, total_revenue, {rate}, avg_delivery_days"
SQL["location_performance"] = text(f"""
SELECT {STATE_COLUMNS.format(rate='order_loss_rate_pct')},
       {QUADRANT.format(v='total_orders', r='order_loss_rate_pct')} AS performance_segment
FROM by_state""", ORDERS, BY_ORDER)
STATES = f"""
states AS (
  SELECT {STATE_COLUMNS.format(rate='loss_rate_pct')},
         {QUADRANT.format(v='total_orders', r='loss_rate_pct')} AS quadrant,
         median_volume AS median_orders, mean_rate AS avg_loss_rate
  FROM by_state)"""
PLAIN_STATES = "SELECT * EXCLUDE (median_orders, avg_loss_rate) FROM states"
SQL["location_performance_lines"] = text(
    "SELECT * REPLACE (ROUND(avg_loss_rate, 6) AS avg_loss_rate) FROM states", ORDERS, BY_LINE, STATES)
SQL["top_states"] = text(
    PLAIN_STATES + " ORDER BY total_orders DESC, state, region LIMIT 10", ORDERS, BY_LINE, STATES)
SQL["states_by_loss_rate"] = text(PLAIN_STATES, ORDERS, BY_LINE, STATES)
SQL["priority_states"] = text(
    PLAIN_STATES + " WHERE quadrant = 'High Volume / Poor Performance - PRIORITY'",
    ORDERS, BY_LINE, STATES)


def segments(min_orders: int) -> str:
    return f"""
segment_rows AS (
  SELECT state, sub_category, order_id, COUNT(*) AS k, {n(LOSS)} AS k_loss, SUM(profit) AS profit
  FROM lines GROUP BY ALL),
thick AS (
  SELECT state, sub_category, COUNT(*) AS order_volume,
         {pct('SUM(k_loss)', 'SUM(k)')} AS line_loss_rate_pct, {money('profit')} AS total_profit
  FROM segment_rows GROUP BY state, sub_category HAVING COUNT(*) >= {min_orders}),
classified AS (
  SELECT * EXCLUDE (median_volume, mean_rate),
         {QUADRANT.format(v='order_volume', r='line_loss_rate_pct')} AS quadrant,
         ROUND(median_volume, 1) AS overall_median_volume,
         ROUND(mean_rate, 2) AS overall_avg_line_loss_rate
  FROM (SELECT *, MEDIAN(order_volume) OVER () AS median_volume,
               AVG(line_loss_rate_pct) OVER () AS mean_rate FROM thick))"""


SEGMENT = "state, sub_category, order_volume, line_loss_rate_pct, total_profit, quadrant"
SQL["bottleneck_segments"] = text("SELECT * FROM classified", segments(5))
SQL["bottleneck_segments_min_orders"] = text(f"SELECT {SEGMENT} FROM classified", segments(12))
SQL["priority_segments"] = text(f"""
SELECT {SEGMENT} FROM classified WHERE quadrant = 'High Volume / Poor Performance - PRIORITY'
ORDER BY order_volume DESC, state, sub_category LIMIT 15""", segments(5))

# -- delivery and calendar ------------------------------------------------------------------


def benchmark(source: str) -> str:
    """75th percentile per ship mode, read off the running counts of its delivery days: the
    value at place 0.75 * (n - 1), between two neighbours in proportion.
    """
    return f"""
day_counts AS (
  SELECT ship_mode, delivery_days AS d, COUNT(*) AS k FROM {source}
  WHERE delivery_days IS NOT NULL GROUP BY ALL),
day_places AS (
  SELECT *, SUM(k) OVER (PARTITION BY ship_mode ORDER BY d) AS upto,
         0.75::DOUBLE * (SUM(k) OVER (PARTITION BY ship_mode) - 1) AS place FROM day_counts),
p75s AS (
  SELECT ship_mode, MIN(d) FILTER (WHERE upto > floor(place))
           + (place - floor(place)) * (MIN(d) FILTER (WHERE upto > ceil(place))
                                       - MIN(d) FILTER (WHERE upto > floor(place))) AS p75
  FROM day_places GROUP BY ship_mode, place),
delivered AS (SELECT ship_mode, delivery_days, p75 FROM per_order LEFT JOIN p75s USING (ship_mode))"""


OVER = "SUM(CASE WHEN delivery_days > p75 THEN 1 ELSE 0 END)"
SQL["delivery_performance"] = text(f"""
SELECT ship_mode, COUNT(*) AS total_orders, ROUND(AVG(delivery_days), 2) AS avg_delivery_days,
       ROUND(p75, 2) AS internal_benchmark_days, {n(OVER)} AS orders_over_benchmark,
       {pct(OVER, 'COUNT(*)')} AS pct_over_benchmark
FROM delivered GROUP BY ship_mode, p75""", ORDERS, benchmark("lines"))
BENCHMARK = f"""
SELECT ship_mode, COUNT(*) AS total_orders, ROUND(AVG(delivery_days), 2) AS avg_delivery_days,
       p75 AS benchmark_days, {pct(OVER, 'COUNT(*)')} AS pct_over_benchmark
FROM delivered GROUP BY ship_mode, p75"""
SQL["delivery_benchmark"] = text(BENCHMARK, ORDERS, benchmark("per_order"))
SQL["slowest_ship_mode"] = text(
    BENCHMARK + " ORDER BY avg_delivery_days DESC, ship_mode LIMIT 1", ORDERS, benchmark("per_order"))
SQL["worst_benchmark_mode"] = text(
    BENCHMARK + " ORDER BY pct_over_benchmark DESC, ship_mode LIMIT 1", ORDERS,
    benchmark("per_order"))
SQL["delivery_boxplot"] = text("""
SELECT ship_mode, COUNT(*) AS n_orders, MIN(delivery_days) AS min_days, MAX(q1) AS q1_days,
       MAX(q2) AS median_days, MAX(q3) AS q3_days, MAX(delivery_days) AS max_days,
       MIN(delivery_days) FILTER (WHERE inside) AS lower_whisker,
       MAX(delivery_days) FILTER (WHERE inside) AS upper_whisker,
       COUNT(*) FILTER (WHERE NOT inside) AS n_outliers
FROM (SELECT o.ship_mode, delivery_days, q1, q2, q3,
             delivery_days BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM per_order o JOIN (
        SELECT ship_mode, PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY delivery_days) AS q1,
               PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY delivery_days) AS q2,
               PERCENTILE_CONT(0.75) WITHIN GROUP (ORDER BY delivery_days) AS q3
        FROM per_order GROUP BY ship_mode) b ON o.ship_mode = b.ship_mode)
GROUP BY ship_mode""", ORDERS)
MONTHS = f"""
months AS (
  SELECT month(order_date) AS order_month, COUNT(DISTINCT order_id) AS total_orders,
         {money('sales')} AS total_revenue
  FROM lines GROUP BY ALL)"""
SQL["demand_by_month"] = text("SELECT * FROM months", MONTHS)
SQL["peak_months"] = text("""
SELECT * FROM (SELECT *, DENSE_RANK() OVER (ORDER BY total_orders DESC) AS demand_rank FROM months)
WHERE demand_rank <= 2""", MONTHS)
SQL["demand_by_weekday"] = text(f"""
SELECT dayname(order_date) AS day_of_week, COUNT(DISTINCT order_id) AS total_orders,
       {money('sales')} AS total_revenue
FROM lines GROUP BY ALL""")
SQL["monthly_trend"] = text(f"""
SELECT strftime(order_date, '%Y-%m') AS month, COUNT(DISTINCT order_id) AS total_orders,
       {money('sales')} AS total_revenue
FROM lines GROUP BY ALL""")
SQL["month_seasonality"] = text("""
SELECT month(order_date) AS month_num, strftime(order_date, '%b') AS month_name,
       COUNT(DISTINCT order_id) AS total_orders
FROM lines GROUP BY ALL""")
SQL["category_month_trend"] = text(f"""
SELECT strftime(order_date, '%Y-%m') AS month, category, {money('sales')} AS total_revenue
FROM lines GROUP BY ALL""")

# -- filters, findings, profiling ---------------------------------------------------------------

LINE = """order_id, {n}CAST(line_number AS BIGINT) AS line_number, order_date, ship_date, delivery_days,
       ship_mode, customer_id, customer_name, segment, state, region, product_id, product_name,
       category, sub_category, CAST(sales AS DOUBLE) AS sales, CAST(quantity AS BIGINT) AS quantity,
       CAST(discount AS DOUBLE) AS discount, CAST(profit AS DOUBLE) AS profit,
       is_loss_line""".replace("{n}", "")
SQL["filter_lines"] = text(f"SELECT {LINE} FROM chosen", SELECTION)
SQL["filter_domains"] = text("""
SELECT DISTINCT 'region' AS field, region AS value FROM lines
UNION ALL SELECT DISTINCT 'category', category FROM lines
UNION ALL SELECT DISTINCT 'ship_mode', ship_mode FROM lines
UNION ALL SELECT 'order_date', CAST(MIN(order_date) AS VARCHAR) FROM lines
UNION ALL SELECT 'order_date', CAST(MAX(order_date) AS VARCHAR) FROM lines""")


def histogram(column: str) -> str:
    return text(f"""
SELECT bin, ROUND(lo + (bin - 1) * width, 6) AS bin_start, ROUND(lo + bin * width, 6) AS bin_end,
       COUNT(*) AS n, ROUND(LOG10(COUNT(*)), 6) AS log10_n
FROM (SELECT CAST(LEAST(FLOOR((CAST({column} AS DOUBLE) - lo) / width), 59) + 1 AS BIGINT) AS bin,
             lo, width
      FROM lines, (SELECT lo, (hi - lo) / CAST(60 AS DOUBLE) AS width
                   FROM (SELECT CAST(MIN({column}) AS DOUBLE) AS lo,
                                CAST(MAX({column}) AS DOUBLE) AS hi FROM lines)))
GROUP BY bin, lo, width""")


SQL["histogram_sales"] = histogram("sales")
SQL["histogram_profit"] = histogram("profit")
SQL["loss_line_share"] = text(f"""
SELECT {n(LOSS)} AS loss_making_lines, {pct(LOSS, 'COUNT(*)')} AS pct_of_lines FROM lines""")
SQL["value_counts"] = text(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS n FROM lines GROUP BY {c}"
    for c in ("region", "category", "sub_category", "ship_mode", "segment")))
SQL["sample_lines"] = text("""
SELECT order_id, CAST(line_number AS BIGINT) AS line_number, product_id,
       CAST(quantity AS BIGINT) AS quantity, CAST(discount AS DOUBLE) AS discount,
       CAST(sales AS DOUBLE) AS sales, category, CAST(profit AS DOUBLE) AS profit
FROM lines
ORDER BY md5(concat_ws('|', '1', order_id, line_number, product_id, quantity, discount, sales,
                       category, profit)),
         order_id, line_number, product_id, quantity, discount, sales, category, profit
LIMIT 2000""")
NUMERIC = ("sales", "quantity", "discount", "profit", "delivery_days")
SQL["correlation_matrix"] = text(" UNION ALL ".join(
    f"SELECT '{a}' AS column_x, '{b}' AS column_y, "
    f"ROUND(COVAR_POP(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / NULLIF("
    f"STDDEV_POP(CAST({a} AS DOUBLE)) * STDDEV_POP(CAST({b} AS DOUBLE)), 0), 6) AS correlation FROM lines"
    for a in NUMERIC for b in NUMERIC))
SQL["head_lines"] = text("""
SELECT order_id, CAST(line_number AS BIGINT) AS line_number, product_id,
       CAST(quantity AS BIGINT) AS quantity, CAST(sales AS DOUBLE) AS sales
FROM lines ORDER BY order_id, line_number, product_id, quantity, lines.sales LIMIT 10""")

PRIORITY = """
top_state AS (
  SELECT s.*, avg_loss_rate AS mean_rate,
         (SELECT CAST(SUM(discount) AS DOUBLE) / COUNT(*) FROM lines l WHERE l.state = s.state) AS d_in,
         (SELECT CAST(SUM(discount) AS DOUBLE) / COUNT(*) FROM lines l WHERE l.state <> s.state) AS d_out
  FROM (SELECT * FROM states WHERE quadrant = 'High Volume / Poor Performance - PRIORITY'
        ORDER BY total_orders DESC, state, region LIMIT 1) s)"""
WORST = "worst AS (" + revenue_by("sub_category") + \
    " ORDER BY profit_margin_pct ASC NULLS LAST, sub_category LIMIT 1)"
DEEP = f"""
deep_parts AS (
  SELECT sub_category, COUNT(*) AS k FROM lines WHERE discount > 0.08 GROUP BY sub_category),
deep AS (
  SELECT COUNT(*) AS k,
         {pct(LOSS, 'COUNT(*)')} AS loss_rate,
         (SELECT {pct(LOSS, 'COUNT(*)')} FROM lines) AS baseline,
         (SELECT sub_category FROM deep_parts ORDER BY k DESC, sub_category LIMIT 1) AS part,
         (SELECT {pct('MAX(k)', 'SUM(k)')} FROM deep_parts) AS share
  FROM lines WHERE discount > 0.08)"""
MODES = "modes AS (" + BENCHMARK + ")"


def say_pct(x: str) -> str:
    return f"CAST(CAST(ROUND({x}, 1) AS DECIMAL(20,1)) AS VARCHAR) || '%'"


def say_whole(x: str) -> str:
    return f"format('{{:,}}', CAST(ROUND({x}, 0) AS BIGINT))"


def finding(number: int, source: str, subject: str, evidence: str, value: str, baseline: str,
            k: str) -> str:
    return f"""
SELECT CAST({number} AS BIGINT) AS finding_no, {subject} AS subject, {evidence} AS evidence,
       CAST({value} AS DOUBLE) AS value, CAST({baseline} AS DOUBLE) AS baseline,
       CAST({k} AS BIGINT) AS n
FROM {source}"""


REPORT = (ORDERS, BY_LINE, STATES, PRIORITY, "\n" + WORST, DEEP, benchmark("per_order"), "\n" + MODES)
SQL["findings"] = text(" UNION ALL ".join((
    finding(1, "top_state", "state",
            f"'loss-making orders ' || {say_pct('loss_rate_pct')} || ' of ' || {say_whole('total_orders')} "
            f"|| ' (mean of states ' || {say_pct('mean_rate')} || '); mean discount ' || "
            f"{say_pct('ROUND(d_in, 4) * 100')} || ' (other states ' || "
            f"{say_pct('ROUND(d_out, 4) * 100')} || ')'",
            "loss_rate_pct", "ROUND(mean_rate, 6)", "total_orders"),
    finding(2, "worst", "sub_category",
            f"'margin ' || {say_pct('profit_margin_pct')} || ' on revenue ' || "
            f"{say_whole('total_revenue')} || ', lowest of the sub-categories'",
            "profit_margin_pct", "NULL", "NULL"),
    finding(3, "deep WHERE k > 0", "part",
            f"'lines over 8% discount: ' || {say_whole('k')} || ', loss-making ' || {say_pct('loss_rate')} "
            f"|| ' (all lines ' || {say_pct('baseline')} || '); largest share ' || {say_pct('share')}",
            "loss_rate", "baseline", "k"),
    finding(4, "(SELECT * FROM modes ORDER BY pct_over_benchmark DESC, ship_mode LIMIT 1)",
            "ship_mode",
            "'orders over the 75th percentile of ' || CAST(CAST(ROUND(benchmark_days, 0) AS BIGINT) AS VARCHAR) "
            f"|| ' days: ' || {say_pct('pct_over_benchmark')} || ' of ' || {say_whole('total_orders')}",
            "pct_over_benchmark", "benchmark_days", "total_orders"),
)), *REPORT)
SQL["insights"] = text(" UNION ALL ".join((
    f"""SELECT CAST(1 AS BIGINT) AS insight_no,
        state || ': loss-making orders ' || {say_pct('loss_rate_pct')} || ' of ' ||
        {say_whole('total_orders')} || ' (mean of states ' || {say_pct('mean_rate')} ||
        '), mean discount ' || {say_pct('ROUND(d_in, 4) * 100')} AS insight FROM top_state""",
    f"""SELECT 2, sub_category || ': margin ' || {say_pct('profit_margin_pct')} || ' on revenue ' ||
        {say_whole('total_revenue')} FROM worst""",
    f"""SELECT 3, 'Over 8% discount: loss-making ' || {say_pct('loss_rate')} || ' of ' ||
        {say_whole('k')} || ' lines' FROM deep WHERE k > 0""",
    f"""SELECT 4, ship_mode || ': mean delivery ' ||
        CAST(CAST(ROUND(avg_delivery_days, 1) AS DECIMAL(20,1)) AS VARCHAR) ||
        ' days, over its benchmark ' || {say_pct('pct_over_benchmark')} || ' of orders'
        FROM (SELECT * FROM modes ORDER BY avg_delivery_days DESC, ship_mode LIMIT 1)""",
    f"""SELECT 5, 'All: margin ' || {say_pct('m')} || ', orders ' || {say_whole('k')} ||
        ', revenue ' || {say_whole('r')}
        FROM (SELECT {pct('SUM(profit)', 'SUM(sales)')} AS m, COUNT(DISTINCT order_id) AS k,
                     ROUND(SUM(sales), 2) AS r FROM lines) WHERE k > 0""",
)), *REPORT)

# -- quality --------------------------------------------------------------------------------

RAW_ROW = """order_id, CAST(line_number AS BIGINT) AS line_number, order_date, ship_date, ship_mode,
       customer_id, customer_name, segment, state, region, category, sub_category, product_id,
       product_name, CAST(sales AS DOUBLE) AS sales, CAST(quantity AS BIGINT) AS quantity, CAST(discount AS DOUBLE) AS discount,
       CAST(profit AS DOUBLE) AS profit"""
CLEAN_ROW = RAW_ROW + ", delivery_days, data_quality_flag, is_loss_line"
SQL["normalize_columns"] = text(f"SELECT {RAW_ROW} FROM raw", RAW)
SQL["scan_raw_csv"] = SQL["normalize_columns"]
for name in ("clean_lines", "write_clean", "scan_clean"):
    SQL[name] = text(f"SELECT {CLEAN_ROW} FROM clean", CLEAN)
RESENT = """
resent AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE ship_date <> 'pending')"""
SQL["dedup_lines"] = text("""
SELECT (SELECT COUNT(*) FROM resent) AS n_rows, k AS n_distinct,
       (SELECT COUNT(*) FROM resent) - k AS n_removed
FROM (SELECT COUNT(*) AS k FROM (SELECT DISTINCT * FROM resent))""", RAW, RESENT)

CLEAN_COLUMNS = ("order_id", "line_number", "order_date", "ship_date", "ship_mode",
                 "customer_id", "customer_name", "segment", "state", "region", "category",
                 "sub_category", "product_id", "product_name", "sales", "quantity", "discount",
                 "profit", "delivery_days", "data_quality_flag", "is_loss_line")
SQL["null_profile"] = text(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_null FROM clean"
    for c in CLEAN_COLUMNS), CLEAN)
SQL["parse_dates"] = text("""
SELECT order_id, CAST(line_number AS BIGINT) AS line_number, order_date,
       CASE WHEN order_status <> 'P' THEN ship_date END AS ship_date FROM lines""")
SQL["quality_flag"] = text("""
SELECT CASE WHEN ship_date < order_date THEN 'ship_before_order' ELSE 'ok' END AS data_quality_flag,
       COUNT(*) AS n FROM lines GROUP BY ALL""")
SQL["derive_delivery_days"] = text("""
SELECT order_id, CAST(line_number AS BIGINT) AS line_number, order_date, ship_date, delivery_days
FROM lines""")
RANGES = {"quantity<=0": "quantity <= 0", "sales<=0": "sales <= 0",
          "discount outside [0,1]": "discount < 0 OR discount > 1"}
SQL["range_checks"] = text(" UNION ALL ".join(
    f"SELECT '{name}' AS check_name, COUNT(*) FILTER (WHERE {rule}) AS n_bad FROM lines"
    for name, rule in RANGES.items()))
CATEGORICAL = ("region", "category", "sub_category", "ship_mode", "segment")
SQL["categorical_profile"] = text(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(DISTINCT TRIM({c})) AS n_distinct FROM raw"
    for c in CATEGORICAL), RAW)
SQL["derive_loss_flag"] = text("""
SELECT order_id, CAST(line_number AS BIGINT) AS line_number, CAST(profit AS DOUBLE) AS profit,
       is_loss_line FROM lines""")


def check(step: int, name: str, column: str | None, value: str, source: str) -> str:
    shown = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return (f"SELECT CAST({step} AS BIGINT) AS step, '{name}' AS check_name, {shown} AS column_name, "
            f"CAST({value} AS BIGINT) AS n_rows FROM {source}")


SQL["cleaning_report"] = text(" UNION ALL ".join(
    [check(1, "rows read", None, "COUNT(*)", "resent"),
     check(1, "duplicate rows removed", None,
           "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM resent))", "resent")]
    + [check(2, "missing values", c, f"COUNT(*) - COUNT({c})", "(SELECT DISTINCT * FROM raw)")
       for c in CLEAN_COLUMNS[:18]]
    + [check(3, "unparseable dates", "order_date", "COUNT(*) - COUNT(order_date)", "clean"),
       check(3, "unparseable dates", "ship_date", "COUNT(*) - COUNT(ship_date)", "clean"),
       check(5, "ship_date before order_date", None,
             "COUNT(*) FILTER (WHERE data_quality_flag <> 'ok')", "clean")]
    + [check(4, "unparseable numbers", c, f"COUNT({c}) - COUNT(TRY_CAST({c} AS DECIMAL(38,12)))", "clean")
       for c in ("sales", "quantity", "discount", "profit")]
    + [check(6, name, None, f"COUNT(*) FILTER (WHERE {rule})", "clean")
       for name, rule in RANGES.items()]
    + [check(7, "distinct values after trimming", c, f"COUNT(DISTINCT {c})", "clean")
       for c in CATEGORICAL]
    + [check(8, "loss-making lines", None, "COUNT(*) FILTER (WHERE is_loss_line)", "clean")]
), RAW, RESENT, CLEAN)

HEADERS = """
headers AS (
  SELECT DISTINCT order_id, customer_id, state, region, order_date, ship_date, ship_mode,
         delivery_days FROM lines)"""
# The stored tables before any of them is joined to another but for what it looks up.
BASE = """
shipped AS (SELECT l_orderkey, CAST(MAX(l_shipdate) AS DATE) AS ship_date FROM lineitem GROUP BY ALL),
stored_places AS (
  SELECT n_nationkey AS location_id, n_regionkey AS region_id, n_name AS state, r_name AS region
  FROM nation LEFT JOIN region ON r_regionkey = n_regionkey),
stored_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, c_nationkey AS location_id,
         CAST(o_orderdate AS DATE) AS order_date, ship_date, o_orderpriority AS ship_mode,
         date_diff('day', CAST(o_orderdate AS DATE), ship_date) AS delivery_days
  FROM orders JOIN shipped ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
stored_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS product_id,
         CAST(l_extendedprice AS DOUBLE) * (1 - l_discount) AS sales,
         CAST(l_quantity AS INTEGER) AS quantity, l_discount AS discount, l_quantity, l_extendedprice
  FROM lineitem)"""
NOT_NULL = {
    "locations": ("stored_places", ("state", "region")),
    "customers": ("(SELECT c_custkey AS customer_id, c_name AS customer_name, "
                  "c_mktsegment AS segment FROM customer)",
                  ("customer_id", "customer_name", "segment")),
    "products": ("(SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, "
                 "p_brand AS sub_category, p_retailprice FROM part)",
                 ("product_id", "product_name", "category", "sub_category")),
    "orders": ("stored_orders", ("order_id", "customer_id", "order_date", "ship_date", "ship_mode",
                                 "delivery_days")),
    "order_items": ("stored_items", ("order_id", "product_id", "sales", "quantity", "discount")),
}
CHECKS = {
    "orders": {"delivery_days >= 0": "delivery_days < 0",
               "ship_date >= order_date": "ship_date < order_date"},
    "order_items": {"sales >= 0": "sales < 0", "quantity > 0": "quantity <= 0",
                    "discount between 0 and 1": "discount < 0 OR discount > 1",
                    "whole quantity": "l_quantity <> round(l_quantity)",
                    "amounts in hundredths": "abs(l_extendedprice * 100 - round(l_extendedprice * 100)) > 1e-6 "
                                             "OR abs(discount * 100 - round(discount * 100)) > 1e-6"},
    "products": {"price in hundredths": "abs(p_retailprice * 100 - round(p_retailprice * 100)) > 1e-6"},
}
UNIQUE = {
    "locations unique (location_id)": ("nation", "n_nationkey"),
    "customers unique (customer_id)": ("customer", "c_custkey"),
    "products unique (product_id)": ("part", "p_partkey"),
    "orders unique (order_id)": ("stored_orders", "order_id"),
    "order_items unique (order_id, line_number)": ("stored_items", "(order_id, line_number)"),
}
def orphans(child: str, key: str, parent: str, parent_key: str) -> str:
    return (f"{child} WHERE {key} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} WHERE {parent_key} = {key})")


REFERENCES = {
    "locations.region_id references regions": orphans("nation", "n_regionkey", "region", "r_regionkey"),
    "customers.location_id references locations":
        orphans("customer", "c_nationkey", "nation", "n_nationkey"),
    "orders.customer_id references customers":
        orphans("stored_orders", "customer_id", "customer", "c_custkey"),
    "orders.location_id references locations":
        orphans("stored_orders", "location_id", "nation", "n_nationkey"),
    "order_items.order_id references orders":
        orphans("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "order_items.product_id references products":
        orphans("lineitem", "l_partkey", "part", "p_partkey"),
}
LENGTHS = {
    "locations": {"state": 100, "region": 50}, "customers": {"customer_name": 150, "segment": 50},
    "products": {"product_name": 255, "category": 50, "sub_category": 50},
    "orders": {"ship_mode": 30},
}
SQL["constraint_violations"] = text(" UNION ALL ".join(
    [f"SELECT '{t}.{c} not null' AS rule, COUNT(*) - COUNT({c}) AS n_violations FROM {source}"
     for t, (source, columns) in NOT_NULL.items() for c in columns]
    + [f"SELECT '{t}: {name}', COUNT(*) FILTER (WHERE {bad}) FROM {NOT_NULL[t][0]}"
       for t, rules in CHECKS.items() for name, bad in rules.items()]
    + [f"SELECT '{t}.{c} at most {k} characters', COUNT(*) FILTER (WHERE length({c}) > {k}) "
       f"FROM {NOT_NULL[t][0]}" for t, limits in LENGTHS.items() for c, k in limits.items()]
    + [f"SELECT '{name}', COUNT(*) - COUNT(DISTINCT {key}) FROM {source}"
       for name, (source, key) in UNIQUE.items()]
    + [f"SELECT '{name}', COUNT(*) FROM {source}" for name, source in REFERENCES.items()]
), BASE)
SQL["quarantine_lines"] = text("""
SELECT * FROM (
  SELECT order_id, CAST(line_number AS BIGINT) AS line_number, order_date, ship_date, delivery_days,
         CAST(sales AS DOUBLE) AS sales, CAST(quantity AS BIGINT) AS quantity,
         CAST(discount AS DOUBLE) AS discount,
         concat_ws('; ', CASE WHEN delivery_days < 0 THEN 'delivery_days >= 0' END,
                   CASE WHEN ship_date < order_date THEN 'ship_date >= order_date' END,
                   CASE WHEN sales < 0 THEN 'sales >= 0' END,
                   CASE WHEN quantity <= 0 THEN 'quantity > 0' END,
                   CASE WHEN discount < 0 OR discount > 1 THEN 'discount between 0 and 1' END)
           AS broken_rules
  FROM lines) WHERE broken_rules <> ''""")
SQL["accepted_lines"] = text("""
SELECT order_id, CAST(line_number AS BIGINT) AS line_number, order_date, ship_date, delivery_days,
       CAST(sales AS DOUBLE) AS sales, CAST(quantity AS BIGINT) AS quantity,
       CAST(discount AS DOUBLE) AS discount
FROM lines
WHERE NOT (delivery_days < 0 OR ship_date < order_date OR sales < 0 OR quantity <= 0
           OR discount < 0 OR discount > 1)""")
SQL["append_stored"] = text("SELECT DISTINCT customer_id, customer_name, segment FROM lines")
SQL["duplicate_keys"] = text("""
SELECT COUNT(*) AS n_keys, CAST(COALESCE(SUM(k - 1), 0) AS BIGINT) AS n_repeats
FROM (SELECT COUNT(*) AS k FROM lines GROUP BY order_id, line_number HAVING COUNT(*) > 1)""")
SQL["order_fd_check"] = text(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_orders FROM "
    f"(SELECT order_id FROM lines GROUP BY order_id HAVING COUNT(DISTINCT {c}) > 1)"
    for c in ("state", "ship_mode", "delivery_days", "line_ship_date")))
SQL["dataset_overview"] = text("""
SELECT COUNT(*) AS n_rows, CAST(20 AS BIGINT) AS n_columns, COUNT(DISTINCT order_id) AS n_orders,
       MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date FROM lines""")
TYPES = {
    "order_id": "bigint", "line_number": "int", "order_date": "date", "ship_date": "date",
    "delivery_days": "int", "ship_mode": "string", "customer_id": "bigint",
    "customer_name": "string", "segment": "string", "state": "string", "region": "string",
    "product_id": "bigint", "product_name": "string", "category": "string",
    "sub_category": "string", "sales": "decimal(14,4)", "quantity": "int",
    "discount": "decimal(4,2)", "profit": "decimal(14,4)", "is_loss_line": "boolean",
}
SQL["column_types"] = text(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, COUNT({c}) AS n_values FROM lines"
    for c, t in TYPES.items()))

# -- star schema and files --------------------------------------------------------------------

SQL["order_lines"] = text(f"SELECT {LINE} FROM lines")
SQL["clean_and_report"] = SQL["cleaning_report"]
SQL["gate_report"] = """
WITH places AS (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey),
buyers AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM places)),
placed AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM buyers)),
used AS (
  SELECT 'line_product' AS key_set, l_partkey AS key, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) AS good
  FROM lineitem
  UNION ALL SELECT 'line_order', l_orderkey, EXISTS (SELECT 1 FROM placed WHERE o_orderkey = l_orderkey) FROM lineitem
  UNION ALL SELECT 'order_customer', o_custkey, EXISTS (SELECT 1 FROM buyers WHERE c_custkey = o_custkey) FROM orders)
SELECT s.key_set, COUNT(DISTINCT key) AS n_keys, COUNT(good) AS n_rows
FROM (VALUES ('line_product'), ('line_order'), ('order_customer')) s(key_set)
LEFT JOIN used u ON u.key_set = s.key_set AND NOT good
GROUP BY s.key_set"""
GROUPED = "COUNT(DISTINCT order_id) AS total_orders, COUNT(*) AS total_line_items"
SQL["rollups_in_one_pass"] = text(f"""
SELECT CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(sub_category) = 0 THEN 'sub_category'
            WHEN GROUPING(region) = 0 THEN 'region' WHEN GROUPING(state) = 0 THEN 'state'
            WHEN GROUPING(ship_mode) = 0 THEN 'ship_mode'
            WHEN GROUPING(segment) = 0 AND GROUPING(discount_band) = 0 THEN 'segment, discount_band'
            WHEN GROUPING(segment) = 0 THEN 'segment' ELSE 'discount_band' END AS grouping,
       COALESCE(category, sub_category, region, state, ship_mode, segment) AS key, discount_band,
       {GROUPED}, {n(LOSS)} AS loss_making_lines,
       {money('sales')} AS total_revenue, {money('profit')} AS total_profit
FROM (SELECT *, {BAND} AS discount_band FROM lines)
GROUP BY GROUPING SETS (category, sub_category, region, state, ship_mode, segment,
                        (segment, discount_band), discount_band)""")
SQL["distinct_by_year"] = text(" UNION ALL ".join(
    f"SELECT YEAR(order_date) AS order_year, '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_distinct, "
    "TRUE AS within_bound FROM lines GROUP BY 1" for c in ("customer_id", "order_id")))
SQL["sales_quantiles_by_year"] = text("""
SELECT YEAR(order_date) AS order_year, share, COUNT(*) AS n_rows, TRUE AS within_bound
FROM lines, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) s(share) GROUP BY 1, 2""")
SQL["refreshed_orders"] = text(f"""
SELECT order_id, order_date, ship_mode, customer_id, segment, state, region, ship_date, COUNT(*) AS n_lines,
       CAST(SUM(sales) AS DOUBLE) AS sum_sales, CAST(SUM(profit) AS DOUBLE) AS sum_profit,
       {n(LOSS)} AS n_loss_lines, CAST(SUM(discount) AS DOUBLE) AS sum_discount, delivery_days
FROM lines GROUP BY ALL""")
SQL["scan_star_view"] = SQL["order_lines"]
SQL["scan_star_filtered"] = SQL["filter_lines"]
SQL["load_batches"] = text(f"SELECT DISTINCT {LINE} FROM lines")
BATCHES = """
dealt AS (
  SELECT *, order_date < DATE '1998-01-01' AND state < 'K' AS early FROM lines)"""
SQL["batch_audit"] = text(" UNION ALL ".join(
    f"SELECT '{table}' AS table_name, CAST(batch AS BIGINT) AS batch, COUNT(*) AS n_rows FROM ("
    f"SELECT {key}, CASE WHEN BOOL_OR(early) THEN 0 ELSE 1 END AS batch FROM dealt GROUP BY ALL) GROUP BY batch"
    for table, key in (("locations", "state"), ("customers", "customer_id"), ("products", "product_id"),
                       ("orders", "order_id"),
                       ("order_items", "order_id, line_number, product_id, sales, quantity, discount, profit"))), BATCHES)
SQL["place_ids"] = text("""
SELECT state, region, ROW_NUMBER() OVER (ORDER BY CASE WHEN early THEN 0 ELSE 1 END, md5('=' || state)) AS location_id
FROM (SELECT state, region, BOOL_OR(early) AS early FROM dealt GROUP BY state, region)""", BATCHES)
SQL["dim_locations"] = text("SELECT DISTINCT state, region FROM lines")
SQL["dim_customers"] = text("SELECT DISTINCT customer_id, customer_name, segment FROM lines")
SQL["dim_products"] = text(
    "SELECT DISTINCT product_id, product_name, category, sub_category FROM lines")
SQL["order_headers"] = text("SELECT * FROM headers", HEADERS)
SQL["fact_order_items"] = text("""
SELECT order_id, CAST(line_number AS BIGINT) AS line_number, product_id, CAST(sales AS DOUBLE) AS sales,
       CAST(quantity AS BIGINT) AS quantity, CAST(discount AS DOUBLE) AS discount,
       CAST(profit AS DOUBLE) AS profit FROM lines""")
SQL["append_new_rows"] = text("""
SELECT DISTINCT customer_id, customer_name, segment FROM lines
WHERE order_date >= DATE '1999-01-01' AND customer_id NOT IN (
  SELECT customer_id FROM lines WHERE order_date < DATE '1999-01-01')""")
SQL["load_audit"] = text("""
SELECT 'locations' AS table_name, COUNT(DISTINCT state) AS n_rows FROM lines
UNION ALL SELECT 'customers', COUNT(DISTINCT customer_id) FROM lines
UNION ALL SELECT 'products', COUNT(DISTINCT product_id) FROM lines
UNION ALL SELECT 'orders', COUNT(DISTINCT order_id) FROM lines
UNION ALL SELECT 'order_items', COUNT(*) FROM lines""")
