"""Expected results as SQL over the given tables, one text per query."""

from __future__ import annotations

# ---------------------------------------------------------------- building blocks

FLAT = """flat AS (
  SELECT *, CAST(sales - 0.6 * retail * units AS DECIMAL(18,4)) AS profit
  FROM (
    SELECT l_orderkey AS order_id,
           CAST(o_orderdate AS DATE) AS order_date,
           CAST(l_shipdate AS DATE) AS ship_date,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
             WHEN '3-MEDIUM' THEN 'Second Class' WHEN '4-NOT SPECIFIED' THEN 'Standard Class'
             ELSE o_orderpriority END AS ship_mode,
           o_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
           'World' AS country, n_name AS state, n_name AS city,
           CAST(n_nationkey AS VARCHAR) AS postal_code, r_name AS region,
           l_partkey AS product_id, p_type AS category, p_brand AS sub_category,
           p_name AS product_name,
           CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
             AS DECIMAL(18,4)) AS sales,
           CAST(l_quantity AS INTEGER) AS quantity,
           CAST(l_discount AS DECIMAL(4,2)) AS discount,
           CAST(p_retailprice AS DECIMAL(12,2)) AS retail,
           CAST(l_quantity AS DECIMAL(6,0)) AS units
    FROM lineitem
    LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN part ON l_partkey = p_partkey))"""

LINES = """lines AS (
  SELECT *, sales - profit AS cost,
         CASE WHEN sales <> 0 THEN CAST(profit AS DOUBLE) / CAST(sales AS DOUBLE) ELSE 0 END AS margin
  FROM flat)"""

RETURNED = """returned AS (
  SELECT l_orderkey AS order_id FROM lineitem GROUP BY l_orderkey
  HAVING bool_or(l_returnflag = 'R'))"""

RETURN_ROWS = """return_rows AS (
  SELECT DISTINCT order_id, customer_id, product_id, order_date, region
  FROM flat JOIN returned USING (order_id))"""

MANAGERS = """managers AS (
  SELECT r_name AS region, min(s_name) AS manager_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name)"""


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def avg(col: str) -> str:
    """Mean as one division of doubles over an exact sum."""
    return f"{dbl(f'sum({col})')} / NULLIF(count({col}), 0)"


def half_up(expr: str, digits: int) -> str:
    """Rounds the shortest decimal text of a double, halves away from zero."""
    text = f"CAST(CAST({dbl(expr)} AS VARCHAR) AS DECIMAL(38,15))"
    return dbl(f"round({text}, {digits})")


def pct(expr: str, digits: int = 1) -> str:
    return half_up(f"{dbl(expr)} * 100", digits)


MONTHLY = f"""monthly AS (
  SELECT *, total_revenue / NULLIF(total_orders, 0) AS revenue_per_order,
         total_profit / NULLIF(total_orders, 0) AS profit_per_order
  FROM (
    SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
           strftime(order_date, '%B') AS month_name,
           {dbl('sum(sales)')} AS total_revenue, {dbl('sum(profit)')} AS total_profit,
           {dbl('sum(cost)')} AS total_cost, count(DISTINCT order_id) AS total_orders,
           CAST(sum(quantity) AS BIGINT) AS total_units_sold,
           {avg('sales')} AS avg_line_item_value, {avg('discount')} AS avg_discount,
           {avg('margin')} AS avg_profit_margin,
           {dbl('sum(sales * discount)')} AS total_discount_amount
    FROM lines GROUP BY 1, 2, 3))"""

LTV = f"""ltv AS (
  SELECT *, total_returns / NULLIF({dbl('total_orders')}, 0) AS return_rate,
         CAST(date_diff('day', first_order_date, last_order_date) AS INTEGER) AS customer_tenure_days,
         CASE WHEN lifetime_revenue >= 2500000 THEN 'Platinum'
              WHEN lifetime_revenue >= 2000000 THEN 'Gold'
              WHEN lifetime_revenue >= 1500000 THEN 'Silver' ELSE 'Bronze' END AS ltv_tier
  FROM (
    SELECT customer_id, customer_name, segment,
           {dbl('sum(sales)')} AS lifetime_revenue, {dbl('sum(profit)')} AS lifetime_profit,
           count(DISTINCT order_id) AS total_orders,
           CAST(sum(quantity) AS BIGINT) AS total_units_purchased,
           {avg('sales')} AS avg_order_value,
           min(order_date) AS first_order_date, max(order_date) AS last_order_date,
           {avg('discount')} AS avg_discount_received,
           count(DISTINCT CASE WHEN order_id IN (SELECT order_id FROM returned)
                 THEN order_id END) AS total_returns
    FROM lines GROUP BY customer_id, customer_name, segment))"""

PRODUCT = f"""product AS (
  SELECT *, CAST(rank() OVER (ORDER BY total_revenue DESC NULLS LAST) AS INTEGER) AS revenue_rank,
         CAST(rank() OVER (ORDER BY total_profit DESC NULLS LAST) AS INTEGER) AS profit_rank
  FROM (
    SELECT sold.*, coalesce(total_returns, 0) AS total_returns,
           CASE WHEN total_orders > 0
                THEN coalesce(total_returns, 0) / {dbl('total_orders')} ELSE 0 END AS return_rate
    FROM (
      SELECT product_id, product_name, category, sub_category,
             {dbl('sum(sales)')} AS total_revenue, {dbl('sum(profit)')} AS total_profit,
             CAST(sum(quantity) AS BIGINT) AS total_units_sold,
             count(DISTINCT order_id) AS total_orders,
             {avg('margin')} AS avg_profit_margin, {avg('discount')} AS avg_discount
      FROM lines GROUP BY ALL) sold
    LEFT JOIN (SELECT product_id, count(*) AS total_returns FROM return_rows GROUP BY product_id)
      USING (product_id)))"""

_PLACE = f"""{dbl('sum(sales)')} AS total_revenue, {dbl('sum(profit)')} AS total_profit,
           {dbl('sum(cost)')} AS total_cost, count(DISTINCT order_id) AS total_orders,
           count(DISTINCT customer_id) AS total_customers,
           CAST(sum(quantity) AS BIGINT) AS total_units_sold,
           {avg('margin')} AS avg_profit_margin, {avg('discount')} AS avg_discount"""

REGIONAL = f"""regional AS (
  SELECT *, total_revenue / NULLIF(total_customers, 0) AS revenue_per_customer,
         total_profit / NULLIF(total_customers, 0) AS profit_per_customer
  FROM (SELECT region, manager_name, {_PLACE}
        FROM lines LEFT JOIN managers USING (region) GROUP BY region, manager_name))"""

CATEGORY_BASE = f"""quarterly AS (
  SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(quarter(order_date) AS INTEGER) AS quarter,
         category, sub_category,
         {dbl('sum(sales)')} AS total_revenue, {dbl('sum(profit)')} AS total_profit,
         CAST(sum(quantity) AS BIGINT) AS total_units_sold,
         count(DISTINCT order_id) AS total_orders, {avg('margin')} AS avg_profit_margin
  FROM lines GROUP BY 1, 2, 3, 4)"""

_GROWTH = """(total_revenue - prev_year_revenue) / NULLIF(prev_year_revenue, 0) * 100
           AS yoy_revenue_growth,
         (total_profit - prev_year_profit) / NULLIF(prev_year_profit, 0) * 100 AS yoy_profit_growth"""

CATEGORY = f"""category_trends AS (
  SELECT *, {_GROWTH}
  FROM (SELECT *, lag(total_revenue) OVER w AS prev_year_revenue,
               lag(total_profit) OVER w AS prev_year_profit
        FROM quarterly
        WINDOW w AS (PARTITION BY quarter, category, sub_category ORDER BY year)))"""

CATEGORY_STRICT = f"""category_trends AS (
  SELECT *, {_GROWTH}
  FROM (SELECT q.*, p.total_revenue AS prev_year_revenue, p.total_profit AS prev_year_profit
        FROM quarterly q LEFT JOIN quarterly p
          ON p.year = q.year - 1 AND p.quarter = q.quarter
         AND p.category = q.category AND p.sub_category = q.sub_category))"""

SHIP_TEXT = """CASE ship_mode WHEN 'First Class' THEN 'Priority shipping (1-2 business days)'
             WHEN 'Second Class' THEN 'Standard priority (2-4 business days)'
             WHEN 'Standard Class' THEN 'Regular shipping (4-7 business days)'
             WHEN 'Same Day' THEN 'Same day delivery' ELSE 'Unknown' END"""

SHIPPING = f"""shipping AS (
  SELECT *, total_revenue / NULLIF(sum(total_revenue) OVER (), 0) * 100 AS revenue_share_pct,
         total_orders / {dbl('sum(total_orders) OVER ()')} * 100 AS order_share_pct
  FROM (
    SELECT ship_mode, {SHIP_TEXT} AS ship_mode_description,
           {dbl('sum(sales)')} AS total_revenue, {dbl('sum(profit)')} AS total_profit,
           count(DISTINCT order_id) AS total_orders,
           CAST(sum(quantity) AS BIGINT) AS total_units_shipped,
           {avg("date_diff('day', order_date, ship_date)")} AS avg_delivery_days,
           CAST(min(date_diff('day', order_date, ship_date)) AS INTEGER) AS min_delivery_days,
           CAST(max(date_diff('day', order_date, ship_date)) AS INTEGER) AS max_delivery_days,
           {avg('margin')} AS avg_profit_margin
    FROM lines GROUP BY ship_mode))"""

STATE = f"""state_sales AS (
  SELECT *, total_revenue / NULLIF(total_customers, 0) AS revenue_per_customer,
         total_orders / NULLIF({dbl('total_customers')}, 0) AS orders_per_customer,
         total_revenue / NULLIF(total_orders, 0) AS avg_order_value,
         CASE WHEN total_cost > 0 THEN total_profit / total_cost ELSE 0 END AS profit_to_cost_ratio,
         CAST(rank() OVER (ORDER BY total_revenue DESC NULLS LAST) AS INTEGER) AS state_revenue_rank
  FROM (SELECT country, state, region, {_PLACE},
               min(order_date) AS first_order_date, max(order_date) AS last_order_date
        FROM lines GROUP BY country, state, region))"""

_NEEDS = {
    "flat": [FLAT],
    "lines": [FLAT, LINES],
    "return_rows": [FLAT, RETURNED, RETURN_ROWS],
    "monthly": [FLAT, LINES, MONTHLY],
    "ltv": [FLAT, LINES, RETURNED, LTV],
    "product": [FLAT, LINES, RETURNED, RETURN_ROWS, PRODUCT],
    "regional": [FLAT, LINES, MANAGERS, REGIONAL],
    "category_trends": [FLAT, LINES, CATEGORY_BASE, CATEGORY],
    "category_strict": [FLAT, LINES, CATEGORY_BASE, CATEGORY_STRICT],
    "shipping": [FLAT, LINES, SHIPPING],
    "state_sales": [FLAT, LINES, STATE],
}


def over(source: str, select: str) -> str:
    """A SELECT over one of the blocks above."""
    return "WITH " + ",\n".join(_NEEDS[source]) + "\n" + select


# Columns that average doubles depend on the order of addition in the last digits.
def six(col: str) -> str:
    return half_up(col, 6)


# ---------------------------------------------------------------- star schema

QUERIES: dict[str, str] = {}
Q = QUERIES

Q["clean_names"] = """
SELECT p_partkey, replace(replace(replace(replace(lower(trim(label)), ' ', '_'), '-', '_'),
       '(', ''), ')', '') AS cleaned
FROM (SELECT p_partkey, ' ' || p_name || ' - ' || p_type || ' (' || p_brand || ') ' AS label FROM part)"""

Q["raw_orders"] = over("flat", f"""
SELECT order_id, order_date, ship_date, ship_mode, customer_id, customer_name, segment,
       country AS country_region, city, state AS state_province, postal_code, region, product_id,
       category, sub_category, product_name, {dbl('sales')} AS sales, quantity,
       {dbl('discount')} AS discount, {dbl('profit')} AS profit
FROM flat""")
Q["raw_returns"] = """
SELECT l_orderkey AS order_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'Yes' ELSE 'No' END AS returned
FROM lineitem GROUP BY l_orderkey"""
Q["raw_people"] = f"WITH {MANAGERS} SELECT manager_name AS regional_manager, region FROM managers"

Q["dim_customer"] = over("flat", "SELECT DISTINCT customer_id, customer_name, segment FROM flat")
Q["dim_product"] = over(
    "flat", "SELECT DISTINCT product_id, category, sub_category, product_name FROM flat"
)
Q["dim_geography"] = over(
    "flat", "SELECT DISTINCT country, state, city, postal_code, region FROM flat"
)
Q["dim_ship_mode"] = over(
    "flat", f"SELECT DISTINCT ship_mode, {SHIP_TEXT} AS ship_mode_description FROM flat"
)
Q["dim_date"] = over("flat", """
SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date,
       CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
       CAST(month(date) AS INTEGER) AS month, strftime(date, '%B') AS month_name,
       CAST(day(date) AS INTEGER) AS day, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week,
       strftime(date, '%A') AS day_name, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
       dayofweek(date) IN (0, 6) AS is_weekend
FROM (SELECT order_date AS date FROM flat UNION SELECT ship_date FROM flat)""")
Q["dim_regional_manager"] = f"WITH {MANAGERS} SELECT manager_name, region FROM managers"

Q["fact_sales"] = over("lines", f"""
SELECT order_id, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS order_date_key,
       CAST(strftime(ship_date, '%Y%m%d') AS INTEGER) AS ship_date_key,
       customer_id, product_id, state, ship_mode, {dbl('sales')} AS revenue, quantity,
       {dbl('discount')} AS discount, {dbl('profit')} AS profit, {dbl('cost')} AS cost,
       {six('margin')} AS profit_margin
FROM lines""")
Q["fact_returns"] = over("return_rows", """
SELECT order_id, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS order_date_key,
       customer_id, product_id
FROM return_rows""")

# ---------------------------------------------------------------- marts

_M = f"total_revenue, total_profit, total_orders, {six('avg_profit_margin')} AS avg_profit_margin"

Q["monthly_sales"] = over("monthly", f"""
SELECT year, month, month_name, total_cost, total_units_sold, avg_line_item_value, avg_discount,
       total_discount_amount, revenue_per_order, profit_per_order, {_M}
FROM monthly""")
Q["customer_ltv"] = over("ltv", "SELECT * FROM ltv")
Q["product_performance"] = over("product", f"""
SELECT product_id, product_name, category, sub_category, total_units_sold, avg_discount,
       total_returns, return_rate, revenue_rank, profit_rank, {_M}
FROM product""")
Q["regional_summary"] = over("regional", f"""
SELECT region, manager_name, total_cost, total_customers, total_units_sold, avg_discount,
       revenue_per_customer, profit_per_customer, {_M}
FROM regional""")
_CATEGORY = f"""
SELECT year, quarter, category, sub_category, total_units_sold, prev_year_revenue,
       {six('yoy_revenue_growth')} AS yoy_revenue_growth, prev_year_profit,
       {six('yoy_profit_growth')} AS yoy_profit_growth, {_M}
FROM category_trends"""
Q["category_trends"] = over("category_trends", _CATEGORY)
Q["category_trends_strict"] = over("category_strict", _CATEGORY)
Q["shipping_analysis"] = over("shipping", f"""
SELECT ship_mode, ship_mode_description, total_units_shipped, avg_delivery_days,
       min_delivery_days, max_delivery_days, {six('revenue_share_pct')} AS revenue_share_pct,
       {six('order_share_pct')} AS order_share_pct, {_M}
FROM shipping""")
Q["state_performance"] = over("state_sales", f"""
SELECT country, state, region, total_cost, total_customers, total_units_sold, avg_discount,
       first_order_date, last_order_date, revenue_per_customer, orders_per_customer,
       avg_order_value, profit_to_cost_ratio, state_revenue_rank, {_M}
FROM state_sales""")

# ---------------------------------------------------------------- marts merged from state, other plans

for _name in (
    "monthly_sales",
    "customer_ltv",
    "product_performance",
    "regional_summary",
    "category_trends",
    "shipping_analysis",
    "state_performance",
):
    Q[f"gold_{_name}"] = Q[_name]
Q["gold_replaced_months"] = Q["monthly_sales"]
for _name in ("regional_summary", "category_trends", "state_performance"):
    Q[f"{_name}_large"] = Q[_name]
# business keys of the given tables own one dimension row each
for _name in ("fact_sales_unique", "fact_sales_joined", "fact_sales_null_safe"):
    Q[_name] = Q["fact_sales"]
Q["fact_returns_joined"] = Q["fact_returns"]
Q["gold_one_year"] = Q["monthly_sales"] + " WHERE year = 1995"
Q["category_trends_gap"] = Q["category_trends_strict"].replace(
    "FROM lines GROUP BY 1, 2, 3, 4)", "FROM lines WHERE year(order_date) <> 1994 GROUP BY 1, 2, 3, 4)"
)
Q["report_yearly_orders"] = over("flat", """
SELECT CAST(year(order_date) AS INTEGER) AS year, count(DISTINCT order_id) AS total_orders FROM flat GROUP BY 1""")
Q["report_category_orders"] = over("category_trends", """
SELECT category, total_orders, summed_orders
FROM (SELECT category, count(DISTINCT order_id) AS total_orders FROM flat GROUP BY category)
JOIN (SELECT category, CAST(sum(total_orders) AS BIGINT) AS summed_orders FROM category_trends GROUP BY category)
  USING (category)""")

# ---------------------------------------------------------------- checks

Q["table_inventory"] = "WITH " + ",\n".join([FLAT, LINES, RETURNED, RETURN_ROWS, MANAGERS, MONTHLY, LTV, PRODUCT, REGIONAL, CATEGORY_BASE, CATEGORY, SHIPPING, STATE]) + """
SELECT * FROM (
  SELECT 'bronze' AS layer, 'orders' AS "table", 'FACT' AS kind, count(*) AS rows, 20 AS columns FROM lineitem
  UNION ALL SELECT 'bronze', 'people', 'FACT', count(*), 2 FROM managers
  UNION ALL SELECT 'bronze', 'returns', 'FACT', count(DISTINCT l_orderkey), 2 FROM lineitem
  UNION ALL SELECT 'silver', 'dim_customer', 'DIMENSION', count(*), 4
    FROM (SELECT DISTINCT customer_id, customer_name, segment FROM flat)
  UNION ALL SELECT 'silver', 'dim_product', 'DIMENSION', count(*), 5
    FROM (SELECT DISTINCT product_id, category, sub_category, product_name FROM flat)
  UNION ALL SELECT 'silver', 'dim_geography', 'DIMENSION', count(*), 6
    FROM (SELECT DISTINCT country, state, city, postal_code, region FROM flat)
  UNION ALL SELECT 'silver', 'dim_ship_mode', 'DIMENSION', count(DISTINCT ship_mode), 3 FROM flat
  UNION ALL SELECT 'silver', 'dim_date', 'DIMENSION', count(*), 11
    FROM (SELECT order_date FROM flat UNION SELECT ship_date FROM flat)
  UNION ALL SELECT 'silver', 'dim_regional_manager', 'DIMENSION', count(*), 3 FROM managers
  UNION ALL SELECT 'silver', 'fact_sales', 'FACT', count(*), 14 FROM flat
  UNION ALL SELECT 'silver', 'fact_returns', 'FACT', count(*), 5 FROM return_rows
  UNION ALL SELECT 'gold', 'agg_monthly_sales', 'FACT', count(*), 14 FROM monthly
  UNION ALL SELECT 'gold', 'agg_customer_lifetime_value', 'FACT', count(*), 16 FROM ltv
  UNION ALL SELECT 'gold', 'agg_product_performance', 'FACT', count(*), 15 FROM product
  UNION ALL SELECT 'gold', 'agg_regional_summary', 'FACT', count(*), 12 FROM regional
  UNION ALL SELECT 'gold', 'agg_category_trends', 'FACT', count(*), 13 FROM category_trends
  UNION ALL SELECT 'gold', 'agg_shipping_analysis', 'FACT', count(*), 12 FROM shipping
  UNION ALL SELECT 'gold', 'agg_state_performance', 'FACT', count(*), 18 FROM state_sales)"""
Q["dq_duplicate_keys"] = over("flat", """
SELECT 'dim_customer' AS dimension, CAST(customer_id AS VARCHAR) AS business_key, count(*) AS versions
FROM (SELECT DISTINCT customer_id, customer_name, segment FROM flat)
GROUP BY customer_id HAVING count(*) > 1
UNION ALL
SELECT 'dim_product', CAST(product_id AS VARCHAR), count(*)
FROM (SELECT DISTINCT product_id, category, sub_category, product_name FROM flat)
GROUP BY product_id HAVING count(*) > 1
UNION ALL
SELECT 'dim_geography', concat_ws('|', country, state, city, postal_code), count(*)
FROM (SELECT DISTINCT country, state, city, postal_code, region FROM flat)
GROUP BY country, state, city, postal_code HAVING count(*) > 1""")
Q["dq_shared_labels"] = over("flat", """
SELECT 'dim_product' AS dimension, product_name AS business_key, count(DISTINCT product_id) AS versions
FROM flat GROUP BY product_name HAVING count(DISTINCT product_id) > 1""")


def _reference(name: str, table: str, column: str, absent: str = "false", missing: str | None = None) -> str:
    missing = missing or f"{column} IS NULL"
    return f"""
SELECT '{name}' AS reference, '{table}' AS dimension, count(*) AS fact_rows,
       count(*) FILTER (WHERE {missing}) AS rows_without_key,
       count(*) FILTER (WHERE NOT ({missing}) AND ({absent})) AS orphan_rows
FROM flat"""


_PLAIN_REFERENCES = (
    _reference("product_key", "dim_product", "product_id", "product_id NOT IN (SELECT p_partkey FROM part)"),
    _reference("ship_mode_key", "dim_ship_mode", "ship_mode"),
    _reference("order_date_key", "dim_date", "order_date"),
    _reference("ship_date_key", "dim_date", "ship_date"),
)
Q["dq_orphan_facts"] = over("flat", "\nUNION ALL".join([
    _reference("customer_key", "dim_customer", "customer_id", "customer_id NOT IN (SELECT c_custkey FROM customer)"),
    _reference("geography_key", "dim_geography", "state"),
    *_PLAIN_REFERENCES,
]))
Q["dq_orphan_facts_found"] = over("flat", "\nUNION ALL".join([
    _reference("customer_key", "dim_customer", "customer_id", "customer_id % 10 = 0"),
    _reference("geography_key", "dim_geography", "state", missing="order_id % 7 = 0"),
    *_PLAIN_REFERENCES,
]))
# one row per business key, so no two rows that could share a surrogate key
Q["dq_key_clashes"] = over("flat", """
SELECT 'dim_customer' AS dimension, customer_id AS key, count(*) AS rows
FROM (SELECT DISTINCT customer_id, customer_name, segment FROM flat) GROUP BY ALL HAVING count(*) > 1
UNION ALL
SELECT 'dim_product', product_id, count(*)
FROM (SELECT DISTINCT product_id, category, sub_category, product_name FROM flat) GROUP BY ALL HAVING count(*) > 1""")
Q["dq_key_clashes_found"] = over("flat", """
SELECT 'dim_customer' AS dimension, customer_id % 1000 AS key, count(*) AS rows
FROM (SELECT DISTINCT customer_id, customer_name, segment FROM flat) GROUP BY ALL HAVING count(*) > 1
UNION ALL
SELECT 'dim_product', product_id % 700, count(*)
FROM (SELECT DISTINCT product_id, category, sub_category, product_name FROM flat) GROUP BY ALL HAVING count(*) > 1
UNION ALL
SELECT 'dim_geography', length(state), count(*)
FROM (SELECT DISTINCT country, state, city, postal_code, region FROM flat) GROUP BY ALL HAVING count(*) > 1
UNION ALL
SELECT 'dim_ship_mode', length(ship_mode), count(*)
FROM (SELECT DISTINCT ship_mode FROM flat) GROUP BY ALL HAVING count(*) > 1""")
Q["fact_sales_settled"] = Q["fact_sales"]
Q["dq_duplicate_keys_found"] = over("flat", """
SELECT 'dim_product' AS dimension, CAST(product_id AS VARCHAR) AS business_key, count(DISTINCT order_id % 2) AS versions
FROM flat GROUP BY product_id HAVING count(DISTINCT order_id % 2) > 1""")
Q["dq_unread_dates"] = over("flat", """
SELECT 'order_date' AS date_column, count(order_date) AS present,
       count(*) FILTER (WHERE order_date IS NOT NULL AND order_id % 3 = 2) AS unread FROM flat
UNION ALL SELECT 'ship_date', count(ship_date), CAST(0 AS BIGINT) FROM flat""")
Q["dq_manager_fanout_found"] = "WITH " + ",\n".join([FLAT, MANAGERS]) + """
SELECT region, CAST(CASE WHEN region LIKE 'A%' THEN 0 WHEN region LIKE 'E%' THEN 2 * count(manager_name)
                    ELSE count(manager_name) END AS BIGINT) AS managers
FROM (SELECT DISTINCT region FROM flat) LEFT JOIN managers USING (region)
GROUP BY region HAVING managers <> 1"""
Q["dq_manager_fanout"] = "WITH " + ",\n".join([FLAT, MANAGERS]) + """
SELECT region, count(manager_name) AS managers
FROM (SELECT DISTINCT region FROM flat) LEFT JOIN managers USING (region)
GROUP BY region HAVING count(manager_name) <> 1"""

# ---------------------------------------------------------------- reports on months


def _kpi(money: int, margin: str, extended: bool = False) -> str:
    more = (
        f""", CAST(sum(total_units_sold) AS BIGINT) AS total_units,
       {half_up('avg(revenue_per_order)', money)} AS avg_order_value"""
        if extended
        else ""
    )
    return over("monthly", f"""
SELECT {half_up('sum(total_revenue)', money)} AS total_revenue,
       {half_up('sum(total_profit)', money)} AS total_profit,
       CAST(sum(total_orders) AS BIGINT) AS total_orders, {margin}{more}
FROM monthly""")


Q["report_kpi"] = _kpi(0, pct("avg(avg_profit_margin)") + " AS avg_margin_pct")
Q["report_kpi_cents"] = _kpi(2, pct("avg(avg_profit_margin)") + " AS avg_profit_margin_pct")
Q["report_kpi_ext"] = _kpi(0, half_up("avg(avg_profit_margin)", 1) + " AS avg_margin", True)
Q["report_kpi_counters"] = over("monthly", f"""
SELECT {half_up('sum(total_revenue)', 3)} AS total_revenue,
       {half_up('sum(total_profit)', 3)} AS total_profit,
       CAST(sum(total_orders) AS BIGINT) AS total_orders,
       CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold,
       {six('avg(avg_profit_margin)')} AS avg_profit_margin,
       {half_up('avg(revenue_per_order)', 3)} AS revenue_per_order
FROM monthly""")


def _money(digits: int | None, *names: tuple[str, str]) -> str:
    return ", ".join(f"{col if digits is None else half_up(col, digits)} AS {n}" for col, n in names)


_TEXT_YEAR = "CAST(year AS VARCHAR) AS year"
_RP = (("total_revenue", "revenue"), ("total_profit", "profit"))
_TRTP = (("total_revenue", "total_revenue"), ("total_profit", "total_profit"))
for _name, _digits in (("report_monthly", 2), ("report_monthly_whole", 0)):
    Q[_name] = over(
        "monthly",
        f"SELECT {_TEXT_YEAR}, month, month_name, {_money(_digits, *_RP)}, total_orders FROM monthly",
    )
Q["report_monthly_money"] = over(
    "monthly", f"SELECT {_TEXT_YEAR}, month, month_name, {_money(2, *_TRTP)} FROM monthly"
)
Q["report_monthly_ext"] = over("monthly", f"""
SELECT year, month, month_name, {_money(0, *_TRTP)}, total_orders, total_units_sold,
       {half_up('avg_profit_margin', 1)} AS avg_profit_margin, {half_up('avg_discount', 2)} AS avg_discount,
       {half_up('revenue_per_order', 0)} AS revenue_per_order
FROM monthly""")
Q["report_monthly_brief"] = over("monthly", f"""
SELECT year, month, month_name, {_money(0, *_TRTP)}, total_orders,
       {half_up('avg_profit_margin', 1)} AS avg_profit_margin, {half_up('avg_discount', 2)} AS avg_discount
FROM monthly""")
Q["report_monthly_plain"] = over("monthly", f"""
SELECT year, month, month_name, total_units_sold, avg_discount, revenue_per_order, {_M}
FROM monthly""")
Q["report_monthly_all"] = Q["monthly_sales"]
Q["widget_kpi_counters"] = Q["report_kpi_counters"]
Q["report_monthly_sql"] = Q["report_monthly_money"]
Q["report_monthly_orders"] = over(
    "monthly", f"SELECT {_TEXT_YEAR}, month, month_name, total_orders, total_units_sold FROM monthly"
)
Q["widget_monthly_orders"] = Q["report_monthly_orders"]
Q["report_discount_margin"] = over("monthly", f"""
SELECT {_TEXT_YEAR}, month, {pct('avg_discount')} AS avg_discount_pct,
       {pct('avg_profit_margin')} AS avg_margin_pct
FROM monthly""")
for _name, _digits, _m in (("report_yearly", 0, 1), ("report_yearly_cents", 2, 2)):
    Q[_name] = over("monthly", f"""
SELECT year, {half_up('sum(total_revenue)', _digits)} AS annual_revenue,
       {half_up('sum(total_profit)', _digits)} AS annual_profit,
       CAST(sum(total_orders) AS BIGINT) AS annual_orders,
       {half_up('avg(avg_profit_margin)', _m)} AS avg_margin
FROM monthly GROUP BY year""")
Q["report_monthly_by_year"] = over("monthly", "SELECT month, " + ", ".join(
    half_up(f"sum(CASE WHEN year = {y} THEN total_revenue END)", 2) + f' AS "{y}"'
    for y in range(1995, 2002)
) + " FROM monthly GROUP BY month")

# ---------------------------------------------------------------- reports on regions

Q["report_regional"] = over("regional", f"""
SELECT region, manager_name, {_money(0, *_RP)}, total_customers,
       {half_up('revenue_per_customer', 0)} AS rev_per_customer
FROM regional""")
Q["report_manager"] = over("regional", f"""
SELECT manager_name, region, {_money(0, *_RP)}, total_customers, total_orders,
       {pct('avg_profit_margin')} AS margin_pct
FROM regional""")
Q["report_regional_cents"] = over("regional", f"""
SELECT region, manager_name, {_money(2, *_TRTP)}, total_orders, total_customers,
       {pct('avg_profit_margin')} AS avg_profit_margin_pct,
       {half_up('revenue_per_customer', 2)} AS revenue_per_customer
FROM regional""")
Q["report_regional_whole"] = over("regional", f"""
SELECT region, manager_name, {_money(0, *_TRTP)}, total_orders, total_customers,
       {half_up('avg_profit_margin', 1)} AS avg_profit_margin,
       {half_up('revenue_per_customer', 0)} AS revenue_per_customer
FROM regional""")
Q["report_regional_plain"] = over("regional", f"""
SELECT region, manager_name, total_cost, total_customers, revenue_per_customer, {_M}
FROM regional""")
Q["report_region_labels"] = over("regional", f"""
SELECT region, manager_name,
       '$' || format('{{:,}}', CAST({half_up('total_revenue', 0)} AS BIGINT)) AS revenue_label
FROM regional""")

# ---------------------------------------------------------------- reports on customers

Q["report_segments"] = over(
    "ltv", "SELECT segment, count(*) AS customer_count FROM ltv GROUP BY segment"
)
for _name, _digits, _col, _more in (
    ("report_segments_revenue", 2, "segment_revenue", False),
    ("report_segments_whole", 0, "total_revenue", False),
    ("report_segments_ext", 0, "total_revenue", True),
    ("report_segments_ext_cents", 2, "total_revenue", True),
):
    _extra = (
        f""", {half_up('avg(lifetime_revenue)', _digits)} AS avg_revenue,
       {half_up('avg(total_orders)', 1)} AS avg_orders"""
        if _more
        else ""
    )
    Q[_name] = over("ltv", f"""
SELECT segment, count(*) AS customer_count,
       {half_up('sum(CAST(lifetime_revenue AS DECIMAL(28,4)))', _digits)} AS {_col}{_extra}
FROM ltv GROUP BY segment""")
Q["report_segment_share"] = over("ltv", f"""
SELECT segment, count(*) AS customer_count,
       {half_up('count(*) / CAST((SELECT count(*) FROM ltv) AS DOUBLE) * 100', 1)} AS share_pct
FROM ltv GROUP BY segment""")
for _name, _digits, _rev, _orders, _value in (
    ("report_ltv_tiers", 0, "avg_revenue", "avg_orders", False),
    ("report_ltv_tiers_ext", 0, "avg_revenue", "avg_orders", True),
    ("report_ltv_tiers_cents", 2, "avg_ltv", None, False),
    ("report_ltv_tiers_whole", 0, "avg_revenue", None, False),
    ("report_ltv_tiers_detail", 2, "avg_lifetime_revenue", "avg_total_orders", False),
):
    _extra = f", {half_up('avg(total_orders)', 1)} AS {_orders}" if _orders else ""
    _extra += f", {half_up('avg(avg_order_value)', _digits)} AS avg_order_value" if _value else ""
    Q[_name] = over("ltv", f"""
SELECT ltv_tier, count(*) AS customer_count,
       {half_up('avg(lifetime_revenue)', _digits)} AS {_rev}{_extra}
FROM ltv GROUP BY ltv_tier""")


def _top_customers(n: int, digits: int | None, revenue: str, value: str, more: str = "") -> str:
    order = "lifetime_revenue" if digits is None else half_up("lifetime_revenue", digits)
    return over("ltv", f"""
SELECT customer_name, segment, ltv_tier,
       {_money(digits, ('lifetime_revenue', revenue), ('avg_order_value', value))}, total_orders{more}
FROM ltv ORDER BY {order} DESC, customer_id LIMIT {n}""")


_RETURN_PCT = f", {pct('return_rate')} AS return_rate_pct"
Q["report_top_customers"] = _top_customers(15, 0, "lifetime_revenue", "avg_order")
Q["report_top_customers_short"] = _top_customers(15, 0, "lifetime_rev", "avg_order")
Q["report_top_customers_cents"] = _top_customers(
    15, 2, "lifetime_revenue", "avg_order_value",
    f", {half_up('lifetime_profit', 2)} AS lifetime_profit{_RETURN_PCT}")
Q["report_top_customers_30"] = _top_customers(
    30, 0, "lifetime_revenue", "avg_order_value",
    f", {half_up('lifetime_profit', 0)} AS lifetime_profit{_RETURN_PCT}")
Q["report_top_customers_20"] = _top_customers(20, 0, "lifetime_revenue", "avg_order_value")
Q["report_top_customers_50"] = _top_customers(
    50, None, "lifetime_revenue", "avg_order_value",
    ", lifetime_profit, return_rate, customer_tenure_days")

# ---------------------------------------------------------------- reports on products


def _products(n: int, columns: str, order: str) -> str:
    return over("product", f"SELECT {columns} FROM product ORDER BY {order}, product_id LIMIT {n}")


def _by_revenue(digits: int) -> str:
    return half_up("total_revenue", digits) + " DESC"


Q["report_top_products"] = _products(
    10, f"product_name, category, {_money(0, *_RP)}, total_units_sold{_RETURN_PCT}", _by_revenue(0))
Q["report_top_products_cents"] = _products(
    10, f"product_name, category, {_money(2, *_TRTP)}, total_units_sold, "
        f"{pct('avg_profit_margin')} AS margin_pct", _by_revenue(2))
Q["report_top_products_15"] = _products(
    15, f"product_name, category, {_money(0, *_RP)}, total_units_sold AS units, "
        f"{pct('return_rate')} AS return_pct", _by_revenue(0))
Q["report_top_products_20"] = _products(
    20, f"product_name, category, sub_category, {_money(0, *_TRTP)}, total_units_sold, "
        f"{half_up('avg_profit_margin', 1)} AS avg_profit_margin{_RETURN_PCT}", _by_revenue(0))
Q["report_product_ranked"] = _products(
    20, f"revenue_rank, product_name, category, sub_category, {_money(2, *_TRTP)}, total_units_sold, "
        f"{pct('avg_profit_margin')} AS margin_pct, total_returns{_RETURN_PCT}", "revenue_rank")
Q["report_product_ranked_whole"] = _products(
    20, f"product_name, category, sub_category, {_money(0, *_TRTP)}, total_units_sold, total_orders, "
        f"{half_up('avg_profit_margin', 1)} AS avg_profit_margin{_RETURN_PCT}, revenue_rank", "revenue_rank")
Q["report_product_ranked_plain"] = _products(
    20, f"product_name, category, sub_category, total_units_sold, return_rate, revenue_rank, {_M}",
    "revenue_rank")
Q["report_top_return_rate"] = over("product", f"""
SELECT product_name, {pct('return_rate')} AS return_rate_pct, total_returns
FROM product WHERE total_returns > 0 ORDER BY return_rate DESC, product_id LIMIT 10""")

# ---------------------------------------------------------------- reports on categories

Q["report_category_trend"] = over("category_trends", f"""
SELECT year || '-Q' || quarter AS period, category, {half_up('total_revenue', 0)} AS revenue
FROM category_trends""")
Q["report_category_quarter"] = over("category_trends", f"""
SELECT {_TEXT_YEAR}, 'Q' || quarter AS quarter_label, category,
       {half_up('total_revenue', 2)} AS total_revenue
FROM category_trends""")
Q["report_category_quarter_whole"] = over("category_trends", f"""
SELECT {_TEXT_YEAR}, 'Q' || quarter AS quarter_label, category, {_money(0, *_RP)}
FROM category_trends""")
Q["report_category_yoy"] = over("category_trends", f"""
SELECT year, quarter, category, sub_category, {_money(0, *_TRTP)}, total_units_sold,
       {half_up('avg_profit_margin', 1)} AS avg_profit_margin,
       {half_up('yoy_revenue_growth', 1)} AS yoy_growth_pct
FROM category_trends""")
Q["report_category_yoy_brief"] = over("category_trends", f"""
SELECT year, quarter, category, {_money(0, *_TRTP)},
       {half_up('avg_profit_margin', 1)} AS avg_profit_margin,
       {half_up('yoy_revenue_growth', 1)} AS yoy_growth_pct
FROM category_trends""")
Q["report_category_plain"] = over("category_trends", f"""
SELECT year, quarter, category, sub_category, total_revenue, total_profit, total_units_sold,
       {six('avg_profit_margin')} AS avg_profit_margin,
       {six('yoy_revenue_growth')} AS yoy_revenue_growth
FROM category_trends""")
for _name, _digits, _m in (("report_category_summary", 0, 1), ("report_category_summary_cents", 2, 2)):
    Q[_name] = over("category_trends", f"""
SELECT category, {half_up('sum(CAST(total_revenue AS DECIMAL(28,4)))', _digits)} AS total_revenue,
       {half_up('sum(CAST(total_profit AS DECIMAL(28,4)))', _digits)} AS total_profit,
       CAST(sum(total_orders) AS BIGINT) AS total_orders,
       {half_up('avg(avg_profit_margin)', _m)} AS avg_margin
FROM category_trends GROUP BY category""")
Q["report_subcategory_margin"] = over("category_trends", f"""
SELECT category, sub_category, {pct('avg(avg_profit_margin)')} AS avg_margin_pct
FROM category_trends GROUP BY category, sub_category""")

# ---------------------------------------------------------------- reports on shipping

_DAYS = half_up("avg_delivery_days", 1)
_REV_SHARE = half_up("revenue_share_pct", 1)
_ORDER_SHARE = half_up("order_share_pct", 1)
Q["report_shipping"] = over("shipping", f"""
SELECT ship_mode, {_money(0, ('total_revenue', 'revenue'))}, total_orders, {_DAYS} AS avg_days,
       {pct('avg_profit_margin')} AS margin_pct, {_REV_SHARE} AS rev_share
FROM shipping""")
Q["report_shipping_short"] = over("shipping", f"""
SELECT ship_mode, total_orders, {_money(0, ('total_revenue', 'revenue'))}, {_DAYS} AS avg_days,
       {pct('avg_profit_margin')} AS margin_pct, {_REV_SHARE} AS rev_share_pct
FROM shipping""")
Q["report_shipping_cents"] = over("shipping", f"""
SELECT ship_mode, ship_mode_description, {half_up('total_revenue', 2)} AS total_revenue,
       total_orders, {_DAYS} AS avg_delivery_days, {pct('avg_profit_margin')} AS margin_pct,
       {_REV_SHARE} AS revenue_share_pct, {_ORDER_SHARE} AS order_share_pct
FROM shipping""")
Q["report_shipping_whole"] = over("shipping", f"""
SELECT ship_mode, ship_mode_description, {_money(0, *_TRTP)}, total_orders,
       {_DAYS} AS avg_delivery_days, {half_up('avg_profit_margin', 1)} AS avg_profit_margin,
       {_REV_SHARE} AS revenue_share_pct, {_ORDER_SHARE} AS order_share_pct
FROM shipping""")
Q["report_shipping_brief"] = over("shipping", f"""
SELECT ship_mode, {half_up('total_revenue', 0)} AS total_revenue, total_orders,
       {_DAYS} AS avg_delivery_days, {half_up('avg_profit_margin', 1)} AS avg_profit_margin,
       {_REV_SHARE} AS revenue_share_pct
FROM shipping""")
Q["report_shipping_plain"] = over("shipping", f"""
SELECT ship_mode, ship_mode_description, total_units_shipped, avg_delivery_days,
       {six('revenue_share_pct')} AS revenue_share_pct, {six('order_share_pct')} AS order_share_pct,
       {_M}
FROM shipping""")
Q["report_shipping_labels"] = over("shipping", f"""
SELECT ship_mode, CAST(round(CAST({_DAYS} AS DECIMAL(18,1)), 1) AS VARCHAR) || 'd' AS days_label,
       CAST(CAST({pct('avg_profit_margin')} AS DECIMAL(18,1)) AS VARCHAR) || '%' AS margin_label
FROM shipping""")
