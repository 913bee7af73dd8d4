"""DuckDB SQL for every registered query, used to check results.

Each statement derives the raw tables from the provided ones (FIXTURES.md section 2) and
states the result plainly, without the Spark-side plan shapes: windows over whole
customers, left joins filtered on NULL, distinct counts.

Money is added up in whole millionths, and ties are broken as in the operators, so results
are comparable to the last bit.
"""

from __future__ import annotations

import re

from martwright.operators.clean import PRODUCT_COLUMNS
from martwright.sources.tables import CUSTOMERS, EVENTS, PRODUCTS

RAW = """
WITH customers_raw AS (
  SELECT c_custkey AS customer_id,
         DATE '2019-01-01' + CAST((c_custkey * 37) % 2000 AS INTEGER) AS signup_date,
         CASE WHEN n_nationkey IN (0,1) AND c_custkey % 2 = 0 THEN ''
              WHEN n_nationkey IN (0,1) THEN NULL ELSE r_name END AS region_customers,
         CASE n_nationkey WHEN 0 THEN 'United States' WHEN 1 THEN 'Canada' WHEN 2 THEN 'United Kingdom'
              WHEN 3 THEN 'Germany' WHEN 4 THEN 'Australia' ELSE n_name END AS country_customers,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Consumer' WHEN 'FURNITURE' THEN 'SOHO'
              WHEN 'MACHINERY' THEN 'Enterprise' ELSE 'SMB' END AS segment,
         CASE c_custkey % 6 WHEN 0 THEN 'Organic' WHEN 1 THEN 'Paid Search' WHEN 2 THEN 'Social'
              WHEN 3 THEN 'Email' WHEN 4 THEN 'Affiliate' ELSE 'Retail Media' END AS acquisition_channel,
         CASE n_nationkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency_preference,
         CASE c_custkey % 3 WHEN 0 THEN '18-34' WHEN 1 THEN '35-54' ELSE '55+' END AS age_band,
         CAST(n_nationkey * 3 - 30 AS DOUBLE) AS country_latitude_customers,
         CAST(n_nationkey * 7 - 80 AS DOUBLE) AS country_longitude_customers
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), products_raw AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 50 = 0 THEN 'Azure AI Studio Annual Standard'
              WHEN p_partkey % 50 = 1 THEN 'Notion AI Annual'
              WHEN p_partkey % 50 = 2 THEN 'Figma Professional Monthly'
              WHEN p_partkey % 7 = 3 THEN concat(p_name, ' Add?on')
              WHEN p_partkey % 11 = 4 THEN concat(p_name, ' Add–on')
              ELSE p_name END AS product_name,
         p_type AS category,
         CASE p_size % 3 WHEN 0 THEN 'Annual' WHEN 1 THEN 'Monthly' ELSE 'One-time' END AS billing_cycle,
         p_size % 3 <> 2 AS is_subscription,
         p_retailprice AS base_price_usd, p_brand AS vendor,
         DATE '2015-01-01' + p_size * 30 AS first_release_date,
         CASE p_partkey % 2 WHEN 0 THEN 'Direct' ELSE 'Resale' END AS resale_model,
         concat(p_brand, ' ', p_type) AS brand_safe_name, p_name AS product_name_orig,
         p_retailprice AS base_price_usd_orig, concat('K-', p_brand) AS base_key,
         concat('v', CAST(p_size % 5 AS VARCHAR(9))) AS product_version
  FROM part
), base AS (
  SELECT CASE WHEN l_orderkey % 50 = 7 AND l_linenumber <= 2 THEN concat(CAST(l_orderkey AS VARCHAR(20)), '-0')
              ELSE concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)),
                             CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20))) END AS event_id,
         CASE WHEN l_orderkey % 97 = 5 THEN o_custkey + 1000000000 ELSE o_custkey END AS customer_id,
         CASE WHEN l_orderkey % 89 = 3 THEN l_partkey + 1000000000 ELSE l_partkey END AS product_id,
         CAST(o_orderdate AS DATE) + 8766 AS event_date,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'invoice' ELSE 'order' END AS event_type,
         CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS unit_price_local,
         CAST(floor(l_extendedprice * (1 - l_discount) * 100) AS DOUBLE) / 100
           + CASE WHEN l_linenumber % 3 = 0 THEN CAST(0.0037 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS net_revenue_usd,
         l_returnflag = 'R' AS is_refunded,
         CASE WHEN l_discount < 0.03 THEN 'N/A' WHEN l_discount < 0.06 THEN 'WELCOME10'
              WHEN l_discount < 0.09 THEN 'SAVE5' ELSE 'LOYALTY15' END AS discount_code,
         CASE l_suppkey % 5 WHEN 0 THEN 'Website' WHEN 1 THEN 'Direct Sales' WHEN 2 THEN 'Reseller'
              WHEN 3 THEN 'Partner' ELSE 'Marketplace' END AS channel,
         l_linenumber AS n, l_orderkey AS order_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), events0 AS (
  SELECT * FROM base
  UNION ALL
  SELECT concat(event_id, '-inv'), customer_id, product_id, event_date + (n * 5 - 10), 'invoice',
         quantity, unit_price_local, net_revenue_usd, is_refunded, discount_code, channel, n, order_key
  FROM base WHERE event_type = 'order' AND product_id % 200 = 7
  UNION ALL
  SELECT concat(event_id, '-first'), customer_id, product_id, event_date - 2600, 'invoice',
         quantity, unit_price_local, net_revenue_usd, FALSE, discount_code, channel, n, order_key
  FROM base WHERE n = 1 AND order_key % 60 = 11
  UNION ALL
  SELECT concat(event_id, '-second'), customer_id, product_id, event_date - 2600 + CAST(customer_id % 4 + 1 AS INTEGER), 'invoice',
         quantity, unit_price_local, net_revenue_usd, TRUE, discount_code, channel, n, order_key
  FROM base WHERE n = 1 AND order_key % 60 = 11
), events_raw AS (
  SELECT e.event_id, e.customer_id, e.product_id, e.event_date, e.event_type, e.quantity, e.unit_price_local,
         e.net_revenue_usd, e.is_refunded, e.discount_code, e.channel, c.region_customers AS region, c.country_customers AS country
  FROM events0 e LEFT JOIN customers_raw c ON e.customer_id = c.customer_id
)
"""

CLEAN = """
, events AS (
  SELECT * REPLACE (CASE WHEN coalesce(region, '') = '' AND country IN ('United States', 'Canada')
                         THEN 'NAm' ELSE region END AS region),
         CASE discount_code WHEN 'N/A' THEN 'Full Price' ELSE discount_code END AS discount_group,
         CAST(date_trunc('month', event_date) AS DATE) AS year_month,
         CASE WHEN event_type = 'invoice' AND NOT is_refunded THEN net_revenue_usd ELSE 0 END AS final_net_revenue_usd
  FROM events_raw
), invoices AS (
  SELECT * FROM events WHERE event_type = 'invoice'
), customers AS (
  SELECT * REPLACE (CASE WHEN coalesce(region_customers, '') = '' AND country_customers IN ('United States', 'Canada')
                         THEN 'NAm' ELSE region_customers END AS region_customers),
         CAST(date_trunc('month', signup_date) AS DATE) AS signup_year_month
  FROM customers_raw
), products AS (
  SELECT * REPLACE (regexp_replace(product_name, 'Add.?on', 'Add-on') AS product_name) FROM products_raw
), timing AS (
  SELECT *, max(event_date) FILTER (event_type = 'invoice' AND NOT is_refunded) OVER up_to AS last_invoice_date,
         min(event_date) FILTER (event_type = 'invoice' AND NOT is_refunded) OVER from_here AS next_invoice_date
  FROM events
  WINDOW up_to AS (PARTITION BY customer_id ORDER BY event_date, event_id, unit_price_local
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         from_here AS (PARTITION BY customer_id ORDER BY event_date, event_id, unit_price_local
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), events_timed AS (
  SELECT *, CAST(event_date - last_invoice_date AS INTEGER) AS days_since_last_invoice,
         CAST(next_invoice_date - event_date AS INTEGER) AS days_to_next_invoice
  FROM timing
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY event_date, event_id, unit_price_local) AS nth
  FROM events_timed WHERE event_type = 'invoice'
), customers_timed AS (
  SELECT c.*, r.event_date AS second_purchase_date, r.days_since_last_invoice AS wait_days,
         r.nth IS NOT NULL AS is_repeater
  FROM customers c LEFT JOIN ranked r ON r.customer_id = c.customer_id AND r.nth = 2
), mart AS (
  SELECT e.*, c.customer_id AS customer_id_c, c.* EXCLUDE (customer_id),
         p.product_id AS product_id_p, p.* EXCLUDE (product_id)
  FROM events_timed e
  LEFT JOIN customers_timed c ON e.customer_id = c.customer_id
  LEFT JOIN products p ON e.product_id = p.product_id
), baskets AS (
  SELECT concat(customer_id, '_', event_date) AS basket_id, customer_id, event_date, product_id, product_name
  FROM mart WHERE event_type = 'invoice'
), multi_baskets AS (
  SELECT * FROM baskets
  WHERE basket_id IN (SELECT basket_id FROM baskets GROUP BY ALL HAVING count(DISTINCT product_id) > 1)
)
"""

#: Read several times by one statement: computed once, whatever the version's optimizer does.
SHARED = ("base", "events", "events_timed")

SAME_DEAL = " AND ".join(
    f"o.{k} = i.{k}"
    for k in ("customer_id", "product_id", "quantity", "unit_price_local", "net_revenue_usd", "is_refunded")
)
ORDERS = "(SELECT * FROM events WHERE event_type = 'order')"
PROCEED = f"{ORDERS} o JOIN invoices i ON {SAME_DEAL}"
NOT_PROCEED = f"{ORDERS} o LEFT JOIN invoices i ON {SAME_DEAL} WHERE i.event_date IS NULL"
NOT_ORDERED = f"invoices i LEFT JOIN {ORDERS} o ON {SAME_DEAL} WHERE o.event_date IS NULL"


def _parts(column: str, where: str = "TRUE") -> str:
    return f"CAST(coalesce(sum(CAST(round({column} * 1000000) AS BIGINT)) FILTER ({where}), 0) AS BIGINT)"


def _usd(column: str, where: str = "TRUE") -> str:
    return f"CAST({_parts(column, where)} AS DOUBLE) / 1000000"


def _rounded(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38, 10)), {digits}) AS DOUBLE)"


def _stats(column: str, table: str) -> str:
    return "SELECT " + ", ".join(
        f"{_rounded(f'{f}({column})', 2)} AS {f}_{column}" for f in ("avg", "min", "max")
    ) + f" FROM {table}"


def _blanks(table: str, schema) -> str:
    parts = []
    for field in schema.fields:
        text = field.dataType.typeName() == "string" and field.name not in ("customer_id", "product_id")
        blank = f"{field.name} IS NULL" + (f" OR {field.name} = ''" if text else "")
        parts.append(
            f"SELECT '{table}' AS table_name, '{field.name}' AS column_name, count(*) AS total_rows, "
            f"count(*) FILTER ({blank}) AS blank_rows FROM {table}"
        )
    return " UNION ALL ".join(parts)


def _orphans(table: str, key: str) -> str:
    return (
        f"SELECT '{table}' AS dependency_table, '{key}' AS key_column, count(DISTINCT {key}) AS orphan_keys, "
        f"count(*) AS orphan_events FROM events_raw "
        f"WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM {table})"
    )


def _key_counts(table: str, key: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{key}' AS key_column, count(*) AS total_rows, "
        f"count(DISTINCT {key}) AS distinct_keys, (SELECT count(*) FROM "
        f"(SELECT {key} FROM {table} GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM {table}"
    )


def _repeaters_by(key: str, name: str = "repeaters") -> str:
    return f"SELECT {key}, count(DISTINCT customer_id) FILTER (is_repeater) AS {name} FROM mart GROUP BY {key}"


SPENT = f"""(SELECT customer_id, {_parts('final_net_revenue_usd')} AS spent FROM mart
             WHERE event_type = 'invoice' GROUP BY customer_id)"""
REPEATER_SPENDING = f"customers_timed JOIN {SPENT} s USING (customer_id) WHERE is_repeater"
AVERAGE_SPENT = "CAST(sum(spent) AS DOUBLE) / count(*) / 1000000"
MONTHS = "CAST(date_diff('month', signup_year_month, event_date) AS INTEGER)"
BASKET_COLUMNS = "basket_id, customer_id, event_date, product_id, product_name"

_STATEMENTS = {
    "mart_export_chunks": """SELECT CAST(year(event_date) AS INTEGER) AS chunk_year, count(*) AS row_count
        FROM mart GROUP BY 1""",
    "duplicate_event_ids": "SELECT event_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1",
    "event_id_summary": """SELECT count(*) AS event_rows, count(DISTINCT event_id) AS distinct_ids,
        (SELECT count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids
        FROM events""",
    "refund_audit": """SELECT net_revenue_usd, is_refunded, event_type, final_net_revenue_usd FROM events
        WHERE is_refunded ORDER BY event_id, unit_price_local LIMIT 50""",
    "refund_violations": """SELECT event_type, count(*) FILTER (is_refunded) AS refunded_rows,
        count(*) FILTER ((is_refunded OR event_type = 'order') AND final_net_revenue_usd <> 0) AS violations
        FROM events GROUP BY 1""",
    "orphan_keys": _orphans("customers_raw", "customer_id") + " UNION ALL " + _orphans("products_raw", "product_id"),
    "dimension_keys": _key_counts("customers_raw", "customer_id") + " UNION ALL " + _key_counts("products_raw", "product_id"),
    "blank_profile": " UNION ALL ".join(
        _blanks(t, s) for t, s in (("events_raw", EVENTS), ("customers_raw", CUSTOMERS), ("products_raw", PRODUCTS))
    ),
    "foreign_font_values": """SELECT * FROM (
        SELECT product_id, product_name, length(product_name) <> strlen(product_name) AS non_ascii,
               regexp_extract(product_name, 'Add.?on') NOT IN ('', 'Add-on') AS addon_variant
        FROM products_raw) WHERE non_ascii OR addon_variant""",
    "invoices_before_signup": """SELECT signup_year_month, count(*) AS invoices,
        count(DISTINCT customer_id) AS customers
        FROM mart WHERE event_type = 'invoice' AND event_date < signup_date GROUP BY 1""",
    "events_clean": "SELECT * FROM events",
    "customers_clean": "SELECT * FROM customers",
    "products_final": f"SELECT {', '.join(PRODUCT_COLUMNS)} FROM products",
    "events_final": "SELECT * FROM events_timed",
    "customers_final": "SELECT * FROM customers_timed",
    "combined": "SELECT * FROM mart",
    "orders_proceed": f"""SELECT o.customer_id, o.product_id, o.event_date AS order_date, i.event_date AS invoice_date,
        o.quantity, o.unit_price_local, o.net_revenue_usd, o.is_refunded,
        CAST(i.event_date - o.event_date AS INTEGER) AS invoice_lag_days FROM {PROCEED}""",
    "orders_not_proceed": f"""SELECT o.customer_id, o.product_id, o.event_date AS order_date, o.quantity,
        o.unit_price_local, o.net_revenue_usd, o.is_refunded FROM {NOT_PROCEED}""",
    "invoices_not_orders": f"""SELECT i.customer_id, i.product_id, i.event_date AS invoice_date, i.quantity,
        i.unit_price_local, i.net_revenue_usd, i.is_refunded FROM {NOT_ORDERED}""",
    "order_invoice_counts": f"""SELECT 'orders_not_proceed' AS category, count(*) AS cnt FROM {NOT_PROCEED}
        UNION ALL SELECT 'invoices_not_orders', count(*) FROM {NOT_ORDERED}
        UNION ALL SELECT 'orders_proceed', count(*) FROM {PROCEED}""",
    "refund_counts_monthly": """SELECT year_month, is_refunded, count(event_id) AS count_refunds FROM events
        WHERE is_refunded GROUP BY ALL""",
    "revenue_monthly": f"SELECT year_month, {_usd('final_net_revenue_usd')} AS revenues_monthly FROM events GROUP BY 1",
    "revenue_vs_year_ago": f""", monthly AS (
          SELECT CAST(year(event_date) AS INTEGER) AS year, month(event_date) AS month,
                 {_parts('final_net_revenue_usd')} AS amount FROM events GROUP BY 1, 2
        ), yearly AS (
          SELECT year, CAST(sum(amount) AS DOUBLE) AS amount FROM monthly GROUP BY 1
        ), matched AS (
          SELECT a.year, CAST(sum(a.amount) AS DOUBLE) AS amount, CAST(sum(b.amount) AS DOUBLE) AS ago
          FROM monthly a JOIN monthly b ON a.month = b.month AND a.year = b.year + 1 GROUP BY 1
        ) SELECT a.year, a.amount / 1000000 AS revenue, b.amount / 1000000 AS revenue_year_ago,
                 a.amount / nullif(b.amount, 0) - 1 AS growth, m.amount / 1000000 AS matched_revenue,
                 m.ago / 1000000 AS matched_revenue_year_ago, m.amount / nullif(m.ago, 0) - 1 AS matched_growth
          FROM yearly a LEFT JOIN yearly b ON a.year = b.year + 1 LEFT JOIN matched m ON m.year = a.year""",
    "revenue_by_country": f""", yearly AS (
          SELECT country, CAST(year(event_date) AS INTEGER) AS year,
                 CAST({_parts('final_net_revenue_usd')} AS DOUBLE) AS amount FROM events GROUP BY 1, 2
        ) SELECT a.country, a.year, a.amount / 1000000 AS revenue, b.amount / 1000000 AS revenue_year_ago,
                 a.amount / nullif(b.amount, 0) - 1 AS growth
          FROM yearly a LEFT JOIN yearly b
            ON a.country IS NOT DISTINCT FROM b.country AND a.year = b.year + 1""",
    "revenue_per_customer_by_billing": f"""SELECT billing_cycle, {_usd('final_net_revenue_usd')} AS revenue,
        count(DISTINCT customer_id) AS count_customers,
        {_usd('final_net_revenue_usd')} / count(DISTINCT customer_id) AS revenue_per_customer
        FROM mart WHERE event_date > DATE '2024-12-31' GROUP BY 1""",
    "price_by_product_country": f"""SELECT product_name, country,
        CAST({_parts('base_price_usd')} AS DOUBLE) / count(*) / 1000000 AS average_price
        FROM mart WHERE country IN ('United States', 'United Kingdom', 'Canada') AND product_name IN
        ('Azure AI Studio Annual Standard', 'Notion AI Annual', 'Figma Professional Monthly')
        GROUP BY 1, 2 ORDER BY product_name, average_price DESC, country LIMIT 10""",
    "refund_loss_by_category": f"""SELECT category, CAST(year(event_date) AS INTEGER) AS year,
        count(*) AS refunded_invoices, {_usd('net_revenue_usd')} AS refund_loss_usd
        FROM mart WHERE event_type = 'invoice' AND is_refunded GROUP BY 1, 2""",
    "invoice_counts_repeat": """SELECT customer_id, count(*) AS invoice_count FROM invoices
        GROUP BY 1 HAVING count(*) > 1""",
    "repeaters_by_month": _repeaters_by("year_month", "repeater"),
    "repeaters_by_acquisition_channel": _repeaters_by("acquisition_channel"),
    "repeaters_by_sales_channel": _repeaters_by("channel"),
    "repeater_revenue_share": f"""SELECT year_month, {_usd('final_net_revenue_usd')} AS total_revenue,
        {_usd('final_net_revenue_usd', 'is_repeater')} AS revenue_repeater,
        {_rounded(
            f"{_parts('final_net_revenue_usd', 'is_repeater')} * CAST(100 AS DOUBLE)"
            f" / nullif({_parts('final_net_revenue_usd')}, 0)", 2)} AS pct_revenue_repeater
        FROM mart GROUP BY 1""",
    "repeater_products_by_segment": "SELECT product_id, "
    + ", ".join(
        f"count(product_id) FILTER (segment = '{s}') AS products_{s.lower()}_repeater"
        for s in ("Consumer", "SOHO", "SMB", "Enterprise")
    )
    + " FROM mart WHERE is_repeater GROUP BY 1",
    "repeater_discount_usage": """SELECT discount_group, count(customer_id) AS repeaters_count
        FROM mart WHERE is_repeater GROUP BY 1""",
    "second_purchase_gap": """SELECT customer_id, min(event_date) AS first_purchase_date,
        max(event_date) AS second_purchase_date,
        CAST(max(event_date) - min(event_date) AS INTEGER) AS gap_days
        FROM ranked WHERE nth <= 2 GROUP BY 1 HAVING count(*) = 2""",
    "second_purchase_stats": _stats("wait_days", "customers_timed"),
    "purchase_cycle_stats": _stats("days_since_last_invoice", "events_timed"),
    "revenue_by_cycle_group": f"""SELECT CASE WHEN wait_days BETWEEN 1 AND 4 THEN wait_days || '-day cycle'
        ELSE 'Other' END AS cycle_group, {AVERAGE_SPENT} AS avg_revenue FROM {REPEATER_SPENDING} GROUP BY 1""",
    "wait_days_distribution": f"""SELECT wait_days, count(*) AS customer_count, {AVERAGE_SPENT} AS avg_revenue
        FROM {REPEATER_SPENDING} GROUP BY 1""",
    "events_baskets": f"SELECT {BASKET_COLUMNS} FROM baskets",
    "events_baskets_preview": f"SELECT {BASKET_COLUMNS} FROM baskets ORDER BY basket_id, product_id LIMIT 5",
    "events_baskets_min2": f"SELECT {BASKET_COLUMNS} FROM multi_baskets",
    "events_baskets_min2_preview": f"""SELECT {BASKET_COLUMNS} FROM multi_baskets
        ORDER BY basket_id, product_id LIMIT 5""",
    "product_pairs": """SELECT a.product_id AS product_a_id, a.product_name AS product_a_name,
        b.product_id AS product_b_id, b.product_name AS product_b_name, count(DISTINCT basket_id) AS pair_count
        FROM multi_baskets a JOIN multi_baskets b USING (basket_id) WHERE a.product_id < b.product_id GROUP BY ALL""",
    "attachment_rate": """SELECT year_month,
        count(DISTINCT customer_id) FILTER (contains(product_name, 'Add-on')) AS addon_customers,
        count(DISTINCT customer_id) FILTER (NOT contains(product_name, 'Add-on')) AS plan_customers,
        addon_customers / nullif(plan_customers, 0) AS attachment_rate
        FROM mart WHERE event_type = 'invoice' GROUP BY 1""",
    "retention_from_signup": f""", activity AS (
          SELECT signup_year_month, {MONTHS} AS months_since_signup, count(DISTINCT customer_id) AS active
          FROM mart WHERE event_type = 'invoice' AND event_date >= signup_year_month GROUP BY 1, 2
        ) SELECT a.signup_year_month, a.months_since_signup,
                 {_rounded('CAST(100 AS DOUBLE) * a.active / s.active', 1)} AS retention_rate_pct
          FROM activity a JOIN activity s
            ON a.signup_year_month = s.signup_year_month AND s.months_since_signup = 0""",
    "retention_calendar": f""", activity AS (
          SELECT signup_year_month, {MONTHS} AS months_since_signup, count(DISTINCT customer_id) AS active
          FROM mart WHERE event_type = 'invoice' GROUP BY 1, 2
        ), size AS (
          SELECT signup_year_month, count(DISTINCT customer_id) AS everyone
          FROM mart WHERE event_type = 'invoice' GROUP BY 1
        ) SELECT signup_year_month, months_since_signup,
                 active * CAST(100 AS DOUBLE) / everyone AS retention_rate_pct
          FROM activity JOIN size USING (signup_year_month)""",
}


def _tables() -> dict[str, str]:
    """The bodies of RAW and CLEAN by name; later ones read earlier ones only."""
    _, *found = re.split(r"(?:WITH |\)\s*, )(\w+) AS \(\n", (RAW + CLEAN).rstrip().removesuffix(")"))
    return dict(zip(found[::2], found[1::2], strict=True))


def _complete(statement: str, tables: dict[str, str]) -> str:
    """`statement` behind the tables it needs, and no others."""
    needed, text = [], statement
    for name, body in reversed(tables.items()):
        if re.search(rf"\b{name}\b", text):
            kept = " MATERIALIZED" if name in SHARED else ""
            needed.insert(0, f"{name} AS{kept} (\n{body})")
            text += body
    return f"WITH {', '.join(needed)}\n{statement}"


def oracle_sql() -> dict[str, str]:
    tables = _tables()
    return {name: _complete(statement, tables) for name, statement in _STATEMENTS.items()}
