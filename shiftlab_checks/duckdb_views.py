"""The derived source tables as DuckDB SQL, written as common table expressions.

``VIEWS`` is in dependency order; ``with_views`` puts those a query names, and what they need, in
front of it.
"""

from __future__ import annotations

import re

_ZIP = """
        CASE {unit}
            WHEN 'GB' THEN 'M' || (CASE WHEN {sub} % 10 >= 5 THEN '1' ELSE '' END) || ({sub} % 10) || ' 1AA'
            WHEN 'IE' THEN 'D0' || ({sub} % 10) || 'X285'
            WHEN 'NL' THEN '100' || ({sub} % 10) || ' ab'
            ELSE '7500' || ({sub} % 10)
        END"""

ZONE_1 = """
        CASE
            WHEN country = 'GB' THEN left(zip, greatest(length(replace(zip, ' ', '')) - 3, 0))
            WHEN country = 'IE' THEN left(zip, greatest(length(zip) - 4, 0))
            WHEN country = 'NL' AND zip = 'NL5042ZK' THEN '5042'
            ELSE zip
        END"""

ZONE_2 = """
        CASE
            WHEN {code} IN ('GB', 'GN') THEN
                left(upper(zip), CASE WHEN length(zip) > 5 THEN 4 ELSE greatest(length(zip) - 3, 0) END)
            WHEN {code} = 'IE' THEN left(zip, greatest(length(zip) - 4, 0))
            WHEN {code} IN ('NL', 'TT', 'GQ') THEN
                left(replace(upper(zip), ' ', ''), greatest(length(replace(zip, ' ', '')) - 2, 0))
            ELSE upper(zip)
        END"""

VIEWS = {
    "v_calendar": """
    SELECT strftime(day, '%Y-%m-%d') AS calendar_date,
           strftime(day, '%G-W%V') AS delivery_week,
           CAST(isodow(day) - 1 AS INTEGER) AS day_of_week,
           strftime(day, '%A') AS day_name
    FROM (SELECT CAST(unnest(generate_series(DATE '2023-10-01', DATE '2024-06-30', INTERVAL 1 DAY)) AS DATE) AS day)""",
    "v_nation": """
    SELECT n_nationkey, n_name, r_name,
           CASE r_name WHEN 'AFRICA' THEN 'GB' WHEN 'AMERICA' THEN 'IE' WHEN 'ASIA' THEN 'NL'
                       WHEN 'EUROPE' THEN 'FR' ELSE 'BE' END AS unit
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_entities": """
    SELECT r_name AS country_group, n_name AS country, unit AS entity_code FROM v_nation""",
    "v_units": """
    SELECT c_custkey AS fk_subscription,
           unnest(CASE WHEN c_custkey % 4 = 1 THEN [unit, CASE unit WHEN 'BE' THEN 'FR' ELSE 'BE' END]
                       ELSE [unit] END) AS country
    FROM customer JOIN v_nation ON c_nationkey = n_nationkey""",
    "v_events": """
    SELECT user_id AS sub, country AS unit, event_type, value,
           CASE WHEN user_id % 7 = 5 THEN greatest(CAST(ts AS DATE), DATE '2024-01-03') ELSE CAST(ts AS DATE) END AS day,
           CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'cancelled'
                WHEN event_type = 'click' AND user_id % 7 < 3 OR user_id % 7 = 6 THEN 'paused' ELSE 'running' END AS status
    FROM events JOIN v_units ON user_id = fk_subscription""",
    "v_snapshots": f"""
    SELECT unit AS country,
           sub AS fk_subscription,
           CAST(strftime(day, '%Y%m%d') AS INTEGER) AS fk_imported_at_date,
           strftime(day - CAST(isodow(day) - 1 AS INTEGER) + CAST(28 + sub % 3 AS INTEGER), '%Y-%m-%d') AS delivery_wk_4,
           'D-' || (sub % 2) || '-0800-1200' AS delivery_time,
           {_ZIP.format(unit="unit", sub="sub")} AS zip,
           CASE WHEN value <= 110 THEN status END AS status_wk_0,
           status AS status_wk_1,
           CASE WHEN value > 50 AND sub % 7 < 3 THEN 'paused' ELSE status END AS status_wk_2,
           CASE WHEN event_type = 'view' AND value > 100 AND sub % 7 < 3 THEN 'paused' ELSE status END AS status_wk_3,
           status AS status_wk_4
    FROM v_events""",
    "v_plans": f"""
    SELECT DISTINCT country, fk_subscription % 10 AS digit, delivery_wk_4 AS origin_date,
           unnest(list_distinct([{ZONE_1}, {ZONE_2.format(code="country")}])) AS postal_code
    FROM v_snapshots""",
    "v_shifts": """
    SELECT country AS business_unit,
           country || '/' || postal_code || '/' || origin_date || '/' || handle AS shift_id,
           postal_code,
           handle AS origin_option_handle,
           CASE WHEN digit % 3 = 0 OR country IN ('FR', 'IE') THEN handle ELSE replace(handle, '0800-1200', '1200-1800') END AS target_option_handle,
           origin_date,
           strftime(CAST(origin_date AS DATE)
               + CAST(CASE digit WHEN 0 THEN -2 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3
                                 WHEN 5 THEN -3 WHEN 6 THEN -4 WHEN 7 THEN 1 WHEN 9 THEN -5 END AS INTEGER),
               '%Y-%m-%d') AS target_date,
           digit % 2 = 0 AS visible_to_customer,
           '2024010' || (1 + digit % 3) || 'T0600' AS fk_imported_at,
           '2024-01-0' || published || 'T08:00:00' AS published_time,
           CASE WHEN digit = 7 THEN 'd' WHEN digit = 5 AND handle LIKE 'D-0%' THEN NULL WHEN digit % 2 = 0 THEN 'c' ELSE 'u' END AS operation
    FROM v_plans,
         (VALUES ('D-0-0800-1200'), ('D-1-0800-1200')) AS handles(handle),
         unnest([1 + digit % 7, 9]) AS publications(published)""",
    "v_latest_shifts": """
    SELECT business_unit, origin_option_handle, target_option_handle, origin_date,
           CASE date_diff('day', CAST(origin_date AS DATE), CAST(target_date AS DATE))
               WHEN -4 THEN strftime(CAST(origin_date AS DATE) + 3, '%Y-%m-%d') ELSE target_date END AS target_date,
           postal_code, published_time
    FROM v_shifts WHERE published_time LIKE '2024-01-09%'""",
    "v_changes": """
    SELECT unit AS business_unit,
           sub AS fk_subscription,
           CAST(CASE WHEN event_type = 'click' THEN 1 + sub % 5 ELSE 1 END AS INTEGER) AS delivery_weekday,
           CASE WHEN extract(day FROM day) % 7 <> sub % 7 THEN NULL
                WHEN event_type = 'click' THEN 'D-' || ((sub + 1) % 2) || '-0800-1200'
                WHEN event_type = 'purchase' THEN 'D-' || (sub % 2) || '-0800-1200' END AS delivery_time,
           strftime(day + 28, '%G-W%V') AS week_id
    FROM v_events""",
    "v_options": """
    SELECT CASE WHEN region_code = 'NL' AND slot = 1 THEN 'XX' ELSE region_code END AS region_code,
           'D-' || day || (CASE slot WHEN 0 THEN '-0800-1200' ELSE '-1200-1800' END) AS option_handle,
           CAST(3 + count(*) % 3 AS INTEGER) AS cutoff,
           CAST((count(*) % 2) * 1.5 AS DECIMAL(10, 2)) AS surcharge_price,
           ['MONDAY', 'TUESDAY', 'WEDNESDAY', 'THURSDAY', 'FRIDAY', 'SATURDAY', 'SUNDAY'][CAST(1 + sum(p_size) % 7 AS BIGINT)] AS packing_day,
           ['MONDAY', 'TUESDAY', 'WEDNESDAY', 'THURSDAY', 'FRIDAY', 'SATURDAY', 'SUNDAY'][1 + min(p_size) % 7] AS delivery_day,
           CAST(count(*) AS INTEGER) AS production_capacity,
           fk_imported_at,
           CASE slot WHEN 0 THEN '08:00:00' ELSE '12:00:00' END AS start_time,
           CASE slot WHEN 0 THEN '12:00:00' ELSE '18:00:00' END AS end_time
    FROM (SELECT ['GB', 'IE', 'NL', 'FR', 'BE'][1 + p_partkey % 5] AS region_code,
                 p_size % 2 AS day,
                 (p_partkey // 5) % 2 AS slot,
                 [$imports][1 + (p_partkey // 10) % len([$imports])] AS fk_imported_at,
                 p_size
          FROM part)
    GROUP BY region_code, day, slot, fk_imported_at""",
    "v_order_lines": """
    SELECT o_custkey AS subscription_id,
           'C' || (CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey - o_custkey % 2 END) AS customer_uuid,
           strftime(o_orderdate, '%Y-%m-%d') AS create_date,
           o_orderkey * 10 + l_linenumber AS order_line_items_id,
           country AS entity_code,
           strftime(DATE '2023-10-30' + CAST(o_orderkey % 160 AS INTEGER), '%G-W%V') AS delivery_week,
           CASE l_returnflag WHEN 'R' THEN 'Addons' ELSE 'Mealboxes' END AS order_item_type
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN v_units ON o_custkey = fk_subscription""",
    "v_order_items": f"""
    SELECT country AS region_code,
           {_ZIP.format(unit="country", sub="o_custkey")} AS postal_code,
           o_custkey AS subscription_nk,
           'D-' || (o_custkey % 2) || '-0800-1200' AS delivery_option_handle,
           strftime(DATE '2024-01-29' + CAST(o_orderkey % 28 AS INTEGER), '%G-W%V') AS delivery_week,
           CASE WHEN l_quantity <= 45 THEN l_linestatus = 'F' END AS is_delivered,
           l_returnflag <> 'R' AS is_mealbox,
           CASE WHEN l_tax >= 0.07 THEN 'd' WHEN l_discount >= 0.09 THEN NULL ELSE 'u' END AS operation
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN v_units ON o_custkey = fk_subscription""",
    "v_comparison": """
    SELECT o_orderkey AS ordinal,
           n_name AS country,
           CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS holiday,
           ['Cohort A (0)', 'Cohort B (-1)', 'Cohort C (+1)', 'no cohort', 'Cohort E (+2)', 'Cohort A (0)',
            'Cohort D (-2)'][1 + o_orderkey % 7] AS cohort,
           o_totalprice % 100 - 50 AS delta_5w,
           CASE WHEN o_custkey % 11 <> 0 THEN 50 - o_totalprice % 100 END AS delta_10w
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
}

VIEWS["v_option_history"] = VIEWS["v_options"].replace("$imports", "20231215, 20240102, 20240105, 20240110, 20240120")
VIEWS["v_options"] = VIEWS["v_options"].replace("$imports", "20231215, 20240105, 20240120")


def with_views(steps: dict[str, str], query: str, views: dict[str, str] | None = None) -> str:
    """``query`` preceded by the views and named steps it uses, directly or through others."""
    known = {**(views or VIEWS), **steps}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(known[name])

    visit(query)
    parts = [f"{name} AS ({sql}\n)" for name, sql in known.items() if name in needed]
    return f"WITH {', '.join(parts)}\n{query.strip()}" if parts else query.strip()
