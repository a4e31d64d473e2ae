"""The SQL each registered query is checked against, in the analyses' plain relational form."""

from __future__ import annotations

from shiftlab_checks.duckdb_views import ZONE_1, ZONE_2, with_views
from shiftlab_checks.queries import FLAG_VARIANTS, HOLIDAY, MIN_IMPORT, MIN_WEEK, ORDER_STUDY, STUDY, UNITS

# Written out, so that a wrong letter in the library shows. Cohorts by days moved.
STATUS_COHORTS = """WHEN 0 THEN 'Cohort A (0)' WHEN -1 THEN 'Cohort B (-1)' WHEN 1 THEN 'Cohort C (+1)'
    WHEN -2 THEN 'Cohort D (-2)' WHEN 2 THEN 'Cohort E (+2)' WHEN -3 THEN 'Cohort F (-3)' WHEN 3 THEN 'Cohort G (+3)'"""
OPTION_COHORTS = STATUS_COHORTS + " WHEN -4 THEN 'Cohort H (-4)'"
ORDER_COHORTS = """WHEN 0 THEN 'Cohort A (0)' WHEN -1 THEN 'Cohort B (-1)' WHEN 1 THEN 'Cohort C (+1)'
    WHEN -2 THEN 'Cohort D (-2)' WHEN 2 THEN 'Cohort E (+2)' WHEN 3 THEN 'Cohort F (+3)' WHEN -3 THEN 'Cohort G (-3)'"""
COLUMN_COHORTS = {
    "A": "Cohort A (0)",
    "B": "Cohort B (-1)",
    "C": "Cohort C (+1)",
    "D": "Cohort D (-2)",
    "E": "Cohort E (+2)",
    "F": "Cohort F (-3)",
    "G": "Cohort G (+3)",
}

_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _between(column: str, bounds: tuple) -> str:
    low, high = (f"'{b}'" if isinstance(b, str) else b for b in bounds)
    return f"{column} BETWEEN {low} AND {high}"


def _label(days: str, cohorts: str) -> str:
    return f"CASE {days} {cohorts} END"


def _days(later: str, earlier: str) -> str:
    return f"CAST(date_diff('day', CAST({earlier} AS DATE), CAST({later} AS DATE)) AS INTEGER)"


def _cutoff(day: str, cutoff: str) -> str:
    return f"upper(strftime(CAST({day} AS DATE) - CAST({cutoff} AS INTEGER), '%a'))"


def _status(start: str) -> str:
    age = (
        "date_diff('day', DATE '" + start + "', "
        "CAST(strptime(CAST(s.fk_imported_at_date AS VARCHAR), '%Y%m%d') AS DATE))"
    )
    return (
        f"CASE WHEN {age} BETWEEN 0 AND 34 THEN "
        f"[s.status_wk_4, s.status_wk_3, s.status_wk_2, s.status_wk_1, s.status_wk_0][{age} // 7 + 1] "
        "ELSE 'Other' END"
    )


STEPS = {
    "s_active": f"""
    SELECT DISTINCT business_unit, origin_option_handle, target_option_handle, origin_date, target_date, postal_code,
           replace(left(published_time, 10), '-', '') AS published_date
    FROM v_shifts WHERE business_unit IN ({_UNITS}) AND origin_date = '{HOLIDAY}' AND operation <> 'd'""",
    "s_active_all": f"""
    SELECT DISTINCT business_unit, origin_option_handle, target_option_handle, origin_date, target_date, postal_code,
           replace(left(published_time, 10), '-', '') AS published_date
    FROM v_shifts WHERE business_unit IN ({_UNITS}) AND origin_date = '{HOLIDAY}'""",
    "s_latest": f"""
    SELECT DISTINCT business_unit, origin_option_handle, target_option_handle, origin_date, target_date, postal_code,
           replace(left(published_time, 10), '-', '') AS published_date
    FROM v_latest_shifts WHERE business_unit IN ({_UNITS}) AND origin_date = '{HOLIDAY}'""",
    "s_changes": f"""
    SELECT c.business_unit, c.fk_subscription, c.delivery_weekday AS changed_delivery_weekday, d.day_name,
           c.delivery_time AS changed_delivery_time, d.calendar_date AS changed_delivery_date,
           c.week_id AS delivery_week
    FROM v_changes c
    LEFT JOIN v_calendar d ON d.delivery_week = c.week_id AND d.day_of_week + 1 = c.delivery_weekday
    WHERE c.business_unit IN ({_UNITS}) AND c.week_id >= '{MIN_WEEK}' AND c.delivery_time IS NOT NULL""",
    "s_first": f"""
    SELECT country, fk_subscription, fk_imported_at_date, delivery_wk_4, delivery_time, zip
    FROM v_snapshots
    WHERE {_between('fk_imported_at_date', STUDY.import_range)} AND country IN ({_UNITS})
      AND {_between('delivery_wk_4', STUDY.delivery_range)}
    QUALIFY row_number() OVER (PARTITION BY country, fk_subscription
                               ORDER BY fk_imported_at_date, delivery_wk_4, delivery_time, zip) = 1""",
    "s_week": "SELECT f.*, d.delivery_week FROM s_first f LEFT JOIN v_calendar d ON d.calendar_date = f.delivery_wk_4",
    "s_moved": f"""
    SELECT DISTINCT f.*, {ZONE_1} AS zone, c.changed_delivery_time, c.changed_delivery_date,
           coalesce(c.changed_delivery_time, f.delivery_time) AS updated_delivery_time,
           coalesce(c.changed_delivery_date, f.delivery_wk_4) AS updated_delivery_date
    FROM s_week f
    LEFT JOIN s_changes c ON c.business_unit = f.country AND c.fk_subscription = f.fk_subscription
                         AND c.delivery_week = f.delivery_week""",
    "s_redated": """
    SELECT f.*, c.changed_delivery_date,
           coalesce(c.changed_delivery_date, f.delivery_wk_4) AS updated_delivery_date
    FROM s_week f
    LEFT JOIN (SELECT business_unit, fk_subscription, delivery_week, min(changed_delivery_date) AS changed_delivery_date
               FROM s_changes GROUP BY ALL) c
      ON c.business_unit = f.country AND c.fk_subscription = f.fk_subscription AND c.delivery_week = f.delivery_week""",
    "s_options": f"""
    SELECT e.country_group AS market, e.entity_code AS country, o.option_handle,
           left(o.start_time, 5) || '-' || left(o.end_time, 5) AS delivery_time,
           o.cutoff, o.surcharge_price, o.packing_day, o.delivery_day, o.production_capacity, o.fk_imported_at
    FROM v_options o
    LEFT JOIN (SELECT DISTINCT country_group, entity_code FROM v_entities) e ON e.entity_code = o.region_code
    WHERE o.fk_imported_at >= {MIN_IMPORT} AND o.region_code IN ({_UNITS})""",
    "s_matched": """
    SELECT m.country, m.fk_subscription, m.zone, m.updated_delivery_time, m.updated_delivery_date,
           a.target_option_handle, a.business_unit, a.origin_option_handle, a.origin_date,
           coalesce(a.target_date, m.updated_delivery_date) AS target_date
    FROM s_moved m
    LEFT JOIN s_active a ON a.business_unit = m.country AND a.postal_code = m.zone
                        AND a.origin_option_handle = m.updated_delivery_time
                        AND a.origin_date = m.updated_delivery_date""",
    "s_planned_match": f"""
    SELECT r.country, r.fk_subscription, r.zone, r.delivery_time, r.updated_delivery_date,
           coalesce(a.target_date, r.updated_delivery_date) AS target_date
    FROM (SELECT f.*, {ZONE_2.format(code="e.entity_code")} AS zone
          FROM (SELECT country, fk_subscription, delivery_time, zip, updated_delivery_date FROM s_redated) f
          LEFT JOIN (SELECT DISTINCT entity_code FROM v_entities) e ON e.entity_code = f.country) r
    LEFT JOIN (SELECT DISTINCT business_unit, postal_code, origin_option_handle, target_date FROM s_latest) a
      ON a.business_unit = r.country AND a.postal_code = r.zone AND a.origin_option_handle = r.delivery_time""",
    "s_flags": f"""
    SELECT m.*,
           left(o1.packing_day, 3) <> left(o2.packing_day, 3) AS packing_day_shifted,
           o1.surcharge_price <> o2.surcharge_price AS surcharge_shifted,
           o1.cutoff <> o2.cutoff AS cutoff_value_shifted,
           {_cutoff('m.updated_delivery_date', 'o1.cutoff')} <> {_cutoff('m.target_date', 'o2.cutoff')}
               AS cutoff_day_shifted,
           coalesce(o1.delivery_time, regexp_extract(m.updated_delivery_time, '(\\d{{4}}-\\d{{4}})', 1))
               <> coalesce(o2.delivery_time, regexp_extract(m.target_option_handle, '(\\d{{4}}-\\d{{4}})', 1))
               AS delivery_time_shift
    FROM s_matched m
    LEFT JOIN s_options o1 ON o1.country = m.business_unit AND o1.option_handle = m.origin_option_handle
    LEFT JOIN s_options o2 ON o2.country = m.business_unit AND o2.option_handle = m.target_option_handle""",
    "s_labelled": f"""
    SELECT *, {_days('target_date', 'updated_delivery_date')} AS day_shift,
           {_label(_days('target_date', 'updated_delivery_date'), STATUS_COHORTS)} AS cohort
    FROM s_matched WHERE updated_delivery_date = '{HOLIDAY}'""",
    "s_option_labelled": f"""
    SELECT *, {_label(_days('target_date', 'updated_delivery_date'), OPTION_COHORTS)} AS cohort
    FROM s_flags WHERE updated_delivery_date = '{HOLIDAY}'""",
    "s_order_labelled": f"""
    SELECT *, {_days('target_date', 'updated_delivery_date')} AS day_shift,
           {_label(_days('target_date', 'updated_delivery_date'), ORDER_COHORTS)} AS cohort
    FROM s_planned_match WHERE updated_delivery_date = '{HOLIDAY}'""",
    "s_dates": f"""
    SELECT DISTINCT fk_imported_at_date FROM v_snapshots
    WHERE country IN ({_UNITS}) AND {_between('fk_imported_at_date', STUDY.panel_range)}""",
    "s_panel": """
    SELECT DISTINCT country, fk_subscription, fk_imported_at_date FROM s_labelled, s_dates""",
    "s_statuses": f"""
    SELECT DISTINCT p.*, {_status(ORDER_STUDY.start)} AS status
    FROM s_panel p JOIN v_snapshots s USING (country, fk_subscription, fk_imported_at_date)""",
    "s_attached": """
    SELECT DISTINCT p.country, p.fk_subscription, p.fk_imported_at_date, p.status, l.cohort
    FROM s_statuses p LEFT JOIN s_labelled l USING (country, fk_subscription)""",
    "s_totals": """
    SELECT fk_imported_at_date, cohort, count(DISTINCT (country, fk_subscription)) AS total_subs
    FROM s_attached GROUP BY ALL""",
    "s_customers": f"""
    SELECT entity_code AS country, subscription_id AS fk_subscription, customer_uuid
    FROM v_order_lines
    WHERE entity_code IN ({_UNITS}) AND {_between('delivery_week', ORDER_STUDY.customer_weeks)}
    QUALIFY row_number() OVER (PARTITION BY entity_code, subscription_id
                               ORDER BY create_date DESC, customer_uuid) = 1""",
    "s_order_panel": f"""
    SELECT DISTINCT l.country, l.fk_subscription, s.fk_imported_at_date, {_status(ORDER_STUDY.start)} AS status, l.cohort
    FROM s_order_labelled l JOIN v_snapshots s USING (country, fk_subscription)
    WHERE {_between('s.fk_imported_at_date', ORDER_STUDY.panel_range)}""",
    "s_member_orders": f"""
    SELECT DISTINCT m.country, m.fk_subscription, c.customer_uuid, o.order_line_items_id, o.delivery_week
    FROM s_order_labelled m
    LEFT JOIN s_customers c USING (country, fk_subscription)
    JOIN v_order_lines o ON o.entity_code = m.country AND o.subscription_id = m.fk_subscription
    WHERE {_between('o.delivery_week', ORDER_STUDY.order_weeks)} AND o.order_item_type = 'Mealboxes'""",
}


def _rounded_ratio(above: str, below: str) -> str:
    """Exact half-up quotient of two counts to two decimals, NULL without a divisor."""
    return f"((200 * {above} + {below}) // nullif(2 * {below}, 0)) / 100"


def _order_rates(by: str, per_customer: bool = False) -> str:
    counts, ratios = [], []
    for name, weeks in ORDER_STUDY.ranges.items():
        inside = _between("o.delivery_week", weeks)
        counts.append(f"count(DISTINCT CASE WHEN {inside} THEN o.order_line_items_id END) AS lines_{name}")
        counts.append(f"count(DISTINCT CASE WHEN {inside} THEN o.customer_uuid END) AS people_{name}")
        below = "people" if per_customer else f"people_{name}"
        ratios.append(f"{_rounded_ratio(f'lines_{name}', below)} AS {name}")
        if per_customer:
            ratios.append(f'lines_{name} AS "{name}_BoxCount"')
    key = f"{by} cohort, status"
    return f"""
    SELECT {key}, people AS "Total_Customers", {', '.join(ratios)}
    FROM (SELECT {key}, count(DISTINCT o.customer_uuid) AS people, {', '.join(counts)}
          FROM s_order_panel p LEFT JOIN s_member_orders o USING (country, fk_subscription)
          GROUP BY {key})"""


STEPS["s_order_rates"] = _order_rates("")
STEPS["s_rates_per_customer"] = _order_rates("", per_customer=True)
STEPS["s_country_rates"] = _order_rates("country,")
STEPS["s_deltas"] = """
    SELECT country AS "Country", 'Test Monday' AS "Holiday", cohort, status,
           Pre_10W_AOR AS "Pre_10W", Pre_5W_AOR AS "Pre_5W", Post_5W_AOR AS "Post_5W", Post_10W_AOR AS "Post_10W",
           round(Pre_5W_AOR - Post_5W_AOR, 2) AS "Delta_5W", round(Pre_10W_AOR - Post_10W_AOR, 2) AS "Delta_10W"
    FROM s_country_rates WHERE status = 'running'"""


def _wide_rates(columns: dict[str, str], source: str, totals: str, where: str = "") -> str:
    """Shares of the cohort total per (day, status, cohort), widened by the largest value."""
    inner = ", ".join(
        f"count(DISTINCT CASE WHEN {test} THEN (a.country, a.fk_subscription) END) / t.total_subs AS {name}"
        for name, test in columns.items()
    )
    outer = ", ".join(f'max({name}) AS "{name}"' for name in columns)
    return f"""
    SELECT day AS "Date", status AS "Status", {outer},
           (SELECT min(published_date) FROM s_active) AS publication_date
    FROM (SELECT a.fk_imported_at_date AS day, a.status, a.cohort, {inner}
          FROM {source} a
          LEFT JOIN {totals} t ON t.fk_imported_at_date = a.fk_imported_at_date AND t.cohort = a.cohort
          GROUP BY a.fk_imported_at_date, a.status, a.cohort, t.total_subs)
    {where}
    GROUP BY day, status"""


def _status_rates(letters: str, zone_filter: str) -> str:
    steps = {
        "r_members": f"SELECT DISTINCT country, fk_subscription, cohort FROM s_labelled {zone_filter}",
        "r_attached": f"""
    SELECT m.*, s.fk_imported_at_date, {_status(STUDY.start)} AS status
    FROM r_members m JOIN v_snapshots s USING (country, fk_subscription)
    WHERE {_between('s.fk_imported_at_date', STUDY.panel_range)}""",
        "r_totals": """
    SELECT fk_imported_at_date, cohort, count(DISTINCT (country, fk_subscription)) AS total_subs FROM r_attached GROUP BY ALL""",
    }
    columns = {
        f"Cohort_{letter}": f"a.cohort = '{cohort}'"
        for letter, cohort in COLUMN_COHORTS.items()
        if letter in letters
    }
    return with_views({**STEPS, **steps}, _wide_rates(columns, "r_attached", "r_totals"), None)


def _flag_rates(flag: str, null_is_true: str, statuses: tuple[str, ...]) -> str:
    steps = {
        "r_members": f"SELECT DISTINCT country, fk_subscription, cohort, {flag} AS flag FROM s_option_labelled",
        "r_attached": f"""
    SELECT m.*, s.fk_imported_at_date, {_status(STUDY.start)} AS status
    FROM r_members m JOIN v_snapshots s USING (country, fk_subscription)
    WHERE {_between('s.fk_imported_at_date', STUDY.panel_range)}""",
        "r_totals": """
    SELECT fk_imported_at_date, cohort, count(DISTINCT (country, fk_subscription)) AS total_subs FROM r_attached GROUP BY ALL""",
    }
    wanted = ", ".join(f"'{s}'" for s in statuses)
    columns = {}
    for letter, cohort in COLUMN_COHORTS.items():
        own = f"a.cohort = '{cohort}'"
        changed = "a.flag IS NULL" if letter in null_is_true else "a.flag"
        columns[f"Cohort_{letter}_TRUE"] = f"{own} AND {changed}"
        columns[f"Cohort_{letter}_FALSE"] = f"{own} AND NOT a.flag"
    return with_views(
        {**STEPS, **steps},
        _wide_rates(columns, "r_attached", "r_totals", f"WHERE status IN ({wanted})"),
        None,
    )


def _report(source: str, country: str, holiday: str, letter: str, order: str) -> str:
    """Share of comparisons the first control row of each group does not lose."""
    parts = []
    for metric in ("Delta_5W", "Delta_10W"):
        parts.append(f"""
    SELECT '{metric}' AS metric,
           coalesce(count(*) FILTER (WHERE c.control <= r.{metric}), 0) AS better_or_equal,
           count(*) AS comparisons,
           CASE WHEN count(*) > 0
                THEN CAST(format('{{:.1f}}', count(*) FILTER (WHERE c.control <= r.{metric}) / count(*) * 100) AS DOUBLE)
                ELSE 0.0 END AS percentage
    FROM {source} r
    JOIN (SELECT {country} AS c_country, {holiday} AS c_holiday, {metric} AS control FROM {source}
          WHERE {letter} = 'A'
          QUALIFY row_number() OVER (PARTITION BY {country}, {holiday} ORDER BY {order}) = 1) c
      ON c.c_country = r.{country} AND c.c_holiday = r.{holiday}
    WHERE {letter.replace('cohort', 'r.cohort')} IS DISTINCT FROM 'A'""")
    return "\n    UNION ALL".join(parts)


_LETTER = "nullif(regexp_extract(cohort, 'Cohort (\\w)', 1), '')"
_SHIFT_KEY = """business_unit, shift_id, postal_code, origin_option_handle, target_option_handle, origin_date,
           target_date, visible_to_customer, left(fk_imported_at, 8)"""

STEPS["s_registry"] = f"""
    SELECT e.country_group AS market, e.entity_code AS country, s.business_unit, s.shift_id, s.postal_code,
           s.origin_option_handle, s.target_option_handle, s.origin_date, s.target_date, s.visible_to_customer,
           left(s.fk_imported_at, 8) AS imported_on, d.delivery_week,
           min(replace(left(s.published_time, 10), '-', '')) AS published_date
    FROM v_shifts s
    LEFT JOIN (SELECT DISTINCT country_group, entity_code FROM v_entities) e ON e.entity_code = s.business_unit
    LEFT JOIN v_calendar d ON d.calendar_date = s.origin_date
    WHERE s.operation <> 'd' AND left(s.origin_date, 4) >= '2024' AND s.business_unit IN ({_UNITS})
    GROUP BY ALL"""
STEPS["s_outcomes"] = f"""
    SELECT DISTINCT region_code AS country, subscription_nk AS fk_subscription, postal_code AS zip,
           delivery_option_handle AS updated_delivery_time, delivery_week, is_delivered
    FROM v_order_items
    WHERE region_code NOT IN ('CA', 'US') AND operation <> 'd' AND is_mealbox AND delivery_week >= '{MIN_WEEK}'"""
STEPS["s_deliveries"] = f"""
    SELECT DISTINCT p.country, p.fk_subscription, p.zone, p.updated_delivery_time, p.updated_delivery_date, o.is_delivered
    FROM (SELECT f.country, f.fk_subscription, f.zip, d.delivery_week,
                 {ZONE_2.format(code="f.country").replace('(zip)', '(f.zip)').replace('(zip,', '(f.zip,')} AS zone,
                 coalesce(c.changed_delivery_time, f.delivery_time) AS updated_delivery_time,
                 coalesce(c.changed_delivery_date, f.delivery_wk_4) AS updated_delivery_date
          FROM v_snapshots f
          LEFT JOIN v_calendar d ON d.calendar_date = f.delivery_wk_4
          LEFT JOIN s_changes c ON c.business_unit = f.country AND c.fk_subscription = f.fk_subscription
                               AND c.delivery_week = d.delivery_week
          WHERE f.delivery_wk_4 >= '2024-01-01' AND f.country IN ({_UNITS})) p
    LEFT JOIN s_outcomes o ON o.country = p.country AND o.zip = p.zip AND o.fk_subscription = p.fk_subscription
                          AND o.updated_delivery_time = p.updated_delivery_time AND o.delivery_week = p.delivery_week"""

STEPS["s_history"] = f"""
    SELECT o.region_code AS country, o.option_handle, o.cutoff, o.surcharge_price, o.packing_day
    FROM v_option_history o WHERE o.fk_imported_at >= {MIN_IMPORT} AND o.region_code IN ({_UNITS})"""

_IMPACT = f"""
    SELECT h.market, h.country, h.shift_id, h.postal_code, h.visible_to_customer, h.published_date,
           left(o1.packing_day, 3) AS origin_packing_day, o1.cutoff AS origin_cutoff_value,
           {_cutoff('h.origin_date', 'o1.cutoff')} AS origin_cutoff_name,
           o1.surcharge_price AS origin_surcharge_price,
           left(o2.packing_day, 3) AS target_packing_day, o2.cutoff AS target_cutoff_value,
           {_cutoff('h.origin_date', 'o2.cutoff')} AS target_cutoff_name,
           o2.surcharge_price AS target_surcharge_price,
           h.origin_option_handle AS updated_origin_time_handle, h.target_option_handle,
           h.origin_date AS updated_origin_date,
           coalesce(h.target_date, h.origin_date) AS updated_target_date, d.delivery_week,
           {_days('coalesce(h.target_date, h.origin_date)', 'h.origin_date')} AS day_difference,
           b.is_delivered, count(DISTINCT b.fk_subscription) AS subscription_count
    FROM s_registry h
    LEFT JOIN s_history o1 ON o1.country = h.country AND o1.option_handle = h.origin_option_handle
    LEFT JOIN s_history o2 ON o2.country = h.country AND o2.option_handle = h.target_option_handle
    LEFT JOIN s_deliveries b ON b.country = h.country AND b.zone = h.postal_code
                            AND b.updated_delivery_time = h.origin_option_handle
                            AND b.updated_delivery_date = h.origin_date
    JOIN v_calendar d ON d.calendar_date = h.origin_date
    WHERE d.delivery_week >= '{MIN_WEEK}'
    GROUP BY ALL"""

_FIXED_NL = ZONE_1.replace(
    "WHEN country = 'NL' AND",
    "WHEN country = 'NL' AND length(replace(zip, ' ', '')) = 6 THEN left(zip, length(zip) - 2)\n"
    "            WHEN country = 'NL' AND",
)

_SELECTS = {
    "active_shifts": "SELECT * FROM s_active",
    "active_shifts_with_deleted": "SELECT * FROM s_active_all",
    "shift_registry": "SELECT * FROM s_registry",
    "publication_start": "SELECT min(published_date) AS publication_date FROM s_active",
    "one_off_changes": "SELECT DISTINCT * FROM s_changes",
    "one_off_changes_with_repeats": "SELECT * FROM s_changes",
    "first_snapshot": "SELECT * FROM s_first",
    "simple_zones": f"SELECT DISTINCT country, zip, {ZONE_1} AS zone FROM v_snapshots",
    "simple_zones_fixed_nl": f"SELECT DISTINCT country, zip, {_FIXED_NL} AS zone FROM v_snapshots",
    "extended_zones": f"SELECT DISTINCT country, zip, {ZONE_2.format(code='country')} AS zone FROM v_snapshots",
    "applied_overrides": "SELECT * FROM s_moved",
    "overridden_dates": "SELECT * FROM s_redated",
    "delivery_options_by_region": "SELECT * EXCLUDE (delivery_time) FROM s_options",
    "delivery_options_with_slot": "SELECT * FROM s_options",
    "delivery_outcomes": "SELECT * FROM s_outcomes",
    "matched_shifts": """
    SELECT DISTINCT country, fk_subscription, zone, updated_delivery_time, updated_delivery_date,
           target_option_handle, target_date FROM s_matched""",
    "matched_shifts_by_planned_time": "SELECT * FROM s_planned_match",
    "affected_subscriptions": """
    SELECT b.country, b.zone AS postal_code, b.updated_delivery_time AS origin_option_handle,
           b.updated_delivery_date AS origin_date, b.is_delivered,
           count(DISTINCT b.fk_subscription) AS subscription_count
    FROM s_deliveries b
    WHERE EXISTS (SELECT 1 FROM s_registry h
                  WHERE h.country = b.country AND h.postal_code = b.zone
                    AND h.origin_option_handle = b.updated_delivery_time
                    AND h.origin_date = b.updated_delivery_date)
    GROUP BY ALL""",
    "option_change_flags": f"""
    SELECT DISTINCT a.business_unit, a.origin_option_handle, a.target_option_handle, a.origin_date, a.target_date,
           a.postal_code,
           left(o1.packing_day, 3) <> left(o2.packing_day, 3) AS packing_day_shifted,
           o1.surcharge_price <> o2.surcharge_price AS surcharge_shifted,
           o1.cutoff <> o2.cutoff AS cutoff_value_shifted,
           {_cutoff('a.origin_date', 'o1.cutoff')} <> {_cutoff('coalesce(a.target_date, a.origin_date)', 'o2.cutoff')}
               AS cutoff_day_shifted,
           coalesce(o1.delivery_time, regexp_extract(a.origin_option_handle, '(\\d{{4}}-\\d{{4}})', 1))
               <> coalesce(o2.delivery_time, regexp_extract(a.target_option_handle, '(\\d{{4}}-\\d{{4}})', 1))
               AS delivery_time_shift
    FROM s_active a
    LEFT JOIN s_options o1 ON o1.country = a.business_unit AND o1.option_handle = a.origin_option_handle
    LEFT JOIN s_options o2 ON o2.country = a.business_unit AND o2.option_handle = a.target_option_handle""",
    "cutoff_days": f"""
    SELECT DISTINCT a.business_unit, a.origin_option_handle, a.origin_date,
           {_cutoff('a.origin_date', 'o.cutoff')} AS closes
    FROM s_active a
    LEFT JOIN s_options o ON o.country = a.business_unit AND o.option_handle = a.origin_option_handle""",
    "status_cohorts": "SELECT DISTINCT country, fk_subscription, zone, day_shift, cohort FROM s_labelled",
    "order_cohorts": "SELECT DISTINCT country, fk_subscription, zone, day_shift, cohort FROM s_order_labelled",
    "daily_panel": "SELECT * FROM s_panel",
    "statuses_as_of": "SELECT * FROM s_statuses",
    "attached_cohorts": "SELECT * FROM s_attached",
    "cohort_totals": "SELECT * FROM s_totals",
    "daily_cohort_counts": """
    SELECT a.fk_imported_at_date, a.cohort, a.status, count(DISTINCT (a.country, a.fk_subscription)) AS members,
           any_value(t.total_subs) AS total_subs
    FROM s_attached a JOIN s_totals t
      ON t.fk_imported_at_date = a.fk_imported_at_date AND t.cohort IS NOT DISTINCT FROM a.cohort
    GROUP BY a.fk_imported_at_date, a.cohort, a.status""",
    "snapshot_dates": f"""
    SELECT DISTINCT fk_imported_at_date FROM v_snapshots
    WHERE country IN ({_UNITS}) AND delivery_wk_4 = '{HOLIDAY}'""",
    "delivery_dates": f"""
    SELECT DISTINCT delivery_wk_4 FROM v_snapshots
    WHERE country IN ({_UNITS}) AND {_between('fk_imported_at_date', STUDY.import_range)}""",
    "shift_coverage": """
    SELECT origin_date, count(DISTINCT postal_code) AS postal_codes
    FROM v_shifts WHERE operation <> 'd' GROUP BY origin_date""",
    "published_dates": "SELECT DISTINCT published_date FROM s_active",
    "cohort_sizes": "SELECT cohort, count(DISTINCT (country, fk_subscription)) AS subscriptions FROM s_labelled GROUP BY cohort",
    "cohort_sizes_by_delivery_time": """
    SELECT cohort, delivery_time_shift, count(DISTINCT (country, fk_subscription)) AS subscriptions
    FROM s_option_labelled GROUP BY cohort, delivery_time_shift""",
    "latest_customers": "SELECT * FROM s_customers",
    "cohort_orders": f"""
    SELECT DISTINCT m.country, m.fk_subscription, c.customer_uuid, o.order_line_items_id, o.delivery_week
    FROM s_labelled m
    LEFT JOIN s_customers c USING (country, fk_subscription)
    JOIN v_order_lines o ON o.entity_code = m.country AND o.subscription_id = m.fk_subscription
    WHERE {_between('o.delivery_week', ORDER_STUDY.order_weeks)} AND o.order_item_type = 'Mealboxes'""",
    "shift_impact_table": _IMPACT,
    "order_rates": 'SELECT * RENAME (cohort AS "Cohort", status AS "Status") FROM s_order_rates',
    "order_rates_per_customer": 'SELECT * RENAME (cohort AS "Cohort", status AS "Status") FROM s_rates_per_customer',
    "order_rate_deltas": "SELECT * FROM s_deltas",
    "control_report_of_order_rates": _report("s_deltas", "Country", "Holiday", _LETTER, "cohort"),
    "control_report": _report("v_comparison", "country", "holiday", _LETTER, "ordinal"),
}

_SELECTS["option_change_flags_with_normalised_slots"] = (
    _SELECTS["option_change_flags"]
    .replace("coalesce(o1.delivery_time,", "coalesce(replace(o1.delivery_time, ':', ''),")
    .replace("coalesce(o2.delivery_time,", "coalesce(replace(o2.delivery_time, ':', ''),")
)

ORACLES: dict[str, str] = {name: with_views(STEPS, sql) for name, sql in _SELECTS.items()}
ORACLES["status_rates"] = _status_rates("ABCDE", "WHERE length(zone) > 2")
ORACLES["status_rates_all_cohorts"] = _status_rates("ABCDEFG", "")
for _name, _variant in FLAG_VARIANTS.items():
    ORACLES[f"status_rates_by_{_name}"] = _flag_rates(*_variant)
