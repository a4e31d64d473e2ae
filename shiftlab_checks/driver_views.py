"""The analyses' source tables, derived from the driver's tables.

Events act as subscription snapshots (a user is a subscription), parts as delivery options, orders
and line items as order lines. Every table follows ``sources.SCHEMAS``; ``duckdb_views`` derives the
same rows for the SQL side. What the last digit of a subscription decides (zone, target date,
deleted or not) is there to reach every rule of the analyses; a quarter of the subscriptions exist in
two units, some never pause, run or cancel, and some are not seen in the panel's first days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.functions import zone_extended, zone_simple

RAW_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "part": "p_partkey BIGINT, p_size INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING",
    "events": "ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}

_WEEK = "concat(extract(YEAROFWEEK FROM {day}), '-W', lpad(string(weekofyear({day})), 2, '0'))"
_ZIP = """CASE {unit}
    WHEN 'GB' THEN concat('M', if({sub} % 10 >= 5, '1', ''), {sub} % 10, ' 1AA')
    WHEN 'IE' THEN concat('D0', {sub} % 10, 'X285')
    WHEN 'NL' THEN concat('100', {sub} % 10, ' ab')
    ELSE concat('7500', {sub} % 10) END"""

CALENDAR = f"""
SELECT string(day) AS calendar_date, {_WEEK.format(day="day")} AS delivery_week,
       weekday(day) AS day_of_week, date_format(day, 'EEEE') AS day_name
FROM (SELECT explode(sequence(DATE'2023-10-01', DATE'2024-06-30')) AS day)"""

NATIONS = """
SELECT n_nationkey, n_name, r_name,
       decode(r_name, 'AFRICA', 'GB', 'AMERICA', 'IE', 'ASIA', 'NL', 'EUROPE', 'FR', 'BE') AS unit
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""

UNITS = """
SELECT c_custkey AS fk_subscription,
       explode(if(c_custkey % 4 = 1, array(unit, if(unit = 'BE', 'FR', 'BE')), array(unit))) AS country
FROM {customer} JOIN {nations} ON c_nationkey = n_nationkey"""

EVENTS = """
SELECT user_id AS sub, country AS unit, event_type, value,
       if(user_id % 7 = 5, greatest(to_date(ts), DATE'2024-01-03'), to_date(ts)) AS day,
       CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'cancelled'
            WHEN event_type = 'click' AND user_id % 7 < 3 OR user_id % 7 = 6 THEN 'paused' ELSE 'running' END AS status
FROM {events} JOIN {units} ON user_id = fk_subscription"""

SNAPSHOTS = f"""
SELECT unit AS country, sub AS fk_subscription,
       year(day) * 10000 + month(day) * 100 + dayofmonth(day) AS fk_imported_at_date,
       string(date_add(date_sub(day, weekday(day)), int(28 + sub % 3))) AS delivery_wk_4,
       concat('D-', sub % 2, '-0800-1200') AS delivery_time,
       {_ZIP.format(unit="unit", sub="sub")} AS zip,
       CASE WHEN value <= 110 THEN status END AS status_wk_0,
       status AS status_wk_1,
       if(value > 50 AND sub % 7 < 3, 'paused', status) AS status_wk_2,
       if(event_type = 'view' AND value > 100 AND sub % 7 < 3, 'paused', status) AS status_wk_3,
       status AS status_wk_4
FROM {{user_events}}"""

PLANS = """
SELECT DISTINCT country, zip, fk_subscription % 10 AS digit, delivery_wk_4 AS origin_date FROM {snapshots}"""

SHIFTS = """
SELECT country AS business_unit,
       concat_ws('/', country, postal_code, origin_date, handle) AS shift_id,
       postal_code,
       handle AS origin_option_handle,
       if(digit % 3 = 0 OR country IN ('FR', 'IE'), handle, replace(handle, '0800-1200', '1200-1800'))
           AS target_option_handle,
       origin_date,
       string(date_add(origin_date, CASE digit WHEN 0 THEN -2 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN 2
           WHEN 4 THEN 3 WHEN 5 THEN -3 WHEN 6 THEN -4 WHEN 7 THEN 1 WHEN 9 THEN -5 END)) AS target_date,
       digit % 2 = 0 AS visible_to_customer,
       concat('2024010', 1 + digit % 3, 'T0600') AS fk_imported_at,
       concat('2024-01-0', published, 'T08:00:00') AS published_time,
       struct(CASE WHEN digit = 7 THEN 'd' WHEN digit = 5 AND handle LIKE 'D-0%' THEN NULL WHEN digit % 2 = 0 THEN 'c' ELSE 'u' END
           AS operation) AS meta
FROM (SELECT *, explode(array(1 + digit % 7, 9)) AS published
      FROM (SELECT *, explode(array('D-0-0800-1200', 'D-1-0800-1200')) AS handle FROM {zones}))"""

# The latest state of the shifts: the last publication only, no marks, and one target date corrected.
LATEST_SHIFTS = """
SELECT business_unit, origin_option_handle, target_option_handle, origin_date,
       if(target_date = string(date_add(origin_date, -4)), string(date_add(origin_date, 3)), target_date) AS target_date,
       postal_code, published_time
FROM {shifts} WHERE published_time LIKE '2024-01-09%'"""

CHANGES = f"""
SELECT unit AS business_unit, sub AS fk_subscription,
       int(if(event_type = 'click', 1 + sub % 5, 1)) AS delivery_weekday,
       CASE WHEN dayofmonth(day) % 7 <> sub % 7 THEN NULL
            WHEN event_type = 'click' THEN concat('D-', (sub + 1) % 2, '-0800-1200')
            WHEN event_type = 'purchase' THEN concat('D-', sub % 2, '-0800-1200') END AS delivery_time,
       {_WEEK.format(day="date_add(day, 28)")} AS week_id
FROM {{user_events}}"""

_OPTIONS = """
SELECT if(region_code = 'NL' AND slot = 1, 'XX', region_code) AS region_code,
       concat('D-', day, if(slot = 0, '-0800-1200', '-1200-1800')) AS option_handle,
       int(3 + count(*) % 3) AS cutoff,
       CAST((count(*) % 2) * 1.5 AS DECIMAL(10, 2)) AS surcharge_price,
       element_at(array('MONDAY', 'TUESDAY', 'WEDNESDAY', 'THURSDAY', 'FRIDAY', 'SATURDAY', 'SUNDAY'),
                  int(1 + sum(p_size) % 7)) AS packing_day,
       element_at(array('MONDAY', 'TUESDAY', 'WEDNESDAY', 'THURSDAY', 'FRIDAY', 'SATURDAY', 'SUNDAY'),
                  int(1 + min(p_size) % 7)) AS delivery_day,
       int(count(*)) AS production_capacity,
       fk_imported_at,
       if(slot = 0, '08:00:00', '12:00:00') AS start_time,
       if(slot = 0, '12:00:00', '18:00:00') AS end_time
FROM (SELECT element_at(array('GB', 'IE', 'NL', 'FR', 'BE'), int(1 + p_partkey % 5)) AS region_code,
             p_size % 2 AS day,
             (p_partkey DIV 5) % 2 AS slot,
             element_at(array($imports), int(1 + (p_partkey DIV 10) % size(array($imports)))) AS fk_imported_at,
             p_size
      FROM {part})
GROUP BY region_code, day, slot, fk_imported_at"""
OPTIONS = _OPTIONS.replace("$imports", "20231215, 20240105, 20240120")
OPTION_HISTORY = _OPTIONS.replace("$imports", "20231215, 20240102, 20240105, 20240110, 20240120")

ORDER_LINES = f"""
SELECT subscription_id, customer_uuid, create_date, o_orderkey * 10 + l_linenumber AS order_line_items_id,
       entity_code, delivery_week, if(l_returnflag = 'R', 'Addons', 'Mealboxes') AS order_item_type
FROM (SELECT o_orderkey, o_custkey AS subscription_id, country AS entity_code,
             concat('C', if(o_orderkey % 3 = 0, o_custkey, o_custkey - o_custkey % 2)) AS customer_uuid,
             string(to_date(o_orderdate)) AS create_date,
             {_WEEK.format(day="date_add(DATE'2023-10-30', int(o_orderkey % 160))")} AS delivery_week
      FROM {{orders}} JOIN {{units}} ON o_custkey = fk_subscription)
JOIN {{lineitem}} ON o_orderkey = l_orderkey"""

ORDER_ITEMS = f"""
SELECT region_code, postal_code, subscription_nk, delivery_option_handle, delivery_week,
       CASE WHEN l_quantity <= 45 THEN l_linestatus = 'F' END AS is_delivered,
       l_returnflag <> 'R' AS is_mealbox,
       struct(CASE WHEN l_tax >= 0.07D THEN 'd' WHEN l_discount >= 0.09D THEN NULL ELSE 'u' END AS operation) AS meta
FROM (SELECT o_orderkey, o_custkey AS subscription_nk, country AS region_code,
             {_ZIP.format(unit="country", sub="o_custkey")} AS postal_code,
             concat('D-', o_custkey % 2, '-0800-1200') AS delivery_option_handle,
             {_WEEK.format(day="date_add(DATE'2024-01-29', int(o_orderkey % 28))")} AS delivery_week
      FROM {{orders}} JOIN {{units}} ON o_custkey = fk_subscription)
JOIN {{lineitem}} ON o_orderkey = l_orderkey"""

COMPARISON = """
SELECT o_orderkey AS ordinal, n_name AS Country,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS Holiday,
       element_at(array('Cohort A (0)', 'Cohort B (-1)', 'Cohort C (+1)', 'no cohort', 'Cohort E (+2)',
                        'Cohort A (0)', 'Cohort D (-2)'), int(1 + o_orderkey % 7)) AS cohort,
       o_totalprice % 100 - 50 AS Delta_5W,
       CASE WHEN o_custkey % 11 <> 0 THEN 50 - o_totalprice % 100 END AS Delta_10W
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""


class DriverViews(Mapping):
    """Tables of one scale-factor folder by the names the plans use, derived when asked for."""

    names = (
        "shifts",
        "latest_shifts",
        "changes",
        "calendar",
        "entities",
        "snapshots",
        "status_snapshots",
        "options",
        "option_history",
        "order_items",
        "order_lines",
    )

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        source = "snapshots" if name == "status_snapshots" else name
        return self._once(source, getattr(self, source))

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._known:
            self._known[name] = build()
        return self._known[name]

    def _sql(self, query: str, *raw: str, **frames: DataFrame) -> DataFrame:
        for name in raw:
            frames[name] = self._once(f"raw {name}", lambda name=name: self._read(name))
        return self.spark.sql(query, **frames)

    def _read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(path)

    def _nations(self) -> DataFrame:
        return self._once("nations", lambda: self._sql(NATIONS, "nation", "region"))

    def _units(self) -> DataFrame:
        return self._once(
            "units", lambda: self._sql(UNITS, "customer", nations=self._nations())
        )

    def _user_events(self) -> DataFrame:
        return self._once("user events", lambda: self._sql(EVENTS, "events", units=self._units()))

    def calendar(self) -> DataFrame:
        return self.spark.sql(CALENDAR)

    def entities(self) -> DataFrame:
        return self._nations().selectExpr(
            "r_name AS country_group", "n_name AS country", "unit AS entity_code"
        )

    def snapshots(self) -> DataFrame:
        return self._sql(SNAPSHOTS, user_events=self._user_events())

    def shifts(self) -> DataFrame:
        """Shifts for every planned date, in the zones of both rule sets, each published twice."""
        country, postcode = F.col("country"), F.col("zip")
        both = F.array(zone_simple(country, postcode), zone_extended(country, postcode))
        plans = self._sql(PLANS, snapshots=self["snapshots"])
        zones = plans.select(
            "country", "digit", "origin_date", F.explode(F.array_distinct(both)).alias("postal_code")
        )
        return self._sql(SHIFTS, zones=zones)

    def latest_shifts(self) -> DataFrame:
        return self._sql(LATEST_SHIFTS, shifts=self["shifts"])

    def changes(self) -> DataFrame:
        return self._sql(CHANGES, user_events=self._user_events())

    def options(self) -> DataFrame:
        """Three imports per option; the Dutch afternoon slots stand under a region nobody knows."""
        return self._sql(OPTIONS, "part")

    def option_history(self) -> DataFrame:
        """Five imports per option, other attributes than the latest options have."""
        return self._sql(OPTION_HISTORY, "part").drop("start_time", "end_time")

    def order_lines(self) -> DataFrame:
        return self._sql(ORDER_LINES, "orders", "lineitem", units=self._units())

    def order_items(self) -> DataFrame:
        return self._sql(ORDER_ITEMS, "orders", "lineitem", units=self._units())

    def comparison_rows(self) -> DataFrame:
        """Every order as a comparison row of its nation and priority."""
        return self._sql(COMPARISON, "orders", "customer", "nation")
