"""The sixteen reports as parameterised Spark SQL over a registered base view.

For users who write SQL: register the normalised base once, then run a report
by name with named parameters (``:start``, ``:end``, ``:grain``) bound by
``spark.sql(text, args=...)`` -- values are bound as literals, never spliced
into the text.  Catalyst plans these exactly like the DataFrame reports in
``operators.reports`` (same pushdown, same aggregation strategy).  R14 takes
its medians from digit histograms as ``operators.median`` does, never from a
function that gathers a whole route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import (
    DAY_EXACT_CLASSES,
    PATH_EXACT_CLASSES,
    ROUTE_SEPARATOR,
    TXN_EXACT_CLASSES,
    TXN_RANGE_CLASSES,
)
from ..params import ReportParams

VIEW = "transfers"


def register_base(base: DataFrame, name: str = VIEW) -> None:
    """Expose the normalised relation (``BASE_COLUMNS``) to SQL as ``name``."""
    base.createOrReplaceTempView(name)


def sql_report(spark: SparkSession, name: str, p: ReportParams, view: str = VIEW) -> DataFrame:
    """Run report ``name`` (``r01_overview_kpis`` ... ``r16_route_totals``) for ``p``."""
    text = REPORT_SQL[name].replace("{view}", view)
    return spark.sql(text, args={"start": p.start, "end": p.end, "grain": p.grain})


def _sr(x: str) -> str:
    return f"round(round({x}, 4))"


def _classes(measure: str, classes, label: str) -> str:
    whens = " ".join(
        f"WHEN n >= {lo} THEN '{lab}'" if hi is None else f"WHEN n BETWEEN {lo} AND {hi} THEN '{lab}'"
        for lo, hi, lab in classes)
    return f"""WITH u AS (SELECT user_address, {measure} AS n FROM {{view}}
           WHERE created_date BETWEEN :start AND :end GROUP BY user_address)
SELECT CASE {whens} END AS {label}, count(user_address) AS number_of_users
FROM u GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST"""


def _code(x: str) -> str:
    """``median.order_code`` in SQL."""
    bits = f"CAST(java_method('java.lang.Double', 'doubleToLongBits', {x}) AS BIGINT)"
    return f"IF({bits} >= 0, {bits}, {bits} ^ 9223372036854775807)"


def _digit(name: str, histogram: str, shift: int, within: tuple[str, int] | None) -> str:
    """CTEs: the histogram of one digit of ``code``, and the digits that hold the middle ranks (0-based)."""
    if within is None:
        return f"""{histogram} AS (
  SELECT path, digit, w, sum(w) OVER (PARTITION BY path ORDER BY digit) - w AS before, sum(w) OVER (PARTITION BY path) AS n
  FROM (SELECT path, shiftright(code, {shift}) AS digit, sum(w) AS w FROM coded GROUP BY 1, 2)),
{name} AS (
  SELECT path, digit, middle, middle - before AS rank
  FROM (SELECT *, explode(array_distinct(array((n - 1) DIV 2, n DIV 2))) AS middle FROM {histogram})
  WHERE before <= middle AND middle < before + w)"""
    source, earlier = within
    return f"""{histogram} AS (
  SELECT *, sum(w) OVER (PARTITION BY path, middle ORDER BY digit) - w AS before
  FROM (SELECT c.path, middle, rank, shiftright(code, {shift}) AS digit, sum(c.w) AS w, max(c.usd) AS usd
        FROM coded c JOIN {source} t ON c.path <=> t.path AND shiftright(code, {earlier}) = t.digit GROUP BY 1, 2, 3, 4)),
{name} AS (
  SELECT path, digit, middle, rank - before AS rank, usd FROM {histogram} WHERE before <= rank AND rank < before + w)"""


_IN_RANGE = "FROM {view} WHERE created_date BETWEEN :start AND :end"
_BUCKET = "CASE WHEN :grain = 'day' THEN created_date ELSE trunc(created_date, :grain) END"
_FIRST_BUCKET = "CASE WHEN :grain = 'day' THEN first_txn_date ELSE trunc(first_txn_date, :grain) END"
_QUARTER = ("CASE WHEN year(created_date) BETWEEN 2022 AND 2026 "
            "AND created_date < date_sub(add_months(trunc(created_date, 'quarter'), 3), 1) "
            "THEN concat('Q', quarter(created_date), '-', year(created_date)) END")
_ROUTE = f"concat(source_chain, '{ROUTE_SEPARATOR}', destination_chain)"
_ROUTE_FOLDED = f"concat(lower(source_chain), '{ROUTE_SEPARATOR}', lower(destination_chain))"
_FIRST_SEEN = """first_seen AS (SELECT user_address, min(created_date) AS first_txn_date
                    FROM {view} GROUP BY user_address)"""

REPORT_SQL: dict[str, str] = {
    "r01_overview_kpis": f"""SELECT count(DISTINCT id) AS total_transactions,
       count(DISTINCT user_address) AS unique_users,
       {_sr('sum(amount_usd)')} AS total_volume,
       {_sr('try_divide(sum(amount_usd), count(DISTINCT user_address))')} AS average_volume_per_user
{_IN_RANGE}""",
    "r02_activity_over_time": f"""SELECT {_BUCKET} AS date, count(DISTINCT id) AS total_transactions,
       count(DISTINCT user_address) AS unique_users, {_sr('sum(amount_usd)')} AS total_volume
{_IN_RANGE} GROUP BY 1 ORDER BY 1 ASC NULLS LAST""",
    "r03_quarterly_cumulative": f"""WITH g AS (
  SELECT {_BUCKET} AS date, {_QUARTER} AS quarter, {_sr('sum(amount_usd)')} AS total_volume
  {_IN_RANGE} GROUP BY 1, 2)
SELECT date, quarter, total_volume,
       sum(total_volume) OVER (PARTITION BY quarter ORDER BY date) AS cumulative_volume
FROM g ORDER BY date ASC NULLS LAST, quarter ASC NULLS LAST""",
    "r04_chain_kpis": f"""SELECT count(DISTINCT lower(source_chain)) AS number_of_sources,
       count(DISTINCT lower(destination_chain)) AS number_of_destinations,
       {_sr('avg(amount_usd)')} AS average_volume, {_sr('max(amount_usd)')} AS max_volume
{_IN_RANGE}""",
    "r05_active_chains": f"""SELECT {_BUCKET} AS date, count(DISTINCT lower(source_chain)) AS sources,
       count(DISTINCT lower(destination_chain)) AS destinations
{_IN_RANGE} GROUP BY 1 ORDER BY 1 ASC NULLS LAST""",
    "r06_moving_average": f"""WITH g AS (SELECT {_BUCKET} AS date, {_sr('sum(amount_usd)')} AS usd_volume
           {_IN_RANGE} GROUP BY 1)
SELECT date, usd_volume,
       avg(usd_volume) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS avg_30_day_moving,
       avg(usd_volume) OVER (ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS avg_60_day_moving,
       avg(usd_volume) OVER (ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS avg_90_day_moving
FROM g ORDER BY date ASC NULLS LAST""",
    "r07_txn_ranges": _classes("count(DISTINCT id)", TXN_RANGE_CLASSES, "class"),
    "r08_new_users": f"""WITH {_FIRST_SEEN},
g AS (SELECT {_FIRST_BUCKET} AS date, count(user_address) AS new_users FROM first_seen
      WHERE first_txn_date BETWEEN :start AND :end GROUP BY 1)
SELECT date, new_users, CAST(sum(new_users) OVER (ORDER BY date) AS BIGINT) AS cumulative_new_users
FROM g ORDER BY date ASC NULLS LAST""",
    "r09_new_user_kpis": f"""WITH {_FIRST_SEEN},
d AS (SELECT first_txn_date AS date, count(user_address) AS new_users FROM first_seen
      WHERE first_txn_date BETWEEN :start AND :end GROUP BY 1)
SELECT CAST(sum(new_users) AS BIGINT) AS cumulative_new_users,
       {_sr('avg(new_users)')} AS average_daily_new_users
FROM d""",
    "r10_txn_exact": _classes("count(DISTINCT id)", TXN_EXACT_CLASSES, "number_of_txns"),
    "r11_active_days": _classes("count(DISTINCT created_date)", DAY_EXACT_CLASSES, "days_of_activity"),
    "r12_paths_per_user": _classes(f"count(DISTINCT {_ROUTE_FOLDED})", PATH_EXACT_CLASSES, "number_of_paths"),
    "r13_heatmap": f"""SELECT hour(created_at) AS hour,
       concat(CAST(weekday(created_at) + 1 AS STRING), ' - ', date_format(created_at, 'E')) AS day,
       count(DISTINCT id) AS number_of_transfers, {_sr('sum(amount_usd)')} AS volume_of_transfers
{_IN_RANGE} GROUP BY 1, 2 ORDER BY 1 ASC NULLS LAST, 2 ASC NULLS LAST""",
    "r14_route_profile": f"""WITH prices AS (
  SELECT {_ROUTE} AS path, amount_usd AS usd, count(*) AS w {_IN_RANGE} AND amount_usd IS NOT NULL GROUP BY 1, 2),
coded AS (SELECT path, usd, w, {_code('usd')} AS code FROM prices),
{_digit('d1', 'n1', 44, None)},
{_digit('d2', 'n2', 22, ('d1', 44))},
{_digit('d3', 'n3', 0, ('d2', 22))},
medians AS (SELECT path AS of, 0.5D * min(usd) + 0.5D * max(usd) AS usd FROM d3 GROUP BY path),
stats AS (
  SELECT {_ROUTE} AS path,
         count(DISTINCT created_date) AS active_days,
         count(DISTINCT id) AS number_of_transfers,
         count(DISTINCT user_address) AS number_of_users,
         count(DISTINCT raw_asset) AS transferred_tokens,
         sum(amount_usd) AS total, avg(amount_usd) AS mean, max(amount_usd) AS most
  {_IN_RANGE} GROUP BY 1)
SELECT path, active_days, number_of_transfers, number_of_users,
       {_sr('try_divide(number_of_users, active_days)')} AS avg_daily_users,
       transferred_tokens,
       {_sr('total')} AS volume_usd,
       {_sr('mean')} AS avg_volume_usd,
       {_sr('usd')} AS median_volume_usd,
       {_sr('most')} AS max_volume_usd,
       {_sr('try_divide(total, active_days)')} AS avg_daily_volume_usd
FROM stats LEFT JOIN medians ON path <=> of ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST""",
    "r15_source_destination": f"""SELECT lower(source_chain) AS source_chain,
       lower(destination_chain) AS destination_chain,
       {_sr('sum(amount_usd)')} AS volume_usd, count(DISTINCT id) AS number_of_transactions
{_IN_RANGE} AND amount_usd IS NOT NULL
GROUP BY 1, 2 ORDER BY 3 DESC NULLS FIRST, 4 ASC NULLS LAST, 1 ASC NULLS LAST, 2 ASC NULLS LAST""",
    "r16_route_totals": f"""SELECT {_ROUTE} AS path, count(DISTINCT id) AS number_of_transfers,
       count(DISTINCT user_address) AS number_of_users,
       {_sr('sum(amount_usd)')} AS volume_of_transfers_usd
{_IN_RANGE} GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST""",
}
