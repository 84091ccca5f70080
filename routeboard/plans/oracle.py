"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL never goes through the JSON payload: the events relation is rebuilt
from the raw ``events`` columns with the rotation rules documented in
``sources/envelope.py``, so the extraction path is checked by a second route.
Quarter labels are spelled out as explicit date ranges, one per quarter.
"""

from __future__ import annotations

from datetime import date, timedelta

from ..params import ReportParams

# Literals on purpose: what the queries are checked against does not come from them.
PAGE = ReportParams(date(2023, 1, 1), date(2025, 8, 31), "week")
CLASS_WINDOW = ReportParams(date(2022, 11, 1), date(2025, 8, 31), "week")
EVENT_RANGE = ReportParams(date(2024, 1, 10), date(2024, 1, 20), "day")
EVENT_COHORT = ReportParams(date(2024, 1, 2), date(2024, 1, 20), "day")
DATE_SHIFT_DAYS = 9862
ROUTE_SEPARATOR = "➡"
TXN_RANGE_CLASSES = (
    (1, 1, "1 Txn"), (2, 2, "2 Txns"), (3, 5, "3-5 Txns"), (6, 10, "6-10 Txns"), (11, 15, "11-15 Txns"),
    (16, 25, "16-25 Txns"), (26, 50, "26-50 Txns"), (51, None, ">50 Txns"),
)
TXN_EXACT_CLASSES = (
    (1, 1, "1 Txn"), (2, 2, "2 Txns"), (3, 3, "3 Txns"), (4, 4, "4 Txn"), (5, 5, "5 Txns"), (6, 6, "6 Txns"),
    (7, 7, "7 Txn"), (8, 8, "8 Txns"), (9, 9, "9 Txns"), (10, 10, "10 Txns"), (11, None, ">10 Txns"),
)
DAY_EXACT_CLASSES = (
    (1, 1, "1 Day"), (2, 2, "2 Days"), (3, 3, "3 Days"), (4, 4, "4 Days"), (5, 5, "5 Days"), (6, 6, "6 Days"),
    (7, 7, "7 Days"), (8, 8, "8 Days"), (9, 9, "9 Days"), (10, 10, "10 Days"), (11, None, ">10 Days"),
)
PATH_EXACT_CLASSES = (
    (1, 1, "1 Path"), (2, 2, "2 Paths"), (3, 3, "3 Paths"), (4, 4, "4 Paths"), (5, 5, "5 Paths"), (6, 6, "6 Paths"),
    (7, 7, "7 Paths"), (8, 8, "8 Paths"), (9, 9, "9 Paths"), (10, 10, "10 Paths"), (11, None, ">10 Paths"),
)

ORDERS_CTE = f"""base AS (
  SELECT CAST(CAST(o.o_orderdate AS DATE) + {DATE_SHIFT_DAYS} AS TIMESTAMP) AS created_at,
         CAST(o.o_orderdate AS DATE) + {DATE_SHIFT_DAYS} AS created_date,
         o.o_orderkey AS id,
         CAST(o.o_custkey AS VARCHAR) AS user_address,
         cn.n_name AS source_chain,
         sn.n_name AS destination_chain,
         'GMP' AS service,
         l.l_quantity AS amount,
         l.l_extendedprice AS amount_usd,
         l.l_extendedprice * l.l_tax AS fee,
         p.p_brand AS raw_asset
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
)"""


def _events_cte(folded: bool) -> str:
    src = "lower(event_type)" if folded else "upper(left(event_type, 1)) || substr(event_type, 2)"
    dst_prefix = "chain-" if folded else "Chain-"
    return f"""base AS (
  SELECT ts AS created_at,
         CAST(ts AS DATE) AS created_date,
         event_id AS id,
         '0x' || CAST(user_id AS VARCHAR) AS user_address,
         {src} AS source_chain,
         '{dst_prefix}' || CAST(user_id % 7 AS VARCHAR) AS destination_chain,
         'GMP' AS service,
         CASE WHEN (event_id + 5) % 10 IN (0, 1, 3, 4, 5) THEN NULL ELSE value END AS amount,
         CASE WHEN event_id % 10 IN (0, 1, 3, 4, 5) THEN NULL ELSE value END AS amount_usd,
         coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 2.5 END,
                  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 0.25 END) AS fee,
         'T' || CAST(user_id % 5 AS VARCHAR) AS raw_asset
  FROM events
  WHERE event_type <> 'error' AND event_id % 11 <> 0
)"""


EVENTS_CTE = _events_cte(folded=False)
EVENTS_FOLDED_CTE = _events_cte(folded=True)


def sr(x: str) -> str:
    return f"round(round({x}, 4))"


def div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def bucket(col: str, grain: str) -> str:
    return col if grain == "day" else f"CAST(date_trunc('{grain}', {col}) AS DATE)"


def rng(p: ReportParams, col: str = "created_date") -> str:
    return f"{col} BETWEEN DATE '{p.start.isoformat()}' AND DATE '{p.end.isoformat()}'"


def quarter_case(col: str) -> str:
    whens = []
    for year in range(2022, 2027):
        for q in range(4):
            first = date(year, 3 * q + 1, 1)
            nxt = date(year + 1, 1, 1) if q == 3 else date(year, 3 * q + 4, 1)
            last = nxt - timedelta(days=1)
            whens.append(f"WHEN {col} >= DATE '{first}' AND {col} < DATE '{last}' THEN 'Q{q + 1}-{year}'")
    return "CASE " + " ".join(whens) + " END"


def weekday_sql(ts: str) -> str:
    return f"CAST(isodow({ts}) AS VARCHAR) || ' - ' || strftime({ts}, '%a')"


def route_sql(a: str, b: str) -> str:
    return f"{a} || '{ROUTE_SEPARATOR}' || {b}"


def class_case(n: str, classes) -> str:
    whens = []
    for lo, hi, label in classes:
        cond = f"{n} >= {lo}" if hi is None else f"{n} BETWEEN {lo} AND {hi}"
        whens.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(whens) + " END"


# --- reports ---------------------------------------------------------------------
def r01(cte, p):
    return f"""WITH {cte}
SELECT count(DISTINCT id) AS total_transactions,
       count(DISTINCT user_address) AS unique_users,
       {sr('sum(amount_usd)')} AS total_volume,
       {sr(div('sum(amount_usd)', 'count(DISTINCT user_address)'))} AS average_volume_per_user
FROM base WHERE {rng(p)}"""


def r02(cte, p):
    return f"""WITH {cte}
SELECT {bucket('created_date', p.grain)} AS date,
       count(DISTINCT id) AS total_transactions,
       count(DISTINCT user_address) AS unique_users,
       {sr('sum(amount_usd)')} AS total_volume
FROM base WHERE {rng(p)} GROUP BY 1 ORDER BY 1"""


def r03(cte, p):
    return f"""WITH {cte},
g AS (SELECT {bucket('created_date', p.grain)} AS date, {quarter_case('created_date')} AS quarter,
             {sr('sum(amount_usd)')} AS total_volume
      FROM base WHERE {rng(p)} GROUP BY 1, 2)
SELECT date, quarter, total_volume,
       sum(total_volume) OVER (PARTITION BY quarter ORDER BY date) AS cumulative_volume
FROM g ORDER BY date ASC NULLS LAST, quarter ASC NULLS LAST"""


def r04(cte, p):
    return f"""WITH {cte}
SELECT count(DISTINCT lower(source_chain)) AS number_of_sources,
       count(DISTINCT lower(destination_chain)) AS number_of_destinations,
       {sr('avg(amount_usd)')} AS average_volume,
       {sr('max(amount_usd)')} AS max_volume
FROM base WHERE {rng(p)}"""


def r05(cte, p):
    return f"""WITH {cte}
SELECT {bucket('created_date', p.grain)} AS date,
       count(DISTINCT lower(source_chain)) AS sources,
       count(DISTINCT lower(destination_chain)) AS destinations
FROM base WHERE {rng(p)} GROUP BY 1 ORDER BY 1"""


def r06(cte, p):
    return f"""WITH {cte},
g AS (SELECT {bucket('created_date', p.grain)} AS date, {sr('sum(amount_usd)')} AS usd_volume
      FROM base WHERE {rng(p)} GROUP BY 1)
SELECT date, usd_volume,
       avg(usd_volume) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS avg_30_day_moving,
       avg(usd_volume) OVER (ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS avg_60_day_moving,
       avg(usd_volume) OVER (ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS avg_90_day_moving
FROM g ORDER BY date"""


def _classes(cte, p, measure, classes, label):
    return f"""WITH {cte},
u AS (SELECT user_address, {measure} AS n FROM base WHERE {rng(p)} GROUP BY user_address)
SELECT {class_case('n', classes)} AS {label}, count(DISTINCT user_address) AS number_of_users
FROM u GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST"""


def r07(cte, p):
    return _classes(cte, p, "count(DISTINCT id)", TXN_RANGE_CLASSES, "class")


def r10(cte, p):
    return _classes(cte, p, "count(DISTINCT id)", TXN_EXACT_CLASSES, "number_of_txns")


def r11(cte, p):
    return _classes(cte, p, "count(DISTINCT created_date)", DAY_EXACT_CLASSES, "days_of_activity")


def r12(cte, p):
    route = route_sql("lower(source_chain)", "lower(destination_chain)")
    return _classes(cte, p, f"count(DISTINCT {route})", PATH_EXACT_CLASSES, "number_of_paths")


def _first_seen(cte):
    return f"""WITH {cte},
f AS (SELECT user_address, min(created_date) AS first_txn_date FROM base GROUP BY user_address)"""


def r08(cte, p):
    return f"""{_first_seen(cte)},
g AS (SELECT {bucket('first_txn_date', p.grain)} AS date, count(DISTINCT user_address) AS new_users
      FROM f WHERE {rng(p, 'first_txn_date')} GROUP BY 1)
SELECT date, new_users, CAST(sum(new_users) OVER (ORDER BY date) AS BIGINT) AS cumulative_new_users
FROM g ORDER BY date"""


def _daily_new(cte, p):
    return f"""{_first_seen(cte)},
d AS (SELECT first_txn_date AS date, count(DISTINCT user_address) AS new_users
      FROM f WHERE {rng(p, 'first_txn_date')} GROUP BY 1)"""


def r09(cte, p):
    return f"""{_daily_new(cte, p)}
SELECT CAST(sum(new_users) AS BIGINT) AS cumulative_new_users,
       {sr('avg(new_users)')} AS average_daily_new_users
FROM d"""


def _r13_body(p):
    return f"""SELECT CAST(hour(created_at) AS INTEGER) AS hour, {weekday_sql('created_at')} AS day,
       count(DISTINCT id) AS number_of_transfers, {sr('sum(amount_usd)')} AS volume_of_transfers
FROM base WHERE {rng(p)} GROUP BY 1, 2"""


def r13(cte, p):
    return f"WITH {cte}\n{_r13_body(p)} ORDER BY 1, 2"


def _r14_body(p, folded=False):
    src, dst = ("lower(source_chain)", "lower(destination_chain)") if folded else ("source_chain", "destination_chain")
    return f"""SELECT {route_sql(src, dst)} AS path,
       count(DISTINCT created_date) AS active_days,
       count(DISTINCT id) AS number_of_transfers,
       count(DISTINCT user_address) AS number_of_users,
       {sr(div('count(DISTINCT user_address)', 'count(DISTINCT created_date)'))} AS avg_daily_users,
       count(DISTINCT raw_asset) AS transferred_tokens,
       {sr('sum(amount_usd)')} AS volume_usd,
       {sr('avg(amount_usd)')} AS avg_volume_usd,
       {sr('median(amount_usd)')} AS median_volume_usd,
       {sr('max(amount_usd)')} AS max_volume_usd,
       {sr(div('sum(amount_usd)', 'count(DISTINCT created_date)'))} AS avg_daily_volume_usd
FROM base WHERE {rng(p)} GROUP BY 1"""


def r14(cte, p):
    return f"WITH {cte}\n{_r14_body(p)} ORDER BY active_days DESC NULLS FIRST, path ASC NULLS LAST"


def r15(cte, p):
    return f"""WITH {cte}
SELECT lower(source_chain) AS source_chain, lower(destination_chain) AS destination_chain,
       {sr('sum(amount_usd)')} AS volume_usd, count(DISTINCT id) AS number_of_transactions
FROM base WHERE {rng(p)} AND amount_usd IS NOT NULL
GROUP BY 1, 2 ORDER BY 3 DESC NULLS FIRST, 4 ASC NULLS LAST, 1 ASC NULLS LAST, 2 ASC NULLS LAST"""


def _r16_body(p):
    return f"""SELECT {route_sql('source_chain', 'destination_chain')} AS path,
       count(DISTINCT id) AS number_of_transfers,
       count(DISTINCT user_address) AS number_of_users,
       {sr('sum(amount_usd)')} AS volume_of_transfers_usd
FROM base WHERE {rng(p)} GROUP BY 1"""


def r16(cte, p):
    return f"WITH {cte}\n{_r16_body(p)} ORDER BY 2 DESC NULLS FIRST, 1 ASC NULLS LAST"


# --- derived -----------------------------------------------------------------------
def d_pivot(cte, p, value):
    cells = ",\n       ".join(
        f"coalesce(avg({value}) FILTER (WHERE hour = {h}), 0) AS h{h:02d}" for h in range(24))
    return f"""WITH {cte}, h AS ({_r13_body(p)})
SELECT day,
       {cells}
FROM h WHERE {value} IS NOT NULL GROUP BY day ORDER BY day"""


def _fmt_int(c):
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE format('{{:,}}', {c}) END AS {c}"


def _fmt_dbl(c):
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE format('{{:,.1f}}', {c}) END AS {c}"


def d3(cte, p):
    ints = ["active_days", "number_of_transfers", "number_of_users", "transferred_tokens"]
    dbls = ["avg_daily_users", "volume_usd", "avg_volume_usd", "median_volume_usd", "max_volume_usd",
            "avg_daily_volume_usd"]
    order = ["active_days", "number_of_transfers", "number_of_users", "avg_daily_users",
             "transferred_tokens", "volume_usd", "avg_volume_usd", "median_volume_usd",
             "max_volume_usd", "avg_daily_volume_usd"]
    cols = ",\n       ".join(_fmt_int(c) if c in ints else _fmt_dbl(c) for c in order)
    assert set(order) == set(ints) | set(dbls)
    return f"""WITH {cte}, r AS ({_r14_body(p)})
SELECT row_number() OVER (ORDER BY active_days DESC NULLS FIRST, path ASC NULLS LAST) AS row_number,
       path,
       {cols}
FROM r"""


def _top_volume(p):
    return f"""SELECT * FROM ({_r16_body(p)}) t
ORDER BY volume_of_transfers_usd DESC NULLS LAST, number_of_transfers DESC NULLS FIRST, path ASC NULLS LAST
LIMIT 10"""


def _top_transfers(p):
    return f"""SELECT * FROM ({_r16_body(p)}) t
ORDER BY number_of_transfers DESC NULLS LAST, path ASC NULLS LAST LIMIT 10"""


def d4(cte, p):
    return f"WITH {cte}\n{_top_volume(p)}"


def d5(cte, p):
    return f"WITH {cte}\n{_top_transfers(p)}"


def d6(cte, p):
    return f"""WITH {cte}, t AS ({_top_transfers(p)})
SELECT path, 'number_of_transfers' AS metric, number_of_transfers AS count FROM t
UNION ALL
SELECT path, 'number_of_users' AS metric, number_of_users AS count FROM t"""


def d7(class_sql):
    return f"""WITH c AS ({class_sql})
SELECT *, CAST(number_of_users AS DOUBLE) / NULLIF(CAST(sum(number_of_users) OVER () AS DOUBLE), 0)
       AS share_of_users
FROM c"""


# --- primitives -----------------------------------------------------------------------
def _ev(select, where="TRUE", folded=True):
    cte = EVENTS_FOLDED_CTE if folded else EVENTS_CTE
    return f"WITH {cte}\nSELECT {select} FROM base WHERE {where}"


ORACLE: dict[str, str] = {
    "r01_overview_kpis": r01(ORDERS_CTE, PAGE),
    "r01_overview_kpis_events": r01(EVENTS_CTE, EVENT_RANGE),
    "r02_activity_over_time": r02(ORDERS_CTE, PAGE),
    "r02_activity_over_time_day": r02(ORDERS_CTE, PAGE.with_grain("day")),
    "r02_activity_over_time_month": r02(ORDERS_CTE, PAGE.with_grain("month")),
    "r02_activity_over_time_events": r02(EVENTS_CTE, EVENT_RANGE),
    "r03_quarterly_cumulative": r03(ORDERS_CTE, PAGE),
    "r03_quarterly_cumulative_month": r03(ORDERS_CTE, PAGE.with_grain("month")),
    "r04_chain_kpis": r04(ORDERS_CTE, PAGE),
    "r04_chain_kpis_events": r04(EVENTS_CTE, EVENT_RANGE),
    "r05_active_chains": r05(ORDERS_CTE, PAGE),
    "r05_active_chains_events": r05(EVENTS_CTE, EVENT_RANGE),
    "r06_moving_average": r06(ORDERS_CTE, PAGE),
    "r06_moving_average_day": r06(ORDERS_CTE, PAGE.with_grain("day")),
    "r07_txn_ranges": r07(ORDERS_CTE, CLASS_WINDOW),
    "r07_txn_ranges_events": r07(EVENTS_CTE, CLASS_WINDOW),
    "r08_new_users": r08(ORDERS_CTE, PAGE),
    "r08_new_users_month": r08(ORDERS_CTE, PAGE.with_grain("month")),
    "r09_new_user_kpis": r09(ORDERS_CTE, PAGE),
    "r10_txn_exact": r10(ORDERS_CTE, PAGE),
    "r11_active_days": r11(ORDERS_CTE, PAGE),
    "r12_paths_per_user": r12(ORDERS_CTE, PAGE),
    "r13_heatmap": r13(EVENTS_CTE, PAGE),
    "r13_heatmap_range": r13(EVENTS_CTE, EVENT_RANGE),
    "r14_route_profile": r14(ORDERS_CTE, PAGE),
    "r14_route_profile_ranked": r14(ORDERS_CTE, PAGE),
    "r14_route_profile_events": r14(EVENTS_CTE, EVENT_RANGE),
    "r15_source_destination": r15(ORDERS_CTE, PAGE),
    "r15_source_destination_events": r15(EVENTS_CTE, EVENT_RANGE),
    "r16_route_totals": r16(ORDERS_CTE, PAGE),
    "r16_route_totals_events": r16(EVENTS_CTE, EVENT_RANGE),
    "d1_heatmap_transfers": d_pivot(EVENTS_CTE, PAGE, "number_of_transfers"),
    "d2_heatmap_volume": d_pivot(EVENTS_CTE, PAGE, "volume_of_transfers"),
    "d3_routes_numbered": d3(ORDERS_CTE, PAGE),
    "d4_top_volume": d4(ORDERS_CTE, PAGE),
    "d5_top_transfers": d5(ORDERS_CTE, PAGE),
    "d6_top_long": d6(ORDERS_CTE, PAGE),
    "d7_share_txn_ranges": d7(r07(ORDERS_CTE, CLASS_WINDOW)),
    "d7_share_txn_exact": d7(r10(ORDERS_CTE, PAGE)),
    "d7_share_active_days": d7(r11(ORDERS_CTE, PAGE)),
    "d7_share_paths": d7(r12(ORDERS_CTE, PAGE)),
    "r03_quarterly_cumulative_events": r03(EVENTS_CTE, EVENT_RANGE),
    "r06_moving_average_events": r06(EVENTS_CTE, EVENT_RANGE),
    "r08_new_users_events": r08(EVENTS_CTE, EVENT_COHORT),
    "r09_new_user_kpis_events": r09(EVENTS_CTE, EVENT_COHORT),
    "r10_txn_exact_events": r10(EVENTS_CTE, EVENT_RANGE),
    "r11_active_days_events": r11(EVENTS_CTE, EVENT_RANGE),
    "r12_paths_per_user_events": r12(EVENTS_CTE, EVENT_RANGE),
    "d3_routes_numbered_events": d3(EVENTS_CTE, EVENT_RANGE),
    "d4_top_volume_events": d4(EVENTS_CTE, EVENT_RANGE),
    "d6_top_long_events": d6(EVENTS_CTE, EVENT_RANGE),
    "p_extract_strings": _ev("id, user_address, source_chain, destination_chain, raw_asset"),
    "p_amount": _ev("id, amount"),
    "p_amount_usd": _ev("id, amount_usd"),
    "p_fee": _ev("id, fee"),
    "p_normalized": _ev("created_at, created_date, id, user_address, source_chain, destination_chain, "
                        "service, amount, amount_usd, fee, raw_asset"),
    "p_route_label": _ev(f"id, {route_sql('source_chain', 'destination_chain')} AS path", folded=False),
    "p_success_filter": """SELECT event_id AS id, 'executed' AS status, 'received' AS simplified_status
FROM events WHERE event_type <> 'error' AND event_id % 11 <> 0""",
    "p_date_range": _ev("id, created_date", rng(EVENT_RANGE), folded=False),
    "p_priced": _ev("id, amount_usd", "amount_usd IS NOT NULL", folded=False),
    "p_quarter_label": f"""WITH {ORDERS_CTE}
SELECT DISTINCT created_date, {quarter_case('created_date')} AS quarter FROM base""",
    "p_weekday_label": _ev(f"id, CAST(hour(created_at) AS INTEGER) AS hour, {weekday_sql('created_at')} AS day",
                           folded=False),
    "p_first_seen": f"""WITH {ORDERS_CTE}
SELECT user_address, min(created_date) AS first_txn_date FROM base GROUP BY user_address""",
    "p_median": f"""WITH {ORDERS_CTE}
SELECT raw_asset, round(median(amount_usd), 4) AS median_amount_usd
FROM base WHERE amount_usd IS NOT NULL GROUP BY raw_asset""",
    "p_running_total": f"""WITH {ORDERS_CTE},
g AS (SELECT created_date AS date, {sr('sum(amount_usd)')} AS total_volume FROM base WHERE {rng(PAGE)} GROUP BY 1)
SELECT date, total_volume, sum(total_volume) OVER (ORDER BY date) AS running_volume FROM g""",
    "p_whole_partition_max": f"""{_daily_new(ORDERS_CTE, PAGE)}
SELECT date, new_users, max(new_users) OVER () AS peak_new_users FROM d""",
    "p_distinct_rows": f"""WITH {ORDERS_CTE}
SELECT DISTINCT source_chain, destination_chain FROM base""",
}
ORACLE["p_median_ranked"] = ORACLE["p_median"]
ORACLE["p_normalized_variant"] = ORACLE["p_normalized"]

# stored, kept and streamed results are the same tables
ORACLE |= {
    "t_streamed_activity": ORACLE["r02_activity_over_time_events"],
    "t_streamed_quarterly": ORACLE["r03_quarterly_cumulative_events"],
    "t_streamed_chains": ORACLE["r05_active_chains_events"],
    "t_streamed_moving_average": ORACLE["r06_moving_average_events"],
    "t_streamed_heatmap": ORACLE["r13_heatmap_range"],
    "t_streamed_first_seen": f"WITH {EVENTS_CTE}\nSELECT user_address, min(created_date) AS first_txn_date FROM base GROUP BY user_address",
    "p_stored_fact": ORACLE["p_normalized"],
    "s_kept_activity": ORACLE["r02_activity_over_time"],
    "s_kept_activity_events": ORACLE["r02_activity_over_time_events"],
    "s_kept_quarterly": ORACLE["r03_quarterly_cumulative"],
    "s_kept_chain_kpis": ORACLE["r04_chain_kpis"],
    "s_kept_heatmap": ORACLE["r13_heatmap"],
    "s_kept_route_profile": ORACLE["r14_route_profile"],
    "s_kept_route_profile_events": ORACLE["r14_route_profile_events"],
    "s_kept_pairs_events": ORACLE["r15_source_destination_events"],
}
