"""Reports on a hand-written normalised relation, expected values worked out by hand."""

from datetime import date, datetime

import pytest

from routeboard.operators import derived, reports as R
from routeboard.params import ReportParams

BASE_SCHEMA = ("created_at timestamp_ntz, created_date date, id bigint, user_address string, "
               "source_chain string, destination_chain string, service string, amount double, "
               "amount_usd double, fee double, raw_asset string")


def base_of(spark, rows):
    """rows: (created_at, id, user, source, destination, amount_usd, asset)"""
    full = [(ts, ts.date(), i, u, s, d, "GMP", None, usd, None, a) for ts, i, u, s, d, usd, a in rows]
    return spark.createDataFrame(full, BASE_SCHEMA)


P = ReportParams(date(2023, 1, 1), date(2023, 12, 31), "week")


@pytest.fixture(scope="module")
def base(spark):
    rows = [
        (datetime(2022, 12, 31, 23, 0), 1, "u1", "Eth", "Arb", 10.0, "A"),      # before start: excluded
        (datetime(2023, 1, 1, 0, 0), 2, "u1", "Eth", "Arb", 1.5, "A"),          # start day 00:00
        (datetime(2023, 1, 1, 5, 0), 2, "u1", "Eth", "Arb", 1.0, "A"),          # duplicate id
        (datetime(2023, 3, 31, 8, 0), 3, "u2", "eth", "Arb", 2.0, "B"),         # quarter last day; case differs
        (datetime(2023, 4, 3, 9, 0), 4, None, "Eth", "Arb", None, "A"),         # NULL user, NULL value
        (datetime(2023, 12, 31, 23, 59, 59, 999999), 5, "u3", None, "Arb", 4.0, "C"),  # end day; NULL source
        (datetime(2024, 1, 1, 0, 0), 6, "u3", "Eth", "Arb", 100.0, "A"),        # after end: excluded
    ]
    return base_of(spark, rows)


def test_overview(base):
    r = R.overview_kpis(base, P).first()
    assert r.total_transactions == 4        # ids 2, 3, 4, 5
    assert r.unique_users == 3              # u1, u2, u3 (NULL ignored)
    assert r.total_volume == 9.0            # 1.5 + 1 + 2 + 4 = 8.5 -> 9 (half away from zero)
    assert r.average_volume_per_user == 3.0  # 8.5 / 3


def test_overview_empty_range(base):
    r = R.overview_kpis(base, ReportParams(date(2030, 1, 1), date(2030, 1, 2))).first()
    assert (r.total_transactions, r.unique_users, r.total_volume, r.average_volume_per_user) == (0, 0, None, None)


def test_activity_weekly(base):
    rows = R.activity_over_time(base, P).collect()
    assert [r.date for r in rows] == [date(2022, 12, 26), date(2023, 3, 27), date(2023, 4, 3), date(2023, 12, 25)]
    assert [r.total_transactions for r in rows] == [1, 1, 1, 1]
    assert rows[2].unique_users == 0 and rows[2].total_volume is None


def test_quarterly(base):
    rows = R.quarterly_cumulative(base, P.with_grain("month")).collect()
    got = [(r.date, r.quarter, r.total_volume, r.cumulative_volume) for r in rows]
    assert got == [
        (date(2023, 1, 1), "Q1-2023", 3.0, 3.0),    # 2.5 -> 3
        (date(2023, 3, 1), None, 2.0, 2.0),         # 31 Mar is outside Q1
        (date(2023, 4, 1), "Q2-2023", None, None),
        (date(2023, 12, 1), None, 4.0, 6.0),        # NULL quarter is one running partition
    ]


def test_chain_kpis(base):
    r = R.chain_kpis(base, P).first()
    assert (r.number_of_sources, r.number_of_destinations) == (1, 1)   # "Eth"/"eth" fold together
    assert r.average_volume == 2.0 and r.max_volume == 4.0             # 8.5 / 4 = 2.125


def test_route_reports_fold_case_differently(base):
    paths = {r.path for r in R.route_totals(base, P).collect()}
    assert paths == {"Eth➡Arb", "eth➡Arb", None}
    folded = {(r.source_chain, r.destination_chain) for r in R.source_destination(base, P).collect()}
    assert folded == {("eth", "arb"), (None, "arb")}        # the NULL-value row is dropped


def test_route_profile(base):
    rows = {r.path: r for r in R.route_profile(base, P).collect()}
    eth = rows["Eth➡Arb"]
    assert (eth.active_days, eth.number_of_transfers, eth.number_of_users) == (2, 2, 1)
    assert eth.transferred_tokens == 1
    assert eth.median_volume_usd == 1.0      # median(1.5, 1.0) = 1.25
    assert eth.avg_daily_users == 1.0        # 1 / 2 = 0.5 -> 1
    assert rows[None].volume_usd == 4.0


def test_route_profile_median_strategies_agree(base):
    a = {r.path: r.asDict() for r in R.route_profile(base, P).collect()}
    b = {r.path: r.asDict() for r in R.route_profile(base, P, medians=R.route_medians(base, P)).collect()}
    assert a == b


def test_heatmap(base):
    rows = {(r.hour, r.day): r for r in R.heatmap(base, P).collect()}
    assert rows[(0, "7 - Sun")].number_of_transfers == 1     # 2023-01-01 is a Sunday
    assert rows[(23, "7 - Sun")].volume_of_transfers == 4.0  # 2023-12-31 is a Sunday
    assert rows[(8, "5 - Fri")].number_of_transfers == 1


@pytest.fixture(scope="module")
def users(spark):
    # user k has k distinct ids (plus one duplicate row) for the listed k; one NULL-user row
    counts = [1, 2, 3, 5, 6, 10, 11, 15, 16, 25, 26, 50, 51]
    rows, next_id = [], 0
    for k in counts:
        for j in range(k):
            next_id += 1
            day = datetime(2023, 5, 1 + j % 28, 10, 0)
            rows.append((day, next_id, f"user{k}", "A", f"D{j % 12}", 1.0, "T"))
        rows.append((datetime(2023, 5, 1, 11, 0), next_id, f"user{k}", "A", "D0", 1.0, "T"))
    rows.append((datetime(2023, 5, 2, 10, 0), 99999, None, "A", "D0", 1.0, "T"))
    # user active before the range and again inside: not new in range
    rows.append((datetime(2022, 6, 1, 10, 0), 100000, "old", "A", "D0", 1.0, "T"))
    rows.append((datetime(2023, 5, 3, 10, 0), 100001, "old", "A", "D0", 1.0, "T"))
    return base_of(spark, rows)


def test_txn_ranges(users):
    got = {r["class"]: r.number_of_users for r in R.txn_ranges(users, P).collect()}
    assert got == {"1 Txn": 2, "2 Txns": 1, "3-5 Txns": 2, "6-10 Txns": 2, "11-15 Txns": 2,
                   "16-25 Txns": 2, "26-50 Txns": 2, ">50 Txns": 1}
    # the NULL user has one id, so its group lands in "1 Txn" but adds no user there


def test_exact_classes_and_shares(users):
    t = R.txn_exact(users, P)
    got = {r.number_of_txns: r.number_of_users for r in t.collect()}
    assert got["1 Txn"] == 2 and got[">10 Txns"] == 7 and got["3 Txns"] == 1
    shares = derived.share_of_users(t).collect()
    assert abs(sum(r.share_of_users for r in shares) - 1.0) < 1e-12
    days = {r.days_of_activity: r.number_of_users for r in R.active_days(users, P).collect()}
    assert days[">10 Days"] == 7
    paths = {r.number_of_paths: r.number_of_users for r in R.paths_per_user(users, P).collect()}
    assert paths[">10 Paths"] == 7 and paths["10 Paths"] == 1   # min(k, 12) destinations each


def test_new_users(users):
    rows = R.new_users(users, P.with_grain("month")).collect()
    assert [(r.date, r.new_users, r.cumulative_new_users) for r in rows] == [(date(2023, 5, 1), 13, 13)]
    k = R.new_user_kpis(users, P).first()
    daily = {r.date: r.new_users for r in R.daily_new_users(users, P).collect()}
    assert k.cumulative_new_users == 13 == sum(daily.values())
    # mean over days that had a new user: 13 users first seen on 1 May, the NULL user on 2 May (0)
    assert daily == {date(2023, 5, 1): 13, date(2023, 5, 2): 0}
    assert k.average_daily_new_users == 7.0      # 6.5 -> 7


def test_moving_average(spark):
    from datetime import timedelta
    monday = datetime(2023, 1, 2)
    rows = [(monday + timedelta(weeks=w), w, "u", "A", "B", float(w), "T") for w in range(1, 15)]
    got = R.moving_average(base_of(spark, rows), P).collect()
    assert got[0].avg_30_day_moving == 1.0
    assert got[4].avg_30_day_moving == 3.0              # mean(1..5)
    assert got[13].avg_30_day_moving == 12.0            # mean(10..14)
    assert got[13].avg_90_day_moving == 8.0             # mean(2..14)


def test_top_k_and_long_form(spark):
    rows = []
    for i in range(12):
        for j in range(i + 1):
            rows.append((datetime(2023, 6, 1), i * 100 + j, f"u{j}", f"S{i:02d}", "D", 1.0 if i != 11 else None, "T"))
    totals = R.route_totals(base_of(spark, rows), P)
    top = derived.top_volume(totals).collect()
    assert len(top) == 10 and top[0].path == "S10➡D"     # S11 has NULL volume: last
    assert all(r.volume_of_transfers_usd is not None for r in top)
    tt = derived.top_transfers(totals)
    assert tt.first().path == "S11➡D"
    long = derived.top_long(tt).collect()
    assert len(long) == 20 and {r.metric for r in long} == {"number_of_transfers", "number_of_users"}


def test_pivot_and_format(spark):
    heat = spark.createDataFrame(
        [(0, "1 - Mon", 3, 10.0), (5, "1 - Mon", 1, None), (23, "2 - Tue", 2, None)],
        "hour int, day string, number_of_transfers bigint, volume_of_transfers double")
    t = {r.day: r for r in derived.heatmap_transfers(heat).collect()}
    assert t["1 - Mon"].h00 == 3.0 and t["1 - Mon"].h05 == 1.0 and t["1 - Mon"].h01 == 0.0
    assert len(derived.heatmap_transfers(heat).columns) == 25
    v = {r.day: r for r in derived.heatmap_volume(heat).collect()}
    assert set(v) == {"1 - Mon"} and v["1 - Mon"].h05 == 0.0
    from routeboard.operators.reshape import format_numbers
    df = spark.createDataFrame([(1234567, 1234.0, "x", None)], "a bigint, b double, c string, d double")
    r = format_numbers(df).first()
    assert (r.a, r.b, r.c, r.d) == ("1,234,567", "1,234.0", "x", None)


def test_null_id_is_not_a_transfer(spark):
    rows = [
        (datetime(2023, 5, 1, 9, 0), 1, "u1", "A", "B", 2.0, "T"),
        (datetime(2023, 5, 1, 9, 5), None, "u2", "A", "B", 3.0, "T"),   # NULL id: user and value still count
    ]
    base = base_of(spark, rows)
    r = R.overview_kpis(base, P).first()
    assert (r.total_transactions, r.unique_users, r.total_volume) == (1, 2, 5.0)
    classes = {x.number_of_txns: x.number_of_users for x in R.txn_exact(base, P).collect()}
    assert classes == {"1 Txn": 1, None: 1}      # a user whose ids are all NULL has 0 transfers: no class
