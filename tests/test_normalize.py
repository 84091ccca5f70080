import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from routeboard.operators.normalize import normalize
from routeboard.operators.reports import in_range
from routeboard.params import ReportParams
from routeboard.sources.envelope import events_fact
from routeboard.sources.storage import scratch_path
from tests.conftest import SF_SMALL
from tests.edge_rows import FEE_CASES, RAW_SCHEMA, VALUE_CASES, raw_rows


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if math.isnan(b):
        return math.isnan(a)
    return a == b


def test_value_shapes(spark):
    raw = spark.createDataFrame(raw_rows([p for p, _ in VALUE_CASES]), RAW_SCHEMA)
    got = {r["id"]: r["amount_usd"] for r in normalize(raw).select("id", "amount_usd").collect()}
    for i, (payload, want) in enumerate(VALUE_CASES):
        assert same(got[i], want), (payload, got[i], want)


def test_amount_uses_same_guard(spark):
    raw = spark.createDataFrame(raw_rows(['{"amount":"1d"}', '{"amount":"12.5"}', '{"amount":[3]}']), RAW_SCHEMA)
    got = [r["amount"] for r in normalize(raw).orderBy("id").collect()]
    assert got == [None, 12.5, None]


def test_fee(spark):
    raw = spark.createDataFrame(raw_rows([p for p, _ in FEE_CASES]), RAW_SCHEMA)
    got = {r["id"]: r["fee"] for r in normalize(raw).select("id", "fee").collect()}
    for i, (payload, want) in enumerate(FEE_CASES):
        assert same(got[i], want), (payload, got[i], want)


def test_strings_case_folding_and_service(spark):
    payload = ('{"call":{"chain":"Ethereum","returnValues":{"destinationChain":"ArbiTrum"},'
               '"transaction":{"from":"0xAbC"}},"symbol":"USDC"}')
    raw = spark.createDataFrame(raw_rows([payload]), RAW_SCHEMA)
    folded = normalize(raw).first()
    assert (folded.source_chain, folded.destination_chain) == ("ethereum", "arbitrum")
    assert folded.user_address == "0xAbC"          # addresses keep their case
    assert folded.raw_asset == "USDC" and folded.service == "GMP"
    kept = normalize(raw, fold_case=False, service="X").first()
    assert (kept.source_chain, kept.destination_chain, kept.service) == ("Ethereum", "ArbiTrum", "X")


def test_success_filter(spark):
    rows = [
        (1, None, "executed", "received", "{}"),
        (2, None, "executed", "failed", "{}"),
        (3, None, "error", "received", "{}"),
        (4, None, None, None, "{}"),
    ]
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    assert [r.id for r in normalize(raw).collect()] == [1]


def test_created_date(spark):
    from datetime import date, datetime
    rows = raw_rows(["{}"], created_at=datetime(2023, 12, 31, 23, 59, 59, 999999))
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    assert normalize(raw).first().created_date == date(2023, 12, 31)


def test_json_parsed_once_per_row(spark, capsys):
    raw = spark.createDataFrame(raw_rows(['{"value":1}']), RAW_SCHEMA)
    df = normalize(raw)
    df.explain()
    plan = capsys.readouterr().out
    assert plan.count("from_json(") == 1
    assert df.select(F.col("amount_usd")).first()[0] == 1.0


def test_variant_payload_same_as_json_text(spark):
    from tests.edge_rows import FEE_CASES, VALUE_CASES
    payloads = [p for p, _ in VALUE_CASES] + [p for p, _ in FEE_CASES]
    raw = spark.createDataFrame(raw_rows(payloads), RAW_SCHEMA)
    as_variant = raw.withColumn("data", F.try_parse_json("data"))
    a = {r.id: r for r in normalize(raw).collect()}
    b = {r.id: r for r in normalize(as_variant).collect()}
    assert set(a) == set(b)
    for i in a:
        for col in ("user_address", "source_chain", "destination_chain", "raw_asset"):
            assert a[i][col] == b[i][col], (payloads[i], col)
        for col in ("amount", "amount_usd", "fee"):
            assert same(b[i][col], a[i][col]), (payloads[i], col, a[i][col], b[i][col])


def test_variant_events_fact(spark):
    from routeboard.sources.envelope import events_fact
    from tests.conftest import SF_SMALL
    raw = events_fact(spark, SF_SMALL)
    text = normalize(raw, fold_case=False)
    variant = normalize(raw.withColumn("data", F.parse_json("data")), fold_case=False)
    assert variant.count() == text.count()
    assert variant.exceptAll(text).count() == 0


def test_instant_created_at_read_as_utc_whatever_the_session_zone(spark):
    from datetime import date, datetime
    rows = raw_rows(['{"value":1}'], created_at=datetime(2024, 1, 1, 3, 0))   # 03:00 UTC on 1 Jan
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        instant = spark.createDataFrame(rows, RAW_SCHEMA).withColumn(
            "created_at", F.col("created_at").cast("timestamp"))
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")   # 19:00 on 31 Dec there
        r = normalize(instant).select("created_at", "created_date", F.hour("created_at").alias("h")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (r.created_at, r.created_date, r.h) == (datetime(2024, 1, 1, 3, 0), date(2024, 1, 1), 3)


@pytest.mark.parametrize("name", ["p_priced", "r15_source_destination_events", "r14_route_profile_events"])
def test_one_parse_whatever_the_filter(spark, name):
    from routeboard.plans.catalog import QUERIES
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("Relation [")
    assert scans == 1 or name.startswith("r14")      # R14's cells stand in the plan once for each reader, and run once
    assert plan.count("from_json") == scans


def test_stored_filters_go_below_the_parse(spark):
    path = scratch_path(spark, "fact")
    events_fact(spark, SF_SMALL).write.parquet(path)
    df = in_range(normalize(spark.read.parquet(path)), ReportParams(date(2024, 1, 10), date(2024, 1, 12), "day"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("\n")[0]
    assert "created_at" in pushed and "EqualTo(status,executed)" in pushed
