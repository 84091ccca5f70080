"""The raw fact's contract: by path, by catalog name, and every way a table can miss it."""

import pytest
from pyspark.sql import functions as F

from routeboard.operators.normalize import normalize
from routeboard.sources.envelope import events_fact
from routeboard.sources.schema import FACT_COLUMNS
from routeboard.sources.storage import scratch_path
from routeboard.sources.tables import FactContractError, conform_fact, read_fact
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "fact")
    events_fact(spark, SF_SMALL).withColumn("loaded_by", F.lit("job 7")).write.parquet(path)
    return path


def ordered(df):
    return sorted(map(str, df.collect()))


def test_by_path_and_by_name_normalise_alike(spark, stored):
    want = ordered(normalize(events_fact(spark, SF_SMALL)))
    by_path = read_fact(spark, stored)
    assert tuple(by_path.columns) == FACT_COLUMNS
    assert ordered(normalize(by_path)) == want
    spark.read.parquet(stored).createOrReplaceTempView("stored_fact")
    assert ordered(normalize(read_fact(spark, "stored_fact", fmt=None))) == want


def test_further_columns_are_not_scanned(spark, stored):
    plan = normalize(read_fact(spark, stored))._jdf.queryExecution().executedPlan().toString()
    assert "loaded_by" not in plan
    with pytest.raises(FactContractError, match="unknown columns loaded_by"):
        read_fact(spark, stored, extra="error")
    with pytest.raises(ValueError):
        read_fact(spark, stored, extra="keep")


def test_all_problems_are_named_at_once(spark, stored):
    bad = spark.read.parquet(stored).drop("status").withColumn("created_at", F.col("created_at").cast("string")).withColumn("data", F.lit(1))
    with pytest.raises(FactContractError) as raised:
        conform_fact(bad, "bad")
    assert len(raised.value.problems) == 3
    assert "status is missing" in str(raised.value) and "created_at is string" in str(raised.value) and "data is int" in str(raised.value)


def test_repeated_and_differently_cased_names(spark, stored):
    df = spark.read.parquet(stored)
    assert conform_fact(df.withColumnRenamed("id", "ID")).count() == df.count()
    twice = df.select("*", F.col("id").alias("Id"))
    with pytest.raises(FactContractError, match="id is there 2 times"):
        conform_fact(twice)


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)", "binary"])
def test_ids_of_other_types(spark, kind):
    df = events_fact(spark, SF_SMALL).limit(5)
    ids = df.withColumn("id", F.col("id").cast("string").cast(kind) if kind == "binary" else F.col("id").cast(kind))
    assert read_fact(spark, ids).count() == 5


def test_variant_and_empty(spark):
    fact = events_fact(spark, SF_SMALL)
    assert read_fact(spark, fact.withColumn("data", F.parse_json("data"))).count() == fact.count()
    assert normalize(read_fact(spark, fact.limit(0))).count() == 0
