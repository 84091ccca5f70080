"""Distributed row numbers against a plain sort, with hot groups, ties, NULLs and empty tables."""

import pytest
from pyspark.sql import functions as F

from routeboard.operators.numbering import number_in_order
from routeboard.operators.reshape import number_rows


@pytest.fixture(scope="module")
def rows(spark):
    # a third of the rows in one group, a third of them all equal, NULL groups and values
    data = [("hot", 7, "same")] * 300 + [(None if i % 7 == 0 else f"g{i % 5}", None if i % 11 == 0 else i * 37 % 101, f"v{i}") for i in range(600)]
    return spark.createDataFrame(data, "g string, x int, _part string").repartition(7)


def order_of(x):
    return (x is None, x if x is not None else 0)


def test_global_numbers(rows):
    got = number_in_order(rows, [F.asc_nulls_last("x"), F.col("_part").asc()]).collect()
    assert sorted(r["row_number"] for r in got) == list(range(1, 901))
    by_number = sorted(got, key=lambda r: r["row_number"])
    keys = [(order_of(r["x"]), r["_part"]) for r in by_number]
    assert keys == sorted(keys)
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(str(tuple(r)) for r in rows.collect())


def test_numbers_in_groups(rows):
    got = number_in_order(rows, [F.asc_nulls_last("x")], by=["g"], out="n").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["n"], order_of(r["x"])))
    assert len(got) == 900 and None in groups
    for numbered in groups.values():
        numbered.sort()
        assert [n for n, _ in numbered] == list(range(1, len(numbered) + 1))
        assert [x for _, x in numbered] == sorted(x for _, x in numbered)


def test_empty_and_single(spark, rows):
    assert number_in_order(rows.limit(0), [F.asc("x")]).count() == 0
    assert number_in_order(rows.limit(0), [F.asc("x")], by=["g"]).count() == 0
    assert [r["row_number"] for r in number_in_order(spark.range(1), [F.asc("id")]).collect()] == [1]


def test_no_single_partition(rows):
    plan = number_rows(rows, [F.asc_nulls_last("x")])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
