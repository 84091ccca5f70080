"""Normalised transfer relation derived from the order/line-item star schema.

One transfer per line item: the order is the transfer id (several lines share
it), the ordering customer is the user, the customer's nation the source chain,
the supplier's nation the destination chain, the part brand the asset and the
extended price the USD value.  Order dates are moved forward by a fixed
number of days so that the history spans the dashboard's 2022-2026 quarters.

Join plan, written for a fact far larger than memory:

* every input is column-pruned to the keys and the one payload column it
  contributes, so the shuffles move narrow rows;
* ``orders`` meets ``customer`` first (the smaller pair), then ``lineitem`` joins
  that on the order key.  Both sides of that join grow with the data, so it is
  pinned to a sort-merge join (hint): without table statistics Spark sizes a
  join's output as the product of its inputs and would otherwise broadcast
  whichever fact file happens to fall under the threshold.  AQE splits skewed
  partitions of it (``spark.sql.adaptive.skewJoin.enabled``);
* ``customer``, ``supplier`` and ``part`` join by Spark's size check: broadcast
  while under ``spark.sql.autoBroadcastJoinThreshold``, sort-merge beyond it;
* nation keys travel as integers through the big joins and are resolved to
  names last, against the 25-row ``nation`` table, which falls under the
  broadcast threshold and so costs no shuffle.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import SERVICE_TAG
from ..params import ReportParams
from .tables import read_table

# Fixed value: days added to every order date (1995-01-01 becomes 2022-01-01).
DATE_SHIFT_DAYS = 9862


def order_lines_base(spark: SparkSession, data_dir: str, service: str = SERVICE_TAG,
                     window: ReportParams | None = None) -> DataFrame:
    """Normalised relation (``BASE_COLUMNS``), chains unfolded (nation names as stored).

    ``window`` keeps the transfers of its date range only.  The shifted date
    hides the stored one from the optimizer, so the range is moved back and
    filters ``o_orderdate`` itself, in the scan of ``orders``.
    """
    orders = read_table(spark, data_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if window is not None:
        shift = timedelta(days=DATE_SHIFT_DAYS)
        orders = orders.where((F.col("o_orderdate") >= F.lit(window.start - shift))
                              & (F.col("o_orderdate") < F.lit(window.end - shift + timedelta(days=1))))
    customer = read_table(spark, data_dir, "customer").select("c_custkey", "c_nationkey")
    lines = read_table(spark, data_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
    supplier = read_table(spark, data_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = read_table(spark, data_dir, "part").select("p_partkey", "p_brand")
    nation = read_table(spark, data_dir, "nation").select("n_nationkey", "n_name")

    customer_orders = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", "o_custkey", "o_orderdate", "c_nationkey")
    joined = (
        lines.join(customer_orders.hint("merge"), lines.l_orderkey == customer_orders.o_orderkey)
        .join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .join(part, lines.l_partkey == part.p_partkey)
    )
    src = nation.select(F.col("n_nationkey").alias("src_key"), F.col("n_name").alias("source_chain"))
    dst = nation.select(F.col("n_nationkey").alias("dst_key"), F.col("n_name").alias("destination_chain"))
    joined = (
        joined.join(src, joined.c_nationkey == src.src_key)
        .join(dst, joined.s_nationkey == dst.dst_key)
    )
    created_date = F.date_add(F.to_date("o_orderdate"), DATE_SHIFT_DAYS)
    return joined.select(
        created_date.cast("timestamp_ntz").alias("created_at"),
        created_date.alias("created_date"),
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("string").alias("user_address"),
        "source_chain",
        "destination_chain",
        F.lit(service).alias("service"),
        F.col("l_quantity").alias("amount"),
        F.col("l_extendedprice").alias("amount_usd"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
        F.col("p_brand").alias("raw_asset"),
    )
