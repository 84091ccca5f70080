"""Raw transfer fact with a JSON payload, derived from the ``events`` table.

The payload deliberately carries every shape the normaliser must cope with:
numbers, numeric strings, junk strings, booleans, JSON null, arrays and
objects, on a rotation keyed by ``event_id``.  Building it is one narrow
projection over the scan (string concatenation, no shuffle), so its cost grows
linearly with ``events``.

Column rules (``n`` = ``event_id``):

* ``id`` = ``event_id``, ``created_at`` = ``ts``
* ``status`` = ``'error'`` for ``event_type = 'error'`` else ``'executed'``
* ``simplified_status`` = ``'failed'`` when ``n % 11 = 0`` else ``'received'``
* ``call.chain`` = ``initcap(event_type)``; ``call.returnValues.destinationChain``
  = ``'Chain-' || user_id % 7``; ``call.transaction.from`` = ``'0x' || user_id``
* ``symbol`` = ``'T' || user_id % 5``
* ``value`` by ``n % 10``: 0 array, 1 object, 2 numeric string, 3 null, 4 ``"n/a"``,
  5 ``true``, otherwise the number ``value``; ``amount`` the same on ``(n + 5) % 10``
* ``gas.gas_used_amount`` an object when ``n % 3 = 0`` else the number ``value``;
  ``gas_price_rate.source_token.token_price.usd`` the string ``"2.5"``
* ``fees.express_fee_usd`` ``[]`` when ``n % 5 = 0`` else ``0.25``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _q(c: Column) -> Column:
    """JSON string literal of a plain word/number column (no escaping needed here)."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def _rotating_number(slot: Column, number: Column) -> Column:
    """JSON text of one numeric leaf, whose shape rotates with ``slot`` (0..9)."""
    text = number.cast("string")
    return (
        F.when(slot == 0, F.lit("[1,2]"))
        .when(slot == 1, F.lit('{"hex":"0x1"}'))
        .when(slot == 2, _q(text))
        .when(slot == 3, F.lit("null"))
        .when(slot == 4, F.lit('"n/a"'))
        .when(slot == 5, F.lit("true"))
        .otherwise(text)
    )


def events_payload(events: DataFrame) -> Column:
    n = F.col("event_id")
    value = F.col("value")
    user = F.col("user_id")
    call = F.concat(
        F.lit('{"chain":'), _q(F.initcap(F.col("event_type"))),
        F.lit(',"returnValues":{"destinationChain":'), _q(F.concat(F.lit("Chain-"), (user % 7).cast("string"))),
        F.lit('},"transaction":{"from":'), _q(F.concat(F.lit("0x"), user.cast("string"))),
        F.lit("}}"),
    )
    gas_used = F.when(n % 3 == 0, F.lit('{"units":1}')).otherwise(value.cast("string"))
    express = F.when(n % 5 == 0, F.lit("[]")).otherwise(F.lit("0.25"))
    return F.concat(
        F.lit('{"call":'), call,
        F.lit(',"amount":'), _rotating_number((n + 5) % 10, value),
        F.lit(',"value":'), _rotating_number(n % 10, value),
        F.lit(',"gas":{"gas_used_amount":'), gas_used,
        F.lit('},"gas_price_rate":{"source_token":{"token_price":{"usd":"2.5"}}}'),
        F.lit(',"fees":{"express_fee_usd":'), express,
        F.lit('},"symbol":'), _q(F.concat(F.lit("T"), (user % 5).cast("string"))),
        F.lit("}"),
    )


def events_fact(spark: SparkSession, data_dir: str) -> DataFrame:
    """Raw fact (``id, created_at, status, simplified_status, data``) over ``events``."""
    ev = read_table(spark, data_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("executed")).alias("status"),
        F.when(F.col("event_id") % 11 == 0, F.lit("failed")).otherwise(F.lit("received")).alias("simplified_status"),
        events_payload(ev).alias("data"),
    )
