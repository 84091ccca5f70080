"""Raw fact -> normalised transfer relation (one definition shared by all reports)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import strict_double
from ..sources.schema import DATA_SCHEMA

# The status pair that marks a successful transfer, and the
# service tag stamped on every normalised row.
SUCCESS_STATUS = "executed"
SUCCESS_SIMPLIFIED_STATUS = "received"
SERVICE_TAG = "GMP"


def success_filter() -> Column:
    """Successful transfers: executed and received."""
    return (F.col("status") == SUCCESS_STATUS) & (F.col("simplified_status") == SUCCESS_SIMPLIFIED_STATUS)


def fold(c: Column, fold_case: bool) -> Column:
    return F.lower(c) if fold_case else c


def utc_wall_time(ts: str) -> Column:
    """A ``TIMESTAMP`` instant as its UTC wall time (``TIMESTAMP_NTZ``).

    Epoch microseconds added to the NTZ epoch: plain arithmetic, so the
    result does not depend on ``spark.sql.session.timeZone``.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(ts)), epoch)


_UTC_ZONES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00", "Zulu"}


def _event_time(fact: DataFrame) -> tuple[Column, Column]:
    """``(created_at, created_date)`` as UTC wall time and date.

    ``TIMESTAMP_NTZ`` already is wall time.  A ``TIMESTAMP`` instant read in a
    UTC session is cast, and its date taken from the instant itself, so a date
    range still reaches the scan as a timestamp range; in any other session
    zone the instant is converted arithmetically (``utc_wall_time``).
    """
    if not isinstance(fact.schema["created_at"].dataType, T.TimestampType):
        return F.col("created_at"), F.to_date("created_at")
    zone = fact.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone in _UTC_ZONES:
        return F.col("created_at").cast("timestamp_ntz"), F.to_date("created_at")
    wall = utc_wall_time("created_at")
    return wall, F.to_date(wall)


# Payload path of every leaf the reports read.
PATHS = {
    "chain": "call.chain",
    "destination": "call.returnValues.destinationChain",
    "sender": "call.transaction.from",
    "amount": "amount",
    "value": "value",
    "gas_used": "gas.gas_used_amount",
    "token_usd": "gas_price_rate.source_token.token_price.usd",
    "express_fee": "fees.express_fee_usd",
    "symbol": "symbol",
}


def normalize(fact: DataFrame, fold_case: bool = True, service: str = SERVICE_TAG) -> DataFrame:
    """Successful transfers with payload fields extracted and typed.

    ``fact`` has ``id, created_at, status, simplified_status, data``.
    ``created_at`` is either a ``TIMESTAMP_NTZ`` holding UTC wall time, or a
    ``TIMESTAMP`` (an instant), which is turned into its UTC wall time whatever
    the session time zone (``utc_wall_time``).  The
    status filter runs before the payload is read, and is pushed into the scan
    when the statuses are stored columns.  ``data`` may be

    * JSON text: parsed once per row with ``from_json`` against ``DATA_SCHEMA``,
      whatever filter or projection follows (every leaf reads the same parsed
      struct, which is a generated column that Catalyst does not repeat; it is
      made even where no leaf is read), or
    * a ``VARIANT`` column: each leaf is read straight from the binary value
      with ``try_variant_get(..., 'string')``.

    Either way a leaf arrives as text -- numbers, booleans and containers as
    their JSON text -- and numbers are typed by ``strict_double``, so JSON
    ``true`` never becomes 1.0.  A missing path, a malformed document or a
    scalar where an object is expected all give NULL leaves.

    ``fold_case`` lower-cases the chain names.  The shared dashboard base keeps
    them as written (``fold_case=False``) and each report folds where the
    dashboard does.
    """
    rows = fact.where(success_filter())
    created_at, created_date = _event_time(fact)
    if isinstance(fact.schema["data"].dataType, T.VariantType):
        rows = rows.select("created_at", "id", F.col("data").alias("d"))

        def leaf(name: str) -> Column:
            return F.try_variant_get(F.col("d"), "$." + PATHS[name], "string")
    else:
        # a generated column is not inlined: filters on leaves stay above the parse, those on stored columns go below
        rows = rows.select("created_at", "id", F.explode(F.array(F.from_json("data", DATA_SCHEMA))).alias("d"))

        def leaf(name: str) -> Column:
            c = F.col("d")
            for part in PATHS[name].split("."):
                c = c.getField(part)
            return c

    return rows.select(
        created_at.alias("created_at"),
        created_date.alias("created_date"),
        F.col("id"),
        leaf("sender").alias("user_address"),
        fold(leaf("chain"), fold_case).alias("source_chain"),
        fold(leaf("destination"), fold_case).alias("destination_chain"),
        F.lit(service).alias("service"),
        strict_double(leaf("amount")).alias("amount"),
        strict_double(leaf("value")).alias("amount_usd"),
        F.coalesce(strict_double(leaf("gas_used")) * strict_double(leaf("token_usd")),
                   strict_double(leaf("express_fee"))).alias("fee"),
        leaf("symbol").alias("raw_asset"),
    )
