"""Schemas of the raw transfer fact, its JSON payload and the normalised relation."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw fact: one row per cross-chain call, payload kept as JSON text.
FACT_COLUMNS = ("id", "created_at", "status", "simplified_status", "data")

# Payload paths the reports read, every leaf declared STRING so that numbers,
# booleans and nested containers all arrive as their JSON text and are typed
# afterwards by ``strict_double``.  Only these paths are materialised; the
# rest of a document is skipped by the parser.
DATA_SCHEMA = T.StructType([
    T.StructField("call", T.StructType([
        T.StructField("chain", T.StringType()),
        T.StructField("returnValues", T.StructType([
            T.StructField("destinationChain", T.StringType()),
        ])),
        T.StructField("transaction", T.StructType([
            T.StructField("from", T.StringType()),
        ])),
    ])),
    T.StructField("amount", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("gas", T.StructType([
        T.StructField("gas_used_amount", T.StringType()),
    ])),
    T.StructField("gas_price_rate", T.StructType([
        T.StructField("source_token", T.StructType([
            T.StructField("token_price", T.StructType([
                T.StructField("usd", T.StringType()),
            ])),
        ])),
    ])),
    T.StructField("fees", T.StructType([
        T.StructField("express_fee_usd", T.StringType()),
    ])),
    T.StructField("symbol", T.StringType()),
])

# Normalised relation every report reads.
BASE_COLUMNS = (
    "created_at",        # timestamp_ntz, UTC wall time
    "created_date",      # date
    "id",                # distinct-counted key (may repeat)
    "user_address",      # sender
    "source_chain",      # as written in the payload unless folded
    "destination_chain",
    "service",
    "amount",            # token units, double
    "amount_usd",        # double
    "fee",               # double
    "raw_asset",         # token symbol
)
