"""Hand-written raw transfer rows (one per edge case) with expected values."""

from datetime import datetime

NAN = float("nan")
INF = float("inf")


def doc(value_json=None, **parts):
    """A payload with a ``value`` leaf given as raw JSON text (None = key missing)."""
    fields = ['"call":{"chain":"Alpha","returnValues":{"destinationChain":"Beta"},"transaction":{"from":"0xU"}}']
    if value_json is not None:
        fields.append(f'"value":{value_json}')
    for k, v in parts.items():
        fields.append(f'"{k}":{v}')
    return "{" + ",".join(fields) + "}"


# (payload, expected amount_usd); value leaf shapes
VALUE_CASES = [
    (doc("1.5"), 1.5),
    (doc('"2.5"'), 2.5),
    (doc('"1e3"'), 1000.0),
    (doc('" 7 "'), 7.0),
    (doc('{"x":1}'), None),
    (doc("[1,2]"), None),
    (doc("true"), None),
    (doc("null"), None),
    (doc(None), None),
    (doc('""'), None),
    (doc('"abc"'), None),
    (doc('"1,000"'), None),
    (doc('"0x1F"'), None),
    (doc('"1d"'), None),
    (doc('"1f"'), None),
    (doc('"NaN"'), NAN),
    (doc('"inf"'), INF),
    (doc(None, VALUE="5"), None),
    ('{"value": 5', None),              # malformed document
    ("[1]", None),                      # top-level array
    ('{"call":3,"value":"x"}', None),   # call is a scalar
    (doc('"5."'), 5.0),
    (doc('".5"'), 0.5),
    (doc('"-Infinity"'), -INF),
    (doc('"1E+5"'), 100000.0),
    (doc('"."'), None),
    (doc('"1e"'), None),
]

GAS = '"gas":{"gas_used_amount":%s}'
PRICE = '"gas_price_rate":{"source_token":{"token_price":{"usd":%s}}}'
EXPRESS = '"fees":{"express_fee_usd":%s}'


def fee_doc(gas=None, price=None, express=None):
    parts = ['"call":{"chain":"a"}']
    if gas is not None:
        parts.append(GAS % gas)
    if price is not None:
        parts.append(PRICE % price)
    if express is not None:
        parts.append(EXPRESS % express)
    return "{" + ",".join(parts) + "}"


# (payload, expected fee)
FEE_CASES = [
    (fee_doc("4", '"2.5"', "0.25"), 10.0),         # both gas sides good
    (fee_doc('{"u":1}', '"2.5"', "0.25"), 0.25),   # gas side is an object
    (fee_doc("4", None, "0.25"), 0.25),            # price missing
    (fee_doc("[1]", '"2.5"', '"0.5"'), 0.5),       # gas array, express fee kept
    (fee_doc("[1]", '"2.5"', "{}"), None),         # both bad
    (fee_doc('"3"', "2", None), 6.0),              # numeric strings and numbers mix
]


def raw_rows(payloads, created_at=datetime(2024, 1, 10, 12, 0, 0)):
    return [(i, created_at, "executed", "received", p) for i, p in enumerate(payloads)]


RAW_SCHEMA = "id bigint, created_at timestamp_ntz, status string, simplified_status string, data string"
