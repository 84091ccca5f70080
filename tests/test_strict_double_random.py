"""strict_double on random number-like text, against a plain-Python statement of the rule:
the whole text (spaces aside) is a decimal or scientific number or a NaN/infinity word."""

import math
import random
import re

from routeboard.functions.numeric import NUMBER_PATTERN, strict_double

PIECES = ["0", "1", "7", "42", "3.5", ".", "e", "E", "+", "-", " ", "\t", "d", "f", "x", "0x", ",",
          "inf", "Infinity", "NaN", "nan", "abc", "true", "1e400", "_", "[", "]", "{}", '"']


def expected(s: str):
    if not re.fullmatch(NUMBER_PATTERN.strip("^$"), s):
        return None
    return float(s.strip())


def number_like(rnd: random.Random) -> str:
    """A well-formed number, sometimes with spaces, sign, exponent or a special word."""
    pick = rnd.choice
    if rnd.random() < 0.15:
        body = pick(["nan", "NaN", "inf", "INF", "Infinity", "infinity"])
    else:
        body = pick(["", "0", "12", "345"]) + pick(["", ".", ".5", ".25"]) or "7"
        body += pick(["", "", "e3", "E-2", "e+10", "e400"])
    return pick(["", " ", "\t"]) + pick(["", "", "+", "-"]) + body + pick(["", " ", "\t "])


def test_random_texts(spark):
    rnd = random.Random(20241203)
    texts = set()
    while len(texts) < 3000:
        if rnd.random() < 0.5:
            texts.add(number_like(rnd))
        else:
            texts.add("".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 5))))
    texts = sorted(texts)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.v for r in df.select("s", strict_double("s").alias("v")).collect()}
    numbers = 0
    for t in texts:
        want = expected(t)
        if want is None:
            assert got[t] is None, t
        elif math.isnan(want):
            assert got[t] is not None and math.isnan(got[t]), t
        else:
            numbers += 1
            assert got[t] == want, (t, got[t], want)
    assert numbers > 500          # the sample really exercises the numeric branch
