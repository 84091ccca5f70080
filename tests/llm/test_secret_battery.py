"""The randomness battery and its false-discovery control, recomputed in plain Python."""

import math
import random
import string
import time

import pytest
from pyspark.sql import functions as F

from routeboard.llm import secrets_scan as scan

WORDS = ("abstract factory bean manager session handler request response context default service provider builder internal "
         "message queue listener adapter config parser stream cache index value object").split()
ALPHANUMERIC = string.ascii_letters + string.digits


def planted(n=60):
    """Rows (id, text, kind): random keys of every alphabet, and names that are none."""
    rng = random.Random(5)
    pick = lambda k: [rng.choice(WORDS) for _ in range(k)]
    of = lambda symbols, k: "".join(rng.choice(symbols) for _ in range(k))
    makers = {"key62": lambda: of(ALPHANUMERIC, 32), "key64": lambda: of(ALPHANUMERIC + "+/", 40),
              "key36": lambda: of(string.ascii_lowercase + string.digits, 31), "KEY36": lambda: of(string.ascii_uppercase + string.digits, 31),
              "HEX": lambda: of("0123456789ABCDEF", 48), "hex": lambda: of("0123456789abcdef", 30),
              "camel": lambda: "".join(w.title() for w in pick(4)) + str(rng.randint(1, 99)),
              "slug": lambda: "-".join(pick(5)) + f"-{rng.randint(1, 2025)}", "path": lambda: "/".join(pick(5)) + f"/v{rng.randint(1, 30)}",
              "constant": lambda: "_".join(pick(4)).upper() + f"_{rng.randint(1, 9)}",
              "stamp": lambda: f"2024-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-00Z",
              "again": lambda: f"abc{rng.randint(1, 9)}" * 12}
    rows = [(kind, f"see {make()} here") for kind, make in makers.items() for _ in range(n)]
    return [(i, text, kind) for i, (kind, text) in enumerate(rows)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(planted(), "doc_id long, text string, kind string").repartition(3).cache()


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def class_of(x):
    return next(g for g, symbols in scan.CLASSES if x in symbols)


def by_hand(token, model):
    """(battery p, log p of the background) of a token."""
    alphabet = next(set(a) and a for e, _, a in scan.ALPHABETS if e == "base64" or set(token) <= set(a))
    n, k, at = len(token), len(alphabet), [alphabet.index(x) for x in token]
    chi = sum((at.count(s) - n / k) ** 2 / (n / k) for s in range(k))
    spread = 2 / (9 * (k - 1))
    z_chi = ((chi / (k - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread)
    above = [x >= k / 2 for x in at]
    runs, high = 1 + sum(a != b for a, b in zip(above, above[1:], strict=False)), sum(above)
    mu = 2 * high * (n - high) / n + 1
    z_runs = abs(runs - mu) / math.sqrt((mu - 1) * (mu - 2) / (n - 1)) if mu > 2 else 30
    mean = sum(at) / n
    lagged = sum((x - mean) * (y - mean) for x, y in zip(at, at[1:], strict=False)) / sum((x - mean) ** 2 for x in at)
    z_serial = abs(lagged + 1 / n) * math.sqrt(n)
    p = min(1, 3 * min(tail(z_chi), 2 * tail(z_runs), 2 * tail(z_serial)))
    classes = [class_of(x) for x in token]
    ratio = sum(math.log(sum(class_of(y) == g for y in alphabet) / k) for g in classes) - math.log(model["start"][classes[0]])
    ratio -= sum(math.log(model[a][b]) for a, b in zip(classes, classes[1:], strict=False))
    return p, math.log(len(scan.ALPHABETS)) - ratio


def test_p_values(table):
    model = scan.background(table)
    assert all(sum(row.values()) == pytest.approx(1) for row in model.values())
    found = {r["doc_id"]: r["candidates"] for r in scan._judged(table, "text", model).select("row.doc_id", "candidates").collect()}
    checked = 0
    for i, text, _ in planted():
        for c in found[i] or ():
            p, log_p = by_hand(text[c["start"]:c["end"]], model)
            assert c["p"] == pytest.approx(p, abs=2e-6) and c["log_p"] == pytest.approx(log_p, abs=1e-6)
            checked += 1
    assert checked > 500


def test_background_counts(spark):
    texts = ["the Apple, tea", None, "", "ÉA b1"]
    n = dict(scan.PRIOR)
    for t in texts:
        for k, x in enumerate(t or ""):
            if x in string.ascii_letters:
                after = (t + " ")[k + 1]
                n[("v" if x in "aeiouAEIOU" else "c") + ("$" if after not in string.ascii_letters else "v" if after in "aeiouAEIOU" else "c")] += 1
    model = scan.background(spark.createDataFrame([(t,) for t in texts], "text string"))
    ends = n["v$"] / (n["vv"] + n["vc"] + n["v$"])
    assert model["v"]["0"] == pytest.approx(ends * scan.JOINS["lower"][2])
    assert model["v"]["c"] + model["v"]["v"] == pytest.approx(1 - ends + ends * scan.JOINS["lower"][0])


def test_false_discovery_edges(table):
    """Benjamini-Hochberg by length class, over p-values rounded up to the grid."""
    classes = {}
    for r in scan._judged(table, "text", scan.background(table)).select(F.explode("candidates").alias("c")).select("c.*").collect():
        assert r["bin"] == 0 or 10 ** (-r["bin"] / scan.BINS_A_DECADE) >= math.exp(r["log_p"]) * (1 - 1e-9) or r["bin"] == scan.BINS
        classes.setdefault(r["length_class"], []).append(10 ** (-r["bin"] / scan.BINS_A_DECADE))
    want = {}
    for name, ps in classes.items():
        ps.sort()
        passing = [p for k, p in enumerate(ps) if p <= scan.RATE * sum(q <= p for q in ps) / len(ps)]
        if passing:
            want[name] = round(-math.log10(max(passing)) * scan.BINS_A_DECADE)
    assert scan.false_discovery_edges(table) == want and len(want) >= 2


def test_keys_against_names(table):
    """Random keys of every alphabet are found; names, slugs, paths, time stamps and repetitions stay."""
    added, total = {}, {}
    for r in scan.find_secrets(table).collect():
        kind = r["row"]["kind"]
        total[kind] = total.get(kind, 0) + 1
        added[kind] = added.get(kind, 0) + any(s["kind"] == 3 for s in r["spans"])
    keys = {k for k in total if k.lower() in ("key62", "key64", "key36", "hex")}
    assert len(keys) == 6 and all(added[k] >= 0.9 * total[k] for k in keys), added
    false = sum(added[k] for k in total if k not in keys)
    assert false <= scan.RATE * sum(added.values()), added


def test_tokens_at_pattern_spans(spark):
    """A token that meets a pattern's span is no span of its own, however many spans there are."""
    rng = random.Random(2)
    key = lambda n, symbols=ALPHANUMERIC: "".join(rng.choice(symbols) for _ in range(n))
    parts = [f"password={key(24)} {key(33)} {key(32, '0123456789abcdef')}" for _ in range(300)]
    row = scan.find_secrets(spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")).first()
    base = [tuple(s) for s in row["base"]]
    added = [tuple(s) for s in row["spans"] if s["kind"] == 3]
    assert sum(k == 0 for _, k, _ in base) == 300 and sum(k == 2 for _, k, _ in base) >= 300
    assert len(added) >= 285 and not any(a < e and s < b for s, _, e in added for a, _, b in base)
    assert all(e - s == 33 for s, _, e in added)


def test_many_matches_in_one_text(spark):
    """The places of matches cost no more each in a text with many."""
    rng = random.Random(3)
    spent = {}
    for n in (1000, 1000, 8000):
        text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(n))
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        started = time.perf_counter()
        row = scan.find_secrets(rows).first()
        spent[n] = time.perf_counter() - started
        assert [tuple(s) for s in row["base"]] == [(33 * k, 2, 33 * k + 32) for k in range(n)] == [tuple(s) for s in row["spans"]]
    assert spent[8000] <= 8 * spent[1000]
