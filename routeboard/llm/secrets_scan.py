"""Secret scans in DataFrame operations only: patterns plus a battery of randomness tests.

Patterns give the spans ``assign``, ``access`` and ``hex``.  The battery looks
at long tokens that mix digits and letters and meet no pattern's span.  A
token's encoding is inferred from its characters (hexadecimal of either case,
base 36, base 62, base 64), which fixes an alphabet of k symbols, and three
tests of "uniformly random over this alphabet" follow:

* chi-squared uniformity of the symbol counts (k - 1 degrees of freedom),
* runs above and below the middle of the alphabet,
* serial correlation of neighbouring symbols.

The smallest of the three p-values times three is the token's battery p-value;
a token below ``LEAST_P`` (repetition, counting, a skewed alphabet) is no
secret, nor is one of less than ``MIN_BITS`` bits.

Words glued to a name, slug or path pass such tests when they are short, so
false secrets are controlled against what they really are.  The background is
a Markov chain over letter classes (vowel or consonant of either case, digit,
symbol): how vowels and consonants follow each other and how long words are is
counted over the whole corpus, how words are glued is fixed (``JOINS``).  The
likelihood ratio R of the uniform alphabet against the background has mean 1
under the background, so ``len(ALPHABETS) / R`` is a valid p-value of "this is
only glued words" at every length (Markov's inequality, over all encodings).
Benjamini-Hochberg on a grid of these p-values, separately in each length
class, keeps the expected share of such names among the added spans at
``RATE``; short tokens, which carry little evidence, do not borrow from long
ones.  Discoveries are the spans ``random``.

Positions are code points, ends exclusive.  NULL and empty texts have no
spans; repeated rows are scanned row by row.  A very long text is one row of
one task; its cost is linear in its length and, up to some 100,000, in its
matches.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8               # characters of the value
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABETS = (                  # encoding: what all characters match, and its symbols in order
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
LENGTHS = (24, 32, 48, 64, 128)  # upper ends of the length classes
MIN_BITS = 80
LEAST_P = 0.01                 # of the battery
RATE = 0.05                    # false-discovery rate
BINS, BINS_A_DECADE = 400, 20  # grid of p-values: 10 ** -(bin / 20)

#: letter classes: code, symbols
CLASSES = (("v", "aeiou"), ("c", "bcdfghjklmnpqrstvwxyz"), ("V", "AEIOU"), ("C", "BCDFGHJKLMNPQRSTVWXYZ"), ("0", "0123456789"), ("-", "+/-_"))
#: how names go on after a word in lower case, one in upper case, a digit and a symbol, and how they begin: (lower, upper, digit, symbol)
JOINS = {"lower": (0.25, 0.25, 0.2, 0.3), "upper": (0.1, 0.2, 0.3, 0.4), "digit": (0.12, 0.13, 0.6, 0.15),
         "symbol": (0.5, 0.2, 0.15, 0.15), "start": (0.45, 0.35, 0.1, 0.1)}
UPPER_STAYS = 0.5              # inside a word, that a capital is followed by another
#: letters of a text known before any is counted: vowel or consonant (v, c) by what follows, $ the word's end
PRIOR = {"vv": 40, "vc": 260, "cv": 260, "cc": 240, "v$": 80, "c$": 120}
_FOLLOWED = {"v": "(?i)[aeiou]", "c": "(?i)[b-df-hj-np-tv-z]", "$": "(?![A-Za-z])"}
_CHUNK = 128                   # matches whose places are folded together

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _sql(text: str) -> str:
    """A regular expression as a Spark SQL string literal."""
    return "r'" + text.replace("'", r"\x27") + "'"


def _spans(pattern: str, kind: int) -> str:
    """SQL for (start, kind, end, word) of ``pattern``'s leftmost non-overlapping matches in ``text``.

    One fold over the matches carries the place; the lengths of the pieces
    between them move it on.  Matches are folded ``_CHUNK`` at a time, so
    appending a span copies few others.
    """
    p = _sql(pattern)
    item = "struct<start:int,kind:int,end:int,word:string>"
    return f"""
    CASE WHEN text RLIKE {p} THEN
      aggregate(
        transform(array(struct(regexp_extract_all(text, {p}, 0) AS found, split(text, {p}, -1) AS pieces)), s ->
          transform(sequence(0, (size(s.found) - 1) div {_CHUNK}), g ->
            zip_with(slice(s.found, g * {_CHUNK} + 1, {_CHUNK}), slice(s.pieces, g * {_CHUNK} + 1, least({_CHUNK}, size(s.found) - g * {_CHUNK})),
                     (m, gap) -> struct(length(gap) AS gap, length(m) AS n, m AS word))))[0],
        struct(0 AS at, CAST(array() AS array<array<{item}>>) AS done),
        (a, chunk) -> aggregate(chunk, struct(a.at AS at, CAST(array() AS array<{item}>) AS done),
          (b, x) -> struct(b.at + x.gap + x.n AS at, concat(b.done, array(
            struct(b.at + x.gap AS start, {kind} AS kind, b.at + x.gap + x.n AS end, x.word AS word))) AS done),
          b -> struct(b.at AS at, concat(a.done, array(b.done)) AS done)),
        a -> flatten(a.done))
    END"""


def _bare(spans: str) -> str:
    return f"coalesce(transform({spans}, s -> struct(s.start AS start, s.kind AS kind, s.end AS end)), CAST(array() AS {_SPAN}))"


# the value of an assignment is the match's second half: what follows the separator and a quote
_BASE = f"""
array_sort(concat(
  {_bare(f"filter({_spans(ASSIGN, 0)}, s -> length(regexp_extract(s.word, {_sql(ASSIGN)}, 1)) >= {ASSIGN_LEAST})")},
  {_bare(_spans(ACCESS, 1))},
  {_bare(_spans(HEX, 2))}))"""


def _tail(z: str) -> str:
    """SQL for P(N > z) of a standard normal N: a polynomial times the density (error below 1e-7)."""
    t = f"(1.0D / (1.0D + 0.2316419D * abs({z})))"
    upper = (f"exp(-({z}) * ({z}) / 2) / 2.5066282746310002D * {t} * (0.319381530D + {t} * (-0.356563782D + {t} * "
             f"(1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))")
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END)"


_ENCODING = "CASE " + " ".join(f"WHEN c.word RLIKE '{p}' THEN '{e}'" for e, p, _ in ALPHABETS[:-1]) + f" ELSE '{ALPHABETS[-1][0]}' END"
_SYMBOLS = "element_at(map(" + ", ".join(f"'{e}', '{a}'" for e, _, a in ALPHABETS) + "), c.encoding)"
_CLASS = "translate(c.word, '" + "".join(a for _, a in CLASSES) + "', '" + "".join(g * len(a) for g, a in CLASSES) + "')"

#: SQL steps from a candidate c (with its word) to its tests; each step's fields are made of the one before
_STEPS = (
    f"struct(c.start, c.kind, c.end, c.word, split({_CLASS}, '') AS classes, {_ENCODING} AS encoding)",
    f"struct(c.start, c.kind, c.end, c.word, c.classes, c.encoding, {_SYMBOLS} AS alphabet)",
    """struct(c.start, c.kind, c.end, c.classes, c.encoding, CAST(length(c.word) AS DOUBLE) AS n, CAST(length(c.alphabet) AS DOUBLE) AS k,
       transform(split(c.word, ''), x -> CAST(locate(x, c.alphabet) - 1 AS DOUBLE)) AS at)""",
    """struct(c.start, c.kind, c.end, c.classes, c.encoding, c.n, c.k, c.at, aggregate(c.at, 0D, (t, x) -> t + x) / c.n AS mean,
       slice(c.at, 1, size(c.at) - 1) AS this, slice(c.at, 2, size(c.at) - 1) AS next,
       CAST(size(filter(c.at, x -> x >= c.k / 2)) AS DOUBLE) AS high,
       aggregate(array_distinct(c.at), 0D, (t, x) -> t + pow(size(filter(c.at, y -> y = x)), 2)) AS squares)""",
    """struct(c.start, c.kind, c.end, c.classes, c.encoding, c.n, c.k, c.k / c.n * c.squares - c.n AS chi, 2 * c.high * (c.n - c.high) / c.n + 1 AS mu,
       aggregate(zip_with(c.this, c.next, (x, y) -> IF((x >= c.k / 2) = (y >= c.k / 2), 0D, 1D)), 1D, (t, x) -> t + x) AS runs,
       aggregate(zip_with(c.this, c.next, (x, y) -> (x - c.mean) * (y - c.mean)), 0D, (t, x) -> t + x) AS lagged,
       aggregate(c.at, 0D, (t, x) -> t + pow(x - c.mean, 2)) AS spread)""",
    """struct(c.start, c.kind, c.end, c.classes, c.encoding, c.n, c.k,
       (pow(greatest(c.chi, 0D) / (c.k - 1), 1 / 3D) - 1 + 2 / (9 * (c.k - 1))) / sqrt(2 / (9 * (c.k - 1))) AS z_chi,
       IF(c.mu > 2, abs(c.runs - c.mu) / sqrt((c.mu - 1) * (c.mu - 2) / (c.n - 1)), 30D) AS z_runs,
       IF(c.spread > 0, abs(c.lagged / c.spread + 1 / c.n) * sqrt(c.n), 30D) AS z_serial)""",
    f"""struct(c.start, c.kind, c.end, c.classes, c.encoding, c.n, c.k,
       least(1D, 3 * least({_tail("c.z_chi")}, 2 * {_tail("c.z_runs")}, 2 * {_tail("c.z_serial")})) AS p)""",
)


def background(df: DataFrame, text: str = "text") -> dict[str, dict[str, float]]:
    """How glued words run over letter classes: per class code (and ``start``) the probabilities of the next one's.

    One aggregation of six counts over all texts, added to ``PRIOR``.
    """
    found = df.select(*[F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit(_FOLLOWED[a] + (_FOLLOWED[b] if b == "$" else f"(?={_FOLLOWED[b]})")))),
                                   F.lit(0)).alias(a + b) for a, b in PRIOR]).first()
    n = {pair: found[pair] + known for pair, known in PRIOR.items()}
    letters = {a: n[a + "v"] + n[a + "c"] + n[a + "$"] for a in "vc"}
    share = {a: letters[a] / sum(letters.values()) for a in "vc"}

    def joined(after: str, weight: float = 1.0) -> dict[str, float]:
        lower, upper, digit, symbol = (weight * x for x in JOINS[after])
        return {"v": lower * share["v"], "c": lower * share["c"], "V": upper * share["v"], "C": upper * share["c"], "0": digit, "-": symbol}

    out = {"start": joined("start"), "0": joined("digit"), "-": joined("symbol")}
    for a in "vc":
        for case, stays in (("lower", 0.0), ("upper", UPPER_STAYS)):
            row = joined(case, n[a + "$"] / letters[a])
            for b in "vc":
                row[b] += (1 - stays) * n[a + b] / letters[a]
                row[b.upper()] += stays * n[a + b] / letters[a]
            out[a if case == "lower" else a.upper()] = row
    return out


def _evidence(model: dict[str, dict[str, float]]) -> str:
    """SQL for the log-likelihood ratio of candidate c, uniform over its alphabet against the background."""
    uniform = {e + g: sum(x in a for x in symbols) / len(a) for e, _, a in ALPHABETS for g, symbols in CLASSES}
    uniform = ", ".join(f"'{key}', {log(p)!r}D" for key, p in uniform.items() if p)
    start = ", ".join(f"'{g}', {log(p)!r}D" for g, p in model["start"].items())
    moves = ", ".join(f"'{a}{b}', {log(p)!r}D" for a in model if a != "start" for b, p in model[a].items())
    return f"""(aggregate(c.classes, 0D, (t, x) -> t + element_at(map({uniform}), concat(c.encoding, x))) - element_at(map({start}), c.classes[0])
       - aggregate(zip_with(slice(c.classes, 1, size(c.classes) - 1), slice(c.classes, 2, size(c.classes) - 1), (x, y) -> concat(x, y)), 0D,
                   (t, x) -> t + element_at(map({moves}), x)))"""


def _candidates(model: dict[str, dict[str, float]]) -> str:
    """SQL for the tokens that meet no span of ``base`` (in chunks, whose reach is compared first), with their tests."""
    out = f"""transform(array(transform(filter(transform(sequence(0, size(base) div {_CHUNK}), g -> slice(base, g * {_CHUNK} + 1, {_CHUNK})), p -> size(p) > 0),
        p -> struct(p AS spans, p[0].start AS low, array_max(transform(p, s -> s.end)) AS high))), parts ->
      filter({_spans(TOKEN, 3)}, c -> c.word RLIKE '[0-9]' AND c.word RLIKE '[A-Za-z]' AND NOT exists(parts,
        p -> p.low < c.end AND c.start < p.high AND exists(p.spans, b -> b.start < c.end AND c.start < b.end))))[0]"""
    for step in _STEPS:
        out = f"transform({out}, c -> {step})"
    out = f"transform({out}, c -> struct(c.start, c.kind, c.end, c.n, c.n * log2(c.k) AS bits, c.p, {log(len(ALPHABETS))!r}D - {_evidence(model)} AS log_p))"
    tested = f"c.p >= {LEAST_P}D AND c.bits >= {MIN_BITS}"
    return f"""transform({out}, c -> struct(c.start AS start, c.kind AS kind, c.end AS end, c.p AS p, c.log_p AS log_p,
      IF({tested}, CAST(least({BINS}, greatest(0, floor(-c.log_p / {log(10)!r}D * {BINS_A_DECADE}))) AS INT), 0) AS bin,
      {" + ".join(f"IF(c.n > {x}, 1, 0)" for x in LENGTHS)} AS length_class))"""


def _judged(df: DataFrame, text: str, model: dict[str, dict[str, float]]) -> DataFrame:
    rows = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("base", F.expr(_BASE)).withColumn("candidates", F.expr(_candidates(model)))


def false_discovery_edges(df: DataFrame, text: str = "text", model: dict[str, dict[str, float]] | None = None) -> dict[int, int]:
    """Per length class the least bin whose tokens are discovered to be no glued words.

    One aggregation to at most ``BINS`` counts a class; the classes' few rows
    come to the driver.
    """
    # an outer explode: a plain one would be filtered by the size of the array first, which makes it twice
    counts = (_judged(df, text, model or background(df, text)).select(F.explode_outer("candidates").alias("c")).where("c IS NOT NULL")
              .groupBy("c.length_class", "c.bin").agg(F.count("*").alias("n")))
    by_class = Window.partitionBy("length_class")
    at_least = F.sum("n").over(by_class.orderBy(F.desc("bin")))
    discovered = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE) <= RATE * F.col("reach") / F.col("total")
    rows = (counts.withColumn("reach", at_least).withColumn("total", F.sum("n").over(by_class)).where(discovered)
            .groupBy("length_class").agg(F.min("bin").alias("edge")).collect())
    return {r["length_class"]: r["edge"] for r in rows}


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """(row, text, base, spans): the input row as a struct, its text, the patterns' spans and all spans.

    A span is (start, kind, end) with ``kind`` an index into ``KINDS``; spans
    are sorted by start, then kind.
    """
    model = background(df, text)
    edges = false_discovery_edges(df, text, model)
    if not edges:   # no token anywhere is discovered
        return (df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
                .withColumn("base", F.expr(_BASE)).withColumn("spans", F.col("base")))
    edge = "CASE " + " ".join(f"WHEN c.length_class = {k} THEN {b}" for k, b in sorted(edges.items())) + f" ELSE {BINS + 1} END"
    added = _bare(f"filter(candidates, c -> c.bin >= {edge})")
    return _judged(df, text, model).select("row", "text", "base", F.expr(f"array_sort(concat(base, {added}))").alias("spans"))


def span_list(spans: str) -> str:
    """SQL for spans as text: kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"concat_ws(',', transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)))"


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span (overlapping ones as one) in ``text`` replaced by ``mark``; a NULL text stays NULL."""
    cleaned = F.expr(f"""
      aggregate(spans, struct('' AS done, 0 AS at), (a, s) -> IF(s.start < a.at,
          struct(a.done AS done, greatest(a.at, s.end) AS at),
          struct(concat(a.done, substring(text, a.at + 1, s.start - a.at), '{mark}') AS done, s.end AS at)),
        a -> concat(a.done, substring(text, a.at + 1)))""")
    kept = F.when(F.col(f"row.{text}").isNull() | (F.size("spans") == 0), F.col(f"row.{text}")).otherwise(cleaned)
    return find_secrets(df, text).select(*[kept.alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns])
