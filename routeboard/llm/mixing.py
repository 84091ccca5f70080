"""Mixing sources to target weights, in DataFrame operations only.

Words are aggregated per source; water filling turns the weights into targets
(a source's target stops at ``MAX_RATE`` times its words, the excess goes to
the others by weight); target / words is the source's repetition rate.  A
document is taken floor(rate) times, plus once more if a hash of its id, read
as a fraction, is below the rate's fraction.  Rows that share an id draw on
their own: from the second on (in order of source and text) the row's place
among them is hashed too.  They alone are numbered, in range partitions, so an
id that holds a third of all rows is spread.

The aggregation combines map-side, so a hot source costs each task one row.
Rates have one row per source.  They are written before the documents join
them: Spark then knows their size when it plans, sends a small table to every
task, and whole documents are not shuffled.  Rates too many to broadcast are
shuffled with the documents, a hot source split by AQE's skew join.  NULL and
empty texts have no words, NULL is a source of its own (last in order).  Draws
depend on ids, sources and texts alone, so reruns agree; rows equal in all
three are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeboard.llm.words import WORD_PATTERN
from routeboard.operators.numbering import number_in_order
from routeboard.sources.storage import write_and_reload

MAX_RATE = 3
WEIGHTS = (1, 2, 3)
SPACES = " \t\n\x0b\x0c\r"  # what WORD_PATTERN leaves out


def _size(text: str):
    """Words of a text, NULL 0.  (``regexp_count`` would hold every word of a text as an object of its own.)"""
    marks = F.regexp_replace(F.ltrim(F.col(text), F.lit(SPACES)), F.lit(f"{WORD_PATTERN}[{SPACES}]*"), F.lit("."))
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def _print(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def source_rates(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rate) of rows (source, size).

    Sources in code point order, NULL last, weigh 1, 2, 3, 1, ...; one row per
    source goes through the windows here.  With sources in ascending order of
    cap / weight the capped ones come first: a source is capped when its cap
    is at most its share of what the earlier caps leave.
    """
    one = Window.partitionBy()
    exact = "decimal(38,0)"
    total = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
             .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
             .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
             .withColumn("cap", (F.lit(MAX_RATE) * F.col("source_size")).cast(exact))
             .withColumn("bound", F.col("cap") * (F.lit(6) / F.col("weight")).cast("int")))
    rising = Window.orderBy("bound", "place")
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = (total.withColumn("words_left", F.sum(F.col("source_size")).over(one).cast(exact)
                             - F.coalesce(F.sum("cap").over(earlier), F.lit(0)).cast(exact))
            .withColumn("weight_left", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
            .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("words_left") * F.col("weight")))
    level = F.min_by(F.when(~F.col("capped"), F.col("words_left").cast("double") / F.col("weight_left")),
                     F.when(~F.col("capped"), F.struct("bound", "place"))).over(one)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return (left.withColumn("target", target)
            .select("source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_RATE)), F.col("target") / F.col("source_size")))
                    .otherwise(F.lit(0.0)).alias("rate")))


def draw(doc_id, seed: str, place=None):
    """A fraction in [0, 1) fixed by ``seed``, the id and, beyond 1, the row's place among those of its id (52 bits of an MD5)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    if place is not None:
        key = F.concat(key, F.when(place > 1, F.concat(F.lit(":"), place.cast("string"))).otherwise(F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _placed(sized: DataFrame) -> DataFrame:
    """``sized`` with ``place``: 1 for an id's first row (by source and text), 2 for its second and so on."""
    repeated = sized.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("repeated_id"))
    if repeated.isEmpty():
        return sized.withColumn("place", F.lit(1).cast("long"))
    repeated = write_and_reload(repeated, "mix-repeated")
    same = sized["doc_id"].eqNullSafe(repeated["repeated_id"])
    several = number_in_order(sized.join(repeated, same, "left_semi"), [F.col("source").asc_nulls_last(), F.col("print").asc()],
                              by=["doc_id"], out="place")
    return sized.join(repeated, same, "left_anti").withColumn("place", F.lit(1).cast("long")).unionByName(several)


def plan_mix(df: DataFrame, seed: str = "mix", doc_id: str = "doc_id", source: str = "source",
             text: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, source, size, source_size, target, rate, copies."""
    sized = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _size(text).alias("size"), _print(text).alias("print"))
    return _planned(sized, sized, seed)


def _planned(rows: DataFrame, sizes: DataFrame, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, print and more) with the rates that ``sizes`` (source, size) give, and copies."""
    rates = write_and_reload(source_rates(sizes.select("source", "size")).withColumnRenamed("source", "rate_source"), "mix-rates")
    rows = _placed(rows)
    copies = F.floor("rate") + F.when(draw(F.col("doc_id"), seed, F.col("place")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (rows.join(rates, rows["source"].eqNullSafe(rates["rate_source"])).withColumn("copies", copies.cast("long"))
            .drop("rate_source", "print", "place"))


def mix(df: DataFrame, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each row of ``df`` as often as the plan takes it, with the columns of ``df``.

    Only documents with words are repeated or left out by rate; one without
    words adds no word to any source and is left out.
    """
    columns = df.columns
    packed = df.select(F.struct(*columns).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       F.col(text).rlike(WORD_PATTERN).alias("has_words"), _print(text).alias("print"))
    sizes = df.select(F.col(source).alias("source"), _size(text).alias("size"))
    taken = _planned(packed, sizes, seed).where((F.col("copies") > 0) & F.col("has_words"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
