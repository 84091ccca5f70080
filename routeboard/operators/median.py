"""Exact per-group median that never gathers a group in one task, planned lazily.

Spark's built-in ``median`` is exact, but its final merge holds every distinct
value of a group in one task.  Here the middle values are found by digit
histograms instead, whatever the sizes:

1. collapse duplicates to ``(key, value, weight)``: combined map-side, dealt
   out by key *and* value, so a hot key spreads over all tasks;
2. write each double as a 64-bit integer of the same order (``order_code``) and
   cut it into three digits.  The weights per ``(key, first digit)`` are a
   histogram with at most 2**20 rows a key; a running sum over it gives the
   digit that holds each middle rank, and the rank inside it;
3. repeat with the second and third digit, for the values whose earlier digits
   match only; the third digit leaves a single value.

Every step is an aggregation that combines before its shuffle, a window over a
histogram, or a join with at most two rows a key.  Nothing runs when the plan
is made, and no result of a sampled or arbitrary order is used twice, so a
recomputed task gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# low bits that the first, second and third digit leave out: 20, 22 and 22 bits each
DIGIT_SHIFTS = (44, 22, 0)


def order_code(value: Column | str) -> Column:
    """A BIGINT for every DOUBLE, in Spark's order of doubles (NaN last)."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("bigint")
    # negative doubles count down: flip all bits but the sign
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def weigh(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, weight)``: how often each key has each non-NULL value."""
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias(value))
    return rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("weight"))


def group_median(df: DataFrame, key: str, value: str, out: str = "median") -> DataFrame:
    """``(key, out)``: exact median of the non-NULL ``value`` (read as DOUBLE) per ``key`` (NULL key is a group).

    Keys whose values are all NULL are absent; join back with a left join.
    """
    return weighted_median(weigh(df, key, value), key, value, "weight", out)


def weighted_median(weighted: DataFrame, key: str, value: str, weight: str, out: str = "median") -> DataFrame:
    """``(key, out)`` from distinct ``(key, value)`` rows with a positive ``weight`` each."""
    rows = weighted.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.col(weight).alias("_w"),
                           order_code(value).alias("_code"))
    targets = None
    for shift in DIGIT_SHIFTS:
        digit = F.shiftright("_code", shift).alias("_digit")
        if targets is None:
            histogram = rows.groupBy("_key", digit).agg(F.sum("_w").alias("_w"))
            whole = Window.partitionBy("_key")
            n = F.sum("_w").over(whole)
            running = F.sum("_w").over(whole.orderBy("_digit"))
            last = F.shiftright(n, 1)                      # 0-based ranks of the middle values: (n - 1) div 2 and n div 2
            ranks = F.array_distinct(F.array(F.shiftright(n - 1, 1), last))
            found = histogram.select("_key", "_digit", "_w", (running - F.col("_w")).alias("_before"), ranks.alias("_ranks"))
            found = found.withColumn("_rank", F.explode("_ranks")).withColumn("_middle", F.col("_rank"))
        else:
            wanted = targets.select(F.col("_key").alias("_of"), F.col("_digit").alias("_prefix"), "_rank", "_middle")
            matches = F.col("_key").eqNullSafe(F.col("_of")) & (F.shiftright("_code", before) == F.col("_prefix"))
            histogram = rows.join(wanted, matches).groupBy("_key", "_middle", "_rank", digit).agg(F.sum("_w").alias("_w"), F.max("_value").alias("_value"))
            running = F.sum("_w").over(Window.partitionBy("_key", "_middle").orderBy("_digit"))
            found = histogram.withColumn("_before", running - F.col("_w"))
        held = found.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_w")))
        targets = held.withColumn("_rank", F.col("_rank") - F.col("_before"))
        before = shift
    # the whole code is one value
    ends = targets.groupBy("_key").agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    middle = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(0.5 * F.col("_low") + 0.5 * F.col("_high"))
    return ends.select(F.col("_key").alias(key), middle.alias(out))
