"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document over all its text.  The ledger keeps
the measurements and one failure bit per rule, so any number of policies
(masks with a version) are applied later without reading text again, and
ablations are bitwise aggregations over the distinct failure masks.

Hash windows follow ``words.py``; the pass is one ``mapInArrow`` with no
shuffle.  NULL and empty texts measure zero everywhere and fail ``few_words``.
Repeated rows are measured row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeboard.llm.worker import hold
from routeboard.llm.words import forget_words, window_hashes, word_hashes

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: bit -> (name, SQL condition of failure over the measurements); a new rule takes the next bit
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A named version of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(name for name, _ in RULES))


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    data = (text or "").encode()
    tokens = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    repeated = 0
    if len(tokens) > WINDOW:
        _, back, counts = np.unique(window_hashes(word_hashes(tokens), WINDOW), return_inverse=True, return_counts=True)
        if len(counts) < len(back):
            twice = counts[back] > 1
            edges = np.zeros(len(tokens) + 1, np.int64)
            edges[:len(twice)] += twice
            edges[WINDOW:WINDOW + len(twice)] -= twice
            repeated = int((np.cumsum(edges[:-1]) > 0).sum())
    return (len(tokens), len(text or "") - (len(data) - len(data.translate(None, SPACE))),
            len(data) - len(data.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, plus ``MEASURES`` and ``failures`` (bit i set: rule i failed).

    Columns of ``df`` named like a measurement are replaced.
    """
    return _failures(_measured(df, text).drop(text))


def _measured(df: DataFrame, text: str, within: int | None = None) -> DataFrame:
    """``df`` with ``MEASURES`` of its column ``text``, or of field ``within`` of its column ``row``."""
    keep = [c for c in df.columns if c not in (*MEASURES, "failures")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches):
        hold("words", forget_words)
        for batch in batches:
            texts = batch.column(text) if within is None else batch.column("row").field(within)
            found = [measure(t.as_py()) for t in texts]      # one text at a time: a batch is never held twice
            columns = zip(*found, strict=True) if found else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(x, pa.int64()) for x in columns], names=[*keep, *MEASURES])

    return df.mapInArrow(run, schema)


def _failures(measured: DataFrame) -> DataFrame:
    bits = sum((F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, sql) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("failures", bits.cast("long"))


def apply_policy(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``kept``: no rule of ``policy`` failed."""
    return ledger_df.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0)


def keep(df: DataFrame, policy: Policy = STRICT, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass ``policy``, with the columns of ``df``."""
    columns = df.columns
    packed = df.select(F.struct(*columns).alias("row"))
    return apply_policy(_failures(_measured(packed, text, columns.index(text))), policy).where("kept").select("row.*")


def ablations(ledger_df: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """Per policy and rule: documents kept by the policy, kept without the rule, and failed by the rule alone.

    One aggregation to the distinct failure masks (at most two to the number
    of rules), then bitwise arithmetic on those few rows.
    """
    masks = ledger_df.groupBy("failures").count()
    cases = F.explode(F.array(*[
        F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"),
                 F.lit(p.mask & ~Policy("", (r,)).mask).cast("long").alias("without"))
        for p in policies for r in p.rules]))
    failed, n = F.col("failures").bitwiseAND(F.col("mask")), F.col("count")
    without = F.col("failures").bitwiseAND(F.col("without"))
    return (masks.select("failures", "count", cases.alias("case")).select("failures", "count", "case.*")
            .groupBy("version", "rule").agg(
                F.sum(F.when(failed == 0, n).otherwise(0)).alias("kept"),
                F.sum(F.when(without == 0, n).otherwise(0)).alias("kept_without"),
                F.sum(F.when((without == 0) & (failed != 0), n).otherwise(0)).alias("failed_alone")))
