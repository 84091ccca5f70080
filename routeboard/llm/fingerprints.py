"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a document's
shingles (five lower-cased words; a shorter text is one shingle; no word: no
hash).  Sketches of parts merge to the sketch of the whole.  With at most
``k`` shingles a sketch is the whole set and every estimate is exact.

Text form: 16 hexadecimal digits per hash in ascending order, so equal texts
have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeboard.llm.blocks import with_block
from routeboard.llm.words import shingle_set, unused

K = 128
BLOCK_ROWS = 512


def sketch(text: str | None, k: int = K) -> np.ndarray:
    return shingle_set(text)[:k]


def to_hex(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def distinct_shingles(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(s)) if len(s) < k else (k - 1) / (float(s[-1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike (1)."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; an empty ``a`` is contained (1)."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    union = distinct_shingles(merge(a, b, k), k)
    return min(1.0, r * union / distinct_shingles(a, k))


def fingerprint(df: DataFrame, k: int = K, text: str = "text") -> DataFrame:
    """``df`` with ``fingerprint`` (text form) and ``n_shingles`` (estimate); such columns are replaced."""
    @F.pandas_udf("fingerprint string, n_shingles double")
    def run(texts):
        import pandas as pd
        made = [sketch(t, k) for t in texts]
        return pd.DataFrame({"fingerprint": [to_hex(s) for s in made], "n_shingles": [distinct_shingles(s, k) for s in made]})

    keep = [c for c in df.columns if c.lower() not in ("fingerprint", "n_shingles")]
    made = unused("made", df.columns)
    return df.select(*keep, run(F.col(text)).alias(made)).select(*keep, f"{made}.*")


def with_edited(df: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text.

    The next document is the one after this in descending ``doc_id`` (equal
    ids: by text; NULL ids last), after the last the first.  The edited text
    has its last half (rounded down) replaced by as many first characters of
    the next text.  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, by blocks in id order; a block also gets the
    first document of the following block, so every document meets its next
    in a sorted stream and no task holds more than a few texts at a time.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_block(rows, BLOCK_ROWS, falling=True)
    # per block the id of its first document, and the block that it follows (the first block's: the last)
    heads = rows.groupBy("block").agg(F.max("doc_id").alias("head"))
    falling, every = Window.orderBy(F.desc("block")), Window.partitionBy()
    heads = heads.select("block", "head", F.coalesce(F.lag("block").over(falling), F.min("block").over(every)).alias("goes_to"))
    # at most blocks.MAX_BLOCKS narrow rows, so this broadcast is bounded; the texts stay where they are
    first = (rows.join(F.broadcast(heads.select(F.col("block").alias("head_block"), "head", "goes_to")),
                       (F.col("block") == F.col("head_block")) & F.col("doc_id").eqNullSafe(F.col("head")))
             .select("doc_id", "text", F.col("goes_to").alias("block"), F.lit(1).alias("is_next")))
    together = rows.select("doc_id", "text", "block", F.lit(0).alias("is_next")).unionByName(first)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = together.repartition(parts, "block").sortWithinPartitions("block", "is_next", F.desc_nulls_last("doc_id"), "text")

    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last = None
        for batch in batches:
            out = []
            for i, t, block, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and last[4] == extra == 1 and last[3] == block:
                    continue   # of several heads only the first follows
                own = sketch(t, k)
                if last and last[3] == block:
                    out.append(_compare(last, t, own, k))
                last = (i, t, own, block, extra)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), _TYPES, strict=True)], names=names)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
                                   " edited_fingerprint string, near_edited double, near_next double")


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(doc, next_text: str, next_sketch: np.ndarray, k: int) -> tuple:
    doc_id, text, own, _, _ = doc
    half = len(text) // 2
    edited = text[:len(text) - half] + next_text[:half]
    changed = sketch(edited, k)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_hex(own), to_hex(changed),
            resemblance(own, changed, k), resemblance(own, next_sketch, k))
