"""Substring deduplication: repeated windows of ``WINDOW`` words become maximal removal intervals.

Rabin-Karp hashes of every window are counted over the whole corpus.  The
first occurrence of a window (smallest doc_id, then earliest start; NULL ids
count as the smallest) stays, the words of every later one are removed.
Repeats are judged on the input alone.

Documents are grouped into blocks of the id range.  A block sends each of its
distinct window hashes once, packed per hash bucket (so a passage that stands
in a third of all documents costs one hash a block), and gets back which of
them start in an earlier block.  Texts are shuffled once: the same exchange
feeds the hashing and, after the buckets answered, the removal.  The answer
names hashes by their place in the block's sorted order, which the removal
recomputes.

Texts of fewer words than a window, empty and NULL texts lose nothing.
Repeated rows (same id) are ordered by text; of equal rows the first is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from routeboard.llm.blocks import blocked, by_bucket, sorted_rows
from routeboard.llm.words import window_hashes, word_hashes, words

WINDOW = 20
BLOCK_ROWS = 1024


def _windows(rows, window: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    tokens = [words(text) for _, _, text in rows]
    return tokens, [window_hashes(word_hashes(t), window) for t in tokens]


def remove_repeats(df: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, removed (array of word intervals [start, end), maximal and ascending) and
    kept (the other words, joined by single spaces)."""
    rows = blocked(df, BLOCK_ROWS, doc_id, text)
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(key, block):
        _, hashes = _windows(sorted_rows(block), window)
        distinct = np.unique(np.concatenate(hashes))
        order, used, starts = by_bucket(distinct, buckets)
        packed = [x.tobytes() for x in np.split(distinct[order], starts[1:])] if len(used) else []
        return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array([key[0].as_py()] * len(used), pa.int64()),
                         "hashes": pa.array(packed, pa.binary())})

    def answer(key, sent):
        blocks = sent["block"].to_numpy()
        lists = [np.frombuffer(x, np.uint64) for x in sent["hashes"].to_pylist()]
        sizes = np.array([len(x) for x in lists])
        hashes, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((blocks[owner], hashes))
        later = np.flatnonzero(hashes[order][1:] == hashes[order][:-1]) + 1   # an earlier block has the same hash
        hit = order[later]
        hit = hit[np.argsort(owner[hit], kind="stable")]
        owners, starts = np.unique(owner[hit], return_index=True)
        packed = [x.astype(np.uint32).tobytes() for x in np.split(place[hit], starts[1:])] if len(owners) else []
        return pa.table({"block": pa.array(blocks[owners], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(owners), pa.int32()),
                         "places": pa.array(packed, pa.binary())})

    def remove(block, answers):
        ordered = sorted_rows(block)
        tokens, hashes = _windows(ordered, window)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        distinct, first, back = np.unique(every, return_index=True, return_inverse=True)
        earlier = np.zeros(len(distinct), bool)
        order, used, starts = by_bucket(distinct, buckets)
        starts = starts[np.searchsorted(used, answers["bucket"].to_numpy())]
        for start, places in zip(starts, answers["places"].to_pylist(), strict=True):
            earlier[order[start + np.frombuffer(places, np.uint32)]] = True
        gone = earlier[back] | (first[back] != np.arange(len(every)))
        out, done = [], 0
        for (given, i, _), t, h in zip(ordered, tokens, hashes, strict=True):
            n, own = len(t), gone[done:done + len(h)]
            done += len(h)
            spans, kept = [], t
            if own.any():
                edges = np.zeros(n + 1, np.int64)
                edges[:len(own)] += own
                edges[window:window + len(own)] -= own
                covered = np.cumsum(edges[:n]) > 0
                turns = np.flatnonzero(np.diff(np.r_[False, covered, False])).reshape(-1, 2).tolist()
                spans = [{"start": a, "end": b} for a, b in turns]
                kept = [w for w, c in zip(t, covered, strict=True) if not c]
            out.append((i if given else None, n, spans, b" ".join(kept).decode()))
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table([pa.array(c, ty) for c, ty in zip(columns, _OUT, strict=True)], names=["doc_id", "n_words", "removed", "kept"])

    answers = (rows.groupBy("block").applyInArrow(send, "bucket int, block long, hashes binary")
               .groupBy("bucket").applyInArrow(answer, "block long, bucket int, places binary"))
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        remove, "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string")


_OUT = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
