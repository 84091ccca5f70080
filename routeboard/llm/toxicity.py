"""Toxicity classifier: averaged subword embeddings under a linear softmax, trained in numpy.

A word's features are the word itself and its character n-grams of 3 to 5
(with boundary marks), each hashed to one of ``BUCKETS`` embeddings, so a
misspelling never seen shares most vectors with its word.  A document is the
mean of its words' features; embeddings and softmax weights are learnt
jointly by Adam with a fixed seed.

Training uses a bounded sample of labelled rows: at most ``sample[1]`` of
label 1 and ``sample[0]`` of label 0: ids of smallest hash first, then, if ids
repeat, the rows of smallest hash of id and text, equal rows once.  Features of
the sample are made in Spark tasks from whole texts; only their counts reach
the driver, each document's at most ``BUCKETS`` pairs.  Scoring is one pass
over whole texts without a shuffle; the broadcast model has ``BUCKETS``
numbers, because the softmax margin of a mean of embeddings is the mean of
the embeddings' margins.

NULL and empty texts have no features and score by the intercept alone; where
no sampled text has a word, all do.  With labels of one kind only (or none)
every score is that label's (or 0.5).  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeboard.llm.words import mix, slices, words

BUCKETS = 1 << 16
SIZE = 16                      # numbers in an embedding
GRAMS = (3, 4, 5)
SAMPLE = (3000, 1500)          # most rows of label 0 and 1 to fit on
EPOCHS = 8
SLICE_BYTES = 4_000_000        # texts whose words are numbered together
_EDGES = ".,;:!?\"'()[]{}|*#$%&<>-_"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features and, for each, the number of its word.

    Words are lower-cased and lose the punctuation at their ends; one of
    punctuation alone has no features.  An n-gram's bucket is a polynomial
    hash of its code points.
    """
    bare = [w.decode().lower().strip(_EDGES) for w in distinct]
    marked = [f"<{w}>" if w else "" for w in bare]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # the whole word: codes times powers of their place, summed
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _STEP, np.uint64), dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    whole = np.add.reduceat(codes * powers[place], (np.cumsum(sizes) - sizes)[filled]) if len(filled) else codes
    hashes, owners = [mix(whole)], [filled]
    for n in GRAMS:
        at = np.flatnonzero((place + n <= sizes[owner]) & (n < sizes[owner]))
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _STEP + codes[at + k]
        hashes.append(mix(h))
        owners.append(owner[at])
    return (np.concatenate(hashes) >> np.uint64(48)).astype(np.int64), np.concatenate(owners)


def _numbered(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each text's words in a row, and how many each text has."""
    tokens = [words(t) for t in texts]
    coded = pa.array([w for t in tokens for w in t], pa.binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.fromiter(map(len, tokens), np.int64, len(tokens))


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, label, buckets, shares) of rows (doc_id, label, text)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                distinct, numbers, sizes = _numbered(part.column("text").to_pylist())
                buckets, owner = features(distinct)
                order = np.argsort(owner, kind="stable")
                starts = np.searchsorted(owner[order], np.arange(len(distinct) + 1))
                ids, shares = [], []
                for own in np.split(numbers, np.cumsum(sizes)[:-1]):
                    which, times = np.unique(own, return_counts=True)
                    made = [buckets[order[starts[w]:starts[w + 1]]] for w in which]
                    total = np.bincount(np.concatenate(made), np.repeat(times, list(map(len, made))), BUCKETS) if made else np.zeros(1)
                    found = np.flatnonzero(total)
                    ids.append(found.astype(np.uint16).tobytes())
                    shares.append((total[found] / max(1, total.sum())).astype(np.float32).tobytes())
                yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array(ids, pa.binary()),
                                       pa.array(shares, pa.binary())], names=["doc_id", "label", "buckets", "shares"])

    return docs.mapInArrow(run, "doc_id long, label int, buckets binary, shares binary")


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, size: int = SIZE, rate: float = 0.02,
          decay: float = 1e-2, batch: int = 128) -> tuple[np.ndarray, float]:
    """Fits embeddings and softmax on (buckets, shares, label) rows; returns the margin of label 1 per bucket and the intercept.

    The shares are scaled by the root mean square of a row, which only fixes the step size.
    """
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    soft = rng.normal(0, 0.5, (size, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if len({label for *_, label in rows}) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0 if not rows else (20.0 if rows[0][2] else -20.0)
    params = [emb, soft, bias]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    scale = np.float32(1 / np.median([np.sqrt((s * s).sum()) for _, s, _ in rows if len(s)] or [1.0]))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at:at + batch]]
            sizes = np.array([len(b) for b, _, _ in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            ids = np.concatenate([b for b, _, _ in part]).astype(np.int64)
            x = np.concatenate([s for _, s, _ in part]) * scale
            filled = np.flatnonzero(sizes)
            hidden = np.zeros((len(part), size), np.float32)
            if len(filled):
                hidden[filled] = np.add.reduceat(emb[ids] * x[:, None], (np.cumsum(sizes) - sizes)[filled])
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [label for *_, label in part]] -= 1
            p /= len(part)
            order_ids = np.argsort(ids, kind="stable")
            used, starts = np.unique(ids[order_ids], return_index=True)
            back = (p @ soft.T)[owner[order_ids]] * x[order_ids, None]
            grads = [np.add.reduceat(back, starts) if len(used) else back, hidden.T @ p, p.sum(0)]
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, (param, grad, (m, v)) in enumerate(zip(params, grads, state, strict=True)):
                rows_of = used if k == 0 else slice(None)
                m[rows_of] = 0.9 * m[rows_of] + 0.1 * grad
                v[rows_of] = 0.999 * v[rows_of] + 0.001 * grad * grad
                param[rows_of] -= now * ((m[rows_of] / (1 - 0.9**step)) / (np.sqrt(v[rows_of] / (1 - 0.999**step)) + 1e-8)
                                         + decay * param[rows_of])
    return (emb @ (soft[:, 1] - soft[:, 0])) * scale, float(bias[1] - bias[0])


def _known(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, label): one label an id, the largest where they differ."""
    return labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max(label).cast("int").alias("label"))


def sampled(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, doc_id: str = "doc_id",
            label: str = "toxic", text: str = "text") -> DataFrame:
    """(doc_id, label, text): at most ``sample[k]`` rows of label k, each (id, text) once."""
    known = _known(labels, doc_id, label)
    nearest = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in enumerate(sample)]
    # at most sum(sample) ids, so this broadcast is bounded
    chosen = F.broadcast(nearest[0].unionByName(nearest[1]))
    of_ids = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(chosen, "doc_id")
    hashed = of_ids.withColumn("row_hash", F.xxhash64("doc_id", "text"))
    narrow = hashed.select("doc_id", "label", "row_hash").distinct()
    rows = [narrow.where(F.col("label") == k).orderBy("row_hash", "doc_id").limit(n) for k, n in enumerate(sample)]
    wanted = F.broadcast(rows[0].unionByName(rows[1]).drop("label"))   # bounded alike
    return hashed.join(wanted, ["doc_id", "row_hash"]).groupBy("doc_id", "label", "row_hash").agg(F.min("text").alias("text")).drop("row_hash")


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, doc_id: str = "doc_id",
        label: str = "toxic", text: str = "text") -> tuple[np.ndarray, float]:
    """Trains on a sample of the labelled rows of ``docs`` (one label an id: the largest, where they differ; NULL labels are ignored)."""
    known = _known(labels, doc_id, label)
    rows = _counted(sampled(docs, labels, sample, doc_id, label, text).select("doc_id", "label", "text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["buckets"]))
    margins, intercept = train([(np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["shares"], np.float32), r["label"])
                                for r in rows])
    # the sample has its own share of label 1; the intercept goes back to that of all labelled rows
    everywhere = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [sum(r["label"] == k for r in rows) for k in (0, 1)]
    if all(drawn):
        intercept += float(np.log(everywhere[1] / everywhere[0]) - np.log(drawn[1] / drawn[0]))
    return margins, intercept


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``df`` without ``text`` plus ``score`` (0 to 1, higher: likelier toxic); a column ``score`` is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in ("score", text)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                made = scores(part.column(text).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(made, pa.float64())], names=[*keep, "score"])

    return df.mapInArrow(run, schema)


def scores(texts: list[str | None], model: tuple[np.ndarray, float]) -> np.ndarray:
    """The softmax's probability of label 1 for each text."""
    margins, intercept = model
    distinct, numbers, sizes = _numbered(texts)
    buckets, owner = features(distinct)
    total = np.bincount(owner, margins[buckets].astype(np.float64), len(distinct))
    count = np.bincount(owner, minlength=len(distinct)).astype(np.float64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = np.bincount(doc, count[numbers], len(texts))
    mean = np.bincount(doc, total[numbers], len(texts)) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(intercept + mean, -60, 60)))
