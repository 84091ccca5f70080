"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, over a whole corpus.

Exact-text deduplication.  Most of the work is tokenising, so it is done once
for each distinct text: the documents are shuffled by their full text, copies
are counted on the way (each task sends a text once), every distinct text is
tokenised and aligned once, and its counts are weighted by its copies.  The
measures go back to the documents by the text's SHA-256.

Alignment.  Both token sequences spell the same bytes, so they are two ways to
cut one line.  Offsets where both cut part the tokens into groups; every piece
between neighbouring cuts of either kind lies in one A token and one B token,
and each overlapping pair of tokens has exactly one such piece.  A slice of
texts is aligned at once in numpy.

Counts.  The aligned texts are written in blocks of about ``BLOCK_BYTES`` with
the distinct id pairs of each text; a block also writes each of its distinct
pairs once, with the number of documents that hold it.  These rows are summed
over all blocks, the highest count of every A id is found (at most one row an
A id: bounded by the vocabulary), and each block's pairs get their counts back
by a join; a block's texts are then summed against them.  Traffic grows with
the distinct pairs of a block, not with the links.

A block holds whole texts; one that is longer than ``BLOCK_BYTES`` is a block
of its own, so a task's memory is bounded by the longest text.

Defined cases: a NULL or empty text, or one that either vocabulary does not
spell byte by byte (``lead`` and the text), has no tokens and all measures are
0; copies and repeated rows count as documents each; ties for the highest
count are all best; an empty table gives an empty result; other columns take no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeboard.llm.token_counts import Remembered, Splitter, byte_letters, check_supported
from routeboard.llm.words import slices
from routeboard.sources.storage import write_and_reload

SLICE_BYTES = 1 << 19            # text that is tokenised and aligned at a time
BLOCK_BYTES = 24 << 20           # text whose pairs are sent and answered together
BLOCK_TEXTS = 1 << 20
FOLD_PAIRS = 400_000             # id pairs a block holds before they are folded into its distinct ones
MAX_MODEL_BYTES = 64 << 20       # checked bound of what is sent to the tasks
LEAD = " "                       # what B puts in front of a text, and A is given in front of it
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Tokens:
    """One side: a text to its ids (an array), and every id's bytes."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], spelled: Sequence[bytes]):
        self.encode, self.spelled = encode, list(spelled)
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        digits = [str(i) for i in range(len(self.spelled))]
        self.written = np.array([d + end for end in ",|;" for d in digits], object)   # an id with what follows it


class _Ids(Remembered):
    """A pre-token's ids, packed."""

    def value(self, tokens: list) -> bytes:
        return np.array([t.id for t in tokens], "<u4").tobytes()


def byte_level_side(content: str) -> Tokens:
    """A: a byte-level BPE file (JSON) of the tokenizers library; special strings are plain text.

    Pre-tokens are cut as the library cuts them and merged by it, each
    distinct one once while it is remembered.
    """
    import tokenizers

    special = set(check_supported(content))
    own = tokenizers.Tokenizer.from_str(content)
    splitter, ids = Splitter(own), _Ids(own, {})
    values = {c: b for b, c in byte_letters().items()}
    spelled = [b""] * own.get_vocab_size()
    for entry, i in own.get_vocab().items():
        spelled[i] = b"" if entry in special else bytes(values[c] for c in entry)
    return Tokens(lambda texts: [np.frombuffer(b"".join(map(ids.__getitem__, splitter.pieces(LEAD + t))), "<u4") for t in texts], spelled)


def piece_side(model: bytes) -> Tokens:
    """B: a sentencepiece model with byte pieces, which puts a space in front of a text itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    spelled = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i)
               else b"" if own.is_control(i) or own.is_unknown(i) else own.id_to_piece(i).replace("▁", LEAD).encode()
               for i in range(own.get_piece_size())]
    return Tokens(lambda texts: [np.array(ids, np.uint32) for ids in own.encode(texts, num_threads=1)], spelled)


def _spell(side: Tokens, ids: np.ndarray) -> bytes:
    return b"".join(map(side.spelled.__getitem__, ids.tolist()))


def align(texts: list[str], a: Tokens, b: Tokens) -> Iterator[tuple]:
    """For each text (n_a, n_b, n_groups, groups, pairs, times), or None if a side does not spell it.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the distinct id pairs
    that overlap (A id * size of B + B id, ascending), ``times`` how often.
    """
    coded = [(x, y) if (w := (LEAD + t).encode()) == _spell(a, x) == _spell(b, y) else None
             for t, x, y in zip(texts, a.encode(texts), b.encode(texts), strict=True)]
    good = [c for c in coded if c is not None]
    if not good:
        yield from coded
        return
    ids_a, ids_b = (np.concatenate([c[k] for c in good]).astype(np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    last_a, last_b = np.cumsum([len(c[0]) for c in good]), np.cumsum([len(c[1]) for c in good])
    border = ends_a[last_a - 1]                         # where each text ends
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")     # two ascending runs: merged
    again = ends[1:] == ends[:-1]
    both, cuts = ends[1:][again], ends[np.r_[True, ~again]]
    # a link is a piece between neighbouring cuts
    code = ids_a[np.searchsorted(ends_a, cuts)] * len(b.spelled) + ids_b[np.searchsorted(ends_b, cuts)]
    # each token written with what follows it, in the order of groups, A before B
    group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    count_a, count_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
    ahead_a, ahead_b = np.cumsum(count_a), np.cumsum(count_b) - count_b
    out = np.empty(len(ids_a) + len(ids_b), object)
    closes_a, closes_b = both[group_a] == ends_a, both[group_b] == ends_b
    out[np.arange(len(ids_a)) + ahead_b[group_a]] = a.written[ids_a + closes_a * len(a.spelled)]
    out[np.arange(len(ids_b)) + ahead_a[group_b]] = b.written[ids_b + 2 * closes_b * len(b.spelled)]
    at_cut, at_both = np.searchsorted(cuts, border, side="right"), np.searchsorted(both, border, side="right")
    token = link = group = 0
    k = -1
    for c in coded:
        if c is None:
            yield None
            continue
        k += 1
        n_a, n_b = len(c[0]), len(c[1])
        groups = "".join(out[token:token + n_a + n_b].tolist())[:-1]
        pairs, times = np.unique(code[link:at_cut[k]], return_counts=True)
        yield n_a, n_b, int(at_both[k] - group), groups, pairs, times
        token, link, group = token + n_a + n_b, at_cut[k], at_both[k]


_sides: dict[bytes, tuple[Tokens, Tokens]] = {}     # one pair of vocabularies at a time per worker

# rows of the written table: a text (pair NULL) or one of its block's pairs
_ROWS = ("block long, text_id binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "pairs binary, times binary, pair long, weight long")
_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]


def _batch(columns: list, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


class _Block:
    """The distinct pairs of a run of texts with the documents that hold them."""

    def __init__(self, number: int):
        self.number, self.bytes, self.texts, self._new, self._pairs, self._weights = number, 0, 0, 0, [], []

    def add(self, pairs: np.ndarray, copies: int, size: int) -> None:
        self.bytes, self.texts = self.bytes + size, self.texts + 1
        self._pairs.append(pairs)
        self._weights.append(np.full(len(pairs), copies, np.int64))
        self._new += len(pairs)
        if self._new > FOLD_PAIRS:
            self._fold()

    def _fold(self) -> None:
        pairs, at = np.unique(np.concatenate(self._pairs), return_inverse=True)
        weights = np.zeros(len(pairs), np.int64)
        np.add.at(weights, at, np.concatenate(self._weights))
        self._new, self._pairs, self._weights = 0, [pairs], [weights]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        self._fold()
        for k in range(0, len(self._pairs[0]), 100_000):
            pairs, weights = self._pairs[0][k:k + 100_000], self._weights[0][k:k + 100_000]
            yield _batch([np.full(len(pairs), self.number, np.int64), *[None] * 8, pairs, weights], len(pairs))


def _aligned(texts: DataFrame, content: str, model: bytes) -> DataFrame:
    """Rows of texts and of their blocks' pairs, from the distinct ``text`` with ``copies``."""
    shared = texts.sparkSession.sparkContext.broadcast((content, model))
    key = sha256(content.encode() + model).digest()

    def run(batches):
        from pyspark import TaskContext

        if key not in _sides:
            _sides.clear()
            _sides[key] = byte_level_side(shared.value[0]), piece_side(shared.value[1])
        a, b = _sides[key]
        first = TaskContext.get().partitionId() << 32
        block = _Block(first)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = []
                values, copies = part.column("text").to_pylist(), part.column("copies").to_pylist()
                for text, n, found in zip(values, copies, align(values, a, b), strict=True):
                    if found is None:
                        continue
                    n_a, n_b, n_groups, groups, pairs, times = found
                    raw = text.encode()
                    rows.append((block.number, sha256(raw).digest(), n_a, n_b, n_groups, int(times.sum()), sha256(groups.encode()).hexdigest(),
                                 pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes(), None, None))
                    block.add(pairs, n, len(raw))
                    if block.bytes >= BLOCK_BYTES or block.texts >= BLOCK_TEXTS:
                        yield _batch(list(zip(*rows, strict=True)), len(rows))
                        rows = []
                        yield from block.rows()
                        block = _Block(block.number + 1)
                if rows:
                    yield _batch(list(zip(*rows, strict=True)), len(rows))
        yield from block.rows()

    return texts.mapInArrow(run, _ROWS)


def _measure(key, texts: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's texts with count_sum and n_best, from the counts of the block's pairs."""
    pair = counts["pair"].to_numpy()
    order = np.argsort(pair)
    pair, count, best = pair[order], counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
    sums, n_best = [], []
    for pairs, times in zip(texts["pairs"], texts["times"], strict=True):
        at = np.searchsorted(pair, np.frombuffer(pairs.as_buffer(), "<u4"))
        times = np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
        sums.append(int((times * count[at]).sum()))
        n_best.append(int(times[best[at]].sum()))
    kept = texts.select(["text_id", "n_a", "n_b", "n_groups", "n_links"])
    return (kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
            .append_column("groups_sha256", texts["groups_sha256"]))


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): documents that hold each pair linked, and whether that is its A id's highest."""
    counts = rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("weight").alias("count"))
    a_id = F.floor(F.col("pair") / b_size).cast("int")
    highest = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("highest"))      # at most one row an A id
    return counts.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_corpus(df: DataFrame, content: str, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``content`` is A's tokenizer file (byte-level BPE, JSON), ``model`` B's
    sentencepiece model.  ``count_sum`` adds, over a text's links, the number of
    documents that hold the link's id pair; ``n_best`` counts the links whose
    pair is the most frequent of its A id.
    """
    if len(content.encode()) + len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the vocabularies take more than {MAX_MODEL_BYTES} bytes")
    b_size = len(piece_side(model).spelled)
    if len(byte_level_side(content).spelled) * b_size >= 1 << 32:
        raise ValueError("an id pair takes more than 32 bits")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    distinct = docs.where("octet_length(text) > 0").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    rows = write_and_reload(_aligned(distinct, content, model), "aligned")
    counts = pair_counts(rows, b_size)
    wanted = rows.where("pair IS NOT NULL").select("block", "pair").join(counts, "pair")
    texts = rows.where("pair IS NULL").select(F.col("block").alias("of_block"), *_NAMES[1:9])
    wanted = wanted.select(F.col("block").alias("to_block"), "pair", "count", "best")
    measured = texts.groupBy("of_block").cogroup(wanted.groupBy("to_block")).applyInArrow(
        _measure, "text_id binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    own = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("own_text"))
    found = own.join(measured, F.col("own_text") == F.col("text_id"), "left")
    return found.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES],
                        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
