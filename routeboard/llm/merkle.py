"""Merkle manifest of a dataset: a digest for every row, one root, and a proof per row.

Every row becomes a leaf; the leaves of a tree (one per value of a column)
stand in a given order, every two consecutive nodes become their parent until
one node, the subroot, remains; the subroots, ordered by the tree's value, are
the leaves of one more tree, whose top is the root.

Time-forward processing.  A node's label is its tree, level and place.  A node
sends its digest to its parent as a message under the parent's label, and a
priority queue ordered by label hands each node all messages addressed to it.
The queue is external: Spark's shuffle sorts the messages of a round by label
into aligned blocks of ``2**LEVELS`` leaves, and a small heap holds a block's
messages while the sweep works through its labels.  A block sends one message
on, its top node, and the next round sweeps those, so ``n`` leaves take
``log2(n) / LEVELS`` rounds.  The reversed sweep starts at the root with an
empty proof and hands every child its parent's proof with its own sibling put
in front, until the leaves have theirs.

No task holds more than a block.  Every round is written to the shared
checkpoint folder, so a lost executor costs a round at most.

Defined cases: NULL fields are part of a leaf (written ``-``); a NULL tree value
is a tree of its own, first in order; rows with equal or NULL order values
(NULL first) stand in the order of their leaves, so repeated rows are separate,
interchangeable leaves; a very long text is one leaf digest like any other; an
empty table has no rows and no root.  Other columns take no part, whatever
their names; the result has only its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeboard.operators.numbering import number_in_order
from routeboard.sources.storage import write_and_reload

LEVELS = 10              # levels of a tree that one round climbs: blocks of 1,024 nodes

#: one step of a proof: the sibling's side and digest; both NULL where a node was alone in its run
STEP = "struct<side: string, digest: string>"
_STEP = pa.struct([("side", pa.string()), ("digest", pa.string())])


def digest_of(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated strings (UTF-8)."""
    return F.sha2(F.concat(*parts), 256)


def record_digest(columns: Sequence[Column | str]) -> Column:
    """A row's leaf: every field as ``bytes:value`` (``-`` if NULL), concatenated and hashed."""
    fields = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return digest_of(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields])


def _levels(n: int, most: int) -> int:
    """Levels that a round climbs in a tree with ``n`` nodes at its start."""
    return min(most, (n - 1).bit_length())


def _place(level: int, at: int) -> tuple[int, int]:
    """A node's label within its block: children come before parents, left before right."""
    return level, at


def _climb(leaves: list[tuple[int, str]], levels: int) -> tuple[dict, str]:
    """Sweep a block in label order: every node's digest by label, and the top digest.

    ``leaves`` are (place, digest).  The heap holds messages (label, sender's
    place, digest); a label's messages come out together, left child first.
    """
    queue = [(_place(0, at), at, digest) for at, digest in leaves]
    heapq.heapify(queue)
    made, top = {}, ""
    while queue:
        label, _, digest = heapq.heappop(queue)
        parts = [digest]
        while queue and queue[0][0] == label:
            parts.append(heapq.heappop(queue)[2])
        level, at = label
        own = made[label] = sha256("".join(parts).encode()).hexdigest() if level else digest
        if level < levels:
            heapq.heappush(queue, (_place(level + 1, at >> 1), at, own))
        else:
            top = own
    return made, top


def _descend(made: dict, levels: int, proof: list) -> Iterator[tuple[int, list]]:
    """The reversed sweep: from the block's top with its ``proof`` down to (place, proof) of its leaves."""
    if not made:
        return
    queue = [((-levels, -max(at for level, at in made if level == levels)), proof)]
    while queue:
        (level, at), proof = heapq.heappop(queue)
        level, at = -level, -at
        if not level:
            yield at, proof
            continue
        children = [c for c in (2 * at, 2 * at + 1) if (level - 1, c) in made]
        for c in children:
            other = c ^ 1
            step = {"side": "LR"[other > c], "digest": made[level - 1, other]} if len(children) == 2 else {"side": None, "digest": None}
            heapq.heappush(queue, ((-(level - 1), -c), [step, *proof]))


def _blocks(batches) -> Iterator[list[tuple]]:
    """The rows of one block after another; the rows come sorted by tree and block."""
    label, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != label:
                if rows:
                    yield rows
                label, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _up(nodes: DataFrame, most: int) -> DataFrame:
    """The next round's nodes: (tree, at, n, digest), one for each block of ``nodes``."""
    def climb(batches):
        out = []
        for rows in _blocks(batches):
            tree, block, n = rows[0][:3]
            levels = _levels(n, most)
            out.append((tree, block, -(-n // (1 << levels)), _climb([(at, digest) for *_, at, digest in rows], levels)[1]))
            if len(out) == 1000:
                yield _batch(out, _NODES)
                out = []
        if out:
            yield _batch(out, _NODES)

    return _by_block(nodes, most).select("tree", "block", "n", "at", "digest").mapInArrow(climb, "tree string, at long, n long, digest string")


_TYPES = {"tree": pa.string(), "at": pa.int64(), "n": pa.int64(), "digest": pa.string(), "proof": pa.list_(_STEP)}
_NODES = ("tree", "at", "n", "digest")
_PROOFS = ("tree", "at", "proof")


def _batch(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


def _by_block(nodes: DataFrame, most: int) -> DataFrame:
    """The external queue: messages dealt out by block and sorted by label."""
    block = nodes.withColumn("block", F.shiftright("at", most))
    return block.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _down(nodes: DataFrame, tops: DataFrame, most: int) -> DataFrame:
    """(tree, at, proof) of every node, given the proofs of the blocks' tops (tree, at, proof)."""
    def descend(batches):
        out = []
        for rows in _blocks(batches):
            top, leaves = rows[0][5], rows[1:]       # the block's own proof sorts first
            tree, block, n = leaves[0][:3]
            levels = _levels(n, most)
            made, _ = _climb([(at, digest) for _, _, _, at, digest, _ in leaves], levels)
            for at, proof in _descend(made, levels, top):
                out.append((tree, at, proof))
            if len(out) >= 1000:
                yield _batch(out, _PROOFS)
                out = []
        if out:
            yield _batch(out, _PROOFS)

    none = F.lit(None)
    both = (nodes.select("tree", F.shiftright("at", most).alias("block"), "n", "at", "digest", none.cast(f"array<{STEP}>").alias("proof"))
            .unionByName(tops.select("tree", F.col("at").alias("block"), none.cast("long").alias("n"), F.lit(-1).cast("long").alias("at"),
                                     none.cast("string").alias("digest"), "proof")))
    sorted_ = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return sorted_.mapInArrow(descend, f"tree string, at long, proof array<{STEP}>")


def _sweep(leaves: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """The nodes of every round, leaves first; in the last one every tree has one node."""
    rounds = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        rounds.append(write_and_reload(_up(rounds[-1], levels), f"merkle-{name}"))
        largest = -(-largest // (1 << _levels(largest, levels)))
    return rounds


def _proofs(rounds: list[DataFrame], tops: DataFrame, name: str, levels: int) -> DataFrame:
    """(tree, at, proof) of the leaves, given the proofs (tree, at, proof) of the trees' tops."""
    for k, nodes in enumerate(reversed(rounds[:-1])):
        tops = _down(nodes, tops, levels)
        if k < len(rounds) - 2:
            tops = write_and_reload(tops, f"merkle-{name}-proofs")
    return tops


def manifest(df: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang",
             order: str = "doc_id", carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row of ``df``: ``order``, leaf, subroot, root, proof and the ``carry`` columns.

    ``columns`` are the fields of a leaf.  ``proof`` is an array of steps
    (``STEP``) from the leaf to the root; ``fold`` follows it.  ``carry`` names
    expressions over ``df`` that go along with their row.  A task holds blocks
    of ``2**levels`` nodes.
    """
    carry = carry or {}
    kept = [f"carry{k}" for k in range(len(carry))]
    leaves = write_and_reload(df.select(F.col(tree).cast("string").alias("tree"), F.col(order).alias("id"), record_digest(columns).alias("digest"),
                                        *[c.alias(k) for k, c in zip(kept, carry.values(), strict=True)]), "merkle-leaves")
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).select(F.col("tree").alias("of"), "n")
    placed = number_in_order(leaves, [F.col("id").asc_nulls_first(), F.col("digest").asc()], by=["tree"], out="place")
    placed = write_and_reload(placed.join(sizes, F.col("tree").eqNullSafe(F.col("of"))).drop("of").withColumn("at", F.col("place") - 1).drop("place"),
                              "merkle-placed")
    rounds = _sweep(placed.select(*_NODES), "leaves", levels)

    # the subroots are the leaves of the last tree, ordered by the bytes of the tree's value, NULL first
    subroots = number_in_order(rounds[-1].select(F.col("tree").alias("of"), F.col("digest").alias("subroot")),
                               [F.col("of").asc_nulls_first()], out="place")
    subroots = write_and_reload(subroots.select("of", "subroot", F.lit("").alias("tree"), (F.col("place") - 1).alias("at")), "merkle-subroots")
    count = subroots.count()
    forest = subroots.select("tree", "at", F.lit(count).cast("long").alias("n"), F.col("subroot").alias("digest"))
    high = _sweep(forest, "subroots", levels)
    root = (high[-1].first() or {"digest": None})["digest"]
    top = df.sparkSession.range(1 if count else 0).select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("at"),
                                                          F.array().cast(f"array<{STEP}>").alias("proof"))
    own = _proofs(high, top, "subroots", levels).select("at", "proof").join(subroots.select("at", "of", "subroot"), "at")
    own = write_and_reload(own.select("of", "subroot", "proof"), "merkle-tops")

    tops = own.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), "proof")
    proofs = _proofs(rounds, tops, "leaves", levels).select(F.col("tree").alias("of"), F.col("at").alias("place"), "proof")
    found = placed.join(proofs, F.col("tree").eqNullSafe(F.col("of")) & (F.col("at") == F.col("place"))).drop("of", "place")
    found = found.join(own.select("of", "subroot"), F.col("tree").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "proof",
                        *[F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)])


def proof_digest(proof: Column | str) -> Column:
    """SHA-256 of the proof's digests, first step first."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: s["digest"])), 256)


def fold(leaf: Column | str, proof: Column | str) -> Column:
    """The root that ``leaf`` leads to along ``proof``."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    left = lambda s: F.when(s["side"] == "L", s["digest"]).otherwise(F.lit(""))     # noqa: E731
    right = lambda s: F.when(s["side"] == "R", s["digest"]).otherwise(F.lit(""))
    return F.aggregate(proof, leaf, lambda own, s: digest_of(left(s), own, right(s)))
