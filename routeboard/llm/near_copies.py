"""N-gram Jaccard join: documents whose 5-word shingle sets share 75 % of their union.

Prefix filtering.  All shingles are ordered rare first, by their cell in a
sketch of document counts (fixed width) and their hash.  Two linked sets
share a shingle among the first ``n - ceil(0.75 n) + 1`` of each, so only
these prefixes are shuffled and joined.  Documents with equal sets are one
class there, wherever their copies are.  Candidates must pass

* the length filter (the smaller set has at least 75 % of the larger),
* the positional filter (what follows the shared shingle in both orders is
  still long enough), and
* the suffix filter: both sets' counts per hash range bound the intersection
  from above.  The survey leaves a byte for about every three hashes, so the
  filter moves a twenty-fourth of a set and comes before any set is made or
  shuffled.

Each surviving pair of classes is verified once, exactly.

Groups of copies.  In a prefix shingle's list every class is first paired with
one hub, its smallest class.  In the rounds after that the classes outside the
list's largest component are paired with a fixed number of its members, more
of them each round as fewer classes are left: a list of n near copies costs a
multiple of n pairs, not n squared.  (In a loose group most pairs miss the
threshold that some pass, so one hub leaves many of its classes alone; each
further hub takes its share of them.)  A list no longer than twice a round's
hubs is compared in full instead and is done, as is one within one component:
the next round reads only the other lists, and the rounds end when there are
none.  At the end every pair of theirs whose classes are still in different
components is compared, so no link between two components is lost.

Link counts.  Every link lies within a component, so once the components are
known each of them is cut into slices of about ``TILE`` classes and at most
about ``TILE_BYTES`` of sets (by a hash)
and every pair of slices is compared in one tile: a sparse incidence matrix of
the shingles that stand in two sets or more, multiplied with itself, gives all
intersections exactly.  A tile sends one number a class, not its pairs.

Empty sets (no word, NULL text) link with nothing.  Repeated rows are copies.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeboard.llm.links import components
from routeboard.llm.worker import hold
from routeboard.llm.words import NEAR_PERCENT, NEAR_WORDS, forget_words, mix, shingle_set
from routeboard.sources.storage import release, write_and_reload

CELLS = 1 << 20          # counters of the document-count sketch; bounds its broadcast to 4 MB
SLICES = 16              # the sketch is summed in slices
MAX_BITS = 1 << 28       # bitmap of candidate ids: 32 MB at most
TILE = 512               # classes in a slice of a component, when its links are counted
TILE_BYTES = 16 << 20    # bytes of sets in a slice
CELLS_AT_ONCE = 1 << 24  # matrix cells (sets x shingles) multiplied at a time: 64 MB
HUBS = (4, 16, 64)       # by round: members of a list's largest component that its other classes are paired with


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set; equal sets have equal keys."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def range_counts(shingles: np.ndarray) -> bytes:
    """A set's hashes counted by ranges, two to four a range on average (a power of two of ranges, a byte each).

    Empty, which filters nothing, for fewer than four hashes or where a count does not fit a byte.
    """
    bits = (len(shingles) // 2).bit_length() - 1
    if bits < 1:
        return b""
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(x: bytes, y: bytes) -> bool:
    """Suffix filter: whether two sets' range counts leave an intersection of ``NEAR_PERCENT`` of the union possible."""
    if not x or not y:
        return True
    a, b = sorted((np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)), key=len)
    b = b.reshape(len(a), -1).sum(axis=1)   # the finer ranges divide the coarser ones
    shared = int(np.minimum(a, b).sum())
    return 100 * shared >= NEAR_PERCENT * (int(a.sum() + b.sum()) - shared)


def required(n: int) -> int:
    """Least intersection of a linked pair in which one set has ``n`` shingles."""
    return -(-NEAR_PERCENT * n // 100)


def _ids(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """One pass: a row (doc_id, n_shingles, class, ranges) for each document and sketch slices of each task."""
    def run(batches):
        hold("words", forget_words)
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t, width)
                np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
                rows.append((len(s), class_of(s), range_counts(s)))
            if rows:
                n, keys, ranges = zip(*rows, strict=True)
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(ranges, pa.binary()),
                                       pa.nulls(len(rows), pa.int32()), *[pa.nulls(len(rows), pa.binary())] * 2], names=_SURVEY)
        # only the cells that this task has met: what is sent grows with its texts, not with the tasks
        parts = [(np.flatnonzero(x).astype("<u2"), x[x > 0].astype("<u4")) for x in np.split(counts, SLICES)]
        yield pa.record_batch([*[pa.nulls(SLICES, pa.int64())] * 3, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()),
                               pa.array([x.tobytes() for x, _ in parts], pa.binary()), pa.array([n.tobytes() for _, n in parts], pa.binary())],
                              names=_SURVEY)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class long, ranges binary, slice int, cells binary, counts binary")


_SURVEY = ["doc_id", "n_shingles", "class", "ranges", "slice", "cells", "counts"]


def _sketch(survey: DataFrame) -> np.ndarray:
    """The tasks' slices added up: streamed per slice, ``CELLS`` numbers in all."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(k, np.zeros(CELLS // SLICES, np.uint64))
                own[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<u4")
        if sums:
            packed = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()]
            yield pa.record_batch([pa.array(sums, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])

    slices = (survey.where("slice IS NOT NULL").select("slice", "cells", "counts").repartition(SLICES, "slice")
              .mapInArrow(add, "slice int, counts binary").collect())
    return np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in sorted(slices, key=lambda r: r["slice"])])


def _prefix_rows(docs: DataFrame, sketch: np.ndarray, width: int, buckets: int) -> DataFrame:
    """Prefix postings packed per bucket: gram, class, set size and position."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        hold("words", forget_words)
        counts = shared.value
        for batch in batches:
            seen: set[int] = set()
            parts = []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t, width)
                if not len(s) or (key := class_of(s)) in seen:
                    continue
                seen.add(key)
                n = len(s)
                order = np.lexsort((s, counts[(s >> np.uint64(44)).astype(np.int64)]))[: n - required(n) + 1]
                row = np.zeros(len(order), _POSTING)
                row["gram"], row["class"], row["n"], row["pos"] = s[order], key, n, np.arange(len(order))
                parts.append(row)
            if parts:
                rows = np.concatenate(parts)
                at = (rows["gram"] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(at, kind="stable")
                used, starts = np.unique(at[order], return_index=True)
                packed = [x.tobytes() for x in np.split(rows[order], starts[1:])]
                yield pa.record_batch([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "postings"])

    return docs.select("text").mapInArrow(run, "bucket int, postings binary")


_POSTING = np.dtype([("gram", "<u8"), ("class", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def _possible(n1, n2, pos1, pos2):
    """Length and positional filter (all arguments numpy arrays or numbers, n1 <= n2)."""
    least = (NEAR_PERCENT * (n1 + n2) + 99 + NEAR_PERCENT) // (100 + NEAR_PERCENT)
    return (100 * n1 >= NEAR_PERCENT * n2) & (1 + np.minimum(n1 - pos1 - 1, n2 - pos2 - 1) >= least)


def _shared_grams(key, sent):
    """Postings whose gram stands in two classes or more, each with its list's hub (the smallest class)."""
    rows = np.concatenate([np.frombuffer(x, _POSTING) for x in sent["postings"].to_pylist()])
    rows = rows[np.lexsort((rows["class"], rows["gram"]))]
    same = rows["gram"][1:] == rows["gram"][:-1]
    rows = rows[np.r_[True, ~(same & (rows["class"][1:] == rows["class"][:-1]))]]
    new = np.r_[True, rows["gram"][1:] != rows["gram"][:-1]]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(rows)])
    hub, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    rows, hub, size = rows[size > 1], rows[hub[size > 1]], size[size > 1]
    small, large = np.where(rows["n"] <= hub["n"], rows, hub), np.where(rows["n"] <= hub["n"], hub, rows)
    wide = lambda x: x.astype(np.int64)
    ok = _possible(wide(small["n"]), wide(large["n"]), wide(small["pos"]), wide(large["pos"])) & (rows["class"] != hub["class"])
    return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "gram": pa.array(rows["gram"].astype(np.int64)),
                     "class": pa.array(rows["class"], pa.int64()), "n": pa.array(rows["n"], pa.int64()),
                     "pos": pa.array(rows["pos"], pa.int64()), "hub": pa.array(hub["class"], pa.int64()),
                     "size": pa.array(size, pa.int64()), "candidate": pa.array(ok)})


def _lists(rows):
    """A bucket's postings by gram and set size, and where each gram's list starts and ends."""
    gram, cls, n, pos, top = (rows[c].to_numpy() for c in ("gram", "class", "n", "pos", "top"))
    order = np.lexsort((cls, n, gram))
    gram = gram[order]
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    return gram, cls[order], n[order], pos[order], top[order], zip(starts, np.r_[starts[1:], len(gram)], strict=True)


def _pair_table(found: list[np.ndarray]) -> pa.Table:
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _pairs_of(cls, n, pos, top, i: int, j: np.ndarray) -> np.ndarray:
    """The possible pairs of row ``i`` with rows ``j`` of its list that are in another component."""
    small, large = np.where(n[j] <= n[i], j, i), np.where(n[j] <= n[i], i, j)
    j = j[(top[j] != top[i]) & _possible(n[small], n[large], pos[small], pos[large])]
    return np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1)


def _in_full(cls, n, pos, top, a: int, b: int) -> list[np.ndarray]:
    """All candidate pairs of the list ``a:b`` (sets of ascending size: partners are a run after each)."""
    ends = a + np.searchsorted(n[a:b], 100 * n[a:b] // NEAR_PERCENT, side="right")
    return [_pairs_of(cls, n, pos, top, i, np.arange(i + 1, ends[i - a])) for i in range(a, b - 1)]


def _to_hubs(hubs_a_list: int):
    """Candidate pairs of each list's classes with ``hubs_a_list`` members of its largest component, and the lists to go on with.

    Pairs fill ``a`` and ``b``; the postings of lists that are not done fill the other columns.
    """
    def candidates(key, rows):
        gram, cls, n, pos, top, lists = _lists(rows)
        ranks = mix(cls.view(np.uint64) + np.uint64(hubs_a_list))
        found, left = [], [np.zeros(0, np.int64)]
        for a, b in lists:
            tops, at, sizes = np.unique(top[a:b], return_inverse=True, return_counts=True)
            if len(tops) == 1:
                continue
            if b - a <= 2 * hubs_a_list:
                found += _in_full(cls, n, pos, top, a, b)
                continue
            inside = a + np.flatnonzero(at == np.argmax(sizes))
            hubs = inside[np.argsort(ranks[inside], kind="stable")[:hubs_a_list]]
            found += [_pairs_of(cls, n, pos, top, i, np.arange(a, b)) for i in hubs]
            left.append(np.arange(a, b))
        pairs, left = _pair_table(found), np.concatenate(left)
        rest = pa.table({"bucket": pa.array([key[0].as_py()] * len(left), pa.int32()), "gram": pa.array(gram[left], pa.int64()),
                         "class": pa.array(cls[left], pa.int64()), "n": pa.array(n[left], pa.int64()), "pos": pa.array(pos[left], pa.int64())})
        return pa.concat_tables([pairs, rest], promote_options="default").select(_ROUND)

    return candidates


_ROUND = ["a", "b", "bucket", "gram", "class", "n", "pos"]


def _across(key, rows):
    """All candidate pairs of a bucket whose classes are in different components."""
    gram, cls, n, pos, top, lists = _lists(rows)
    found = [p for a, b in lists if (top[a:b] != top[a]).any() for p in _in_full(cls, n, pos, top, a, b)]
    pairs = _pair_table(found)
    return pa.concat_tables([pairs, pa.table({"bucket": pa.array([], pa.int32())} | {c: pa.array([], pa.int64()) for c in _ROUND[3:]})],
                            promote_options="default").select(_ROUND)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share ``NEAR_PERCENT`` of their union."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= NEAR_PERCENT * (len(both) - shared)


def _sets(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(class, shingles) of the wanted classes (class, first_id), a written table; further rows and classes that share a bit come along."""
    spark = docs.sparkSession
    # a bitmap of the candidates' ids spares the other documents
    slots = 1 << 20
    n = wanted.count()
    while slots < min(MAX_BITS, 16 * n):
        slots *= 2
    # bitmap functions number from 1: value s is bit s - 1
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    maps = (wanted.select((slot("first_id") + 1).alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("k"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits")).collect())
    marks = bytearray(slots // 8)
    for r in maps:
        marks[(r["k"] - 1) * 4096:r["k"] * 4096] = r["bits"]
    shared = spark.sparkContext.broadcast(bytes(marks))

    def make(batches):
        hold("words", forget_words)
        marks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column("slot").to_numpy()
            hit = np.flatnonzero((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(hit):
                sets = [shingle_set(t, width) for t in batch.column("text").take(pa.array(hit)).to_pylist()]
                yield pa.record_batch([pa.array([class_of(x) for x in sets], pa.int64()),
                                       pa.array([x.tobytes() for x in sets], pa.binary())], names=["class", "shingles"])

    sets = (docs.where("doc_id IS NOT NULL").withColumn("slot", slot("doc_id"))
            .select("text", "slot").mapInArrow(make, "class long, shingles binary"))
    return write_and_reload(sets, "near-sets")


def _passing(pairs: DataFrame, sides: DataFrame, value: str, test, name: str) -> DataFrame:
    """The pairs (a, b) whose two classes' values pass ``test``, written; ``sides`` has one row a class."""
    def run(batches):
        for batch in batches:
            keep = [test(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return write_and_reload(
        pairs.join(sides.select(F.col("class").alias("a"), F.col(value).alias("x")), "a")
        .join(sides.select(F.col("class").alias("b"), F.col(value).alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), name)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The linked pairs (a, b of classes), written.  Sets are made for one document of each class that the suffix filter leaves a pair."""
    met = write_and_reload(_ends(pairs).join(classes.select("class", "first_id", "ranges"), "class"), "near-met")
    possible = _passing(pairs, met, "ranges", may_link, "near-possible")
    wanted = write_and_reload(_ends(possible).join(met.select("class", "first_id"), "class"), "near-candidates")
    # one row a class: false hits fall out, and second copies do not meet the pairs again and again
    sets = _sets(wanted, docs, width)
    kept = sets.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])
    exact = lambda x, y: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
    links = _passing(possible, kept, "shingles", exact, "near-links")
    release(met, possible, wanted, sets)
    return links


def _links_in(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Which of the first ``left`` sets are linked with which of the others; ``left`` 0: all with all (not with themselves)."""
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    same = hashes[1:] == hashes[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    new = np.r_[True, ~same]
    column, owner = (np.cumsum(new & shared) - 1)[shared], owner[shared]
    rows, others = (slice(0, left), slice(left, None)) if left else (slice(None), slice(None))
    n = np.array([len(x) for x in sets])
    both = np.zeros((len(n[rows]), len(n[others])), np.int64)
    wide = max(1, CELLS_AT_ONCE // len(sets))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, (start, start + wide))
        m = np.zeros((len(sets), int(column[b - 1]) - start + 1), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        both += (m[rows] @ m[others].T).astype(np.int64)   # at most 2**24 a product: exact in a float's 24 bits
    out = 100 * both >= NEAR_PERCENT * (n[rows][:, None] + n[others][None, :] - both)
    if not left:
        np.fill_diagonal(out, False)
    return out


def _count_links(batches):
    """Per class of each tile the members of the classes of the tile that it is linked with.

    The rows come sorted by tile and side; one tile is held at a time.
    """
    def counted(tile, rows):
        cls, side, weight, sets = zip(*rows, strict=True)
        weight, left = np.array(weight, np.int64), 0
        if tile[1] != tile[2]:
            left = side.count(tile[1])
            if left in (0, len(side)):   # a slice without classes
                return None
        hit = _links_in([np.frombuffer(x, np.uint64) for x in sets], left)
        links = hit @ weight if not left else np.r_[hit @ weight[left:], weight[:left] @ hit]
        return pa.record_batch([pa.array(cls, pa.int64()), pa.array(links, pa.int64())], names=["class", "n"])

    tile, rows = None, []
    for batch in batches:
        for top, low, high, side, cls, weight, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (top, low, high) != tile:
                if rows and (out := counted(tile, rows)) is not None:
                    yield out
                tile, rows = (top, low, high), []
            rows.append((cls, side, weight, shingles))
    if rows and (out := counted(tile, rows)) is not None:
        yield out


def _link_counts(docs: DataFrame, classes: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(class, n), written: for each class of a component of several classes, the rows of other classes it is linked with."""
    inside = classes.join(groups, "class").select("class", "first_id", "members", "n", F.col("component_id").alias("top"))
    cut = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(8 * F.sum("n") / TILE_BYTES))
    slices = inside.groupBy("top").agg(cut.cast("int").alias("slices"))
    inside = write_and_reload(
        inside.join(slices, "top").withColumn("side", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int")), "near-inside")
    sets = _sets(inside.select("class", "first_id"), docs, width)
    tiles = (sets.join(inside, "class").dropDuplicates(["class"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
             .select("top", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "class", "members", "shingles"))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = write_and_reload(
        tiles.repartition(parts, "top", "low", "high").sortWithinPartitions("top", "low", "high", "side")
        .mapInArrow(_count_links, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")), "near-counts")
    release(inside, sets)
    return counts


def _same_id(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the classes with the same first id (rows that share an id), written."""
    shared = classes.groupBy("first_id").agg(F.min("class").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return write_and_reload(classes.join(shared, "first_id").where("class <> a").select("a", F.col("class").alias("b")), "near-same-id")


def _named(tops: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, component_id), written: the smallest first id of each component that has several."""
    inside = tops.select(F.col("id").alias("class"), F.col("component_id").alias("top")).join(classes.select("class", "first_id"), "class")
    least = inside.groupBy("top").agg(F.min("first_id").alias("component_id"), F.max("first_id").alias("last")).where("component_id < last")
    return write_and_reload(inside.join(least, "top").select("class", "component_id"), "near-components")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def near_copies(df: DataFrame, width: int = NEAR_WORDS, doc_id: str = "doc_id", text: str = "text", count_links: bool = True) -> DataFrame:
    """Per row of ``df``: doc_id, n_shingles, class_id (smallest id with the same set), n_links (the other rows that
    it is linked with, copies included) and component_id (smallest id reachable by links, itself included).

    Rows with a NULL id take part in no link; their component is NULL.  Without ``count_links`` there is no
    column n_links, and only the links that connect the components are looked for.
    """
    docs = _ids(df, doc_id, text)
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    survey = write_and_reload(_survey(docs, width), "near-survey")
    sketch = _sketch(survey)
    members = survey.where("slice IS NULL").select("doc_id", "n_shingles", "class", "ranges")
    classes = write_and_reload(
        members.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("members"), F.max("n_shingles").alias("n"),
            F.min("ranges").alias("ranges")), "near-classes")

    shared = write_and_reload(
        _prefix_rows(docs.where("doc_id IS NOT NULL"), sketch, width, buckets).groupBy("bucket").applyInArrow(
            _shared_grams, "bucket int, gram long, class long, n long, pos long, hub long, size long, candidate boolean"),
        "near-shared")
    to_hub = write_and_reload(
        shared.where("candidate").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct(), "near-pairs")
    links, tried = [_verified(to_hub, docs, classes, width)], [to_hub]
    same_id = _same_id(classes)
    tops = components(_all([*links, same_id]), "a", "b")
    before = shared
    longer = shared.where("size > 2").select("bucket", "gram", "class", "n", "pos")
    for candidates in (*map(_to_hubs, HUBS), _across):
        if longer.isEmpty():
            break
        top = tops.select(F.col("id").alias("class"), F.col("component_id").alias("top"))
        found = write_and_reload(
            longer.join(top, "class", "left").withColumn("top", F.coalesce("top", "class"))
            .groupBy("bucket").applyInArrow(candidates, "a long, b long, bucket int, gram long, class long, n long, pos long"),
            "near-round")
        release(before)                  # what a later step reads is written by now
        before, longer = found, found.where("a IS NULL").select("bucket", "gram", "class", "n", "pos")
        pairs = write_and_reload(
            found.where("a IS NOT NULL").select("a", "b").distinct().join(_all(tried), ["a", "b"], "left_anti"), "near-pairs")
        if not pairs.isEmpty():
            links.append(_verified(pairs, docs, classes, width))
            tried.append(pairs)
            release(tops)
            tops = components(_all([*links, same_id]), "a", "b")
    groups = _named(tops, classes)
    release(before, tops, same_id, *links, *tried)
    labelled = classes.drop("n", "ranges").join(groups, "class", "left")
    columns = ["doc_id", "n_shingles",
               F.when(F.col("n_shingles") > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("class_id"),
               F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
               .when(F.col("n_shingles") > 0, F.coalesce("component_id", "first_id"))
               .otherwise(F.col("doc_id")).alias("component_id")]
    if count_links:
        labelled = labelled.join(_link_counts(docs, classes, groups, width), "class", "left")
        n_links = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("members") - 1 + F.coalesce("n", F.lit(0)))
        columns.insert(3, F.coalesce(n_links, F.lit(0)).cast("long").alias("n_links"))
    return members.join(labelled, "class", "left").select(*columns)
