"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition.

Encoding: the text is cut by the vocabulary's split pattern; the distinct new
pieces of a slice of documents go into an in-memory DuckDB table as byte
tokens.  A recursive query unnests them to token-position rows, joins adjacent
pairs with the merge table and contracts every piece's leftmost pair of
minimum rank until no piece changes.  Decoding cuts the ids into short runs,
joins the token positions of the distinct new runs with
the vocabulary and concatenates by an ordered aggregation.

Spark partitions the documents; nothing is shuffled.  A worker's memory is
bounded: documents are handled in slices of ``SLICE_CHARS`` characters (a
longer document is a slice of its own), at most ``QUERY_PIECES`` pieces and
``QUERY_STEPS`` token positions over all steps enter one query, and the piece caches are emptied at
``CACHED_PIECES`` entries.  Contracting one pair at a time is quadratic in a piece's length, so a
piece of more than ``LONG_PIECE`` bytes is contracted by the same rule with a
heap of pairs instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from routeboard.llm.worker import hold
from routeboard.llm.words import slices

SLICE_CHARS = 4_000_000
QUERY_PIECES = 50_000
QUERY_STEPS = 40_000_000       # sum of squared piece lengths: what a query's steps may hold together
CACHED_PIECES = 300_000
CACHED_BYTES = 96              # longer pieces are not remembered
LONG_PIECE = 1_024
RUN_TOKENS = 2                 # tokens decoded together
MAX_VOCABULARY_BYTES = 64 << 20  # the broadcast's checked bound

ENCODE = """
WITH RECURSIVE step(word, toks, best) AS (
  SELECT word, toks, 0::BIGINT FROM words
  UNION ALL
  (WITH pairs AS (
     SELECT word, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[2:], 1) AS pos
     FROM step WHERE best IS NOT NULL AND len(toks) > 1),
   least AS (
     SELECT word, min((rank::BIGINT << 32) | pos) AS best
     FROM pairs JOIN merges ON pair = ((l::BIGINT << 32) | r) GROUP BY word)
   SELECT s.word,
          CASE WHEN least.best IS NULL THEN s.toks
               ELSE list_concat(list_append(s.toks[:(least.best & 4294967295) - 1], (least.best >> 32)::INTEGER),
                                s.toks[(least.best & 4294967295) + 2:]) END,
          least.best
   FROM step s LEFT JOIN least ON least.word = s.word WHERE s.best IS NOT NULL))
SELECT word, toks FROM step WHERE best IS NULL ORDER BY word
"""

DECODE = """
SELECT run, string_agg(bytes, '' ORDER BY pos) AS bytes
FROM (SELECT run, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM runs) JOIN vocabulary USING (id)
GROUP BY run
"""

WHOLE = "\x01"

# White_Space of Unicode, as the split pattern's \s means it
_SPACE = "\t-\r \x85\xa0  -     　"


def _ranges(category: str) -> str:
    """A character class body of all code points whose general category starts with ``category``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)).startswith(category)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def compile_pattern(pattern: str) -> re.Pattern:
    """The split pattern for the standard ``re``: \\p{L}, \\p{N} and \\s as explicit classes."""
    letters, numbers = _ranges("L"), _ranges("N")
    for outer in (r"[^\s\p{L}\p{N}]",):
        pattern = pattern.replace(outer, f"[^{_SPACE}{letters}{numbers}]")
    return re.compile(
        pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        .replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


def read_vocabulary(path: str) -> bytes:
    """The rank file's content (a line: base64 token, space, rank), checked before it is broadcast."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of more than {MAX_VOCABULARY_BYTES} bytes")
    return content


def _remember(known: dict, fresh: dict) -> None:
    if len(known) + len(fresh) > CACHED_PIECES:
        known.clear()
    known.update((k, v) for k, v in fresh.items() if len(k) <= CACHED_BYTES)


class Codec:
    """Encodes and decodes lists of strings with one in-memory DuckDB connection."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb

        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = compile_pattern(pattern)
        self.uneven = f"^[{_SPACE}]|[{_SPACE}]$|[{_SPACE}][{_SPACE}]|{WHOLE}"
        self.tokens = {r: t for t, r in ranks.items()}
        merges = {(ranks[t[:i]] << 32 | ranks[t[i:]]): r for t, r in ranks.items()
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        size = max(self.tokens) + 1
        self.opens = np.zeros(size, bool)
        self.opens[[r for t, r in ranks.items() if t[0] < 128 and not t[:1].isalpha()]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self._load("merges", pair=pa.array(merges.keys(), pa.int64()), rank=pa.array(merges.values(), pa.int32()))
        # a byte b is written as the character 256 + b, so any byte sequence is a valid string
        self._load("vocabulary", id=pa.array(self.tokens.keys(), pa.int32()),
                   bytes=pa.array(["".join(chr(256 + b) for b in t) for t in self.tokens.values()]))
        self.merges: dict[int, int] | None = None
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.runs: dict[bytes, bytes] = {}

    def _load(self, name: str, **columns) -> None:
        self.db.register("loading", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loading")
        self.db.unregister("loading")

    def _query(self, sql: str, name: str, **columns) -> pa.Table:
        self.db.register(name, pa.table(columns))
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def _contract_long(self, token_ids: list[int]) -> list[int]:
        """Leftmost pair of minimum rank first, with a heap; for one very long piece."""
        ids, n = list(token_ids), len(token_ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        if self.merges is None:     # only long pieces need the table outside DuckDB
            self.merges = dict(self.db.sql("SELECT pair, rank FROM merges").fetchall())
        merges = self.merges
        pair = lambda i: merges.get(ids[i] << 32 | ids[after[i]]) if i >= 0 and after[i] >= 0 else None
        heap = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or pair(i) != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = rank, -1, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        out, group, size = {}, [], 0
        def flush():
            flat = self.byte_ids[np.frombuffer(b"".join(e for _, e in group), np.uint8)]
            ends = np.cumsum([len(e) for _, e in group])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat))
            ids = self._query(ENCODE, "words", word=pa.array(range(len(group)), pa.int32()), toks=lists)["toks"]
            ids = ids.combine_chunks()
            data, offsets = ids.values.to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy() * 4
            out.update((p, data[a:b]) for (p, _), a, b in zip(group, offsets[:-1], offsets[1:], strict=True))
            group.clear()
        for piece in new:
            e = piece.encode()
            if len(e) > LONG_PIECE:
                ids = self._contract_long(self.byte_ids[np.frombuffer(e, np.uint8)].tolist())
                out[piece] = np.array(ids, "<u4").tobytes()
                continue
            group.append((piece, e))
            size += len(e) ** 2
            if len(group) >= QUERY_PIECES or size >= QUERY_STEPS:
                flush()
                size = 0
        if group:
            flush()
        return out

    def _expand(self, parts: pa.Array, known: dict, make, counts: np.ndarray) -> pa.Array:
        """Maps ``parts`` to bytes by ``make`` (asked only for distinct new ones) and joins ``counts`` of them a row."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = make([p for p in distinct if p not in known])
        values = pa.array([fresh[p] if p in fresh else known[p] for p in distinct], pa.binary())
        _remember(known, fresh)
        made = values.take(coded.indices).cast(pa.large_binary())
        starts = np.frombuffer(made.buffers()[1], np.int64, len(made) + 1, made.offset * 8)
        ends = starts[np.r_[0, np.cumsum(counts)]]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(counts), [None, pa.py_buffer(ends), made.buffers()[2]]).cast(pa.binary())

    def _encode_chunks(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks: ``WHOLE`` + piece stands for the piece, any other chunk for itself after a space."""
        # letters only: one piece, whatever the pattern
        split = {c: [" " + c] if c.isalpha() else self.pattern.findall(c[1:] if c[0] == WHOLE else " " + c) for c in new}
        distinct = {p for ps in split.values() for p in ps}
        fresh = self._encode_new([p for p in distinct if p not in self.pieces])
        ids = fresh | {p: self.pieces[p] for p in distinct if p not in fresh}
        _remember(self.pieces, fresh)
        return {c: b"".join([ids[p] for p in ps]) for c, ps in split.items()}

    def encode(self, texts: list[str]) -> pa.Array:
        """Per text its ids as little-endian unsigned 32-bit integers.

        A text whose only runs of white space are single characters between
        other characters is cut at its spaces first, as no piece then reaches
        over the next space; only distinct chunks meet the pattern.  Any other
        text is cut by the pattern as a whole.
        """
        rows = pa.array(texts, pa.large_string())
        even = pc.invert(pc.match_substring_regex(rows, self.uneven)).to_pylist()
        rows = pa.array([f"{WHOLE}{t}" if e and t else None for t, e in zip(texts, even, strict=True)], pa.large_string())
        chunks = pc.split_pattern(rows, " ")
        counts = pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = chunks.flatten()
        if not all(even):
            groups = iter(np.split(np.arange(len(parts)), np.cumsum(counts)[:-1]))
            lists = []
            for t, e, g in zip(texts, even, groups, strict=True):
                lists.append(parts.take(pa.array(g)) if e else
                             pa.array([WHOLE + p for p in self.pattern.findall(t)], pa.large_string()))
            counts = np.array([len(x) for x in lists], np.int64)
            parts = pa.concat_arrays(lists)
        return self._expand(parts, self.chunks, self._encode_chunks, counts)

    def _decode_new(self, new: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        while new:
            group, new = new[:QUERY_PIECES], new[QUERY_PIECES:]
            ends = np.cumsum([len(r) // 4 for r in group])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()),
                                           pa.array(np.frombuffer(b"".join(group), "<u4").astype(np.int32)))
            got = self._query(DECODE, "runs", run=pa.array(range(len(group)), pa.int32()), ids=ids)
            for run, text in zip(got["run"].to_pylist(), got["bytes"].to_pylist(), strict=True):
                out[group[run]] = text.encode("utf-16-le")[::2]
        return out

    def decode(self, encoded: list[bytes]) -> pa.Array:
        """Per sequence of ids (little-endian unsigned 32-bit) its bytes; an unknown id is an error."""
        data = b"".join(encoded)
        ids = np.frombuffer(data, "<u4")
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        starts = np.cumsum(sizes) - sizes
        opens = self.opens[ids]
        opens[starts[sizes > 0]] = True   # a run never reaches into the next document
        first = np.flatnonzero(opens)
        within = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
        at = np.flatnonzero(within % RUN_TOKENS == 0)
        counts = np.searchsorted(at, starts + sizes) - np.searchsorted(at, starts)
        runs = pa.BinaryArray.from_buffers(pa.binary(), len(at), [
            None, pa.py_buffer((np.r_[at, len(ids)] * 4).astype(np.int32)), pa.py_buffer(data)])
        return self._expand(runs, self.runs, self._decode_new, counts)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """The worker's codec for a vocabulary, built once per Python worker."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(content, pattern)
    return _codecs[key]


def forget_codecs() -> None:
    """Drops this worker's codecs with all they remember."""
    _codecs.clear()


def _apply(df: DataFrame, source: str, add: dict[str, T.DataType], content: bytes, pattern: str, work) -> DataFrame:
    """``df`` with the columns ``add`` (replacing columns of the same name), made by ``work(codec, values)``."""
    shared = df.sparkSession.sparkContext.broadcast(content)
    keep = [c for c in df.columns if c not in add]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, t) for c, t in add.items()])

    def run(batches):
        hold("bpe", forget_codecs)
        own = codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, source, SLICE_CHARS):
                made = work(own, part.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made,
                                                 names=keep + list(add))

    plan = df if source in keep else df.select("*")
    return plan.mapInArrow(run, schema)


def encode(df: DataFrame, content: bytes, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds ``into``: the token ids of ``text`` packed as little-endian unsigned 32-bit integers.

    NULL and empty texts have no tokens (an empty value).  Every row is kept,
    repeated ones too; a column already called ``into`` is replaced.
    """
    return _apply(df, text, {into: T.BinaryType()}, content, pattern,
                  lambda own, texts: [own.encode([t or "" for t in texts])])


def decode(df: DataFrame, content: bytes, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into``: the bytes of the packed ``ids``; NULL ids decode to no bytes."""
    return _apply(df, ids, {into: T.BinaryType()}, content, pattern,
                  lambda own, packed: [own.decode([p or b"" for p in packed])])


def round_trip(df: DataFrame, content: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: adds ``ids`` and ``decoded``."""
    def work(own: Codec, texts):
        ids = own.encode([t or "" for t in texts])
        return [ids, own.decode(ids.to_pylist())]

    return _apply(df, text, {"ids": T.BinaryType(), "decoded": T.BinaryType()}, content, pattern, work)
