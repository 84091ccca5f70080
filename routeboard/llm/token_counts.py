"""Token counts of whole texts by a byte-level BPE file of the tokenizers library.

Whole-token shortcut.  Before any text is read the driver proves which strings
of the vocabulary the tokenizer turns into exactly one token when they stand
alone: the string must be one pre-token, and its merges must end in the one
token.  The proven strings go to the tasks (their size is checked).  There a
text is cut into pre-tokens; each one that is proven counts one at once, and
only the rest is merged, once per distinct string while it is remembered.

Pre-tokens follow the library's rule.  Which characters are letters, numbers
or spaces is the library's own Unicode version, not that of our pattern
engine: every character that a worker meets for the first time (outside ASCII)
is put to the library, and where the two disagree the pattern is corrected.

Special tokens are found inside texts as the library does by default: each
occurrence of an added token counts one and parts the text around it.  No
begin, end or other tokens are added; nothing is truncated or padded.

Nothing is shuffled.  A worker's memory is bounded: remembered strings take at
most ``REMEMBERED_BYTES``, and texts are read pre-token by pre-token, so a very
long one needs no more than its own characters.

Defined cases: NULL counts like the empty text (no bytes, no tokens); repeated
rows are counted each; an empty table gives an empty result; all columns of the
input stay, except that an own ``n_bytes`` or ``n_tokens`` is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENIZER_BYTES = 64 << 20   # checked bound of what is sent to the tasks
REMEMBERED_BYTES = 24 << 20      # merged strings that a worker remembers (with their overhead)
ENTRY_BYTES = 100                # a remembered string's overhead


def _tokenizer(content: str):
    import tokenizers

    return tokenizers.Tokenizer.from_str(content)


def check_supported(content: str) -> list[str]:
    """The added tokens of a tokenizer file; an error if it is not plain byte-level BPE."""
    spec = json.loads(content)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space") and model.get("type") == "BPE"
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")))
    added = spec.get("added_tokens") or []
    if not plain or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only plain byte-level BPE files with unnormalised added tokens are supported")
    return [t["content"] for t in added]


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Fixed rule: printable Latin-1 characters stand for themselves, the other
    bytes are numbered from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Splitter:
    """Cuts texts into pre-tokens as the library does, whatever the pattern engine's Unicode version."""

    def __init__(self, tokenizer):
        self._pre = tokenizer.pre_tokenizer
        self._known: set[str] = {chr(c) for c in range(128)}
        self._as: dict[str, set[str]] = {"L": set(), "N": set(), "s": set(), "": set()}   # corrected characters by class
        self._own = {k: regex.compile(p) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s"))}
        self._compile()

    def _compile(self) -> None:
        wrong = "".join(regex.escape(c) for cs in self._as.values() for c in sorted(cs))

        def members(kind: str, base: str) -> str:
            more = "".join(regex.escape(c) for c in sorted(self._as[kind]))
            return f"(?:[{more}]|(?![{wrong}]){base})" if more else f"(?:(?![{wrong}]){base})" if wrong else base

        L, N, s = members("L", r"\p{L}"), members("N", r"\p{N}"), members("s", r"\s")
        other = f"(?:(?!{L}|{N}|{s})[\\S\\s])" if wrong else r"[^\s\p{L}\p{N}]"
        last = f"{s}+(?!(?!{s})[\\S\\s])" if wrong else r"\s+(?!\S)"
        # fixed value: the split rule of byte-level vocabularies of this kind
        self._pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{other}+|{last}|{s}+")

    def _class_in_library(self, c: str) -> str:
        """``L``, ``N``, ``s`` or nothing: what the library joins ``c`` with."""
        for kind, mate in (("L", "a"), ("N", "1"), ("", "!")):
            if len(self._pre.pre_tokenize_str(mate + c)) == 1:
                return kind
        return "s"

    def learn(self, text: str) -> None:
        """Puts the characters that are new to this worker to the library."""
        if text.isascii():
            return
        new = set(text) - self._known
        if not new:
            return
        self._known |= new
        odd = False
        for c in new:
            kind = self._class_in_library(c)
            if kind != next((k for k, p in self._own.items() if p.fullmatch(c)), ""):
                self._as[kind].add(c)
                odd = True
        if odd:
            self._compile()

    def pieces(self, text: str) -> Iterator[str]:
        self.learn(text)
        if len(text) < 1_000_000:
            return iter(self._pattern.findall(text))
        return (m.group() for m in self._pattern.finditer(text))   # the same pieces, one at a time


class Remembered(dict):
    """What is known of pre-tokens: ``start`` for good, the rest merged by the library and remembered within bounds."""

    def __init__(self, tokenizer, start: dict):
        super().__init__(start)
        self._start, self._model, self._letters, self._bytes = start, tokenizer.model, byte_letters(), 0

    def value(self, tokens: list):
        """What to remember of a pre-token's tokens."""
        raise NotImplementedError

    def __missing__(self, piece: str):
        raw = piece.encode()
        value = self.value(self._model.tokenize(raw.decode("latin-1").translate(self._letters)))
        size = ENTRY_BYTES + len(raw)
        if size <= REMEMBERED_BYTES // 1000:
            self._bytes += size
            if self._bytes > REMEMBERED_BYTES:
                self.clear()
                self.update(self._start)
                self._bytes = size
            self[piece] = value
        return value


class _Lengths(Remembered):
    """Tokens of a pre-token: 1 for the proven ones."""

    def __init__(self, tokenizer, proven):
        super().__init__(tokenizer, dict.fromkeys(proven, 1))

    def value(self, tokens: list) -> int:
        return len(tokens)


def whole_tokens(content: str) -> list[str]:
    """The vocabulary strings that encode alone as one token, proven by encoding each of them."""
    tokenizer = _tokenizer(content)
    special = set(check_supported(content))
    values = {c: b for b, c in byte_letters().items()}
    splitter, proven = Splitter(tokenizer), []
    for entry in json.loads(content)["model"]["vocab"]:
        try:
            text = bytes(values[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):   # a part of a character never is a pre-token
            continue
        if any(s in text for s in special) or len(list(splitter.pieces(text))) != 1:
            continue
        if [t.value for t in tokenizer.model.tokenize(entry)] == [entry]:
            proven.append(text)
    return proven


class Counter:
    """Counts the tokens of texts in one worker."""

    def __init__(self, content: str, proven: list[str]):
        tokenizer = _tokenizer(content)
        self._special = check_supported(content)
        self._splitter = Splitter(tokenizer)
        self._lengths = _Lengths(tokenizer, proven)
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self._special, key=len, reverse=True)))) if self._special else None

    def count(self, text: str) -> int:
        parts, n = [text], 0
        if self._cut and any(s in text for s in self._special):
            parts = self._cut.split(text)
            n = len(parts) - 1
        lengths = self._lengths.__getitem__
        return n + sum(sum(map(lengths, self._splitter.pieces(p))) for p in parts if p)


_counters: dict[str, Counter] = {}     # one tokenizer at a time per worker


def count_tokens(df: DataFrame, content: str, text: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """The ``columns`` of ``df`` (all by default) with ``n_bytes`` (UTF-8) and ``n_tokens`` of its column ``text``.

    ``content`` is a tokenizer file (JSON).
    """
    proven = whole_tokens(content)
    size = len(content.encode()) + sum(len(p.encode()) + ENTRY_BYTES for p in proven)
    if size > MAX_TOKENIZER_BYTES:
        raise ValueError(f"the tokenizer takes {size} bytes; the bound is {MAX_TOKENIZER_BYTES}")
    shared = df.sparkSession.sparkContext.broadcast((content, proven))
    key = sha256(content.encode()).hexdigest()
    kept = [c for c in (df.columns if columns is None else columns) if c.lower() not in ("n_bytes", "n_tokens")]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    fields = [*[quoted(c).alias(f"c{k}") for k, c in enumerate(kept)], quoted(text).cast("string").alias("counted")]
    if text in kept:                       # a text crosses to Python once
        fields[kept.index(text)] = F.lit(None).cast("string").alias(f"c{kept.index(text)}")

    def run(batches):
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(*shared.value)
        count = _counters[key].count
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column("counted").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])

    rows = df.select(*fields)
    sizes = F.coalesce(F.octet_length("counted"), F.lit(0)).cast("long").alias("n_bytes")
    counted = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", n long")
    return counted.select(*[F.col("counted" if c == text else f"c{k}").alias(c) for k, c in enumerate(kept)], sizes, F.col("n").alias("n_tokens"))
