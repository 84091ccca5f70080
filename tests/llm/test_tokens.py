"""Token counts, cross-tokenizer alignment and the Merkle manifest against the libraries and brute force."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeboard.llm import alignment, merkle, registry, token_counts
from tools.check_oracle import compare, register_views

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that the operators use themselves
                       *[T.StructField(c, T.StringType()) for c in ("row", "counted", "n_tokens", "block", "pair", "tree", "at", "place", "_part", "digest", "c0")]])
TEXTS = [None, "", " ", "\n\t ", "one two", "one two", "don't we'll  stop  ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endo", "<s> <unk> <0x41> ▁",
         "é ß 日本語 🙂 中文字 ½ Ⅷ", "a\u0000b c", "▁x", "ab" * 3000, "x" * 5000, "word " * 4000, "tabs\tand  runs   of    spaces\n\n\nend ",
         "\U00016D40 ࢏ ౜ odd letters", "1234567890 12 3", "'s 't 'LL", " nb　sp\u0085nel\u001cfs", "one two three four five six"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i * 3, t, [None, "en", "fr", "日"][i % 4], None if i % 5 == 0 else f"s{i % 3}", None if i % 6 == 0 else i, *["x"] * 11)
            for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[9], (None, "one two", None, None, None, *["x"] * 11)]      # repeated rows, copies, NULL ids
    rows += [(1000 + i, "a copy that a third of all rows hold", "en", "hot", 5, *["x"] * 11) for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_str(registry.public_file("byte_bpe_50k.json").decode())


# --- token counts -----------------------------------------------------------------

def test_counts_equal_the_library(docs, empty):
    own, content = library(), registry.public_file("byte_bpe_50k.json").decode()
    got = token_counts.count_tokens(docs, content)
    assert got.columns == [c for c in docs.columns if c != "n_tokens"] + ["n_bytes", "n_tokens"]
    assert got.count() == docs.count()
    for r in got.collect():
        assert r["n_tokens"] == len(own.encode(r["text"] or "", add_special_tokens=False).ids), r["text"]
        assert r["n_bytes"] == len((r["text"] or "").encode())
        assert r["counted"] == r["block"] == "x"
    assert token_counts.count_tokens(empty, content, columns=["doc_id"]).collect() == []


def test_counts_of_random_characters():
    own, content = library(), registry.public_file("byte_bpe_50k.json").decode()
    counter = token_counts.Counter(content, token_counts.whole_tokens(content))
    rng = random.Random(11)
    pool = [*"ab 1!'sS\n\t\r　 é中🙂\U00016D40౜՘ि", "<|endoftext|>", "'ll", "<|endo"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x32000)]))
                       for _ in range(rng.randrange(1, 14)))
        assert counter.count(text) == len(own.encode(text, add_special_tokens=False).ids), text


def test_proof_of_whole_tokens():
    own, content = library(), registry.public_file("byte_bpe_50k.json").decode()
    proven = token_counts.whole_tokens(content)
    assert len(proven) > 45_000 and " the" in proven
    for e, p in zip(own.encode_batch(proven[::7], add_special_tokens=False), proven[::7], strict=True):
        assert len(e.ids) == 1, p
    # strings that are not one pre-token are no shortcut, whatever the vocabulary holds
    splitter = token_counts.Splitter(own)
    assert all(len(list(splitter.pieces(p))) == 1 for p in proven[::50])


def test_remembered_strings_are_bounded(monkeypatch):
    content = registry.public_file("byte_bpe_50k.json").decode()
    monkeypatch.setattr(token_counts, "REMEMBERED_BYTES", 100_000)
    counter = token_counts.Counter(content, [" the"])
    text = " ".join(f"w{i}x{i * 7}" for i in range(5000)) + " the"
    assert counter.count(text) == len(library().encode(text, add_special_tokens=False).ids)
    assert len(counter._lengths) < 1200


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.check_supported(registry.public_file("word_bpe_49k.json").decode())


def test_token_count_query(spark):
    own = library()
    texts = {r["doc_id"]: r["text"] for r in registry.table(spark, SF, "documents").collect()}
    got = registry.op13_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(own.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)


# --- alignment ----------------------------------------------------------------------

def brute_force(rows):
    """(doc_id, measures) of every row, by comparing all token ranges of a text."""
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    values = {c: k for k, c in token_counts.byte_letters().items()}

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out
    found, counts = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        parts_a = [bytes(values[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            found.append((doc_id, None))
            continue
        sa, sb = spans(parts_a), spans(parts_b)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, s in zip(ids_a, sa, strict=True) if start <= s[0] < end) + "|"
                          + ",".join(str(i) for i, s in zip(ids_b, sb, strict=True) if start <= s[0] < end))
            start = end
        first, links = 0, []
        for i, x in zip(ids_a, sa, strict=True):
            while sb[first][1] <= x[0]:
                first += 1
            k = first
            while k < len(sb) and sb[k][0] < x[1]:
                links.append((i, ids_b[k]))
                k += 1
        counts.update(set(links))
        found.append((doc_id, (len(ids_a), len(ids_b), groups, links)))
    highest = {}
    for (i, _), n in counts.items():
        highest[i] = max(highest.get(i, 0), n)
    return [(d, 0, 0, 0, 0, 0, 0, "") if x is None else
            (d, x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == highest[p[0]] for p in x[3]), sum(counts[p] for p in x[3]),
             sha256(";".join(x[2]).encode()).hexdigest()) for d, x in found]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def vocabularies():
    return registry.public_file("byte_bpe_50k.json").decode(), registry.public_file("piece_bpe_32k.model")


def test_alignment_equals_brute_force(docs, empty):
    expected = ordered(brute_force([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert ordered(alignment.align_corpus(docs, *vocabularies()).collect()) == expected
    assert sum(r[1] > 0 for r in expected) > 20 and any(r[1] == 0 and r[0] is not None for r in expected)
    assert alignment.align_corpus(empty, *vocabularies()).collect() == []


def test_small_blocks_and_slices(docs):
    a, b = alignment.byte_level_side(vocabularies()[0]), alignment.piece_side(vocabularies()[1])
    texts = [t for t in TEXTS if t]
    whole = list(alignment.align(texts, a, b))
    for t, x in zip(texts, whole, strict=True):
        (y,) = alignment.align([t], a, b)
        assert (x is None) == (y is None)
        if x is not None:
            assert x[:4] == y[:4] and x[4].tolist() == y[4].tolist() and x[5].tolist() == y[5].tolist()
    block = alignment._Block(7)
    for k in range(30):
        block.add(whole[texts.index("one two")][4], 2, 10)
    (rows,) = block.rows()
    assert set(rows.column("weight").to_pylist()) == {60} and set(rows.column("block").to_pylist()) == {7}


def test_alignment_query(spark):
    docs = registry.table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ordered(registry.op11_alignment(spark, SF).collect()) == ordered(brute_force(rows))


# --- manifest -----------------------------------------------------------------------

def H(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(r, n_chars):
    fields = [r["doc_id"], r["source"], r["lang"], n_chars, r["text"]]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(digests):
    """All levels of a tree."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k:k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, at):
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(("R" if other > at else "L", level[other]) if other < len(level) else (None, None))
        at >>= 1
    return out


def manifest_of(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["n_chars"])))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {t: climb([leaf for *_, leaf in sorted(trees[t])]) for t in order}
    top = climb([made[t][-1][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for at, (some, doc_id, leaf) in enumerate(sorted(trees[t])):
            out.append((doc_id if some else None, leaf, made[t][-1][0], top[-1][0], tuple(steps(made[t], at) + steps(top, k))))
    return out


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest(docs, empty, levels):
    rows = docs.collect()
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["side"], s["digest"]) for s in r["proof"]))
           for r in merkle.manifest(docs, levels=levels).collect()]
    assert ordered(got) == ordered(manifest_of(rows))
    if levels == 2:
        assert merkle.manifest(empty).collect() == []
        one = docs.where("doc_id = 6")
        (r,) = merkle.manifest(one).collect()
        assert r["leaf"] == r["subroot"] == r["root"] and r["proof"] == []


def test_tampered_rows_do_not_verify(docs):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
                      merkle.record_digest(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"]))
    made = merkle.manifest(docs, carry={"digest": tampered, "n": F.col("n_chars")}).withColumn("folded", merkle.fold(F.coalesce("digest", "leaf"), "proof"))
    bad = 0
    for r in made.collect():
        touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n"] is not None
        assert (r["folded"] == r["root"]) == (not touched)
        bad += touched
    assert bad


def test_manifest_query(spark):
    con = duckdb.connect()
    register_views(con, SF)
    same, s_rows, o_rows, s_cols, o_cols = compare(registry.op12_merkle_manifest(spark, SF), con, registry.ORACLE["op12_merkle_manifest"])
    assert sorted(s_cols) == sorted(o_cols) and len(s_rows) == len(o_rows) and same
