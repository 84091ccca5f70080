"""Registered queries ``opN_<name>`` and their DuckDB SQL.

Each query applies one operator, with production parameters, to its whole
table and derives the digest columns from the operator's output.  Operators
that SQL cannot express (BPE, fingerprints, the classifier, randomness tests)
are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from routeboard.llm import (alignment, bpe, fingerprints, language_model, merkle, mixing, near_copies, quality, secrets_scan, substrings,
                            token_counts, toxicity, urls)
from routeboard.llm.words import WORD_PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary() -> tuple[bytes, str]:
    """The public multilingual rank file and split pattern the queries use."""
    import public_tokenizers as public
    return bpe.read_vocabulary(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, *vocabulary()).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 6).alias("log_score"),
                         F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_trigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 6).alias("log_score"),
                         F.round("mean_log_score", 6).alias("mean_log_score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), quality.STRICT)
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (F.col("failures").bitwiseAND(F.lit(quality.BASE.mask)) != 0).alias("base_failed"), "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.expr(f"CAST(size(filter(base, s -> s.kind = {kind})) AS BIGINT)")
    return found.select("row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(F.expr(secrets_scan.span_list("base")), 256).alias("base_sha256"),
                        F.expr(secrets_scan.span_list("spans")).alias("spans"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def public_file(name: str) -> bytes:
    """A public tokenizer file, read on the driver."""
    import public_tokenizers as public
    return Path(public.path(name)).read_bytes()


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align_corpus(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json").decode(), public_file("piece_bpe_32k.model"))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json").decode(), columns=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
                      merkle.record_digest(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"]))
    made = merkle.manifest(docs, carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), "proof")
    return made.withColumn("folded_root", folded).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_near_copies": op2_near_copies,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_urls": op5_urls,
    "op6_fingerprints": op6_fingerprints,
    "op7_language_model": op7_language_model,
    "op7_trigram_model": op7_trigram_model,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_substrings": op10_substrings,
    "op11_alignment": op11_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_counts": op13_token_counts,
}

def queries() -> dict:
    """The registered queries, with the pipeline at the repository top."""
    return {**QUERIES, "pipeline": corpus_pipeline.run}


_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')"

ORACLE = {
    "op7_language_model": f"""
WITH texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
positions AS (SELECT doc_id, unnest(words) AS w2, generate_subscripts(words, 1) AS pos FROM texts),
pairs AS (SELECT doc_id, pos, w2, lag(w2) OVER (PARTITION BY doc_id ORDER BY pos) AS w1 FROM positions),
ones AS (SELECT w2 AS w, count(*) AS n FROM positions GROUP BY w2),
twos AS (SELECT w1, w2, count(*) AS n FROM pairs WHERE w1 IS NOT NULL GROUP BY w1, w2),
total AS (SELECT count(*) AS n FROM positions),
scored AS (
  SELECT doc_id, p.w1 IS NOT NULL AND t.n < 2 AS backed_off,
         CASE WHEN p.w1 IS NULL THEN ln(b.n / (SELECT n FROM total)) WHEN t.n >= 2 THEN ln(t.n / a.n)
              ELSE ln(0.4::DOUBLE * b.n / (SELECT n FROM total)) END AS log_p
  FROM pairs p LEFT JOIN twos t ON t.w1 = p.w1 AND t.w2 = p.w2 LEFT JOIN ones a ON a.w = p.w1 JOIN ones b ON b.w = p.w2),
summed AS (SELECT doc_id, count(*) FILTER (WHERE backed_off) AS n_backoff, sum(log_p) AS log_score FROM scored GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(log_score, 0.0), 6) AS log_score,
       round(CASE WHEN len(words) > 0 THEN log_score / len(words) END, 6) AS mean_log_score
FROM texts LEFT JOIN summed USING (doc_id)
""",
    "op7_trigram_model": f"""
WITH texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
positions AS (SELECT doc_id, unnest(words) AS w3, generate_subscripts(words, 1) AS pos FROM texts),
triples AS (
  SELECT doc_id, pos, w3, lag(w3) OVER w AS w2, lag(w3, 2) OVER w AS w1
  FROM positions WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ones AS (SELECT w3 AS w, count(*) AS n FROM positions GROUP BY w3),
twos AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM triples WHERE w2 IS NOT NULL GROUP BY w2, w3),
threes AS (SELECT w1, w2, w3, count(*) AS n FROM triples WHERE w1 IS NOT NULL GROUP BY w1, w2, w3),
total AS (SELECT count(*) AS n FROM positions),
shorter AS (
  SELECT t.*, CASE WHEN t.w2 IS NULL THEN b.n / (SELECT n FROM total) WHEN p.n >= 2 THEN p.n / a.n
                   ELSE 0.4::DOUBLE * b.n / (SELECT n FROM total) END AS two, p.n AS n_two
  FROM triples t JOIN ones b ON b.w = t.w3 LEFT JOIN ones a ON a.w = t.w2 LEFT JOIN twos p ON p.a = t.w2 AND p.b = t.w3),
scored AS (
  SELECT doc_id, CASE WHEN s.w1 IS NULL THEN s.w2 IS NOT NULL AND n_two < 2 ELSE t.n < 2 END AS backed_off,
         ln(CASE WHEN s.w1 IS NULL THEN two WHEN t.n >= 2 THEN t.n / c.n ELSE 0.4::DOUBLE * two END) AS log_p
  FROM shorter s LEFT JOIN threes t ON t.w1 = s.w1 AND t.w2 = s.w2 AND t.w3 = s.w3 LEFT JOIN twos c ON c.a = s.w1 AND c.b = s.w2),
summed AS (SELECT doc_id, count(*) FILTER (WHERE backed_off) AS n_backoff, sum(log_p) AS log_score FROM scored GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(log_score, 0.0), 6) AS log_score,
       round(CASE WHEN len(words) > 0 THEN log_score / len(words) END, 6) AS mean_log_score
FROM texts LEFT JOIN summed USING (doc_id)
""",
    "op10_substrings": f"""
WITH texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS pos FROM texts WHERE len(words) >= 20),
windows AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS w FROM starts JOIN texts USING (doc_id)),
numbered AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM windows),
removed AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM numbered WHERE nth > 1),
positions AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM positions ANTI JOIN removed USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
""",
    "op3_mixing": f"""
WITH sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sums),
bounded AS (SELECT *, 3 * source_size AS cap, 18 * source_size // weight AS bound FROM placed),
rest AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM bounded WINDOW before AS (ORDER BY bound, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, cap * weight_left <= words_left * weight AS capped FROM rest),
targets AS (
  SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE weight * (SELECT arg_min(words_left::DOUBLE / weight_left, bound) FROM flagged WHERE NOT capped) END AS target
  FROM flagged),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT
                                       / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
""",
    "op12_merkle_manifest": """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
         -- crc32 of the decimal doc_id, bit by bit
         list_reduce([4294967295::BIGINT] || list_transform(range(8 * length(doc_id::VARCHAR)), lambda i:
             ((ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) >> (i % 8)::INTEGER) & 1)::BIGINT),
             lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))) AS crc
  FROM documents),
digests AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
         CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0
              THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || tail) END AS tampered
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot,
         count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM digests),
nodes AS (
  SELECT tree, 0 AS level, spot, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, spot // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY spot)) FROM nodes WHERE n > 1 GROUP BY tree, level, spot // 2, n),
subroots AS (SELECT tree, digest, level AS height FROM nodes WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS spot, count(*) OVER () AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, spot // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY spot)) FROM high WHERE n > 1 GROUP BY level, spot // 2, n),
top AS (SELECT digest AS root, level AS height FROM high WHERE n = 1),
low_steps AS (
  SELECT l.tree, l.spot, l.level, s.digest, (l.spot >> l.level) % 2 = 1 AS is_left
  FROM (SELECT tree, spot, unnest(range(height)) AS level FROM leaves JOIN subroots USING (tree)) l
  LEFT JOIN nodes s ON s.tree = l.tree AND s.level = l.level AND s.spot = xor(l.spot >> l.level, 1)),
high_steps AS (
  SELECT t.tree, t.level, s.digest, (t.tree >> t.level) % 2 = 1 AS is_left
  FROM (SELECT tree, unnest(range((SELECT height FROM top))) AS level FROM subroots) t
  LEFT JOIN high s ON s.level = t.level AND s.spot = xor(t.tree >> t.level, 1)),
whole AS (
  SELECT tree, spot, level, digest, is_left FROM low_steps
  UNION ALL
  SELECT l.tree, l.spot, b.height + h.level, h.digest, h.is_left FROM leaves l JOIN subroots b USING (tree) JOIN high_steps h USING (tree)),
proofs AS (
  SELECT tree, spot, sha256(coalesce(string_agg(digest, '' ORDER BY level), '')) AS proof_sha256,
         list(struct_pack(digest, is_left) ORDER BY level) AS steps FROM whole GROUP BY tree, spot),
folding AS (
  SELECT l.tree, l.spot, coalesce(tampered, leaf) AS own, coalesce(steps, []) AS steps, 1 AS k FROM leaves l LEFT JOIN proofs p ON p.tree = l.tree AND p.spot = l.spot
  UNION ALL
  SELECT tree, spot, sha256(CASE WHEN steps[k].is_left THEN coalesce(steps[k].digest, '') ELSE '' END || own
                          || CASE WHEN steps[k].is_left THEN '' ELSE coalesce(steps[k].digest, '') END), steps, k + 1
  FROM folding WHERE k <= len(steps))
SELECT doc_id, leaf, s.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.own AS folded_root, f.own = root AS verified
FROM leaves l JOIN subroots s USING (tree) CROSS JOIN top LEFT JOIN proofs p ON p.tree = l.tree AND p.spot = l.spot
JOIN folding f ON f.tree = l.tree AND f.spot = l.spot AND f.k = len(f.steps) + 1
""",
    "op5_urls": """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id)
""",
    "op8_quality": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
positions AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
windows AS (
  SELECT doc_id, pos, word AS a, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c, lead(word, 3) OVER w AS d,
         lead(word, 4) OVER w AS e FROM positions WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) AS n FROM windows WHERE e IS NOT NULL),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{WORD_PATTERN}')
  GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM measured
""",
}
