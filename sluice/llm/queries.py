"""The registered queries of this subpackage, with the same results in DuckDB's SQL where it can express them."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm import audit, chat, exact_dedup, lm, merkle, mixing, quality, sentencepiece, simhash, substring, token_counts, token_files, toxicity
from sluice.llm.common import read
from sluice.session import scratch_dir

BPE = os.environ.get("SLUICE_BPE", "") or public_tokenizers.path("byte_bpe_50k.json")
PIECES = os.environ.get("SLUICE_PIECES", "") or public_tokenizers.path("piece_bpe_32k.model")
# What op3 redacts: addresses of hosts, long numbers, keys in hexadecimal digits.
REDACTED = {r"\b\d{1,3}(?:\.\d{1,3}){3}\b": "<address>", r"\b\d{12,19}\b": "<number>", r"\b[0-9a-fA-F]{32,64}\b": "<key>"}


def definition(path: str = BPE) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def pieces(path: str = PIECES) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(read(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", toxicity.held_out(F.col("doc_id"), 4, 2))
    known = read(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"), 4, 2))
    model = toxicity.fit(docs.where(~F.col("held_out")), known)
    return toxicity.toxicity(docs, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def redactions(text: str) -> list[token_counts.Edit]:
    """Edits that put marks in the place of what identifies a host, an account or a key."""
    found = [(m.start(), m.end(), mark) for pattern, mark in REDACTED.items() for m in re.finditer(pattern, text)]
    out: list[token_counts.Edit] = []
    for edit in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its redaction."""
    told = definition()
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), told)
    counted = counted.withColumn("n_tokens_before", F.col("n_tokens"))
    after = token_counts.recount(counted, told, redactions)
    return after.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"), "n_edits", "chars_encoded", F.size("leaf_chars").alias("n_leaves"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece.encode(docs, pieces(), verify=True)
    return encoded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "same_back")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.source_rates(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, scratch_dir(spark, "digest-index"))
    return index.verdicts(read(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(read(spark, sf_dir, "documents"), definition(), path)
    return token_files.read_documents(spark, path)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.held_out(F.col("doc_id"), 7, 2)
    scores = lm.lm_scores(docs, ~out)
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(read(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return cut.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against rows of which a third have their text's capitals lowered."""
    docs = read(spark, sf_dir, "documents")
    known = docs.withColumn("recorded_leaf", merkle.leaf({c: F.col(c) for c in merkle.SERIAL}))
    changed = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    now = known.withColumn("text", F.when(changed, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text")))
    proven = merkle.manifest(docs, suspect=now)
    digests = F.transform(F.flatten(F.col("steps.others")), lambda d: F.lower(F.hex(d)))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", digests), 256).alias("proof_sha256"), "folded_root", verified)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_toxicity,
        op3_token_counts,
        op4_simhash,
        op5_sentencepiece,
        op6_mixing,
        op7_exact_dedup,
        op8_token_files,
        op9_lm_scoring,
        op10_quality_rules,
        op11_substring_dedup,
        op12_merkle_manifest,
        op13_filter_audit,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": """
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
logged AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(role := role, text := text) ORDER BY k) AS turns,
    string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10)
      || replace(replace(coalesce(text, ''), '<|im_start|>', ''), '<|im_end|>', '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS chat
  FROM numbered GROUP BY conv_id),
whole AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM logged GROUP BY turns),
inner_prefixes AS (SELECT conv_id, turns[1:k] AS turns FROM (SELECT conv_id, turns, unnest(range(1, n)) AS k FROM logged)),
maximal AS (SELECT * FROM whole WHERE turns NOT IN (SELECT turns FROM inner_prefixes)),
snapshots AS (
  SELECT p.conv_id, sum(w.n_copies) AS n FROM inner_prefixes p JOIN whole w ON p.turns = w.turns GROUP BY p.conv_id)
SELECT m.conv_id, l.n AS n_turns, m.n_copies, coalesce(s.n, 0)::BIGINT AS n_snapshots, l.chat
FROM maximal m JOIN logged l ON m.conv_id = l.conv_id LEFT JOIN snapshots s ON m.conv_id = s.conv_id""",
    "op6_mixing": """
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
weighted AS (SELECT source, chars, CASE WHEN chars > 0 THEN sqrt(chars) ELSE 0 END AS weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM weighted WHERE chars > 0) * (SELECT sum(chars) FROM weighted) / chars ELSE 0 END AS rate
  FROM weighted),
split AS (SELECT source, rate, greatest(1, ceil(rate / 64.0))::BIGINT AS draws FROM rates),
steps AS (SELECT source, draws, rate / draws AS mean, unnest(generate_series(0, 240)) AS k FROM split),
terms AS (
  SELECT source, draws, k, mean, CASE WHEN mean > 0 THEN exp(k * ln(mean) - mean - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END AS p FROM steps),
tables AS (SELECT source, draws, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms WHERE k <= ceil(mean + 12 * sqrt(mean) + 40)),
named AS (SELECT *, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS name FROM documents),
drawn AS (
  SELECT n.*, d.draw, ('0x' || substr(md5('17:' || n.name || ':draw:' || d.draw), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM named n JOIN split s ON n.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT unnest(generate_series(1, s.draws)) AS draw) d),
counted AS (
  SELECT r.doc_id, r.text, r.lang, r.source, r.n_chars, r.name, count(t.k) AS n
  FROM drawn r LEFT JOIN tables t ON r.source IS NOT DISTINCT FROM t.source AND t.c <= r.u
  GROUP BY r.doc_id, r.text, r.lang, r.source, r.n_chars, r.name)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no,
  ('0x' || substr(md5('17:' || name || ':' || copy_no), 1, 13))::BIGINT / 4503599627370496.0 AS position
FROM (SELECT *, unnest(generate_series(1, n)) AS copy_no FROM counted)""",
    "op7_exact_dedup": r"""
WITH marked AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ 	-
]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM marked WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op11_substring_dedup": r"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, start, md5(array_to_string(words[start:start + 12], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS start FROM cut WHERE len(words) >= 13)),
lowest AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
gone AS (
  SELECT doc_id, list(DISTINCT place) AS places
  FROM (SELECT doc_id, unnest(range(start, start + 13)) AS place FROM windows JOIN lowest USING (h) WHERE low < doc_id) GROUP BY doc_id),
placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM cut),
lost AS (SELECT doc_id, unnest(places) AS place FROM gone),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept_text, count(*) AS n
  FROM placed p ANTI JOIN lost l ON p.doc_id = l.doc_id AND p.place = l.place GROUP BY doc_id)
SELECT c.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k ON c.doc_id = k.doc_id""",
    "op12_merkle_manifest": """
WITH RECURSIVE told AS (
  SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now_text
  FROM (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
      lambda a, x: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor(a, x)), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
    FROM documents)),
serials AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(now_text) || ':' || now_text, '-') AS now_body
  FROM told),
leaves AS (
  SELECT doc_id, lang, leaf, now_leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, lang, sha256(head || body) AS leaf, sha256(head || now_body) AS now_leaf FROM serials)),
nodes AS (
  SELECT lang, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, n, i // 8),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, n, i // 8),
both_trees AS (SELECT lang, level, i, digest, n FROM nodes WHERE n > 1 UNION ALL SELECT 'top', level + 1000, i, digest, n FROM tops WHERE n > 1),
beside AS (
  SELECT a.lang, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS ahead,
    coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS behind
  FROM both_trees a JOIN both_trees b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.i // 8 = b.i // 8 GROUP BY a.lang, a.level, a.i),
folds AS (
  SELECT doc_id, lang, leaf, lang AS tree, 0 AS level, i, now_leaf AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, CASE WHEN b.level IS NULL THEN 'top' ELSE f.tree END, CASE WHEN b.level IS NULL THEN 1000 ELSE f.level + 1 END,
    CASE WHEN b.level IS NULL THEN s.i ELSE f.i // 8 END, CASE WHEN b.level IS NULL THEN f.digest ELSE sha256(b.ahead || f.digest || b.behind) END,
    CASE WHEN b.level IS NULL THEN f.proof ELSE f.proof || b.ahead || b.behind END
  FROM folds f LEFT JOIN beside b ON f.tree IS NOT DISTINCT FROM b.lang AND f.level = b.level AND f.i = b.i
    JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang
  WHERE f.level < 1000 OR b.level IS NOT NULL),
ended AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lang, leaf ORDER BY level DESC) AS last FROM folds WHERE level >= 1000),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM ended e JOIN subroots s ON e.lang IS NOT DISTINCT FROM s.lang, root WHERE last = 1""",
    "op13_filter_audit": r"""
WITH cut AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
verdicts AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM cut),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
patterns AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS n_good, sum(coalesce(toxic, 0)) AS n_toxic
  FROM verdicts v LEFT JOIN known k ON v.doc_id = k.doc_id GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM orders, unnest(range(1, 6)) s(step)),
counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN translate(earlier || f, fails, '') = earlier || f THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(earlier, fails, '') = earlier THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(earlier, fails, '') <> earlier THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(earlier, fails, '') = earlier THEN n_good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(earlier, fails, '') = earlier THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM patterns, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted""",
}
