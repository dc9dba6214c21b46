"""The operators' queries over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_masks, exact_dedup, packing, piece_sampling, pii, quality_rules, sharding, simhash, token_store, url_filters
from .common import table, written

#: Rules and key in production.
URL_RULES = (
    url_filters.Rule("block", "net/"),
    url_filters.Rule("allow", "example.net/en/"),
    url_filters.Rule("block", "example.com/de/"),
    url_filters.Rule("allow", "org/fr/"),
)
PII_KEY = pii.Key("surrogates-2024-06")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, PII_KEY, count_as="n_entities")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.build_ledger(table(spark, sf_dir, "documents"))
    base, kept = quality_rules.passes(quality_rules.BASE, F.col("failed")), quality_rules.passes(quality_rules.STANDARD, F.col("failed"))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failed",
                         (~base).alias("base_failed"), (base & kept).alias("kept"))


#: Shows that a text may hold the template's own control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op4_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    made = chat_masks.format_conversations(turns.unionByName(more), tokenizer_path("byte_bpe_50k.json"))
    return chat_masks.digest(made)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return shards.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                         F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_store.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of every document, and whether they decode to its text: crc32 of both. The ids are written and read
    back, so a task runs one Python worker and not one behind another."""
    docs, model = table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")
    decoded = piece_sampling.decode_pieces(written(piece_sampling.sample_pieces(docs, model), "pieces"), model)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
                          F.char_length("text").cast("long").alias("decoded_chars"), F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_pii_surrogates, op3_quality_rules, op4_chat_masks, op5_exact_dedup, op6_packing, op7_sharding,
              op8_simhash, op9_token_store, op10_piece_sampling, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": r"""
WITH RECURSIVE base AS (
  SELECT page_id, html, url,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         regexp_extract(url, '^[^?#]*(\?[^#]*)', 1, 's') AS query
  FROM pages),
links AS (
  SELECT host || path || query AS a,
         regexp_extract(unnest(regexp_extract_all(html, '<link\b[^>]*\brel="?canonical"?[^>]*>', 0, 'is')), 'href="?([^\s">]*)', 1, 'is') AS link
  FROM base WHERE html ILIKE '%canonical%' AND contains(url, '://')),
edges AS (
  SELECT a, translate(regexp_extract(link, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(link, '://[^/?#]*([^#]*)', 1) AS b
  FROM links WHERE contains(link, '://')),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
nodes AS (SELECT a, b, regexp_extract(b, '^([^/?]*)', 1) AS host, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS path FROM reach),
ruled AS (
  SELECT a, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'allow'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block' END AS act
  FROM nodes),
blocked AS (SELECT DISTINCT a FROM ruled WHERE act = 'block'),
judged AS (
  SELECT page_id, host, path, host || path || query AS node, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM base)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN b.a IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN b.a IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM judged j LEFT JOIN blocked b ON j.node = b.a
""",
    "op3_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (
  SELECT r, i, word || ' ' || lead(word, 1) OVER s || ' ' || lead(word, 2) OVER s || ' ' || lead(word, 3) OVER s || ' ' || lead(word, 4) OVER s AS gram
  FROM words WINDOW s AS (PARTITION BY r ORDER BY i)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM windows WHERE gram IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS at FROM repeated, range(5) t(k)) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN covered c ON d.r = c.r LEFT JOIN lines l ON d.r = l.r),
f AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (n_symbols > n_words)::INT
    + 8 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::INT + 16 * (2 * n_dup_lines > n_lines)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed, failed & 3 <> 0 AS base_failed, failed & 31 = 0 AS kept FROM f
""",
    "op4_chat_masks": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok', NULL), (-7, 1, 'assistant', '\### Assistant: </turn> ok', NULL))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(regexp_replace(role, '(\\|###|</turn>|:|\n)', 'X\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', 'X\1', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id, alone
""",
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER s AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
       row_number() OVER s = 1 AS kept, text_sha256
FROM d WINDOW s AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
""",
}
