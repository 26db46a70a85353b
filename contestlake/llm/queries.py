"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlake.llm import (
    chat, decontaminate, jaccard, lexical, packing, paragraphs, pii, quality, secrets, suffixes, urls, warc, whitening,
)

TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame(urls.default_labels(), "url string, label int")
    return urls.judge(table(spark, sf_dir, "pages"), urls.model_from(labels))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT r, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.t = bw.t),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hits) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit,
       coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN items ON d.r = items.r
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM docs),
starts AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM parts WHERE len(w) >= 8),
keyed AS (SELECT r, i, list_slice(w, i, i + 7) AS k FROM starts),
twice AS (SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
stats AS (
  SELECT p.r, doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM parts p LEFT JOIN covered c ON p.r = c.r),
flags AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repetitive,
         10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS dup_lines
  FROM stats),
rules AS (
  SELECT source, unnest([1, 2, 3, 4]) AS rule,
         unnest([short::INT, repetitive::INT, symbols::INT, dup_lines::INT]) AS failed
  FROM flags),
hosts AS (SELECT source, rule, count(*) AS n, sum(failed) AS k FROM rules GROUP BY ALL),
sums AS (
  SELECT rule, count(*) AS h, sum(n) AS docs, sum(n * n) AS squares, sum(k) AS failed, sum(k * k / n) AS weighted
  FROM hosts GROUP BY rule),
means AS (
  SELECT rule, failed / docs AS m, (docs - squares / docs) / (h - 1) AS size,
         CASE WHEN h > 1 AND docs > h THEN (failed - weighted) / (docs - h) END AS within,
         CASE WHEN h > 1 AND docs > h THEN (weighted - failed * failed / docs) / (h - 1) END AS between_hosts
  FROM sums),
prior AS (
  SELECT rule, m, CASE WHEN between_hosts - within > 1e-12 THEN size * within / (between_hosts - within) END AS weight FROM means),
bad AS (
  SELECT DISTINCT source FROM hosts JOIN prior USING (rule)
  WHERE CASE WHEN weight IS NULL THEN m ELSE (k + weight * m) / (n + weight) END > 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, short OR repetitive AS base_failed,
       NOT (short OR repetitive)
         AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.source IS NOT DISTINCT FROM f.source) AS kept
FROM flags f
"""

def op7_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_archives(warc.files_in(spark, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
hexed AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
digits AS (
  SELECT page_id, n, x, list_transform(range(0, 8), lambda i: list_reduce(
           list_transform(range(1, 6), lambda j: strpos('0123456789abcdef', substr(x, (i * 5 + j)::INT, 1)) - 1),
           lambda a, b: a * 16 + b)) AS v
  FROM hexed),
coded AS (
  SELECT page_id, n, array_to_string(list_transform(v, lambda d:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((d // 32768) % 32 + 1)::INT, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((d // 1024) % 32 + 1)::INT, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((d // 32) % 32 + 1)::INT, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (d % 32 + 1)::INT, 1)), '') AS b
  FROM digits),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY b, n) AS f FROM coded)
SELECT page_id, n::BIGINT AS payload_bytes, b AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM firsts
"""


#: One more conversation, whose texts hold the template's control strings.
CONTROLS = r"\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROLS), (-7, 1, "assistant", CONTROLS)], turns.schema)
    formatted = chat.format_conversations(turns.union(more), public_tokenizers.path(TOKENIZER))
    return chat.digests(chat.read_back(formatted))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS t
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sized AS (SELECT r, t, count(*) OVER (PARTITION BY r) AS n FROM s),
pairs AS (
  SELECT a.r AS x, b.r AS y FROM sized a JOIN sized b ON a.t = b.t AND a.r != b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT r, doc_id AS c FROM d
  UNION
  SELECT p.y, reach.c FROM reach JOIN pairs p ON p.x = reach.r),
least_id AS (SELECT r, min(c) AS c FROM reach GROUP BY r),
counted AS (SELECT r, count(*) AS n FROM s GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM d JOIN least_id USING (r) LEFT JOIN counted USING (r)
"""


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.per_document(paragraphs.copies(table(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t
        FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, t),
lengths AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS terms FROM lengths),
normal AS (SELECT r, doc_id, (75 + (25 * n::HUGEINT * docs) // terms)::BIGINT AS m FROM lengths, total),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
scores AS (
  SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN weights USING (t) JOIN normal USING (r) GROUP BY item_id, doc_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents")).drop("text_key")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_legacy_archives": op7_legacy_archives,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_paragraph_dedup": op10_paragraph_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_pii": op12_pii,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op6_quality_rules": OP6_SQL,
    "op7_legacy_archives": OP7_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op11_lexical_search": OP11_SQL,
}
