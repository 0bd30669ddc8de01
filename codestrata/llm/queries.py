"""One query per operator, with production parameters over whole tables. SQL where DuckDB can state the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classifier, langid, lm, mixing, neardup, rules, substring, topk
from .common import crc32_mod, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(docs.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", "removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"), "text")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat formatting of conversations that hold calls, made of all turns: an even turn calls, referring to the call two turns before; an odd one has the result.

    The turn's own text stays beside the block.
    """
    t, own = F.col("turn"), F.coalesce("text", F.lit(""))
    ident = lambda n: F.concat(F.lit('"t'), n.cast("string"), F.lit('"'))
    limit = F.when(t >= 2, F.concat(F.lit(',"limit":{"$ref":'), ident(t - 2), F.lit("}"))).otherwise("")
    call = F.concat(F.lit('<tool_call>{"id":'), ident(t), F.lit(',"name":"search","arguments":{"query":"x"'), limit, F.lit("}}</tool_call>"))
    result = F.concat(F.lit('<tool_result>{"id":'), ident(t - 1), F.lit(',"content":1}</tool_result>'))
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.concat(own, F.when(t % 2 == 0, call).otherwise(result)))
    return chat.format_chats(turns).select("conv_id", "turn", "n_calls", "n_results", "n_linked", "n_invalid", "first_level", F.length(F.get_json_object("json", "$.content")).cast("long").alias("n_content"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_exact_topk, op3_substring_dedup, op4_chat_formatting, op5_bpe, op6_minhash_near_dedup, op7_lm_scoring, op8_language_id, op9_mixing, op10_quality_rules, chat_tool_links)}

_STOP_SQL = ", ".join(f"'{w}', '{w.capitalize()}'" for w in rules.STOP_WORDS)
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    # Levels: calls of a conversation in islands of turns two apart; results one above their call's place. Only calls that are answered are linked.
    "chat_tool_links": """
WITH c AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations WHERE turn % 2 = 0),
l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1 AS level FROM c),
r AS (SELECT conv_id, turn - 1 AS turn FROM conversations WHERE turn % 2 = 1)
SELECT t.conv_id, t.turn, (t.turn % 2 = 0)::INT::BIGINT AS n_calls, (t.turn % 2 = 1)::INT::BIGINT AS n_results,
       CASE WHEN t.turn % 2 = 0 THEN (r.turn IS NOT NULL) ELSE (l.turn IS NOT NULL) END::INT::BIGINT AS n_linked, (t.turn % 2 = 0 AND t.turn >= 2)::INT::BIGINT AS n_invalid,
       (2 * l.level + t.turn % 2)::BIGINT AS first_level, length(coalesce(t.text, ''))::BIGINT AS n_content
FROM conversations t LEFT JOIN l ON l.conv_id = t.conv_id AND l.turn = t.turn - t.turn % 2 LEFT JOIN r ON r.conv_id = t.conv_id AND r.turn = t.turn
""",
    "op9_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS}) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::INT] AS w FROM s),
l AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, 2 * source_size AS cap,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM w),
o AS (SELECT *, cap * w_from <= (total - cap_before) * w AS capped FROM l),
f AS (SELECT total - cap_before AS lft, w_from AS wf FROM o WHERE NOT capped ORDER BY 2 * source_size / w::DOUBLE, source IS NULL, source LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN capped OR lft IS NULL THEN cap::DOUBLE ELSE lft * w / wf END AS target
  FROM o LEFT JOIN f ON true),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
""".replace(' COLLATE "C"', ""),
    "op10_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
b AS (
  SELECT row_number() OVER () AS r, doc_id, ws, len(ws) AS n_words,
         length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS gram FROM b, unnest(range(1, greatest(1, n_words - 6))) AS u(i)),
h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM h, unnest(range(0, 8)) AS u(j) GROUP BY r),
tp AS (SELECT r, max(n) AS top FROM (SELECT r, ws[i] AS a, ws[i + 1] AS c, count(*) AS n FROM b, unnest(range(1, n_words)) AS u(i) GROUP BY ALL) GROUP BY r),
m AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ellipses,
         len(list_filter(ws, lambda x: NOT regexp_matches(x, '[^\x00-@\[-`{{-\x7F]'))) AS n_no_letter,
         len(list_filter(ws, lambda x: list_contains([{_STOP_SQL}], x))) AS n_stop, coalesce(top, 0) AS top
  FROM b LEFT JOIN p USING (r) LEFT JOIN tp USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * greatest(1, n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
         OR 100 * n_bullets > 90 * greatest(1, n_lines) OR 100 * n_ellipses > 30 * greatest(1, n_lines) OR 100 * n_no_letter > 20 * n_words OR n_stop < 2 OR (200 * top > 20 * n_words AND top > 2)) AS kept
FROM v
""",
}
