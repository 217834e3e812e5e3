"""Queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.session import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), with_ids=False)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loamline.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm.warc import captures

    return captures(table(spark, sf_dir, "pages"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm.substring import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"), digests=True)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm.chat import learned, preferences_of_conversations

    found = preferences_of_conversations(table(spark, sf_dir, "conversations"))
    return found.select("pair_id", "part", "prompt", "chosen", learned(F.col("chosen_mask")).alias("chosen_learn"), "rejected", learned(F.col("rejected_mask")).alias("rejected_learn"))


def op10_permindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamline.llm.permindex import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_topk": op2_topk,
    "op3_toxicity": op3_toxicity,
    "op4_minhash": op4_minhash,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_substring": op7_substring,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_permindex": op10_permindex,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_VECTORS = """SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

_TOPK = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS e FROM ({_VECTORS})),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d
),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1),
items AS (SELECT rep, len(s) AS n, unnest(s) AS item FROM classes),
shared AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
  FROM items a JOIN items b ON a.item = b.item AND a.rep < b.rep GROUP BY 1, 2
),
links AS (SELECT a, b FROM shared WHERE 100 * n_both >= 85 * (na + nb - n_both)),
arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS node, a AS root FROM arcs
  UNION SELECT arcs.b, reach.root FROM reach JOIN arcs ON arcs.a = reach.node WHERE reach.root <= arcs.b
),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
named AS (SELECT t.doc_id, coalesce(least.root, c.rep) AS component_id
  FROM sets t JOIN classes c ON list_sort(t.s) = c.s LEFT JOIN least ON least.node = c.rep WHERE len(t.s) > 0)
SELECT z.doc_id, z.n AS n_shingles, coalesce(m.component_id, z.doc_id) AS component_id, z.doc_id = coalesce(m.component_id, z.doc_id) AS kept
FROM sizes z LEFT JOIN named m ON m.doc_id = z.doc_id
"""

_SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM windows),
covered AS (SELECT DISTINCT doc_id, p + i AS p FROM (SELECT doc_id, p, unnest(range(0, 20)) AS i FROM ranked WHERE r > 1)),
spots AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT s.doc_id, count(*) AS n, string_agg(s.word, ' ' ORDER BY s.p) AS text
  FROM spots s LEFT JOIN covered c ON c.doc_id = s.doc_id AND c.p = s.p WHERE c.p IS NULL GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((((strpos('0123456789abcdef', h[i * 5 // 4 + 1]) - 1) * 16 + strpos('0123456789abcdef', h[i * 5 // 4 + 2]) - 1) >> (3 - i * 5 % 4)) & 31) + 1, 1)), '') AS digest FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM b
"""

_CHAT = """
WITH c AS (
  SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS s FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2
),
last AS (SELECT pair_id, max(turn) AS last, arg_max(s.text, turn) AS answer FROM c WHERE s.role = 'assistant' GROUP BY 1),
swap AS (SELECT a.pair_id, a.last, b.answer AS other FROM last a LEFT JOIN last b ON b.pair_id = xor(a.pair_id, 1)),
bad AS (
  SELECT c.pair_id, c.turn, c.s FROM c LEFT JOIN swap w ON w.pair_id = c.pair_id WHERE w.last IS NULL OR c.turn < w.last
  UNION ALL SELECT pair_id, last, {'role': 'assistant', 'text': other} FROM swap WHERE other IS NOT NULL
),
met AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.turn, b.turn) AS turn, a.s AS good, b.s AS bad FROM c a FULL JOIN bad b ON a.pair_id = b.pair_id AND a.turn = b.turn),
first AS (SELECT pair_id, min(turn) AS first FROM met WHERE good IS DISTINCT FROM bad GROUP BY 1),
placed AS (SELECT met.*, coalesce(turn < first, true) AS prompt FROM met LEFT JOIN first USING (pair_id)),
rows AS (
  SELECT pair_id, 'prompt' AS section, turn, good AS s FROM placed WHERE prompt
  UNION ALL SELECT pair_id, 'chosen', turn, good FROM placed WHERE NOT prompt AND good IS NOT NULL
  UNION ALL SELECT pair_id, 'rejected', turn, bad FROM placed WHERE NOT prompt AND bad IS NOT NULL
),
texts AS (SELECT pair_id, CAST(floor(turn / 1024) AS BIGINT) AS part, section, turn, s.role AS role, concat('<|', s.role, '|>', chr(10), s.text, '<|end|>', chr(10)) AS t FROM rows)
SELECT pair_id, part,
  coalesce(string_agg(t, '' ORDER BY turn) FILTER (section = 'prompt'), '') AS prompt,
  coalesce(string_agg(t, '' ORDER BY turn) FILTER (section = 'chosen'), '') AS chosen,
  coalesce(list([CAST(upto - length(t) AS INTEGER), CAST(upto AS INTEGER)] ORDER BY turn) FILTER (section = 'chosen' AND role = 'assistant'), []) AS chosen_learn,
  coalesce(string_agg(t, '' ORDER BY turn) FILTER (section = 'rejected'), '') AS rejected,
  coalesce(list([CAST(upto - length(t) AS INTEGER), CAST(upto AS INTEGER)] ORDER BY turn) FILTER (section = 'rejected' AND role = 'assistant'), []) AS rejected_learn
FROM (SELECT *, sum(length(t)) OVER (PARTITION BY pair_id, part, section ORDER BY turn) AS upto FROM texts)
GROUP BY 1, 2
"""

SQL: dict[str, str] = {
    "op2_topk": _TOPK,
    "op4_minhash": _NEAR,
    "op6_warc": _WARC,
    "op7_substring": _SUBSTRING,
    "op9_chat": _CHAT,
}
