"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm import chat, decontaminate, jaccard, langid, pieces, sharding, suffix, tokenfile, topk, toxicity
from hopweave.llm.common import table


def _tokenizer(name: str) -> str:
    """A public vocabulary file; the folder is a parameter, HOPWEAVE_TOKENIZERS."""
    folder = os.environ.get("HOPWEAVE_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


BYTE_BPE, PIECES = _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")
N_SHARDS, N_SLOTS = 16, 1609


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(rows, F.col("vec_id") % 50 == 0, 5)


OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM e q JOIN e c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, 4), PIECES)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", N_SHARDS, N_SLOTS)


#: The table is filled turn by turn: a step is one claim.
OP3 = f"""
WITH RECURSIVE pref AS (
  SELECT s::INT AS s,
    (('0x' || substr(md5('offset-' || s), 1, 15))::BIGINT % {N_SLOTS})::INT AS o,
    (('0x' || substr(md5('skip-' || s), 1, 15))::BIGINT % {N_SLOTS - 1} + 1)::INT AS k
  FROM range({N_SHARDS}) t(s)
), orders AS (
  SELECT s, list((o + j * k) % {N_SLOTS} ORDER BY j) AS p FROM pref, range({N_SLOTS}) r(j) GROUP BY s
), fill(i, free, slot, shard) AS (
  SELECT 0, list_transform(range({N_SLOTS}), lambda x: true), NULL::BIGINT, NULL::INT
  UNION ALL
  SELECT i + 1, list_concat(free[1:slot_], [false], free[slot_ + 2:]), slot_, s FROM (
    SELECT f.i, f.free, o.s, list_filter(o.p, lambda x: f.free[x + 1])[1] AS slot_
    FROM fill f JOIN orders o ON o.s = f.i % {N_SHARDS} WHERE f.i < {N_SLOTS})
)
SELECT d.doc_id, f.slot::INT AS slot, f.shard AS shard
FROM documents d JOIN fill f ON f.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {N_SLOTS}
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


OP5 = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT row, b, substr(h, 2 * b + 1, 2 * (256 + 199)) AS h FROM (SELECT row, h, unnest(range(0, greatest(len(h) // 2 - 199, 0), 256)) AS b FROM d)),
w AS (SELECT row, b + i AS i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT row, b, h, unnest(range(least(len(h) // 2 - 199, 256))) AS i FROM b)),
r AS (SELECT row, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT row, i, i - lag(i) OVER (PARTITION BY row ORDER BY i) AS gap FROM r),
n AS (SELECT row, i, gap, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY i) AS span FROM g),
s AS (SELECT row, span, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY 1, 2),
k AS (SELECT row, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last FROM s GROUP BY 1),
p AS (SELECT row, lo, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 0) AS since FROM s),
c AS (SELECT row, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS kept FROM p JOIN d USING (row) GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (row) LEFT JOIN c USING (row)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_documents(table(spark, sf_dir, "documents"), BYTE_BPE, 50257, 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.chain_of(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "p_low_quality", "p_toxic", toxicity.rejected(F.col("text"), F.col("p_toxic")).alias("toxic"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), 4, 85)


OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
t AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS r
  FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS f FROM s GROUP BY 1) USING (g)),
p AS (SELECT doc_id, g, n FROM t WHERE r <= n - (85 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id),
e AS (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.g = b.g GROUP BY x, y, nx, ny
  HAVING 100 * count(*) >= 85 * (nx + ny - count(*))),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN l ON l.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) m USING (doc_id)
"""


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) AS t(conv_id, turn, role, text)", args={"t": said})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_turns(turns, BYTE_BPE), BYTE_BPE)


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for m in chat.MARKS:
        out = f"replace({out}, '{m}', '{m[0]}\\{m[1:]}')"
    return f"length({out})"


OP10 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), x AS (
  SELECT *, {_escaped("text")} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 17 + {_escaped("role")} END AS shown FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(shown) + 3)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_sharding": op3_sharding,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_token_ids": op7_token_ids,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_chat_formatting": op10_chat_formatting,
}
SQL = {"op1_topk_search": OP1, "op3_sharding": OP3, "op5_suffix_dedup": OP5, "op9_ngram_jaccard": OP9, "op10_chat_formatting": OP10}
