"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import binary_output, chat, cross_polytope, lm, mixing, near_dedup, packing, quality, suffix_dedup, toxicity, trie_codes, va_file, whitening
from coppice.llm.common import fold, table


def op1_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"), words=3, parts=85, of=100)


OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
     s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
           FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
     l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
     c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.a, c.r FROM c JOIN l ON l.b = c.doc_id WHERE c.r < l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.r AS component_id, d.doc_id = m.r AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    return quality.score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted")
    )


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    categories = ["quality", "toxic"]
    chain = toxicity.fit(docs, table(spark, sf, "labels"), categories)
    return toxicity.predict(docs, chain, categories).select(
        "doc_id", F.col("p_quality"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("toxic")
    )


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf, "documents"))


def op5_cross_polytope(spark: SparkSession, sf: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_va_file(spark: SparkSession, sf: str) -> DataFrame:
    return va_file.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_log_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score(table(spark, sf, "documents"))


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mix(table(spark, sf, "documents")).digest()


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op10_binary_output(spark: SparkSession, sf: str) -> DataFrame:
    shards = binary_output.write_shards(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return binary_output.digests(binary_output.read_shards(shards))


def op11_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    own = json.dumps({"messages": [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]})
    extra = chat.canonical_turns(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(own).alias("record")), json_col="record")
    turns = chat.canonical_turns(table(spark, sf, "conversations")).unionByName(extra)
    return chat.digests(chat.write_chats(chat.format_chats(turns)))


def _escaped(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for s in chat.CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}' || chr(92) || '-{s[1:]}')"
    return out


OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.START) + len(chat.END) + 2} AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op12_code_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie_codes.digest(table(spark, sf, "embeddings"))


def _op12_sql() -> str:
    """Product quantisation round by round; distances from inner products of whole numbers."""
    n, rounds = trie_codes.PARTS, trie_codes.ROUNDS
    steps = [f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({trie_codes.SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, p, x[p * (len(x) // {n}) + 1 : (p + 1) * (len(x) // {n})] AS s FROM v, range({n}) r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {trie_codes.ENTRIES}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT vec_id, p.p, p.s, min(CAST(list_inner_product(p.s, p.s) - 2 * list_inner_product(p.s, b.s) + list_inner_product(b.s, b.s) AS BIGINT) * 256 + e) AS m
       FROM p JOIN b{i} b ON p.p = b.p GROUP BY vec_id, p.p, p.s)""")
        if i < rounds:
            steps.append(f"""
u{i} AS (SELECT p, m % 256 AS e, j, floor(sum(s[j]) / count(*)) AS c FROM a{i}, range(1, 1 + (SELECT max(len(x)) // {n} FROM v)) r(j) GROUP BY p, m % 256, j),
b{i + 1} AS (SELECT b.p, b.e, coalesce(any_value(l.s), any_value(b.s)) AS s FROM b{i} b LEFT JOIN (SELECT p, e, list(c ORDER BY j) AS s FROM u{i} GROUP BY p, e) l ON l.p = b.p AND l.e = b.e GROUP BY b.p, b.e)""")
    return "WITH" + ",".join(steps) + f""",
c AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
k AS (SELECT sha256(string_agg(CAST(CAST(s[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS k FROM b{rounds}, range(1, 1 + (SELECT max(len(x)) // {n} FROM v)) r(j))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, k AS codebooks_sha256 FROM c JOIN v USING (vec_id), k
"""


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_va_file": op6_va_file,
    "op7_log_bilinear": op7_log_bilinear,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_binary_output": op10_binary_output,
    "op11_chat_format": op11_chat_format,
    "op12_code_trie": op12_code_trie,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {"op1_minhash_dedup": OP1_SQL, "op6_va_file": OP6_SQL, "op11_chat_format": OP11_SQL, "op12_code_trie": _op12_sql()}
