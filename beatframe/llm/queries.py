"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, read


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    prepare(spark)
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    prepare(spark)
    return top_products(read(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    prepare(spark)
    return personal_data(read(spark, sf_dir, "documents")).drop("redacted")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    prepare(spark)
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mixed(docs)
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


def op6_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import language_scores

    prepare(spark)
    return language_scores(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    prepare(spark)
    return remove_repeats(read(spark, sf_dir, "documents"), length=20).drop("kept_text")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    prepare(spark)
    return round_trip(read(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    prepare(spark)
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import similar_vectors

    prepare(spark)
    return similar_vectors(read(spark, sf_dir, "embeddings"), least=0.95)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damage, repair

    prepare(spark)
    conversations = read(spark, sf_dir, "conversations")
    return repair(damage(conversations), of=conversations)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .align import alignments

    prepare(spark)
    return alignments(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    prepare(spark)
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_exact_topk, op3_personal_data, op4_quality_classifier, op5_mixing, op6_language_scores, op7_substring_dedup, op8_warc_round_trip, op9_packing, op10_embedding_near_dedup, op11_conversation_repair, op12_tokenizer_alignment, op13_token_counts)}

#: SQL that DuckDB can run on the given tables.
ORACLE = {
    "op2_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    # crc32 bit by bit; the cheapest edits row by row, cost and letters of each state kept as a pair
    "op11_conversation_repair": r"""
WITH RECURSIVE crc AS (
  SELECT DISTINCT conv_id, turn, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda h, c: list_reduce(list_prepend(xor(h, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS fate
  FROM conversations),
damaged AS (
  SELECT d.conv_id, d.turn, CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations d JOIN crc c ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.turn IS NOT DISTINCT FROM c.turn WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS final FROM damaged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM placed),
faults AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, left(role, 1) AS r,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM ranked),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
-- o: start, s: after s, u, a: pairs (cost, letters); u and a are closed under insertion by least()
walk AS (
  SELECT conv_id, 0::BIGINT AS i, n, struct_pack(c := 0, l := '') AS o, struct_pack(c := 999999999, l := '') AS s, struct_pack(c := 5, l := 'I') AS u, struct_pack(c := 10, l := 'II') AS a FROM sums
  UNION ALL
  SELECT conv_id, i, n, o, s, least(u, struct_pack(c := a.c + 5, l := a.l || 'I'), struct_pack(c := o.c + 5, l := o.l || 'I'), struct_pack(c := s.c + 5, l := s.l || 'I')) AS u,
    least(a, struct_pack(c := least(u, struct_pack(c := o.c + 5, l := o.l || 'I'), struct_pack(c := s.c + 5, l := s.l || 'I')).c + 5, l := least(u, struct_pack(c := o.c + 5, l := o.l || 'I'), struct_pack(c := s.c + 5, l := s.l || 'I')).l || 'I')) AS a
  FROM (
    SELECT w.conv_id, w.i + 1 AS i, n, struct_pack(c := o.c + 2, l := o.l || 'D') AS o,
      least(struct_pack(c := s.c + 2, l := s.l || 'D'), CASE WHEN keep AND r = 's' THEN struct_pack(c := o.c + t, l := o.l || 'K') ELSE no END) AS s,
      least(struct_pack(c := u.c + 2, l := u.l || 'D'), CASE WHEN keep AND r = 'u' THEN least(struct_pack(c := o.c + t, l := o.l || 'K'), struct_pack(c := s.c + t, l := s.l || 'K'), struct_pack(c := a.c + t, l := a.l || 'K')) ELSE no END,
        CASE WHEN keep THEN least(struct_pack(c := o.c + t + 1, l := o.l || 'R'), struct_pack(c := s.c + t + 1, l := s.l || 'R'), struct_pack(c := a.c + t + 1, l := a.l || 'R')) ELSE no END) AS u,
      least(struct_pack(c := a.c + 2, l := a.l || 'D'), CASE WHEN keep AND r = 'a' THEN struct_pack(c := u.c + t, l := u.l || 'K') ELSE no END, CASE WHEN keep THEN struct_pack(c := u.c + t + 1, l := u.l || 'R') ELSE no END) AS a
    FROM walk w JOIN (SELECT conv_id, i, r, fault IS NULL OR fault = 'truncated' AS keep, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS t, struct_pack(c := 999999999, l := '') AS no FROM faults) f
      ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
best AS (SELECT conv_id, least(o, a) AS b FROM walk WHERE i = n),
letters AS (SELECT conv_id, b.l AS audit, unnest(generate_series(1, length(b.l))) AS k FROM best),
edits AS (SELECT conv_id, k, audit[k] AS e, count(*) FILTER (audit[k] <> 'I') OVER w AS i, count(*) FILTER (audit[k] <> 'D') OVER w AS p FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
kept AS (SELECT e.conv_id, e.p, e.e, f.role, CASE WHEN e.e = 'I' THEN '' ELSE f.text END AS text, max(CASE WHEN e.e = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e.e <> 'D'),
told AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (p - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.l, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
