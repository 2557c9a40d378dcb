"""Registered queries of the operators, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import (bpe_counts, collocations, compact_windows, exact_dedup, filter_audit, graph_ann, language_id,
                          minhash_dedup, mixing, pii, piece_codec, rans_store, topk_mtree)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_topk_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_mtree.top_k(_table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "language.lang_pred", "language.score")


def op3_rans_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = rans_store.write_store(_table(spark, sf_dir, "documents"))
    return rans_store.read_store(spark, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = piece_codec.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "pieces.n_tokens", F.sha2("pieces.ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("pieces.decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string")))
    return compact_windows.repeated_passages(_table(spark, sf_dir, "documents")).withColumn(
        "passages", F.array_join(spans, ","))


def op10_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(_table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(
        filter_audit.document_masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_topk_mtree, op2_language_id, op3_rans_store, op4_minhash_dedup, op5_source_mix, op6_pii, op7_bpe_counts,
    op8_piece_codec, op9_compact_windows, op10_graph_ann, op11_filter_audit, op12_exact_dedup,
    op13_collocations)}

SQL: dict[str, str] = {
    "op11_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id),
states AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
perm AS (
  SELECT p.c || q.c || r.c || s.c || u.c AS filter_order,
         [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM letter p, letter q, letter r, letter s, letter u
  WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | u.bit) = 31),
steps AS (
  SELECT filter_order, k::INT AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS earlier
  FROM perm, unnest(range(1, 6)) AS x(k)),
report AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM states, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM report""",
    "op12_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
         AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM words, unnest(range(1, len(w) + 1)) AS x(i), unnest([1, 2, 3, 4]) AS y(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS rest
  FROM counts, unnest([1, 2, 3]) AS x(c) WHERE k > 1 AND c < k AND f >= 30),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r,
         ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score, c
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = head
            JOIN counts y ON y.lang = cuts.lang AND y.phrase = rest),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM counts, unnest([1, 2, 3]) AS x(i), unnest([2, 3]) AS y(m)
  WHERE f >= 30 AND m < k AND i + m - 1 <= k GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM lowest JOIN total USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY rank <= 2000""",
}
