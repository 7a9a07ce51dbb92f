"""The registered queries of the training-data operators, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import alignment, blocknames, dominance, gif, langid, mixing, neardup, nearest, pieces, quality, records, secrets, warc
from .common import shared_dir, table


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.describe_media(gif.encode_payloads(table(spark, sf_dir, "documents")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("layers")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_dir(spark)
    return records.read_records(spark, where, records.write_records(table(spark, sf_dir, "documents"), where))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_dir(spark)
    runs = warc.write_archives(table(spark, sf_dir, "pages"), where)
    captures = warc.read_captures(spark, where, warc.merge_runs(spark, where, runs))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32, the decoded text's SHA-256, and whether it is the text's own."""
    docs = table(spark, sf_dir, "documents")
    both = pieces.encode(docs, keep_digest=True)
    back = pieces.decode_rows(both)
    same = F.col("text_sha256").eqNullSafe(F.col("source_sha256"))
    return back.select("doc_id", "ids", "n_pieces", "ids_crc32", "text_sha256", same.alias("lossless"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_dominance_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.sales_above(table(spark, sf_dir, "sales"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_gif_media": op1_gif_media,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_ranking": op3_quality_ranking,
    "op4_source_mix": op4_source_mix,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_records": op7_token_records,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_warc_index": op9_warc_index,
    "op10_piece_sampling": op10_piece_sampling,
    "op11_token_alignment": op11_token_alignment,
    "op12_dominance_count": op12_dominance_count,
    "op13_exact_dedup": op13_exact_dedup,
}
_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {at}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)"
#: CRC-32 of ASCII text: each character's bits are taken in by eight steps.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(sale_id AS VARCHAR), ''), ''), lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, d: xor(xor(c, d) >> 1, 3988292384 * (xor(c, d) & 1))), 4294967295)"
_BASE32 = " || ".join(_B32.format(at=5 * j + 1, shift=s) for j in range(8) for s in (15, 10, 5, 0))

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(l) < 2 THEN l ELSE list_slice(l, CAST(i AS BIGINT), CAST(i AS BIGINT) + 1) END AS g FROM w, range(1, (SELECT max(len(l)) + 1 FROM w)) t(i) WHERE i <= greatest(len(l) - 1, least(len(l), 1))),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
  r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
  c AS (SELECT x AS doc_id, min(y) AS least FROM r GROUP BY x)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op9_warc_index": f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, upper(sha1(coalesce(html, ''))) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages)
  SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM p""",
    "op12_dominance_count": f"""WITH s AS (SELECT sale_id, CAST(floor(epoch(sold_at) / 86400) AS BIGINT) AS slot, CASE WHEN isfinite(total) THEN CAST(floor(floor(100 * total + 0.5) / 1000) AS BIGINT) END AS level, 1 + {_CRC32} % 3 AS w FROM sales),
  c AS (SELECT slot, level, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
  d AS (SELECT a.slot, a.level, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n, CAST(coalesce(sum(b.w), 0) AS BIGINT) AS w FROM c a LEFT JOIN c b ON b.slot <= a.slot AND b.level > a.level GROUP BY ALL)
  SELECT sale_id, s.slot, s.level, d.n AS n_sales, d.w AS n_rows FROM s LEFT JOIN d ON s.slot = d.slot AND s.level = d.level""",
    "op13_exact_dedup": """WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS x FROM documents),
  k AS (SELECT doc_id, x, first_value(doc_id) OVER (PARTITION BY x ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM k""",
}
