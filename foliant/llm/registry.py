"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, embeddings, language, lines, merkle, mixing, packing, quality, resample, simhash, suffixes, toxicity, url_filter
from foliant.llm.common import read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(read(spark, sf_dir, "documents"), width=200, with_bytes=False).drop("spans")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources at the square root of their size, one epoch's worth of rows in all."""
    return mixing.mix(read(spark, sf_dir, "documents"), temperature=0.5, epochs=1.0, seed=17)


OP5_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, round(sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () * 1.0 / n, 9) AS rate FROM counts),
steps AS (
  SELECT source, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rates),
cdf AS (
  SELECT source, round(sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k), 12) AS c FROM steps),
drawn AS (
  SELECT *, CAST(('0x' || substr(md5('17:' || doc_id), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS n
  FROM drawn d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u
  GROUP BY ALL),
copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy_no FROM counted)
SELECT *, md5('17:' || doc_id || ':' || copy_no) AS shuffle_key FROM copies
"""

#: When each page was fetched, and the dated list, are derived from the tables at hand: minutes from the
#: page's id, and up to four entries a host from its digest. Both engines read the same expressions.
FETCHED = "timestamp_seconds(1704067200 + 60 * ((page_id * 7919) % 525600))"
ENTRIES = """
SELECT CASE WHEN h % 3 = 0 AND host LIKE '%.%.%' THEN regexp_replace(host, '^[^.]+[.]', '') ELSE host END AS pattern,
       CASE WHEN h % 2 = 0 THEN 'adult' ELSE 'spam' END AS category,
       CASE WHEN step % 2 = 0 THEN 'add' ELSE 'remove' END AS action,
       timestamp_seconds(1704067200 + 86400 * (h % 200 + step * (h % 50 + 5))) AS dated
FROM (SELECT host, h, explode(sequence(0, CAST(h % 4 AS INT))) AS step
      FROM (SELECT host, CAST(conv(substr(md5(host), 1, 8), 16, 10) AS BIGINT) AS h FROM {hosts} WHERE host <> '') WHERE h % 5 < 3)
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list as it stood when the page was fetched."""
    captures = read(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("host")).distinct()
    found = url_filter.filter_urls(captures, spark.sql(ENTRIES, hosts=hosts))
    return found.withColumn("n_active", F.col("n_active").cast("long"))


OP10_SQL = r"""
WITH captures AS (
  SELECT page_id, url, make_timestamp((1704067200 + 60 * ((page_id * 7919) % 525600)) * 1000000) AS fetched_at,
         regexp_replace(regexp_extract(lower(url), '{HOST}', 1), '\.+$', '') AS host
  FROM pages),
hashed AS (
  SELECT host, CAST(('0x' || substr(md5(host), 1, 8)) AS BIGINT) AS h FROM (SELECT DISTINCT host FROM captures) WHERE host <> ''),
entries AS (
  SELECT DISTINCT CASE WHEN h % 3 = 0 AND host LIKE '%.%.%' THEN regexp_replace(host, '^[^.]+[.]', '') ELSE host END AS pattern,
         CASE WHEN h % 2 = 0 THEN 'adult' ELSE 'spam' END AS category,
         CASE WHEN step % 2 = 0 THEN 'add' ELSE 'remove' END AS action,
         make_timestamp((1704067200 + 86400 * (h % 200 + step * (h % 50 + 5))) * 1000000) AS dated
  FROM (SELECT host, h, unnest(range(0, h % 4 + 1)) AS step FROM hashed WHERE h % 5 < 3)),
spans AS (
  SELECT * FROM (SELECT *, lead(dated) OVER (PARTITION BY pattern, category ORDER BY dated, action) AS valid_to FROM entries)
  WHERE action = 'add' AND (valid_to IS NULL OR valid_to > dated)),
hits AS (
  SELECT c.page_id, s.pattern, s.category, s.dated,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.pattern) DESC, s.dated DESC, s.category) AS k,
         count(*) OVER (PARTITION BY c.page_id) AS n
  FROM captures c JOIN spans s
    ON (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern) AND NOT regexp_matches(c.host, '{ADDRESS}')) AND s.dated <= c.fetched_at AND (s.valid_to IS NULL OR s.valid_to > c.fetched_at))
SELECT c.page_id, c.url, c.fetched_at, c.host, h.page_id IS NOT NULL AS blocked, coalesce(h.n, 0) AS n_active,
       h.pattern, h.category, h.dated AS listed_at
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.k = 1
""".replace("{HOST}", url_filter.HOST).replace("{ADDRESS}", url_filter.ADDRESS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("n_removed_lines").alias("n_removed"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs))
    return decoded.select("doc_id", F.expr("CAST(octet_length(ids) div 4 AS long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: What a leaf of the manifest is made of, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded anew from a text that is lower-cased in about every fifth."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    now = F.when(touched, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle.verified(read(spark, sf_dir, "documents"), LEAF, "source", "doc_id", altered={"text": now})


#: The CRC-32 of the text `v` in a table with the column t, a list of 256 remainders; CRC_TABLE makes that list.
CRC_TABLE = """
remainders AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b)))
"""
CRC = """
xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen({v}), 2), lambda i: CAST('0x' || substr(hex(encode({v})), i, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)
"""

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
touched AS (SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS d FROM documents WHERE doc_id IS NOT NULL),
marked AS (SELECT DISTINCT id, {CRC.format(v="d")} % 5 = 0 AS hit FROM touched, remainders),
fields AS (
  SELECT doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         CASE WHEN hit THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS now
  FROM documents LEFT JOIN marked ON id = doc_id),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS now
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves),
below AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM below WHERE n > 1 GROUP BY tree, level, pos // 16),
subroots AS (SELECT tree, digest, count(*) OVER () AS n FROM below WHERE n = 1),
above AS (
  SELECT 0 AS level, tree AS pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, pos // 16),
met AS (
  SELECT p.tree AS tree, p.pos AS pos, b.level AS step, b.digest AS digest, b.pos AS sib, p.pos >> CAST(4 * b.level AS BIGINT) AS own
  FROM placed p JOIN below b ON b.tree = p.tree AND b.n > 1 AND b.pos // 16 = p.pos >> CAST(4 * (b.level + 1) AS BIGINT)
  UNION ALL
  SELECT p.tree, p.pos, 100 + a.level, a.digest, a.pos, p.tree >> CAST(4 * a.level AS BIGINT)
  FROM placed p JOIN above a ON a.n > 1 AND a.pos // 16 = p.tree >> CAST(4 * (a.level + 1) AS BIGINT)),
steps AS (
  SELECT tree, pos, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS k,
         coalesce(string_agg(digest, '' ORDER BY sib) FILTER (WHERE sib < own), '') AS l, coalesce(string_agg(digest, '' ORDER BY sib) FILTER (WHERE sib > own), '') AS r
  FROM met GROUP BY tree, pos, step),
folded AS (
  SELECT tree, pos, CAST(0 AS BIGINT) AS k, now AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.pos, s.k, sha256(s.l || f.digest || s.r) FROM folded f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k + 1),
last AS (SELECT tree, pos, arg_max(digest, k) AS folded_root FROM folded GROUP BY tree, pos),
proofs AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM steps GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, s.digest AS subroot, a.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, l.folded_root, l.folded_root = a.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN last l USING (tree, pos) LEFT JOIN proofs q USING (tree, pos) CROSS JOIN (SELECT digest FROM above WHERE n = 1) a
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
WITH {CRC_TABLE},
rows AS (SELECT row_number() OVER () AS r, * FROM documents),
used AS (
  SELECT r, w FROM (SELECT r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM rows)),
wanted AS (SELECT unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
every AS (SELECT w FROM used UNION SELECT w FROM wanted),
hashed AS (SELECT w, {CRC.format(v="w")} % 10000 AS b FROM every, remainders),
source AS (SELECT b, count(*) AS s FROM used JOIN hashed USING (w) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM wanted JOIN hashed USING (w) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM used) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)))) AS BIGINT) AS gain
  FROM source LEFT JOIN target USING (b)),
weighed AS (SELECT r, count(*) AS n, sum(gain) AS total FROM used JOIN hashed USING (w) JOIN gains USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE CAST((total - ((total % n) + n) % n) // n AS BIGINT) END AS weight,
         CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM rows LEFT JOIN weighed USING (r)),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER () AS n FROM noisy WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, CAST(score AS BIGINT) AS score, CASE WHEN k <= n * 10 // 100 THEN k END AS rank
FROM noisy LEFT JOIN ranked USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op4_language_id": op4_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_quality_rules": op7_quality_rules,
        "op5_source_mixing": op5_source_mixing,
        "op10_url_filters": op10_url_filters,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op8_line_dedup": op8_line_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mixing": OP5_SQL, "op10_url_filters": OP10_SQL, "op12_merkle_manifest": OP12_SQL, "op13_importance_resampling": OP13_SQL}
