"""Queries over Markdown: lines, tables, image references, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import images, tables
from foliant.plans.inputs import MIXED, PICTURES, RAGGED, TABLE_ROWS, derived, for_duckdb, read

_MIXED, _RAGGED, _PICTURES = for_duckdb(MIXED), for_duckdb(RAGGED), for_duckdb(PICTURES)
_LINES = "string_split(CASE WHEN suffix(md, chr(10)) THEN left(md, length(md) - 1) ELSE md END, chr(10))"
_PIPE = "(starts_with(trim({0}), '|') AND length({0}) - length(replace({0}, '|', '')) >= 2)"
_CELLS = r"list_transform(regexp_extract_all(regexp_replace(regexp_replace(trim({0}), '^\|', ''), '\|$', '') || ' |', '((?:\\.|[^|\\])*)\|', 1), lambda x: trim(x))"


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with its number and length."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", F.length("line").alias("n"), F.md5("line").alias("digest"))


MD_LINES = """
SELECT doc_id, CAST(i - 1 AS INT) AS line_no, CAST(length(l[i]) AS INT) AS n, md5(l[i]) AS digest
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT doc_id, string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents WHERE text <> ''))
"""


def md_table_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, TABLE_ROWS)
    return tables.export(rows, "key", ["n", "p", "s", "flag", "status", "qty"], ["part", "qty", "flag", "status"])


MD_TABLE_EXPORT = f"""
SELECT key, '| part | qty | flag | status |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  string_agg('| ' || part || ' | ' || qty || ' | ' || flag || ' | ' || status || ' |', chr(10) ORDER BY n, p, s, flag, status, qty) AS markdown
FROM ({for_duckdb(TABLE_ROWS)}) GROUP BY key
"""


def md_table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, MIXED).select("key", F.posexplode(tables.blocks(F.col("md"))).alias("pos", "b"))
    return rows.select("key", "pos", "b.start_line", "b.end_line", "b.kind", "b.markdown")


# The inputs hold a pipe run of three lines, an HTML block that may lack its end, and a run of two at the end.
MD_TABLE_BLOCKS = f"""
WITH d AS (SELECT key, {_LINES} AS l FROM ({_MIXED})),
rows AS (SELECT key, i, l[i] AS x, l FROM (SELECT key, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
marks AS (SELECT *, {_PIPE.format("x")} AS pipe, lower(x) LIKE '%<table%' AS opens, lower(x) LIKE '%</table>%' AS shuts FROM rows),
html AS (SELECT o.key, o.i AS a, min(s.i) AS b FROM marks o JOIN marks s ON s.key = o.key AND s.i >= o.i AND s.shuts WHERE o.opens GROUP BY 1, 2),
runs AS (
  SELECT key, min(i) AS a, max(i) AS b FROM (SELECT key, i, i - row_number() OVER (PARTITION BY key ORDER BY i) AS g FROM marks WHERE pipe) GROUP BY key, g HAVING count(*) >= 2),
every AS (SELECT *, 'html' AS kind FROM html UNION ALL SELECT *, 'pipe' FROM runs)
SELECT e.key, CAST(row_number() OVER (PARTITION BY e.key ORDER BY a) - 1 AS INT) AS pos, CAST(a - 1 AS INT) AS start_line, CAST(b - 1 AS INT) AS end_line, kind,
  array_to_string(list_slice(l, a, b), chr(10)) AS markdown
FROM every e JOIN d ON d.key = e.key
"""


def md_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and rows of each table of each kind."""
    rows = derived(spark, sf_dir, MIXED).select("key", F.posexplode(tables.blocks(F.col("md"))).alias("pos", "b"))
    return rows.select("key", "pos", tables.column_count(F.col("b.markdown")).cast("int").alias("n_columns"), tables.html_rows(F.col("b.markdown")).alias("n_tr"))


MD_TABLE_COLUMNS = f"""
WITH b AS ({MD_TABLE_BLOCKS})
SELECT key, pos, CAST(CASE WHEN kind = 'pipe' THEN 2 ELSE greatest(1, key % 4) + 1 END AS INT) AS n_columns,
  CAST(len(regexp_extract_all(markdown, '(?i)<tr\\b')) AS INT) AS n_tr FROM b
""".replace("\\\\b", "\\b")


def md_table_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RAGGED).select("key", tables.normalize(F.col("md")).alias("md"))


# Lines 2 and 3 are the header and its rule, 4 and 5 the body; a header of one cell or a rule of two dashes makes no table.
MD_TABLE_NORMALIZE = f"""
WITH d AS (SELECT key, {_LINES} AS l FROM ({_RAGGED})),
c AS (SELECT key, l, {_CELLS.format("l[2]")} AS h, {_CELLS.format("l[4]")} AS r1, {_CELLS.format("l[5]")} AS r2, key % 7 <> 0 AND key % 5 <> 0 AS good FROM d),
f AS (SELECT *, lambda_row(r1, len(h)) AS f1, lambda_row(r2, len(h)) AS f2 FROM c)
SELECT key, CASE WHEN NOT good THEN array_to_string(l, chr(10)) ELSE array_to_string(list_concat(
  [l[1], '| ' || array_to_string(h, ' | ') || ' |', '| --- | --- | --- |', '| ' || array_to_string(f1, ' | ') || ' |', '| ' || array_to_string(f2, ' | ') || ' |'], list_slice(l, 6, len(l))), chr(10)) END AS md
FROM f
"""
_FIT = "CASE WHEN len({0}) > len(h) THEN list_append(list_slice({0}, 1, len(h) - 1), array_to_string(list_slice({0}, len(h), len({0})), ' | ')) ELSE list_concat({0}, list_transform(range(0, greatest(0, len(h) - len({0}))), lambda x: '')) END"
MD_TABLE_NORMALIZE = MD_TABLE_NORMALIZE.replace("lambda_row(r1, len(h))", _FIT.format("r1")).replace("lambda_row(r2, len(h))", _FIT.format("r2"))


def md_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every pipe line, separator lines marked."""
    rows = derived(spark, sf_dir, RAGGED).select("key", F.posexplode(text.lines(F.col("md"))).alias("line_no", "line")).where(tables.is_pipe_line(F.col("line")))
    cells = tables.split_row(F.col("line"))
    return rows.select("key", "line_no", F.array_join(cells, "¦").alias("cells"), F.size(cells).alias("n"), tables.is_separator(F.col("line")).alias("rule"))


MD_SPLIT_ROWS = f"""
WITH r AS (SELECT key, i, l[i] AS x FROM (SELECT key, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT key, {_LINES} AS l FROM ({_RAGGED})))),
c AS (SELECT key, CAST(i - 1 AS INT) AS line_no, {_CELLS.format("x")} AS c FROM r WHERE {_PIPE.format("x")})
SELECT key, line_no, array_to_string(c, '¦') AS cells, CAST(len(c) AS INT) AS n, len(list_filter(c, lambda x: NOT regexp_matches(x, '^:?-{{3,}}:?$'))) = 0 AS rule FROM c
"""


def md_table_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables worth a second look, among ragged, wide and sparse ones."""
    md = F.col("md")
    return derived(spark, sf_dir, RAGGED).select("key", tables.is_suspicious(md).alias("suspicious"), F.round(tables.empty_share(md), 6).alias("empty_share"), tables.is_caption_worthy(tables.first_block(md)).alias("caption_worthy"))


MD_TABLE_SUSPICIOUS = f"""
WITH p AS (SELECT key, list_filter({_LINES}, lambda x: starts_with(trim(x), '|')) AS l FROM ({_RAGGED})),
c AS (SELECT key, l, list_transform(l, lambda y: {_CELLS.format("y")}) AS c,
  len(string_split(trim(trim(l[1]), '|'), '|')) AS w FROM p),
e AS (SELECT *, flatten(list_slice(c, 3, len(c))) AS body FROM c)
SELECT key, w > 1 AND (w >= 8 OR len(list_filter(c, lambda r: len(r) <> w)) > 0 OR len(list_filter(body, lambda x: x = '')) / len(body) > 0.4) AS suspicious,
  round(len(list_filter(body, lambda x: x = '')) / len(body), 6) AS empty_share,
  len(l) >= 3 AND w >= 2 AND length(array_to_string(l, chr(10))) >= 40 AS caption_worthy
FROM e
"""


def md_table_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables against versions with a row or a cell lost, or nothing left, by key."""
    rows = derived(spark, sf_dir, TABLE_ROWS)
    md = tables.export(rows, "key", ["n", "p", "s", "flag", "status", "qty"], ["part", "qty", "flag", "status"])
    k = F.col("key") % 5
    changed = F.when(k == 0, "").when(k == 1, F.regexp_replace("markdown", r"\n[^\n]*$", "")).when(k == 2, F.regexp_replace("markdown", r" \| [^|]* \|$", " |")).otherwise(F.col("markdown"))
    return md.select("key", tables.invariants(F.col("markdown"), changed).alias("v")).select("key", "v.ok", "v.reason")


MD_TABLE_INVARIANTS = """
SELECT l_orderkey AS key, l_orderkey % 5 > 2 AS ok,
  CASE l_orderkey % 5 WHEN 0 THEN 'empty_output' WHEN 1 THEN 'row_count_changed' WHEN 2 THEN 'row_column_count_changed' END AS reason
FROM lineitem GROUP BY l_orderkey
"""


def md_image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, PICTURES)
    return rows.select("key", F.posexplode(images.refs(F.col("md"))).alias("pos", "path"))


MD_IMAGE_REFS = rf"""
SELECT key, CAST(i - 1 AS INT) AS pos, r[i] AS path
FROM (SELECT key, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT key, regexp_extract_all(md, '!\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1) AS r FROM ({_PICTURES})))
"""


def md_image_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference with its line, and the label found for it."""
    rows = derived(spark, sf_dir, PICTURES).select("key", text.lines(F.col("md")).alias("l"), F.posexplode(images.image_blocks(F.col("md"))).alias("pos", "b"))
    return rows.select("key", "pos", "b.line_no", "b.alt", "b.src", images.label(F.col("l"), F.col("b.line_no"), F.col("b.alt")).alias("label"))


MD_IMAGE_BLOCKS = rf"""
WITH r AS (SELECT key, i, l[i] AS x, l FROM (SELECT key, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT key, {_LINES} AS l FROM ({_PICTURES})))),
m AS (SELECT key, i, l, raw, k FROM (SELECT key, i, l, unnest(range(1, len(f) + 1)) AS k, f, f[k] AS raw FROM (SELECT *, regexp_extract_all(x, '!\[([^\]]*)\]\(([^)]+)\)', 0) AS f FROM r))),
b AS (SELECT key, i, k, trim(regexp_extract(raw, '!\[([^\]]*)\]\(([^)]+)\)', 1)) AS alt, trim(regexp_extract(raw, '!\[([^\]]*)\]\(([^)]+)\)', 2)) AS src FROM m),
ids AS (SELECT key, i, trim(regexp_extract(regexp_replace(trim(x), '\s+', ' ', 'g'), '(图\s*[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*(?:-\d+)?)', 1)) AS id FROM r),
near AS (SELECT b.key, b.i, b.k, ids.id, row_number() OVER (PARTITION BY b.key, b.i, b.k ORDER BY abs(ids.i - b.i), ids.i) AS n
  FROM b JOIN ids ON ids.key = b.key AND ids.i <> b.i AND abs(ids.i - b.i) <= 8 AND id <> '')
SELECT b.key, CAST(row_number() OVER (PARTITION BY b.key ORDER BY b.i, b.k) - 1 AS INT) AS pos, CAST(b.i - 1 AS INT) AS line_no, alt, src, coalesce(near.id, '图像补充') AS label
FROM b LEFT JOIN near ON near.key = b.key AND near.i = b.i AND near.k = b.k AND n = 1
"""


def md_image_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against a version that renames or drops one, by key."""
    k, md = F.col("key") % 3, F.col("md")
    changed = F.when(k == 0, F.replace(md, F.lit("img/"), F.lit("pic/"))).when(k == 1, F.regexp_replace(md, r"!\[\]\([^)]*\)", "")).otherwise(md)
    v = derived(spark, sf_dir, PICTURES).select("key", images.invariants(md, changed).alias("v"))
    return v.select("key", "v.ok", F.array_join("v.missing", ",").alias("missing"), "v.missing_count")


MD_IMAGE_INVARIANTS = """
SELECT p_partkey AS key, p_partkey % 3 = 2 AS ok, CASE WHEN p_partkey % 3 = 0 THEN 'img/' || p_partkey || '.png' ELSE '' END AS missing,
  CAST(p_partkey % 3 = 0 AS INT) AS missing_count FROM part
"""


def nearest_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two images nearest to each table: those before it first."""
    rows = derived(spark, sf_dir, PICTURES).withColumnRenamed("key", "doc_id")
    starts = rows.select("doc_id", F.explode(tables.blocks(F.col("md"))).alias("b")).select("doc_id", "b.start_line")
    found = rows.select("doc_id", F.explode(images.refs_by_line(F.col("md"))).alias("r")).select("doc_id", "r.line_no", "r.path")
    return images.nearest(starts, found, 2)


NEAREST_IMAGES = rf"""
WITH r AS (SELECT key, i - 1 AS i, l[i] AS x FROM (SELECT key, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT key, {_LINES} AS l FROM ({_PICTURES})))),
t AS (SELECT key, min(i) AS start_line FROM r WHERE {_PIPE.format("x")} GROUP BY key),
p AS (SELECT key, i AS line_no, regexp_extract(x, '!\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1) AS path FROM r)
SELECT key AS doc_id, CAST(start_line AS INT) AS start_line, CAST(n AS INT) AS n, CAST(line_no AS INT) AS line_no, path FROM (
  SELECT t.key, start_line, line_no, path, row_number() OVER (PARTITION BY t.key, start_line ORDER BY line_no > start_line, abs(line_no - start_line), line_no, path) AS n
  FROM t JOIN p ON p.key = t.key AND path <> '') WHERE n <= 2
"""


def md_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around each table, and around each document's first image line."""
    rows = derived(spark, sf_dir, PICTURES).select("key", text.lines(F.col("md")).alias("l"), F.get(tables.blocks(F.col("md")), F.lit(0)).alias("b"))
    return rows.select("key", images.table_context(F.col("l"), F.col("b.start_line"), F.col("b.end_line"), 2).alias("table_context"), images.image_context(F.col("l"), F.lit(1), 3).alias("image_context"))


MD_CONTEXTS = f"""
WITH d AS (SELECT key, {_LINES} AS l FROM ({_PICTURES})),
t AS (SELECT *, list_position(l, '| a | b |') AS a FROM d),
c AS (SELECT key, trim(array_to_string(list_slice(l, greatest(1, a - 2), a - 1), chr(10)), ' ' || chr(10)) AS b1, trim(array_to_string(list_slice(l, a + 3, a + 4), chr(10)), ' ' || chr(10)) AS a1,
  l[1] AS b2, array_to_string(list_filter(list_slice(l, 3, 5), lambda x: trim(x) <> ''), chr(10)) AS a2 FROM t)
SELECT key, array_to_string(list_filter([CASE WHEN b1 <> '' THEN '【前文】' || chr(10) || b1 END, CASE WHEN a1 <> '' THEN '【后文】' || chr(10) || a1 END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS table_context,
  '【前文】' || chr(10) || b2 || chr(10) || chr(10) || '【后文】' || chr(10) || a2 AS image_context
FROM c
"""


def md_insert_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caption after each table."""
    rows = derived(spark, sf_dir, PICTURES).select("key", "md", tables.blocks(F.col("md")).alias("b"))
    captions = F.map_from_entries(F.transform("b", lambda b: F.struct(b["end_line"], F.concat(F.lit("about "), F.length(b["markdown"]).cast("string")))))
    return rows.select("key", images.with_captions(F.col("md"), captions, "表格信息").alias("md"))


MD_INSERT_CAPTIONS = f"""
WITH d AS (SELECT key, {_LINES} AS l FROM ({_PICTURES})), t AS (SELECT *, list_position(l, '| a | b |') AS a FROM d)
SELECT key, array_to_string(list_concat(list_slice(l, 1, a + 2), ['', '> **表格信息：** about ' || length(array_to_string(list_slice(l, a, a + 2), chr(10))), ''], list_slice(l, a + 3, len(l))), chr(10)) AS md FROM t
"""


def md_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.operators import review

    rows = derived(spark, sf_dir, MIXED)
    return rows.select("key", review.summary(F.col("md")).alias("s")).select("key", "s.*")


MD_QUALITY_SUMMARY = rf"""
SELECT key, CAST(length(md) AS INT) AS len_chars, CAST(len(regexp_extract_all(md, '!\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1)) AS INT) AS image_refs,
  CAST(len(regexp_extract_all(md, '(?i)<tr\b')) + len(list_filter({_LINES}, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) AS INT) AS table_rows
FROM ({_MIXED})
"""

QUERIES = {
    "md_lines": (md_lines, MD_LINES),
    "md_table_export": (md_table_export, MD_TABLE_EXPORT),
    "md_table_blocks": (md_table_blocks, MD_TABLE_BLOCKS),
    "md_table_columns": (md_table_columns, MD_TABLE_COLUMNS),
    "md_table_normalize": (md_table_normalize, MD_TABLE_NORMALIZE),
    "md_split_rows": (md_split_rows, MD_SPLIT_ROWS),
    "md_table_suspicious": (md_table_suspicious, MD_TABLE_SUSPICIOUS),
    "md_table_invariants": (md_table_invariants, MD_TABLE_INVARIANTS),
    "md_image_refs": (md_image_refs, MD_IMAGE_REFS),
    "md_image_blocks": (md_image_blocks, MD_IMAGE_BLOCKS),
    "md_image_invariants": (md_image_invariants, MD_IMAGE_INVARIANTS),
    "nearest_images": (nearest_images, NEAREST_IMAGES),
    "md_contexts": (md_contexts, MD_CONTEXTS),
    "md_insert_captions": (md_insert_captions, MD_INSERT_CAPTIONS),
    "md_quality_summary": (md_quality_summary, MD_QUALITY_SUMMARY),
}
