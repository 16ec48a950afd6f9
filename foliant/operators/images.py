"""Image references of Markdown texts: finding, resolving, rewriting, checking, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import join_lines, lines, splice_after, stem, strip, strip_signs, suffix

#: A reference with a bare path, one with any source, a figure's number.
REF = r'!\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
ANY_REF = r"!\[([^\]]*)\]\(([^)]+)\)"
FIGURE_ID = r"(图\s*[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*(?:-\d+)?)"
DEFAULT_LABEL = "图像补充"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
NEAR_LINES = 8


def refs(markdown: Column) -> Column:
    """Paths of all references, in order."""
    return F.coalesce(F.regexp_extract_all(markdown, F.lit(REF), F.lit(1)), F.array().cast("array<string>"))


def refs_by_line(markdown: Column) -> Column:
    """array<struct<line_no, path>>: each line's first reference."""
    found = F.transform(lines(markdown), lambda x, i: F.struct(i.cast("int").alias("line_no"), F.regexp_extract(x, REF, 1).alias("path")))
    return F.filter(found, lambda r: r["path"] != "")


def image_blocks(markdown: Column) -> Column:
    """array<struct<alt, src, line_no, raw>>: every reference of every line, empty sources left out."""

    def of_line(x: Column, i: Column) -> Column:
        part = lambda raw: F.struct(
            strip(F.regexp_extract(raw, ANY_REF, 1)).alias("alt"), strip(F.regexp_extract(raw, ANY_REF, 2)).alias("src"), i.cast("int").alias("line_no"), raw.alias("raw")
        )
        return F.transform(F.regexp_extract_all(x, F.lit(ANY_REF), F.lit(0)), part)

    return F.filter(F.flatten(F.transform(lines(markdown), of_line)), lambda b: b["src"] != "")


def is_remote(path: Column) -> Column:
    return path.rlike("^(https?://|data:|blob:)")


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^([/\\]|.:[/\\])")


def local_path(ref: Column, folder: Column) -> Column:
    """The file that a reference names, from the Markdown's folder; null for remote ones."""
    bare = F.regexp_replace(ref, "^file://(/(?=.:))?", "")
    joined = F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), F.regexp_replace(bare, r"^(\./)+", ""))
    return F.when(~is_remote(ref), F.when(is_absolute(bare), bare).otherwise(joined))


def resolve(found: DataFrame, files: DataFrame, most: int, mode: str = "local_abs") -> DataFrame:
    """found (doc_id, pos, ref, folder) as model inputs: remote ones as they are, local ones if they exist.

    The first `most` of each document that can be used stay, numbered again from 1.
    """
    local = strip(F.col("ref")).startswith("file://")
    at = found.withColumn("ref", strip(F.col("ref"))).where("ref <> ''").withColumn("__path", F.when(~local, local_path(F.col("ref"), F.col("folder"))))
    there = at.join(files.select(F.col("path").alias("__path"), F.lit(True).alias("__there")).distinct(), "__path", "left")
    url = F.when(F.lit(mode) == "url", F.concat(F.lit("file://"), F.col("__path"))).otherwise(F.col("__path"))
    kept_local = F.when(F.lit(mode) == "url", F.col("ref")).otherwise(F.regexp_replace("ref", "^file://", ""))
    out = there.withColumn("resolved", F.when(local, kept_local).when(is_remote(F.col("ref")), F.col("ref")).when(F.col("__there"), url))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return out.where("resolved IS NOT NULL").withColumn("n", rank).where(F.col("n") <= most).select("doc_id", "n", "resolved")


def copied_names(found: DataFrame) -> DataFrame:
    """(doc_dir, path, target): where each outside file goes under images/, -2, -3 … for equal names."""
    own = found.select("doc_dir", "path").distinct().withColumn("base", F.regexp_extract("path", r"([^/\\]+)$", 1))
    n = F.row_number().over(Window.partitionBy("doc_dir", "base").orderBy("path"))
    name = F.concat(stem(F.col("base")), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.regexp_extract("base", r"(\.[^.]+)$", 1))
    return own.select("doc_dir", "path", F.concat(F.lit("images/"), name).alias("target"))


def invariants(original: Column, refined: Column) -> Column:
    """struct(ok, missing, missing_count): equally many references, and each of the first ones present."""
    a, b = refs(original), refs(refined)
    missing = F.filter(a, lambda r: ~F.array_contains(b, r))
    same = F.size(a) == F.size(b)
    count = F.when(same, F.size(missing)).otherwise(0)
    return F.struct((same & (F.size(missing) == 0)).alias("ok"), F.when(same, F.slice(missing, 1, 10)).otherwise(F.array().cast("array<string>")).alias("missing"), count.alias("missing_count"))


def table_context(parts: Column, first: Column, last: Column, around: int) -> Column:
    """The lines before and after a table, under their headings; blank sides are left out."""
    lo = F.greatest(first - around, F.lit(0))
    before = strip(join_lines(F.slice(parts, lo + 1, first - lo)))
    after = strip(join_lines(F.slice(parts, last + 2, around)))
    both = F.array(F.when(before != "", F.concat(F.lit("【前文】\n"), before)), F.when(after != "", F.concat(F.lit("【后文】\n"), after)))
    return F.array_join(F.filter(both, lambda x: x.isNotNull()), "\n\n")


def image_context(parts: Column, at: Column, around: int) -> Column:
    """As table_context() for one line, blank lines left out first."""
    some = lambda x: F.filter(x, lambda y: strip(y) != "")
    lo = F.greatest(at - around, F.lit(0))
    before, after = join_lines(some(F.slice(parts, lo + 1, at - lo))), join_lines(some(F.slice(parts, at + 2, around)))
    both = F.array(F.when(before != "", F.concat(F.lit("【前文】\n"), before)), F.when(after != "", F.concat(F.lit("【后文】\n"), after)))
    return F.array_join(F.filter(both, lambda x: x.isNotNull()), "\n\n")


def figure_id(text: Column) -> Column:
    """The figure number that a text names; null if none."""
    s = strip_signs(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"\s+", " "), ">*\\- ")
    return F.nullif(strip(F.regexp_extract(s, FIGURE_ID, 1)), F.lit(""))


def label(parts: Column, at: Column, alt: Column) -> Column:
    """A figure's label: from its alt text, or the nearest line within eight, the one before first."""
    near = [n for k in range(1, NEAR_LINES + 1) for n in (F.when(at >= k, figure_id(F.get(parts, at - k))), figure_id(F.get(parts, at + k)))]
    return F.coalesce(figure_id(alt), *near, F.lit(DEFAULT_LABEL))


def nearest(tables: DataFrame, images: DataFrame, most: int) -> DataFrame:
    """tables (doc_id, start_line) with their nearest images (doc_id, line_no, path): those at or before, nearest first, then those after."""
    joined = tables.join(images, "doc_id")
    after = (F.col("line_no") > F.col("start_line")).cast("int")
    own = Window.partitionBy("doc_id", "start_line").orderBy(after, F.abs(F.col("line_no") - F.col("start_line")), "line_no", "path")
    return joined.withColumn("n", F.row_number().over(own)).where(F.col("n") <= most).select("doc_id", "start_line", "n", "line_no", "path")


def with_captions(markdown: Column, captions: Column, title: str) -> Column:
    """`markdown` with a quoted caption after each line that captions (map<int, string>) names."""
    block = lambda k, v: F.array(F.lit(""), F.concat(F.lit(f"> **{title}：** "), v), F.lit(""))
    return join_lines(splice_after(lines(markdown), F.transform_values(captions, block)))


#: Stock openers that a caption loses, by what it is about.
OPENERS = {"image": "^(该图展示了|该图说明了|该图反映了|这张图展示了)", "table": "^(该表列出了|该表说明了|该表展示了|该表反映了)"}
OWN_LABEL = r"^图像补充[:：]\s*"


def clean_caption(text: Column, longest: int, kind: str = "table") -> Column:
    """One line without a fence, a label and stock openers, cut to `longest` characters (0: not cut) and then ended with a full stop."""
    s = F.regexp_replace(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    s = strip(F.regexp_replace(s, r"\n+", " "))
    s = strip(F.regexp_replace(s, OWN_LABEL, "")) if kind == "image" else s
    s = strip(F.regexp_replace(s, OPENERS[kind], ""))
    if longest <= 0:
        return s
    cut = F.concat(F.regexp_replace(F.left(s, F.lit(longest)), "[，,;；。 ]+$", ""), F.lit("。"))
    return F.when(F.length(s) > longest, cut).otherwise(s)


def worth_caption(width: Column, height: Column, least_width: int = 0, least_height: int = 0, least_area: int = 0) -> Column:
    """Whether an image that could be read (its sizes are not null) is large enough; a minimum of 0 is none."""
    fine = width.isNotNull() & height.isNotNull()
    for value, least in ((width, least_width), (height, least_height), (width.cast("long") * height, least_area)):
        fine = fine & (value >= least) if least > 0 else fine
    return F.coalesce(fine, F.lit(False))


def normal_path(path: Column) -> Column:
    """A path without `.` and `..` parts, with forward slashes."""

    def step(out: Column, part: Column) -> Column:
        up = F.when(F.size(out) > 0, F.slice(out, 1, F.size(out) - 1)).otherwise(out)
        return F.when((part == ".") | (part == ""), out).when(part == "..", up).otherwise(F.array_append(out, part))

    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.isNotNull(), F.concat(F.when(path.rlike(r"^[/\\]"), "/").otherwise(""), joined))


def relative_refs(found: DataFrame, files: DataFrame) -> DataFrame:
    """found (doc_dir, ref, pos) as (doc_dir, ref, target, copy_from): what each reference becomes, seen from the document's folder.

    Remote references and files that don't exist (files: path) stay out. A file below the folder is named from it;
    another one is to be copied to images/ under its own name, with -2, -3 … in order of appearance where that is taken.
    """
    own = found.where(strip(F.col("ref")) != "").groupBy("doc_dir", "ref").agg(F.min("pos").alias("pos"))
    folder = F.regexp_replace("doc_dir", "/+$", "")
    own = own.withColumn("path", normal_path(local_path(strip(F.col("ref")), folder))).where("path IS NOT NULL")
    there = own.join(files.select("path").distinct(), "path", "left_semi")
    inside = there.where(F.startswith(F.col("path"), F.concat(folder, F.lit("/"))))
    named = inside.select("doc_dir", "ref", F.substring(F.col("path"), F.length(folder) + 2, F.length("path")).alias("target"), F.lit(None).cast("string").alias("copy_from"))
    outside = there.where(~F.startswith(F.col("path"), F.concat(folder, F.lit("/"))))
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    once = outside.groupBy("doc_dir", "path").agg(F.min("pos").alias("pos")).withColumn("base", base)
    held = files.select(F.regexp_extract("path", r"^(.*)/images/[^/]+$", 1).alias("held_dir"), F.regexp_extract("path", r"/images/([^/]+)$", 1).alias("held")).where("held <> ''").distinct()
    once = once.join(held, (folder == F.col("held_dir")) & (F.col("base") == F.col("held")), "left")
    n = F.row_number().over(Window.partitionBy("doc_dir", "base").orderBy("pos", "path")) + F.col("held").isNotNull().cast("int")
    name = F.concat(stem(F.col("base")), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.regexp_extract("base", r"(\.[^.]+)$", 1))
    copies = once.select("doc_dir", "path", F.concat(F.lit("images/"), name).alias("target"))
    copied = outside.join(copies, ["doc_dir", "path"]).select("doc_dir", "ref", "target", F.col("path").alias("copy_from"))
    return named.unionByName(copied)


def with_targets(markdown: Column, targets: Column) -> Column:
    """`markdown` with the paths of its references replaced by targets (map<string, string>); others stay."""

    def one(raw: Column) -> Column:
        path = F.regexp_extract(raw, REF, 1)
        new = F.coalesce(F.try_element_at(targets, path), path)
        at = F.instr(raw, path)
        return F.concat(F.substring(raw, F.lit(1), at - 1), new, F.substring(raw, at + F.length(path), F.length(raw)))

    found = F.regexp_extract_all(markdown, F.lit(REF), F.lit(0))
    between = F.split(markdown, REF, -1)
    return F.array_join(F.zip_with(between, F.transform(found, one), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def rewrite_refs(docs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, doc_dir, md) with md's references seen from doc_dir and n_changed, and the copies (copy_from, copy_to) to make."""
    found = docs.select("doc_dir", F.posexplode(refs(F.col("md"))).alias("pos", "ref"))
    plan = relative_refs(found, files)
    changed = plan.where("ref <> target").groupBy("doc_dir").agg(F.map_from_entries(F.collect_list(F.struct("ref", "target"))).alias("targets"))  # one folder's
    joined = docs.join(changed, "doc_dir", "left")
    n = F.size(F.filter(refs(F.col("md")), lambda r: F.array_contains(F.map_keys("targets"), r)))
    rewritten = F.when(F.col("targets").isNull(), F.col("md")).otherwise(with_targets(F.col("md"), F.col("targets")))
    copies = plan.where("copy_from IS NOT NULL").select("copy_from", F.concat(F.regexp_replace("doc_dir", "/+$", ""), F.lit("/"), F.col("target")).alias("copy_to")).distinct()
    return joined.select("doc_id", rewritten.alias("md"), F.when(F.col("targets").isNull(), 0).otherwise(n).alias("n_changed")), copies


def with_own_image(markdown: Column, path: Column) -> Column:
    """`markdown` led by its source image where an image produced no reference."""
    add = suffix(path).isin(*IMAGE_SUFFIXES) & (F.size(refs(markdown)) == 0)
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.when(add, F.concat(F.lit("!["), stem(path), F.lit("](images/"), name, F.lit(")\n\n"), markdown)).otherwise(markdown)
