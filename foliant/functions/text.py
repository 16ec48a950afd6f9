"""Text functions as Column expressions. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what ends a line (CR LF first).
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: lambdas don't share subexpressions otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end adds none, and an empty text has none."""
    parts = F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END, -1)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(parts)


def join_lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_signs(text: Column, signs: str) -> Column:
    """Without any of the signs at either end. signs: as inside a regular expression's brackets."""
    return F.regexp_replace(text, f"^[{signs}]+|[{signs}]+$", "")


def count_of(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def escape_dimensions(text: Column) -> Column:
    r"""`2*3`, `20m*30` and `2.0 * 2` with `\*`; emphasis and list marks stay."""
    spaced = F.regexp_replace(text, r"((?:\d+\.\d+|\d+))\s+\*(?=\s*\d)", r"$1 \\*")
    tight = F.regexp_replace(spaced, r"(?<=[\d.(\[{])\*(?=\d)", r"\\*")
    return F.regexp_replace(tight, r"(?<=[mM])\*(?=\d)", r"\\*")


def strip_fence(text: Column) -> Column:
    """The inside of a fence around the whole text; the text itself where there is none or nothing in it."""
    t = strip(F.coalesce(text, F.lit("")))
    inner = F.regexp_replace(t, r"^```[a-zA-Z0-9_-]*\s*\n?", "")
    inner = strip(F.regexp_replace(inner, r"\n?```$", ""))
    return F.when(t.startswith("```") & (inner != ""), inner).otherwise(t)


def short_id(job_id: Column) -> Column:
    return F.when(F.length(job_id) > 10, F.concat(F.left(job_id, F.lit(8)), F.lit("…"))).otherwise(job_id)


def folder_name(name: Column, longest: int = 120) -> Column:
    """A name that is safe as a folder's: `model` if nothing is left."""
    s = strip(F.coalesce(name, F.lit("")))
    s = F.regexp_replace(s, r'[\\/:*?"<>|]', "_")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "_"), "_+", "_")
    s = F.left(strip_signs(s, "._"), F.lit(longest))
    return F.when(s == "", F.lit("model")).otherwise(s)


def parse_bool(text: Column, default: bool = False) -> Column:
    return F.when(text.isNull(), F.lit(default)).otherwise(F.lower(strip(text)).isin("1", "true", "yes", "on"))


def parse_size(text: Column, default: int) -> Column:
    """Bytes of `20MB`, `1.5 GB`, `512`; the default where the text is empty."""
    t = F.upper(strip(F.coalesce(text, F.lit(""))))
    number = F.regexp_extract(t, r"^([0-9.]+)\s*(GB|MB|KB|B)?$", 1)
    unit = F.regexp_extract(t, r"^([0-9.]+)\s*(GB|MB|KB|B)?$", 2)
    scale = F.when(unit == "GB", 1 << 30).when(unit == "MB", 1 << 20).when(unit == "KB", 1 << 10).otherwise(1).cast("double")
    size = (number.try_cast("double") * scale).try_cast("long")
    return F.when(t == "", F.lit(default).cast("long")).otherwise(size)


def parse_list(text: Column, default: list[str]) -> Column:
    """Lower-case entries of a comma list, without leading dots, empty ones left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.regexp_replace(F.lower(strip(x)), r"^\.+", ""))
    found = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.when(F.size(found) == 0, F.array(*[F.lit(x) for x in default])).otherwise(found)


def key_values(fields: Column) -> Column:
    """`k=v` pairs of a map, null as `-`, line ends escaped."""
    entry = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.replace(e["value"], F.lit("\n"), F.lit("\\n")), F.lit("-")))
    return F.array_join(F.transform(F.map_entries(fields), entry), " ")


def setting(text: Column, key: str) -> Column:
    """What follows `key=` on its line, stripped; null where the key is missing."""
    found = F.regexp_extract_all(text, F.lit(f"{key}=([^\\n\\r]*)"), F.lit(1))
    return strip(F.get(found, F.lit(0)))


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's last part, with its dot; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]+(\.[^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def data_url(name: Column, content: Column) -> Column:
    """A data URL with the type that the name's suffix tells, PNG by default."""
    s = suffix(name)
    kind = F.when(s.isin(".jpg", ".jpeg"), "image/jpeg").when(s == ".gif", "image/gif").when(s == ".webp", "image/webp").when(s == ".bmp", "image/bmp").otherwise("image/png")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


#: Languages of one OCR engine by their names in the other.
OCR_LANGUAGES = {"en": "eng", "ch_sim": "chi_sim", "zh": "chi_sim", "chi_sim": "chi_sim"}


def ocr_language(code: Column) -> Column:
    """The other engine's name of a language; one that isn't known keeps its own."""
    names = F.create_map(*[F.lit(x) for pair in OCR_LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(strip(code))), code)


def splice_after(parts: Column, inserts: Column) -> Column:
    """`parts` with the lines of inserts[i] after line i. inserts: map<int, array<string>>."""
    none = F.array().cast("array<string>")
    return let(inserts, lambda m: F.flatten(F.transform(parts, lambda line, i: F.concat(F.array(line), F.coalesce(F.try_element_at(m, i.cast("int")), none)))))
