"""URL filter lists joined as they stood when each page was fetched. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh


#: What a host is, for both engines; a user part ends at its last @.
HOST = r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#\s]*@)?(\[[^\]/?#\s]*\]|[^/?#:@\[\]\s]+)"
#: An address stands for itself: it has no parent domain.
ADDRESS = r"^([0-9.]+|\[.*\])$"
#: Tasks that the captures of one host are dealt over.
SALTS = 32


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and final dot; '' if there is none. IPv6 ones keep their brackets."""
    host = F.regexp_extract(F.lower(url), HOST, 1)
    return F.coalesce(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and every parent domain: a.b.c gives a.b.c, b.c and c; an address gives itself."""
    labels = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to): dated entries become half-open intervals.

    entries: (pattern, category, action, dated). An `add` holds until the next entry of its pattern and
    category, or for ever (valid_to null). Of entries of one moment a `remove` counts last. Entries with a
    null pattern or date, and repeated ones, add nothing.
    """
    clean = entries.select(F.lower("pattern").alias("pattern"), "category", "action", "dated").where("pattern IS NOT NULL AND dated IS NOT NULL").distinct()
    own = Window.partitionBy("pattern", "category").orderBy("dated", "action")
    held = clean.withColumn("valid_to", F.lead("dated").over(own)).where("action = 'add' AND (valid_to IS NULL OR valid_to > dated)")
    return held.select("pattern", "category", F.col("dated").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """`captures` with host, blocked, n_active, pattern, category and listed_at; every row stays.

    An entry for a domain covers its subdomains. The named entry is, of those active at fetch time, the
    one with the longest pattern, then the latest, then the first category. A capture without a URL or a time is not blocked.
    Columns of the added names are replaced, others stay, whatever they are called. Hosts are reduced to distinct ones
    before the list is joined, and their captures are dealt over SALTS tasks; a host carries its own list history,
    which grows with the list alone.
    """
    added = ["host", "blocked", "n_active", "pattern", "category", "listed_at"]
    names = [c for c in captures.columns if c not in added or c in (url_col, time_col)]
    host, every, active, first, salt = fresh(captures.columns, "host_key", "every", "active", "first", "salt")
    captures = captures.select(*names, host_of(F.col(url_col)).alias(host))
    hosts = captures.select(host).distinct().where(F.col(host) != "")
    spans = validity(entries)
    listed = hosts.select(host, F.explode(suffixes(F.col(host))).alias("pattern")).join(spans, "pattern")
    entry = F.struct(F.length("pattern").alias("size"), F.col("valid_from"), F.col("valid_to"), F.col("pattern"), F.col("category"))
    history = listed.groupBy(host).agg(F.collect_list(entry).alias(every))
    dealt = history.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    joined = captures.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(dealt, [host, salt], "left")
    at = F.col(time_col)
    holds = lambda e: (e["valid_from"] <= at) & (e["valid_to"].isNull() | (e["valid_to"] > at))
    now = F.coalesce(F.filter(every, holds), F.array().cast(history.schema[every].dataType))
    order = lambda a, b: (
        F.when(a["size"] != b["size"], b["size"] - a["size"])
        .when(a["valid_from"] > b["valid_from"], -1)
        .when(a["valid_from"] < b["valid_from"], 1)
        .when(a["category"].isNull() | (a["category"] < b["category"]), -1)
        .otherwise(1)
    )
    joined = joined.withColumn(active, now).withColumn(first, F.get(F.array_sort(active, order), F.lit(0)))
    return joined.select(
        *names,
        F.col(host).alias("host"),
        (F.size(active) > 0).alias("blocked"),
        F.size(active).alias("n_active"),
        F.col(first)["pattern"].alias("pattern"),
        F.col(first)["category"].alias("category"),
        F.col(first)["valid_from"].alias("listed_at"),
    )
