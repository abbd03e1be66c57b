"""URL filters: temporal list join.

A list is a log of dated entries (pattern, action, listed_on): a pattern is a
host, which also covers its subdomains, or a host with a path prefix. The log
becomes intervals in which a pattern is active, and every capture is held
against the intervals that contain its fetch time. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.llm.common import small, stored

#: An interval is posted to every stretch of so many days that it touches; a capture looks in its own stretch.
STRETCH = 64


def url_host(url: Column) -> Column:
    """Host in lower case without user, port and trailing dots; empty if the text is no absolute URL; null for null."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def url_keys(url: Column) -> Column:
    """Patterns that cover a URL: its host, all parent domains, and the host with each path prefix."""
    host = url_host(url)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    labels, segments = F.split(host, r"\."), F.split(F.ltrim(path, F.lit("/")), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat_ws(".", F.slice(labels, -n, n)))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda n: F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(segments, 1, n)))
    )
    every = F.array_distinct(F.concat(domains, F.when(path != "", prefixes).otherwise(F.array().cast("array<string>"))))
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def list_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, reason, from_day, to_day): when each pattern is active, the end exclusive and null while open.

    ``entries`` has pattern, reason, action ('add' or 'remove') and listed_on.
    An entry holds until the pattern's next one; of entries of one day a
    removal wins, then the smallest reason. Entries without pattern, date or a
    known action are ignored. Hosts are compared in lower case, paths as they are,
    both without slashes at their end.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.regexp_replace(F.concat(F.lower(host), F.substr("pattern", F.length(host) + 1)), "/+$", "")
    usable = entries.where("pattern <> '' AND listed_on IS NOT NULL AND action IN ('add', 'remove')").select(
        pattern.alias("pattern"), "reason", "action", F.col("listed_on").alias("from_day")
    )
    best = usable.groupBy("pattern", "from_day").agg(
        F.max("action").alias("action"), F.min(F.when(F.col("action") == "add", F.col("reason"))).alias("reason")
    )
    until = F.lead("from_day").over(Window.partitionBy("pattern").orderBy("from_day"))
    return best.withColumn("to_day", until).where("action = 'add'").select("pattern", "reason", "from_day", "to_day")


def blocked_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with blocked_by, blocked_reason and n_active: what the list says at fetch time.

    ``captures`` has url and fetched_on. ``blocked_by`` is the longest
    active pattern, of equally long ones the smallest; null if none is active.
    Captures with null or relative URLs or without a date are never blocked.
    Rows that repeat each other are answered each. Columns of the three names
    are replaced; others stay.
    """
    made = ("blocked_by", "blocked_reason", "n_active")
    kept = [c for c in captures.columns if c not in made]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "url", "fetched_on")
    day = F.unix_date("fetched_on")
    intervals = list_intervals(entries)
    last = F.coalesce(F.unix_date("to_day") - 1, F.lit(rows.agg(F.max(day)).first()[0] or 0))
    first = F.unix_date("from_day")
    posted = stored(
        intervals.where(last >= first)
        .withColumn("stretch", F.explode(F.sequence(F.floor(first / STRETCH), F.floor(last / STRETCH))))
        .select("pattern", "reason", "from_day", "to_day", "stretch")
    )
    # distinct (url, day): captures of one page on one day are answered once
    asked = stored(rows.where("url IS NOT NULL AND fetched_on IS NOT NULL").select("url", "fetched_on").distinct())
    keyed = asked.select("url", "fetched_on", F.floor(day / STRETCH).alias("stretch"), F.explode(url_keys(F.col("url"))).alias("pattern"))
    active = (F.col("fetched_on") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("fetched_on") < F.col("to_day")))
    hits = keyed.join(small(posted), ["pattern", "stretch"]).where(active)
    first_hit = F.min(F.struct((-F.length("pattern")).alias("length"), "pattern", "reason"))
    answers = stored(hits.groupBy("url", "fetched_on").agg(first_hit.alias("hit"), F.count(F.lit(1)).alias("n_active")))
    return rows.join(answers, ["url", "fetched_on"], "left").select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.col("hit.pattern").alias("blocked_by"),
        F.col("hit.reason").alias("blocked_reason"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
    )


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages: three entries for each host, its domain and each first path segment, these with a slash at the end."""
    hosts = pages.select(url_host(F.col("url")).alias("pattern"), F.lit("host").alias("reason"))
    domains = hosts.select(F.regexp_extract("pattern", r"([^.]+\.[^.]+)$", 1).alias("pattern"), F.lit("domain").alias("reason"))
    host = url_host(F.col("url"))
    path = F.concat(host, F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*(/[^/?#]+)/", 1), F.lit("/"))
    paths = pages.select(F.when(host != "", path).alias("pattern"), F.lit("path").alias("reason"))
    patterns = hosts.unionByName(domains).unionByName(paths).where("pattern <> ''").groupBy("pattern").agg(F.min("reason").alias("reason"))
    draw = F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("long")
    start = F.date_add(F.lit("2023-01-01").cast("date"), (draw % 500).cast("int"))
    spans = F.array(
        F.struct(F.lit("add").alias("action"), start.alias("listed_on")),
        F.struct(F.lit("remove").alias("action"), F.date_add(start, (draw % 97).cast("int") + 20).alias("listed_on")),
        F.struct(F.lit("add").alias("action"), F.date_add(start, (draw % 211).cast("int") + 90).alias("listed_on")),
    )
    return patterns.select("pattern", "reason", F.inline(spans))


def sample_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages at days that follow from their ids."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 37 % 730).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))
