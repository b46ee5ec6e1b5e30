"""Temporal list join: which dated block-list entry was in force when each page was fetched.

Every pattern's dated entries become validity intervals (an entry holds until the next one for the same pattern), and each
capture is joined as-of its fetch time: the lookup keys of its URL (host and first path segment, host, every parent domain)
meet the intervals on (key, month) and the interval's bounds decide. The month splits a hot host or domain over partitions
and keeps the candidates of a capture to the intervals of one month; adaptive execution splits what remains skewed, and
broadcasts the intervals where their measured size is under its threshold. Only ids, URLs and times are shuffled.

The most specific entry in force decides: prefix over host over domain, longer domain over shorter. DataFrame functions only.

Defined results: a null or hostless URL and a null fetch time match nothing (verdict 'pass'); entries without pattern, kind
or date are left out; of two entries of one pattern at one instant the larger entry_id counts; repeated captures give one
row each time they are repeated (their number is carried through); empty tables give 'pass' or an empty result; only the
named columns are read, so others cannot clash; an URL of any length is one value; a hot host is one key a month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.\-]*://([^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[a-z][a-z0-9+.\-]*://[^/?#]+/([^/?#]+)"
KINDS = {"domain": 0, "host": 1000, "prefix": 2000}


def intervals(entries: DataFrame) -> DataFrame:
    """entries(entry_id, kind, pattern, action, listed_at) as (key, entry_id, action, rank, valid_from, valid_to); lifted stretches are left out."""
    clean = entries.where("pattern IS NOT NULL AND kind IN ('domain', 'host', 'prefix') AND listed_at IS NOT NULL AND entry_id IS NOT NULL")
    last = clean.groupBy("kind", "pattern", "listed_at").agg(F.max_by(F.struct("entry_id", "action"), "entry_id").alias("e"))
    by = Window.partitionBy("kind", "pattern").orderBy("listed_at")
    held = last.withColumn("valid_to", F.lead("listed_at").over(by)).where(F.col("e.action").isin("block", "allow"))
    rank = F.when(F.col("kind") == "prefix", KINDS["prefix"]).when(F.col("kind") == "host", KINDS["host"]).otherwise(F.length("pattern"))
    return held.select(F.concat_ws(":", "kind", F.lower("pattern")).alias("key"), F.col("e.entry_id").alias("entry_id"), F.col("e.action").alias("action"), rank.cast("int").alias("rank"), F.col("listed_at").alias("valid_from"), "valid_to")


def lookup_keys(host, segment):
    """Array of list keys under which a URL can be listed."""
    labels = F.split(host, "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    exact = F.array(F.concat(F.lit("host:"), host))
    prefix = F.when(segment != "", F.array(F.concat(F.lit("prefix:"), host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.concat(domains, exact, prefix)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched_at) with host, verdict ('block', 'allow' or 'pass'), entry_id and listed_at of the deciding entry."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    base = (
        captures.groupBy("page_id", "url", "fetched_at")
        .agg(F.count("*").alias("times"))
        .withColumn("host", F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), HOST, 2))
        .withColumn("segment", F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), SEGMENT, 1))
    )
    who = ["page_id", "url", "fetched_at", "times", "host"]
    asked = base.where("host <> '' AND fetched_at IS NOT NULL").select(*who, month(F.col("fetched_at")).alias("month"), F.explode(lookup_keys(F.col("host"), F.col("segment"))).alias("key"))
    span = captures.agg(month(F.min("fetched_at")).alias("lo"), month(F.max("fetched_at")).alias("hi")).collect()[0]
    if span["lo"] is None:
        span = {"lo": 0, "hi": 0}
    first = F.greatest(month(F.col("valid_from")), F.lit(span["lo"]))
    until = F.least(F.coalesce(month(F.col("valid_to")), F.lit(span["hi"])), F.lit(span["hi"]))
    listed = intervals(entries).withColumn("month", F.explode(F.when(first <= until, F.sequence(first, until)).otherwise(F.array().cast("array<int>"))))
    inside = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = asked.join(listed, ["key", "month"]).where(inside).select(*who, F.struct("rank", "entry_id", "action", "valid_from").alias("hit"))
    none = base.select(*who, F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"))
    best = hits.unionByName(none).groupBy(*who).agg(F.max("hit").alias("hit"))
    return best.select(
        "page_id",
        "url",
        "fetched_at",
        F.nullif("host", F.lit("")).alias("host"),
        F.coalesce("hit.action", F.lit("pass")).alias("verdict"),
        F.col("hit.entry_id").alias("entry_id"),
        F.col("hit.valid_from").alias("listed_at"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"),
    ).drop("copy")
