"""URL filter by a temporal list join.

A list is a history: dated entries say from when a host or a parent domain is blocked or allowed. Each
entry holds until the next one for the same name, which makes validity intervals. A capture is judged
by the entries that were active when it was fetched, the longest matching name first.

The as-of join is an equality join: names with all parents of a capture's host, and months with the
months that an interval covers, so that neither a busy host nor a long history meets in one place; the
exact instants are compared inside a month.

Defined results: a URL's host is what follows its last @ before the path, without port and final dots; an
IP address is one name and has no parents; a null or hostless URL and a null fetch time match nothing
and are kept; entries with a null name, action or date are ignored; of several entries for one name at
one instant a blocking one counts, else the last action by the alphabet; identical captures are judged
each; an empty list keeps everything; empty captures give none; other columns pass through, but for the
names of the new ones, which raise ValueError. Very long URLs are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import smaller, stage

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\\[[^]/?#@]*\\]|[^/?#:@]*)"
ADDRESS = "^(\\[.*|[0-9]+([.][0-9]+){3})$"


def name_of(host: Column) -> Column:
    """Lower-cased, without final dots; null where nothing is left."""
    return F.nullif(F.rtrim(F.lower(host), F.lit(".")), F.lit(""))


def host_of(url: Column) -> Column:
    """The host of a URL, null where there is none."""
    return name_of(F.regexp_extract(url, HOST, 1))


def parents(host: Column) -> Column:
    """The host and every domain above it; an IP address alone."""
    labels = F.split(host, "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(F.rlike(host, F.lit(ADDRESS)), F.array(host)).otherwise(above)


def intervals(entries: DataFrame, block: str = "block") -> DataFrame:
    """name, action, valid_from and valid_to (exclusive, null while it holds) of entries (name, action, listed_at)."""
    usable = entries.select(name_of(F.col("name")).alias("name"), "action", F.col("listed_at").cast("timestamp").alias("valid_from")).dropna()
    single = usable.groupBy("name", "valid_from").agg(F.max_by("action", F.struct(F.col("action") == block, "action")).alias("action"))
    return single.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("name").orderBy("valid_from")))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", block: str = "block") -> DataFrame:
    """All columns of captures and host, entry (the name that decided), action, valid_from and kept."""
    new = ["host", "entry", "action", "valid_from", "kept", "_u", "_t", "hit"]
    if clash := set(new) & set(captures.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    month = lambda t: F.trunc(t, "month")
    seen = captures.select(F.col(url).alias("_u"), F.col(fetched).cast("timestamp").alias("_t")).distinct().withColumn("host", host_of(F.col("_u"))).where(F.col("host").isNotNull() & F.col("_t").isNotNull())
    names = seen.select("_u", "_t", F.explode(parents(F.col("host"))).alias("name"), month(F.col("_t")).alias("month"))
    last = captures.agg(F.max(F.col(fetched).cast("timestamp")).alias("last"))
    # One row, so this join only adds a constant: no interval is dealt to months after the last capture.
    spans = intervals(entries, block).crossJoin(F.broadcast(last)).where(F.col("valid_from") <= F.col("last"))
    end = F.least(F.coalesce("valid_to", "last"), "last")
    dealt = spans.select("name", "action", "valid_from", "valid_to", F.explode(F.sequence(month(F.col("valid_from")), month(end), F.expr("interval 1 month"))).alias("month"))
    dealt = stage(dealt, "intervals")
    # A name of one label stands above very many hosts; it takes part only where a list holds it.
    tops = smaller(dealt.where(~F.contains("name", F.lit("."))).select(F.col("name").alias("top")).distinct())
    names = names.join(tops, F.col("name") == F.col("top"), "left").where(F.contains("name", F.lit(".")) | F.col("top").isNotNull()).drop("top")
    active = names.join(smaller(dealt), ["name", "month"]).where((F.col("_t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_t") < F.col("valid_to"))))
    best = active.groupBy("_u", "_t").agg(F.max_by(F.struct(F.col("name").alias("entry"), "action", "valid_from"), F.length("name")).alias("hit"))
    at = F.col(fetched).cast("timestamp")
    out = captures.withColumn("host", host_of(F.col(url))).join(best, (F.col(url) == F.col("_u")) & (at == F.col("_t")), "left")
    return out.select(*captures.columns, "host", "hit.entry", "hit.action", "hit.valid_from", F.coalesce(F.col("hit.action") != block, F.lit(True)).alias("kept"))
