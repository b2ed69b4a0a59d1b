"""URL filter with dated lists, by DataFrame operations only.

A list is a table of changes (key, at, action): "add" puts a host or a parent domain
on the list, "remove" takes it off. Changes become validity intervals, and an as-of
join finds for each capture the entries that were active when it was fetched.

A capture's host is looked up with all its parent domains. The join is over distinct
(host, fetch time) pairs, so a host with a third of all captures is a few rows, and
by (key, time bucket), so that a key with many changes meets only captures of the
same time; a pair meets at most one interval of each key. Only keys that the list
holds go into the join. A key that a HOT share of the pairs ask for (a listed "com") is
dealt to SALTS parts, with a copy of its intervals in each.

Captures without a host or a fetch time are never blocked. Repeated captures each
get a row. At equal times of a key "add" wins; repeated changes count once; changes
with a null key or time, or another action, have no effect. A key matches itself and
its subdomains; keys are compared in lower case without a dot at the end. Empty
tables on either side give no rows, or nothing blocked. Very long URLs are URLs like
others. Other columns have no effect, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, stored

#: Seconds of a time bucket: 32 days.
BUCKET = 32 * 86_400
#: Listed keys that are asked for up to which they are broadcast; the share of what is asked from which a key is dealt out, and to how many parts.
FEW, HOT, SALTS = 200_000, 1 / 1024, 64
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), HOST, 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def intervals(changes: DataFrame) -> DataFrame:
    """(key, since, until): when a key is on the list; until is null while it still is, and is not part of the interval."""
    key = F.regexp_replace(F.lower("key"), r"\.+$", "")
    own = changes.where("action in ('add', 'remove') and at is not null").select(key.alias("key"), F.col("at").cast("timestamp").alias("at"), (F.col("action") == "add").alias("on")).where("key <> ''")
    once = own.groupBy("key", "at").agg(F.max("on").alias("on"))
    by_time = Window.partitionBy("key").orderBy("at")
    turns = once.withColumn("was", F.lag("on").over(by_time)).where("on <> coalesce(was, false)")
    return turns.withColumn("until", F.lead("at").over(by_time)).where("on").select("key", F.col("at").alias("since"), "until")


def active_entries(pairs: DataFrame, valid: DataFrame, few: int = FEW) -> DataFrame:
    """(host, fetched, entry, since, n_entries) for the distinct pairs with an active entry; entry is the longest key."""
    last = pairs.agg(F.max("fetched")).first()[0]
    if last is None:
        return pairs.select("host", "fetched", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("timestamp").alias("since"), F.lit(0).cast("bigint").alias("n_entries")).where("false")
    bucket = lambda c: F.floor(F.unix_seconds(c) / BUCKET)
    until = F.least(F.coalesce("until", F.lit(last)), F.lit(last))
    spans = valid.where(F.col("since") <= F.lit(last)).select("*", F.explode(F.sequence(bucket("since"), bucket(until))).alias("bucket"))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    keys = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    asked = pairs.select("host", "fetched", bucket("fetched").alias("bucket"), F.explode(keys).alias("key"))
    held = cut(asked.select("key").distinct().join(spans.select("key").distinct(), "key", "left_semi"))
    asked = asked.join(F.broadcast(held) if held.count() <= few else held, "key", "left_semi")
    often = cut(asked.groupBy("key").agg(F.count("*").alias("n")))
    hot = often.where(F.col("n") >= (often.agg(F.sum("n")).first()[0] or 0) * HOT).select(F.col("key").alias("hot"))  # 1 / HOT rows at most
    salted = lambda df, salt: df.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left").withColumn("salt", salt).drop("hot")
    asked = salted(asked, F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("host", "fetched"), F.lit(SALTS)).cast("int")))
    spans = salted(spans, F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    met = asked.join(spans, ["key", "bucket", "salt"]).where("fetched >= since and (until is null or fetched < until)")
    return met.groupBy("host", "fetched").agg(F.max_by(F.struct(F.col("key").alias("entry"), "since"), F.length("key")).alias("m"), F.count("*").alias("n_entries")).select("host", "fetched", "m.entry", "m.since", "n_entries")


def filter_captures(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(page_id, host, fetched, blocked, entry, since, n_entries) for every capture.

    captures has an id, a URL and a fetch time; changes has key, at and action.
    """
    own = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).cast("timestamp").alias("fetched"))
    pairs = stored(own.where("host is not null and fetched is not null").select("host", "fetched").distinct())
    found = active_entries(pairs, stored(intervals(changes)))
    joined = own.join(found, ["host", "fetched"], "left")
    return joined.select("page_id", "host", "fetched", F.col("entry").isNotNull().alias("blocked"), "entry", "since", F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"))


def dated_list(pages: DataFrame) -> DataFrame:
    """The dated list of the query: changes of the pages' hosts and parent domains by a fixed rule.

    With k = 31 * first byte + 7 * second byte + length: a host with k % 5 > 0 goes on
    the list on day k % 200 of 2024, off it 40 days later, and if k is even on again
    on day k % 200 + 90. A parent domain goes on at k % 300 and off ten days later.
    """
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    parents = hosts.select(F.regexp_replace("key", r"^[^.]*\.", "").alias("key")).distinct()
    k = 31 * F.ascii("key") + 7 * F.ascii(F.substr("key", F.lit(2), F.lit(1))) + F.length("key")
    on = lambda day, action: F.struct(F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).cast("timestamp").alias("at"), F.lit(action).alias("action"))
    own = hosts.where(k % 5 > 0).select("key", F.explode(F.array_compact(F.array(on(k % 200, "add"), on(k % 200 + 40, "remove"), F.when(k % 2 == 0, on(k % 200 + 90, "add"))))).alias("c"))
    above = parents.select("key", F.explode(F.array(on(k % 300, "add"), on(k % 300 + 10, "remove"))).alias("c"))
    return own.unionByName(above).select("key", "c.at", "c.action")


def fetch_times(pages: DataFrame) -> DataFrame:
    """The pages with the query's fetch time: noon of day (37 * page_id) % 365 of 2024."""
    day = (F.col("page_id") * 37 % 365).cast("int")
    return pages.withColumn("fetched", F.timestamp_seconds(F.unix_seconds(F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp")) + 43_200))
