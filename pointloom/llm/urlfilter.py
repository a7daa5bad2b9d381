"""URL filters over time: dated list entries become validity intervals, captures are held against those active when fetched.

A list is a log of (kind, value, category, action, effective_on). The days of one entry
(kind, value, category) are put in order, and each 'add' is active from its day until the
next change, of whatever action; on one day the removal comes last. A capture asks with
all keys that could name it: its host, the domains above it, and the beginnings of its
path. Keys meet entries by equality and the interval settles the day, so the join is an
as-of join without sorting captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import nested, own

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
#: An address in brackets keeps its colons.
HOST = r"(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; '' if there is none."""
    found = F.lower(F.regexp_extract(url, SCHEME + HOST, 1))
    return F.regexp_replace(found, r"\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME + r"[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, category, since, until): the days on which an entry holds, ``until`` excluded, null for ever.

    Rows with a null in kind, value, action or effective_on say nothing and are left out; a
    null category is a category of its own, ''. Repeated rows change nothing.
    """
    log = entries.select("kind", "value", F.coalesce("category", F.lit("")).alias("category"), "action", "effective_on").where("kind is not null and value is not null and action is not null and effective_on is not null").distinct()
    order = Window.partitionBy("kind", "value", "category").orderBy("effective_on", "action")
    return log.withColumn("until", F.lead("effective_on").over(order)).where("action = 'add' and (until is null or until > effective_on)").select("kind", "value", "category", F.col("effective_on").alias("since"), "until")


def matches(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (url, fetched_on) of captures with an active entry -> n_matches and categories (sorted, joined by commas)."""
    valid = intervals(entries)
    depth = valid.where("kind = 'path'").agg(F.coalesce(F.max(F.size(F.split("value", "/")) - 1), F.lit(0))).first()[0]
    asked = captures.select("url", "fetched_on").where("url is not null and fetched_on is not null").distinct()
    parsed = asked.select("url", "fetched_on", host(F.col("url")).alias("h"), F.filter(F.split(path(F.col("url")), "/"), lambda s: s != "").alias("segments")).where("h <> ''")
    labels = F.split("h", r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("value")))
    deep = F.least(F.size("segments"), F.lit(int(depth)))  # no entry is deeper
    paths = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda k: F.struct(F.lit("path").alias("kind"), F.concat(F.col("h"), F.lit("/"), F.array_join(F.slice("segments", 1, k), "/")).alias("value"))))
    keys = F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.col("h").alias("value"))), domains, F.coalesce(paths, F.array().cast("array<struct<kind:string,value:string>>")))
    held = parsed.select("url", "fetched_on", F.inline(keys)).join(valid, ["kind", "value"]).where("since <= fetched_on and (until is null or fetched_on < until)")
    return held.groupBy("url", "fetched_on").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures`` (any columns, with url and fetched_on) with blocked, n_matches and categories added.

    A null url or day matches nothing: blocked false, 0 and ''. Repeated rows are all
    kept. Columns of captures named like the added ones are replaced.
    """
    added = ("blocked", "n_matches", "categories")
    kept = captures.select(*[own(captures, c) for c in captures.columns if c.lower() not in added])
    found = matches(captures, entries).withColumnsRenamed({"url": "of", "fetched_on": "on"})
    joined = nested(kept, "url", "fetched_on").join(found, (F.col("url") == F.col("of")) & (F.col("fetched_on") == F.col("on")), "left")
    return joined.select("row.*", F.col("n_matches").isNotNull().alias("blocked"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("categories", F.lit("")).alias("categories"))
