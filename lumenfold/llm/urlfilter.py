"""URL rules as a sort-merge range join, by DataFrame functions alone.

A canonical key is the host reversed by labels, the byte FE and the path: www.example.org/en/1 is
org.example.www FE /en/1 (FE and FF occur in no UTF-8).  A rule's key is a prefix, so it holds an interval of keys, and any two such intervals
nest or are apart.  A rule also fits the subdomains of its host, so a url stands in the order once under
each suffix of its host.

Every rule opens its interval with an event that carries the stack of the rules then active (itself and the
rules around it) and closes it with one that carries the stack without it.  Urls and events are range-partitioned by
key together; in each partition a sweep in key order hands every url the top of the latest stack, and what is
still active at a partition's start comes from the partitions before it.  The range is over (key, kind, id), so one
url or host that fills a third of the rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm._spark import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.encode(F.array_join(F.reverse(F.split(host, r"\.")), "."), "UTF-8"), F.expr("X'FE'"), F.encode(path, "UTF-8"))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): at an interval's start its rule and those around it, longest last; at its end those around it.

    ``rules`` has host, path, verdict; null parts count as empty.  Of rules with one prefix the least
    verdict holds.
    """
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    named = rules.select(_key(host, path).alias("key"), F.concat(host, path).alias("rule"), "verdict").groupBy("key").agg(F.min(F.struct("verdict", "rule")).alias("r"))
    named = named.select("key", F.struct(F.length("key").alias("size"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")).alias("entry"))
    # every prefix of a rule's key that is a rule itself
    around = named.select(F.col("key").alias("own"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("key")))).alias("n")).select("own", F.expr("substring(own, 1, n)").alias("key"))
    stacks = around.join(named, "key").groupBy("own").agg(F.sort_array(F.collect_list("entry")).alias("stack"))
    starts = stacks.select(F.col("own").alias("key"), F.lit(0).alias("kind"), "stack")
    ends = stacks.select(F.concat(F.col("own"), F.expr("X'FF'")).alias("key"), F.lit(0).alias("kind"), F.expr("slice(stack, 1, size(stack) - 1)").alias("stack"))
    return starts.unionByName(ends)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict, a row per row of pages.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with its path; the longest
    wins, of equally long ones the one with the more specific host.  Without a fitting rule, rule is null and verdict
    ``default``.  A null url, or one without ://, has empty host and path and fits no rule.  Pages may repeat.
    """
    parsed = pages.select("page_id", F.monotonically_increasing_id().alias("row"), F.col("url").cast("string").alias("url"))
    parsed = materialize(parsed.select("page_id", "row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).fillna("", ["host", "path"]), "urls")
    labels = F.split("host", r"\.")
    suffixes = parsed.filter("host <> ''").withColumn("labels", labels).select("row", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice(F.col("labels"), i, F.size("labels")), "."))).alias("suffix"))
    urls = suffixes.select(_key(F.col("suffix"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("array<struct<size:int,rule:string,verdict:string>>").alias("stack"), "row")
    events = rule_events(rules).withColumn("row", F.lit(None).cast("long"))
    swept = urls.unionByName(events).repartitionByRange("key", "kind", "row").withColumn("part", F.spark_partition_id())
    swept = materialize(swept, "swept")
    # what is active when a partition begins: the last event of the partitions before it (a row per partition)
    last = swept.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    parts = swept.select("part").distinct().join(last, "part", "left")
    carried = parts.select("part", F.last("stack", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = swept.select("part", "kind", "row", F.last("stack", ignorenulls=True).over(sweep).alias("stack")).filter("kind = 1").join(F.broadcast(carried), "part")
    stack = F.coalesce("stack", "carried")
    top = met.select("row", F.try_element_at(stack, F.lit(-1)).alias("top")).filter("top is not null")
    best = top.groupBy("row").agg(F.max_by("top", F.struct("top.size", "top.rule")).alias("best"))
    joined = parsed.join(best, "row", "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
