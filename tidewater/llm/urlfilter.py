"""URL filters by a sort-merge range join (DataFrame functions only).

A rule is (host, path, verdict).  It fits its host and all subdomains when
the url's path starts with the rule's; the longest fitting rule wins.  The
canonical key of a host and path is the reversed host labels, a separator
byte, and the path, so every rule is an interval of keys.  A url asks with
one key per suffix of its host.  Keys and interval bounds are sorted
together over range partitions; the rule on top of the stack of nested
rules is carried along the sorted rows, and from partition to partition by
one row each.

Cases: a null url, or one without ``://``, has an empty host and path and
fits no rule; repeated pages each get a row; rules with a null host are
dropped, a null path is empty; of equal rules with different verdicts
``block`` counts; no rules or no pages give the default verdict or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import lower_ascii, shuffle_parts, written

# Bytes that no UTF-8 text holds: between host and path, and after every key with a prefix.
SEP, END = "FE", "FF"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _key(reversed_host: Column, path: Column) -> Column:
    return F.concat(reversed_host.cast("binary"), F.unhex(F.lit(SEP)), path.cast("binary"))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def intervals(rules: DataFrame) -> DataFrame:
    """Bounds of the rules' key intervals: (key, top), where top is the rule
    that is innermost from this key on (null fields: none)."""
    rules = (rules.where("host IS NOT NULL")
             .select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    top = F.struct(F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"),
                   F.length(F.concat("host", "path")).alias("n"))
    rules = rules.withColumn("top", top).withColumn("key", _key(F.array_join(_labels(F.col("host")), "."), F.col("path")))
    # The enclosing rule of each: the longest rule of its host whose path is a proper prefix.
    shorter = (rules.where(F.length("path") > 0)
               .select("key", "host", F.explode(F.expr("transform(sequence(0, length(path) - 1), i -> left(path, i))")).alias("path")))
    parent = (shorter.join(rules.select("host", "path", F.col("top").alias("up")), ["host", "path"])
              .groupBy("key").agg(F.max_by("up", F.length("path")).alias("up")))
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(0).alias("n"))
    opens = rules.select("key", "top")
    closes = (rules.select("key").join(parent, "key", "left")
              .select(F.concat("key", F.unhex(F.lit(END))).alias("key"), F.coalesce("up", none).alias("top")))
    return opens.unionByName(closes)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page."""
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rows = written(pages.select("page_id", host.alias("host"), path.alias("path"))
                   .withColumn("uid", F.monotonically_increasing_id()), "urls")
    bounds = intervals(rules)
    # Two numbers: no key need be deeper or longer than the rules'.
    depth, length = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    labels = F.slice(_labels(F.col("host")), 1, depth or 1)
    asks = (rows.withColumn("labels", labels)
            .select("uid", F.substring("path", 1, length or 0).alias("path"),
                    F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, 1, i), '.'))")).alias("h"))
            .select(_key(F.col("h"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "uid",
                    F.lit(None).cast("struct<rule:string,verdict:string,n:int>").alias("top")))
    both = asks.unionByName(bounds.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("uid"), "top"))
    # The uid in the order lets a key that many urls share fall into several partitions.
    swept = written(both.repartitionByRange(shuffle_parts(spark), "key", "kind", "uid")
                    .withColumn("pid", F.spark_partition_id()), "urlkeys")
    # One row per partition: a proven bound for the broadcast.
    last = swept.groupBy("pid").agg(F.max_by("top", F.when(F.col("kind") == 0, F.col("key"))).alias("at_end"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("pid", F.last("at_end", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("pid").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    hits = (swept.withColumn("own", F.last("top", ignorenulls=True).over(inside)).where("kind = 1")
            .join(F.broadcast(carry), "pid")
            .select("uid", F.coalesce("own", "carried").alias("hit")).where("hit.rule IS NOT NULL"))
    best = hits.groupBy("uid").agg(F.max_by("hit", F.col("hit.n")).alias("hit"))
    return (rows.join(best, "uid", "left")
            .select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce("hit.verdict", F.lit(default)).alias("verdict")))
