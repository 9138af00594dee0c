"""URL rules by host suffix and path prefix.

Each URL is expanded into the expressions that a rule could have: its host and parent domains of as many labels as occur
among the rules, with every path prefix of a length that occurs among them. Expressions meet rules in an equi-join on the first bytes of their
digests; what meets is confirmed on the full digest, and of the confirmed rules the longest decides. Everything is
built-in functions; the rules are broadcast only if Spark finds them small.

Defined results: a null URL, or one without `://`, has an empty host and path and meets no rule; repeated rows give
repeated rows; a rule's
null host or path is empty, and a rule of neither is ignored; rules of equal length are decided by block before allow, then by text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that the join compares first.
SHORT = 8
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row; rules has verdict, host, path (its path starts with a slash or is empty)."""
    r = rules.select(F.col("verdict").alias("_verdict"), F.coalesce("host", F.lit("")).alias("_host"), F.coalesce("path", F.lit("")).alias("_path")).where(F.concat("_host", "_path") != "")
    shapes = r.select(F.char_length("_path").alias("n"), F.size(F.split("_host", r"\.")).alias("k")).distinct().collect()  # at most longest path x most labels in rows
    lengths, counts = sorted({x.n for x in shapes}), sorted({x.k for x in shapes})
    r = r.select("_verdict", F.concat("_host", "_path").alias("_rule"), _digest(F.col("_host"), F.col("_path")).alias("_full"))
    r = r.groupBy("_rule", "_full").agg(F.max("_verdict").alias("_verdict")).withColumn("_short", F.substring("_full", 1, SHORT))
    # Rows are numbered and expanded where they are read: what is shuffled afterwards is one short row each.
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"), F.monotonically_increasing_id().alias("_row")).select("_row", "page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    labels = F.split("host", r"\.")
    some = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")
    hosts = some([F.when(F.size(labels) >= k, F.array_join(F.slice(labels, F.lit(-k), F.lit(k)), ".")) for k in counts])
    prefixes = some([F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    expressions = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
    exploded = urls.select("*", F.explode_outer(F.filter(expressions, lambda e: e != "")).alias("_expression"))
    exploded = exploded.withColumn("_digest", F.sha2("_expression", 256)).withColumn("_short", F.substring("_digest", 1, SHORT)).drop("_expression")
    met = exploded.join(r, "_short", "left").withColumn("_fits", F.col("_digest") == F.col("_full"))
    order = F.struct(F.char_length("_rule"), F.col("_verdict"), F.col("_rule"))
    best = met.groupBy("_row", "page_id", "host", "path").agg(F.max(F.when(F.col("_fits"), F.struct(order.alias("o"), F.col("_rule").alias("rule"), F.col("_verdict").alias("v")))).alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.v", F.lit(default)).alias("verdict"))
