"""URL filters: a sort-merge range join of page hosts with nested rules.

A host is keyed by its labels in reverse, each followed by a dot (``a.example.org`` becomes ``org.example.a.``), so
the hosts that a rule covers, itself and all subdomains, are exactly the keys with the rule's key as a prefix: one
interval in sort order, and the intervals of different rules nest or are disjoint. Pages and rules are sorted
together. While the sweep passes a page, the rules whose interval is open form a stack; the stack of the last rule
host passed holds all of them, as every open interval also covers that rule host. The page drops the entries that
have closed meanwhile, tests the paths of the rest, and takes the longest.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, shuffle_partitions


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A rule table (host, path, verdict) from literals."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    empty = F.expr("array()").cast("array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """For each rule host (key) the stack of all rules whose interval covers it, its own included.

    The covering keys of a key are its own label prefixes, so an equi join finds them.
    """
    rules = rules.where("host != '' and path is not null and verdict is not null")
    rules = rules.select(host_key(F.translate("host", UPPER, UPPER.lower())).alias("key"), F.concat("host", "path").alias("rule"), "path", "verdict").distinct()
    labels = F.split(F.col("key"), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    covered = rules.select("key").distinct().select("key", F.explode(prefixes).alias("above"))
    entry = F.struct(F.col("r.key").alias("key"), "path", "rule", "verdict")
    return covered.join(rules.alias("r"), F.col("above") == F.col("r.key")).groupBy(covered["key"].alias("key")).agg(F.collect_list(entry).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", salts: int | None = None) -> DataFrame:
    """The verdict on every page's url.

    pages: page_id, url (others are ignored). rules: host, path, verdict; a rule fits its host and all subdomains
    where the url's path starts with the rule's path, and the longest (host and path together; then the longer host;
    then by text) wins. Returns page_id, host, path, rule, verdict; a page that no rule fits has a null rule and
    ``default``. Null urls and urls without ``://`` have empty host and path, and no rule fits them. Repeated rows
    stay repeated; rules that have no host are ignored; with no rules all pages get ``default``.

    Pages are dealt to ``salts`` sweeps by a hash of the row, so a host with any share of the pages is spread over all
    of them. Each sweep holds all rule hosts; with R rule hosts that costs ``salts * R`` rows.
    """
    salts = salts or 4 * shuffle_partitions(pages.sparkSession)
    stacks = rule_stacks(rules)
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    keyed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"))
    keyed = keyed.select("salt", host_key(F.col("host")).alias("key"), F.lit(True).alias("is_page"), "page_id", "host", "path", none.alias("stack"))
    opening = stacks.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(False).alias("is_page"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"), "stack")
    sweep = Window.partitionBy("salt").orderBy("key", "is_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = keyed.unionByName(opening).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("is_page")
    fits = F.filter("open", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), F.length(r["key"]).alias("m"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("best", longest).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
