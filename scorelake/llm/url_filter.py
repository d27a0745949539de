"""URL filters: a sort-merge range join of reversed-host keys with prefix rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import table

#: Stands between the reversed host and the path; below every character of either.
_GAP = "\x01"
_TOP = "\U0010ffff"


def _lowered(c: Column) -> Column:
    """A-Z in lower case, no other letter: hosts of URLs and of rules alike."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise(F.lit(""))
    return _lowered(rest)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _reversed(host: Column) -> Column:
    """The host's labels from last to first, each with a dot after it, so that a host's key begins with those of all hosts above it."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


def _dealt(bounds: list[str], is_rule: bool):
    """Each key with the number of its range; a rule goes to every range that its host's interval meets."""
    from bisect import bisect_right

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not is_rule:
                pdf["pid"] = [bisect_right(bounds, h + _GAP + p) for h, p in zip(pdf["skey"], pdf["path"], strict=True)]
            else:
                # the ranges from the host's own key to the last key that it is a prefix of
                pdf["pid"] = [list(range(bisect_right(bounds, k), bisect_right(bounds, k + _TOP) + 1)) for k in pdf["skey"]]
                pdf = pdf.explode("pid", ignore_index=True)
            yield pdf.astype({"pid": "int64"})

    return run


class HostRules:
    """The rules of one host on the stack: by path, with the lengths that their paths have."""

    def __init__(self, skey: str):
        self.skey, self.by_path, self.lengths = skey, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        self.by_path[path] = (rule, verdict)
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        return next((self.by_path[path[:n]] for n in self.lengths if path[:n] in self.by_path), None)


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (pid, skey, rules first): the stack holds the rules of the current host and of all hosts above it."""
    pid, stack = None, []
    for pdf in batches:
        out = []
        for p, skey, is_key, rule, verdict, host, path in zip(pdf["pid"], pdf["skey"], pdf["is_key"], pdf["rule"], pdf["verdict"], pdf["host"], pdf["path"], strict=True):
            if p != pid:
                pid, stack = p, []
            while stack and not skey.startswith(stack[-1].skey):
                stack.pop()
            if not is_key:
                if not stack or stack[-1].skey != skey:
                    stack.append(HostRules(skey))
                stack[-1].add(path, rule, verdict)
            elif stack:
                best = None
                for level in reversed(stack):  # longer hosts first, so that they win at equal length
                    found = level.longest(path)
                    if found and (best is None or len(found[0]) > len(best[0])):
                        best = found
                if best:
                    out.append((host, path, *best))
        yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (or null) and verdict of every row of pages, under rules (host, path, verdict).

    A rule fits a URL whose host is the rule's or ends in a dot and the rule's, and whose path starts
    with the rule's. The longest rule (host and path together) wins; of equally long ones that with the
    longer host. No rule: `default`. Of rules repeated with different verdicts, block wins.

    A URL has one key, its reversed host and path. A rule's reversed host is a prefix of just the keys
    of the hosts that it fits, so it covers one interval of the sorted keys. Distinct keys and rules meet in
    one range-partitioned, sorted sweep whose stack holds the rules of the nested hosts that are open; at a
    key, each level of the stack looks up the prefixes of the path of as many lengths as its rules have.
    A rule is sent to each range that its interval meets, so nothing is broadcast, and a host with very
    many paths is dealt over ranges. Repeated URLs are swept once.

    Null or odd URLs have an empty host and path and fit no rule. Empty rules: all get the default. Ids are
    of any type.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).fillna("", ["host", "path"])
    r = rules.select(_lowered(F.col("host")).alias("h"), F.coalesce(F.col("path"), F.lit("")).alias("p"), F.col("verdict"))
    r = r.filter("h is not null").groupBy("h", "p").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v"))
    r = table(r.select(_reversed(F.col("h")).alias("skey"), F.concat("h", "p").alias("rule"), F.col("v.verdict").alias("verdict"), F.col("p").alias("path")))
    keys = table(urls.filter("host <> ''").select("host", "path").distinct().select(_reversed(F.col("host")).alias("skey"), "host", "path"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.concat("skey", F.lit(_GAP), "path")
    firsts = keys.select(whole.alias("key")).repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("n")).agg(F.min("key").alias("first"))
    bounds = sorted(x["first"] for x in firsts.collect())[1:]
    shape = "skey string, is_key boolean, rule string, verdict string, host string, path string, pid long"
    none = F.lit(None).cast("string")
    events = keys.select("skey", F.lit(True).alias("is_key"), none.alias("rule"), none.alias("verdict"), "host", "path").mapInPandas(_dealt(bounds, False), shape)
    events = events.unionByName(r.select("skey", F.lit(False).alias("is_key"), "rule", "verdict", none.alias("host"), "path").mapInPandas(_dealt(bounds, True), shape))
    best = table(events.repartition(parts, "pid").sortWithinPartitions("pid", "skey", "is_key").mapInPandas(_sweep, "host string, path string, rule string, verdict string"))
    # grows with the pages, so it is never to be broadcast
    return urls.join(best.hint("merge"), ["host", "path"], "left").select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    return found.withColumnRenamed("id", "page_id")


OP8_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM v),
f AS (SELECT d.host, d.path, r.h || r.p AS rule, r.v AS verdict,
             row_number() OVER (PARTITION BY d.host, d.path ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS rn
      FROM d JOIN rules r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p))
SELECT page_id, v.host, v.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM v LEFT JOIN f ON v.host = f.host AND v.path = f.path AND f.rn = 1
"""
