"""URL rules by a sort-merge range join, in DataFrame functions only.

A rule (host, path) is keyed by its host's labels in reverse and its path, and
covers the interval of keys that start with its own. Intervals of one host are
nested or apart. Each rule carries the stack of the rules open at its start,
itself on top; a URL is looked up once for its host and for each parent domain
that has rules. URLs and rules are sorted together by key: the last rule start
at or before a URL is the sweep's state there, and the topmost entry of its
stack that the URL still lies in is the rule that fits. Of the rules that fit
at the different domains the longest wins.

A domain that holds many of the URLs is cut into as many parts as keep each a
small share of all, and its rules are repeated for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.base import blocks, partitions, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
#: Most rule hosts for which the table of part counts is sent to every task.
SENT_HOSTS = 100_000
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """From there up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def reversed_host(name: Column) -> Column:
    return F.array_join(F.reverse(F.split(name, r"\.")), ".")


def stacks(rules: DataFrame) -> DataFrame:
    """(domain, at, stack) of the distinct (verdict, host, path) rules: the paths open at each rule's start, the longest last.

    Of rules with the same host and path `block` wins.
    """
    rules = rules.filter(F.col("host").isNotNull() & F.col("verdict").isNotNull())
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    own = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.select(reversed_host(F.col("host")).alias("domain"), F.col("path").alias("at"), "host", "verdict")
    prefixes = own.select(
        "domain", "at", F.explode(F.transform(F.sequence(F.lit(0), F.length("at")), lambda n: F.substr(F.col("at"), F.lit(1), n))).alias("open")
    )
    entry = own.select("domain", F.col("at").alias("open"), F.struct(F.length("at").alias("length"), F.col("at").alias("path"), "host", "verdict").alias("entry"))
    return prefixes.join(entry, ["domain", "open"]).groupBy("domain", "at").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Key, host, path, rule and verdict of each row of `pages`.

    `rules` has columns verdict (allow or block), host and path. A rule fits its
    host and all subdomains, if the URL's path starts with the rule's. The longest
    rule (host and path together) wins, of equally long ones the one with the
    longer host. Without one the rule is null and the verdict the default.

    A null URL and one without `://` have an empty host and path and no rule.
    Repeated rows come out as often as they went in, rows with a null key too.
    Other columns are not read. Without rules every verdict is the default.
    """
    spark = pages.sparkSession
    open_rules = stored(stacks(rules), "rules")
    domains = open_rules.groupBy("domain").agg(F.count(F.lit(1)).alias("rules"))
    small = domains.count() <= SENT_HOSTS
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    rows = rows.select("row", "key", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = stored(rows, "urls")

    labels = F.reverse(F.split("host", r"\."))
    ups = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.array_join(F.slice("labels", F.lit(1), n), "."))
    points = rows.filter("host <> ''").withColumn("labels", labels).select("row", F.col("path").alias("at"), F.explode(ups).alias("domain"))
    points = points.join(F.broadcast(domains) if small else domains, "domain")
    counts = points.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = blocks(total, 4 * partitions(spark))
    cuts = counts.select("domain", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    cuts = F.broadcast(cuts) if small else cuts

    cut_points = points.join(cuts, "domain").select(
        "domain", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "at", "row",
        F.lit(None).cast(open_rules.schema["stack"].dataType).alias("stack"),
    )
    cut_rules = open_rules.join(cuts, "domain").select(
        "domain", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "at", F.lit(None).cast("long").alias("row"), "stack"
    )
    sweep = Window.partitionBy("domain", "part").orderBy("at", F.col("row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    swept = cut_rules.unionByName(cut_points).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
    inside = F.filter("stack", lambda e: F.startswith(F.col("at"), e["path"]))
    fitting = swept.filter("row IS NOT NULL AND stack IS NOT NULL").select("row", F.try_element_at(inside, F.lit(-1)).alias("e")).filter("e IS NOT NULL")
    size = F.struct((F.length("e.host") + F.length("e.path")).alias("all"), F.length("e.host").alias("host"), F.col("e").alias("e"))
    best = fitting.groupBy("row").agg(F.max(size)["e"].alias("e"))
    return rows.join(best, "row", "left").select(
        F.col("key").alias(key), "host", "path", F.concat("e.host", "e.path").alias("rule"),
        F.coalesce("e.verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "verdict string, host string, path string"))


ORACLES = {
    "op6_url_filter": """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), fit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM parsed p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
}
QUERIES = {"op6_url_filter": op6_url_filter}
