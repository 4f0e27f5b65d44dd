"""WARC records and the resolution of not-modified revisits.

A revisit record says that a server answered 304: the content is that of an
earlier capture. Records are put in order by canonical URL and time; each
revisit meets the latest earlier full response of its URL, by an as-of join.
If their validators agree it takes that response's headers, renewed by those
that a 304 may send, and its payload.

Only headers, validators and digests take part in the join, not bodies. The
order is cut into ranges of even size, whatever the URLs' shares: the last
response of a URL is found within a range by a window, and where a range has
none before a revisit, from the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.base import partitions, stored, table
from gaugeworks.llm.urlfilter import host, path

# The headers that a 304 answer may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
HEADERS = "array<struct<name:string,value:string>>"
_BREAK = "\r\n"
#: A break that ends a header, and does not go on with it.
_LINE = "\r\n(?![ \t])"
#: More lines than a text can have.
_ALL = 1 << 30
_EPOCH = "2024-01-01 00:00:00"
_LATER = 1_001


def canonical(url: Column) -> Column:
    """The URL without scheme, user, default port, fragment, `utm_` parameters and a slash at the end, host in lower case."""
    name = F.regexp_replace(F.regexp_replace(host(url), "^.*@", ""), ":(?:80|443)?$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.concat(name, F.regexp_replace(path(url), "/+$", ""), query)


def _headers(block: Column) -> Column:
    """Name in lower case and value of each line after the first; lines without a colon are left out.

    A line that begins with a space or tab goes on with the line before it.
    """
    lines = F.filter(F.slice(F.split(block, _LINE), 2, _ALL), lambda x: F.instr(x, ":") > 0)
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    rest = lambda x: F.trim(F.substr(x, F.instr(x, ":") + 1))
    whole = lambda x: F.when(F.contains(x, F.lit(_BREAK)), F.trim(F.regexp_replace(rest(x), "\r\n[ \t]+", " "))).otherwise(rest(x))
    return F.transform(lines, lambda x: F.struct(name(x).alias("name"), whole(x).alias("value")))


def value(headers: Column, name: str) -> Column:
    """The first value of a header, null without it."""
    return F.try_element_at(F.filter(headers, lambda h: h["name"] == name), F.lit(1))["value"]


def parse(records: DataFrame, raw: str = "record") -> DataFrame:
    """Adds warc and http (headers), status, and body to the text of records: envelope, blank line, HTTP head, blank line, body.

    Anything that is missing is null or empty; a null record has no headers and no type.
    """
    gap = _BREAK * 2
    first = F.instr(F.col(raw), gap)
    records = records.withColumns({
        "_envelope": F.when(first > 0, F.substr(F.col(raw), F.lit(1), first - 1)).otherwise(F.col(raw)),
        "_rest": F.when(first > 0, F.substr(F.col(raw), first + 4)).otherwise(""),
    })
    second = F.instr("_rest", gap)
    records = records.withColumns({
        "_head": F.when(second > 0, F.substr(F.col("_rest"), F.lit(1), second - 1)).otherwise(F.col("_rest")),
        "body": F.when(second > 0, F.substr(F.col("_rest"), second + 4)).otherwise(""),
    })
    return records.withColumns({
        "warc": F.coalesce(_headers(F.col("_envelope")), F.array().cast(HEADERS)),
        "http": F.coalesce(_headers(F.col("_head")), F.array().cast(HEADERS)),
        "status": F.try_element_at(F.split(F.substring_index("_head", _BREAK, 1), " "), F.lit(2)).try_cast("int"),
    }).drop("_envelope", "_rest", "_head")


def _date(text: Column) -> Column:
    """A time in UTC or with an offset as +01, +0130 or +01:30, null if it is written otherwise."""
    read = lambda zone: F.try_to_timestamp(text, F.lit(f"yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]{zone}"))
    return F.coalesce(read("XXX"), read("X"))


def captures(records: DataFrame, raw: str = "record") -> DataFrame:
    """What resolution needs of each response or revisit record: id, type, url, date, http headers, payload digest.

    Dates are UTC or have an offset, with or without a fraction of a second; one
    that can't be read is null, as is whatever a record does not have. Null records
    and those of other types are left out, repeated ones come out as often as they
    went in. Other columns are not read.
    """
    rows = parse(records.select(F.col(raw).alias("record")))
    body = F.when(value(F.col("warc"), "warc-type") == "response", F.md5("body"))
    rows = rows.select(
        value(F.col("warc"), "warc-record-id").alias("id"), value(F.col("warc"), "warc-type").alias("type"),
        canonical(value(F.col("warc"), "warc-target-uri")).alias("url"),
        _date(value(F.col("warc"), "warc-date")).alias("date"),
        "status", "http", F.coalesce(value(F.col("warc"), "warc-payload-digest"), body).alias("digest"),
    )
    return rows.filter(F.col("type").isin("response", "revisit"))


def resolve(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """Each revisit of the `captures` rows with refers_to, outcome, headers and digest.

    outcome is `resolved`; `no_response`, if no full response (status 200 to 299)
    of the URL is earlier; or `validators_differ`, if the latest one has another
    entity tag (compared weakly), else another modification date, else another
    digest, or if the two have no validator in common. Only resolved revisits have refers_to,
    the response's id, merged headers and its digest. At equal times responses come
    before revisits, then ids count. Revisits with a null URL or date are
    `no_response`; repeated revisits come out as often as they went in.
    """
    spark = rows.sparkSession
    full = (F.col("type") == "response") & F.col("status").between(200, 299)
    rows = rows.filter(full | (F.col("type") == "revisit")).withColumn("full", full)
    usable = F.col("url").isNotNull() & (F.col("url") != "") & F.col("date").isNotNull()
    order = ["date", F.col("full").desc(), "id"]
    cut = rows.filter(usable).repartitionByRange(slices or 2 * partitions(spark), "url", *order)
    cut = stored(cut.withColumn("range", F.spark_partition_id()), "ranges")
    offer = F.when(F.col("full"), F.struct("id", "http", "digest"))
    here = Window.partitionBy("url", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("base", F.last(offer, ignorenulls=True).over(here)).filter("NOT full")
    ends = cut.filter("full").groupBy("url", "range").agg(
        F.max_by(F.struct("id", "http", "digest"), F.struct("date", "id")).alias("end")
    )
    stops = cut.select("url", "range").distinct().join(ends, ["url", "range"], "left")
    before = Window.partitionBy("url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = stops.select("url", "range", F.last("end", ignorenulls=True).over(before).alias("carried"))
    carried = stored(carried.filter("carried IS NOT NULL"), "carried")
    found = local.join(carried, ["url", "range"], "left").withColumn("base", F.coalesce("base", "carried")).drop("carried", "range")
    lost = rows.filter("NOT full").filter(~F.coalesce(usable, F.lit(False))).withColumn("base", F.lit(None).cast(found.schema["base"].dataType))
    found = found.unionByName(lost)

    agree = lambda name: F.regexp_replace(value(F.col("http"), name), "^W/", "") == F.regexp_replace(value(F.col("base.http"), name), "^W/", "")
    same = F.coalesce(agree("etag"), agree("last-modified"), F.col("digest") == F.col("base.digest"), F.lit(False))
    outcome = F.when(F.col("base").isNull(), "no_response").when(same, "resolved").otherwise("validators_differ")
    renewed = F.filter("http", lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(renewed, lambda h: h["name"])
    merged = F.concat(F.filter("base.http", lambda h: ~F.array_contains(names, h["name"])), renewed)
    done = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "id", "url", "date", "outcome", F.when(done, F.col("base.id")).alias("refers_to"),
        F.when(done, F.array_sort(merged)).alias("headers"), F.when(done, F.col("base.digest")).alias("digest"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """WARC records of the pages: each page as a response, and a later 304 that repeats its entity tag.

    The time of a capture follows from page_id, so pages of one URL interleave
    with the revisits of others and some entity tags no longer agree.
    """
    page = pages.select(F.col("page_id").alias("n"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    second = lambda shift: F.to_timestamp(F.lit(_EPOCH)) + F.make_dt_interval(secs=2 * F.coalesce("n", F.lit(0)) + shift)
    iso = lambda shift: F.date_format(second(shift), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))

    def record(kind: str, shift: int, head: list[Column], body: Column) -> Column:
        lines = [
            F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit(f"WARC-Record-ID: {kind}-"), "n"),
            F.concat(F.lit("WARC-Target-URI: "), "url"), F.concat(F.lit("WARC-Date: "), iso(shift)),
            F.lit("Content-Type: application/http; msgtype=response"),
        ]
        return F.concat(F.concat_ws(_BREAK, *lines), F.lit(_BREAK * 2), F.concat_ws(_BREAK, *head), F.lit(_BREAK * 2), body)

    response = record("response", 0, [
        F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("ETag: "), tag),
        F.lit("Cache-Control: max-age=60"), F.concat(F.lit("Content-Length: "), F.octet_length("html")),
    ], F.col("html"))
    revisit = record("revisit", _LATER, [
        F.lit("HTTP/1.1 304 Not Modified"), F.concat(F.lit("ETag: W/"), tag), F.lit("Cache-Control: max-age=600"),
        F.lit("Content-Length: 0"),
    ], F.lit(""))
    return page.select(F.explode(F.array(response, revisit)).alias("record"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(records_of(table(spark, sf_dir, "pages"))))
    number = lambda c: F.substring_index(c, "-", -1).try_cast("long")
    lines = F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))
    return found.select(
        number(F.col("id")).alias("page_id"), "url", "outcome", number(F.col("refers_to")).alias("refers_to"),
        F.array_join(lines, "\n").alias("headers"), "digest",
    )


ORACLES = {
    "op5_warc_revisits": """
WITH rest AS (
  SELECT page_id, COALESCE(html, '') AS html, COALESCE(url, '') AS url,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(r, '^[^/?#]*')), '^.*@', ''), ':(80|443)?$', '') AS host,
    regexp_replace(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) AS params FROM rest
), page AS (
  SELECT page_id, md5(html) AS digest, strlen(html) AS size,
    host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url FROM parts
), event AS (
  SELECT page_id, url, digest, size, 2 * page_id AS t, 0 AS k FROM page
  UNION ALL SELECT page_id, url, digest, size, 2 * page_id + 1001, 1 FROM page
), asof_rows AS (
  SELECT *, last_value(CASE WHEN k = 0 AND url <> '' THEN {'id': page_id, 'digest': digest, 'size': size} END IGNORE NULLS)
    OVER (PARTITION BY url ORDER BY t, k, page_id ROWS UNBOUNDED PRECEDING) AS base FROM event
)
SELECT page_id, url,
  CASE WHEN base IS NULL THEN 'no_response' WHEN base.digest = digest THEN 'resolved' ELSE 'validators_differ' END AS outcome,
  CASE WHEN base.digest = digest THEN base.id END AS refers_to,
  CASE WHEN base.digest = digest THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || base.size || chr(10) ||
    'content-type: text/html; charset=utf-8' || chr(10) || 'etag: W/"' || digest || '"' END AS headers,
  CASE WHEN base.digest = digest THEN base.digest END AS digest
FROM asof_rows WHERE k = 1
"""
}
QUERIES = {"op5_warc_revisits": op5_warc_revisits}
