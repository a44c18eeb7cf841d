"""Not-modified revisits in WARC data, resolved to the full response they stand for. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.asof import latest_before
from vicinal.llm.base import table

#: Headers that a 304 response may change in the stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]*|fbclid|gclid)(=|$)"
#: Ticks of the crawl that the query on pages plays: a page is met at FIRST * page_id, some are changed later, revisits come after.
FIRST, CHANGED, EARLY, LATE = 10, 30_000, 20_000, 40_000


def canonical(url: str | Column) -> Column:
    """https for http, host in lower case without default port, no fragment, no tracking parameters, the others sorted, no slash
    at the end. What isn't a URL with a host stays as it is; null stays null."""
    url = F.col(url) if isinstance(url, str) else url
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]+)([^?]*)\??(.*)$"
    part = lambda k: F.regexp_extract(plain, whole, k)
    scheme = F.when(F.lower(part(1)) == "http", F.lit("https")).otherwise(F.lower(part(1)))
    host = F.regexp_replace(F.lower(part(2)), ":(80|443)$", "")
    path = F.regexp_replace(part(3), "/+$", "")
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.array_join(kept, "&")
    return F.when(part(2) == "", url).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit of records: what it stands for.

    records: record_id long, kind ('response' or 'revisit'), url, at long, headers array<struct<k, v>> with lower-case names in
    order, digest. Result: record_id, url (canonical), at, state, source_id, source_at, digest, headers.

    state: 'resolved'; 'changed' if the latest earlier full response has another validator; 'unchecked' if neither an ETag nor
    a Last-Modified is on both sides and the digests aren't equal either; 'missing' without an earlier full response. ETags
    compare weakly, and go before Last-Modified. Only resolved revisits get a digest and headers: the stored ones, with the
    permitted ones of the revisit in their place. A null URL or time resolves to nothing; of responses at one time the greatest
    id counts; repeated revisits get a row each and repeated responses count once; no records give no rows; records of other kinds
    and extra columns are ignored. URLs and headers of any length are taken whole.
    """
    r = records.filter("kind in ('response', 'revisit')").select("record_id", "kind", canonical("url").alias("url"), F.col("at").cast("long").alias("at"), F.coalesce("headers", F.expr("array()").cast("array<struct<k:string,v:string>>")).alias("headers"), "digest")
    there = F.col("url").isNotNull() & F.col("at").isNotNull()
    found = latest_before(r.filter(there), ["url"], "at", F.col("kind") == "response", [F.col("digest").alias("digest"), F.col("headers").alias("headers")], "record_id").filter("kind = 'revisit'")
    lost = r.filter(~there).filter("kind = 'revisit'")
    r = found.unionByName(lost, allowMissingColumns=True)
    of = lambda h, k: F.get(F.filter(h, lambda x: x["k"] == k), F.lit(0))["v"]
    weak = lambda x: F.regexp_replace(x, r"^[Ww]/", "")
    tag, old_tag = weak(of(F.col("headers"), "etag")), weak(of(F.col("found.headers"), "etag"))
    day, old_day = of(F.col("headers"), "last-modified"), of(F.col("found.headers"), "last-modified")
    same = F.when(tag.isNotNull() & old_tag.isNotNull(), tag == old_tag).when(day.isNotNull() & old_day.isNotNull(), day == old_day).when(F.col("digest") == F.col("found.digest"), F.lit(True))
    state = F.when(F.col("found").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    new = F.filter("headers", lambda x: x["k"].isin(*PERMITTED))
    merged = F.array_sort(F.concat(F.filter("found.headers", lambda x: ~F.array_contains(F.transform(new, lambda y: y["k"]), x["k"])), new))
    r = r.withColumn("state", state)
    ok = F.col("state") == "resolved"
    return r.select("record_id", "url", "at", "state", F.when(ok, F.col("found.tie")).alias("source_id"), F.when(ok, F.col("found.at")).alias("source_at"), F.when(ok, F.col("found.digest")).alias("digest"), F.when(ok, merged).alias("headers"))


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Resolved revisits with the column body of the full response; bodies: record_id, body."""
    return resolved.join(bodies.select(F.col("record_id").alias("source_id"), "body"), "source_id", "left")


def crawl(pages: DataFrame) -> DataFrame:
    """Records of a crawl of the pages, from each page's id alone, so that every state occurs:

    - a response when the page is met, under its URL;
    - for each third page a later response, changed, under the URL with a tracking parameter;
    - a revisit between both, with the first one's ETag (weak), an own date, and a header that mustn't be taken over;
    - a revisit after both, under the URL in http and with a fragment: its ETag is the changed one of each sixth page, the first one
      elsewhere, so a third page that isn't a sixth one was changed; each seventh has no validator but the digest, each eleventh
      another digest only;
    - for each thirteenth page a revisit before it is met.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')).alias("tag"))
    p = p.withColumn("new", F.concat(F.lit('"'), F.md5(F.concat("tag", F.lit("2"))), F.lit('"')))
    n, first = F.col("page_id"), F.col("page_id") * FIRST
    h = lambda **kv: F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("k"), v.alias("v")) for k, v in sorted(kv.items())))
    when = lambda x: F.concat(F.lit("tick "), x.cast("string"))
    none, none_h = F.lit(None).cast("string"), F.expr("array()").cast("array<struct<k:string,v:string>>")
    marked = F.concat("url", F.when(F.contains("url", F.lit("?")), F.lit("&utm_source=feed")).otherwise(F.lit("?utm_source=feed")))
    plain = F.concat(F.regexp_replace("url", "^https://", "http://"), F.lit("#again"))
    said = F.when(n % 6 == 0, F.col("new")).otherwise(F.col("tag"))
    late = F.when(n % 11 == 0, none_h).when(n % 7 == 0, none_h).otherwise(h(date=when(first + LATE), etag=said, server=F.lit("other")))
    one = lambda k, kind, url, at, headers, digest, on=F.lit(True): F.when(on, F.struct((n * 5 + k).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), at.alias("at"), headers.alias("headers"), digest.alias("digest")))
    full = lambda at, tag: h(content_type=F.lit("text/html"), date=when(at), etag=tag)
    records = F.array(
        one(0, "response", F.col("url"), first, full(first, F.col("tag")), F.col("tag")),
        one(1, "response", marked, first + CHANGED, full(first + CHANGED, F.col("new")), F.col("new"), n % 3 == 0),
        one(2, "revisit", F.col("url"), first + EARLY, h(content_type=F.lit("text/plain"), date=when(first + EARLY), etag=F.concat(F.lit("W/"), F.col("tag"))), none),
        one(3, "revisit", plain, first + LATE, late, F.when(n % 11 == 0, F.lit("other")).when(n % 7 == 0, said).otherwise(none)),
        one(4, "revisit", F.col("url"), first - 1, h(etag=F.col("tag")), none, n % 13 == 0),
    )
    return p.select(F.explode(F.filter(records, lambda x: x.isNotNull())).alias("r")).select("r.*")


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(crawl(table(spark, sf_dir, "pages")))
    return out.withColumn("headers", F.array_join(F.transform("headers", lambda x: F.concat(x["k"], F.lit(": "), x["v"])), "\n"))


OP1_SQL = rf"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS n, url, '"' || md5(coalesce(html, '')) || '"' AS tag FROM pages),
q AS (SELECT *, '"' || md5(tag || '2') || '"' AS new, CASE WHEN n % 6 = 0 THEN '"' || md5(tag || '2') || '"' ELSE tag END AS said FROM p),
rec AS (
  SELECT n * 5 AS record_id, 'response' AS kind, url, n * {FIRST} AS tm, tag, tag AS digest FROM q
  UNION ALL SELECT n * 5 + 1, 'response', url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=feed', n * {FIRST} + {CHANGED}, new, new FROM q WHERE n % 3 = 0
  UNION ALL SELECT n * 5 + 2, 'revisit', url, n * {FIRST} + {EARLY}, 'W/' || tag, NULL FROM q
  UNION ALL SELECT n * 5 + 3, 'revisit', regexp_replace(url, '^https://', 'http://') || '#again', n * {FIRST} + {LATE}, CASE WHEN n % 11 <> 0 AND n % 7 <> 0 THEN said END, CASE WHEN n % 11 = 0 THEN 'other' WHEN n % 7 = 0 THEN said END FROM q
  UNION ALL SELECT n * 5 + 4, 'revisit', url, n * {FIRST} - 1, tag, NULL FROM q WHERE n % 13 = 0),
x AS (SELECT *, regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]+)([^?]*)\??(.*)$', ['s', 'h', 'p', 'q']) AS u FROM rec),
c AS (SELECT record_id, kind, tm, tag, digest, CASE WHEN u.h = '' THEN url ELSE
        CASE WHEN lower(u.s) = 'http' THEN 'https' ELSE lower(u.s) END || '://' || regexp_replace(lower(u.h), ':(80|443)$', '') || regexp_replace(u.p, '/+$', '')
        || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END AS url
      FROM (SELECT *, list_sort(list_filter(string_split(u.q, '&'), lambda v: v <> '' AND NOT regexp_matches(v, '{TRACKING}'))) AS ps FROM x)),
r AS (SELECT b.record_id, b.url, b.tm, b.tag, b.digest, max_by(f.record_id, f.tm * 1000000000 + f.record_id) AS src
      FROM c b LEFT JOIN c f ON f.kind = 'response' AND f.url = b.url AND f.tm < b.tm WHERE b.kind = 'revisit' GROUP BY ALL),
s AS (SELECT r.*, f.tm AS source_at, f.tag AS old, f.digest AS stored,
      CASE WHEN src IS NULL THEN 'missing' WHEN r.tag IS NOT NULL AND regexp_replace(r.tag, '^W/', '') = f.tag OR r.tag IS NULL AND r.digest = f.digest THEN 'resolved' WHEN r.tag IS NULL THEN 'unchecked' ELSE 'changed' END AS state
      FROM r LEFT JOIN c f ON f.record_id = r.src)
SELECT record_id, url, tm AS at, state, CASE WHEN state = 'resolved' THEN src END AS source_id, CASE WHEN state = 'resolved' THEN source_at END AS source_at, CASE WHEN state = 'resolved' THEN stored END AS digest,
       CASE WHEN state = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: tick ' || CASE WHEN tag IS NULL THEN source_at WHEN record_id % 5 = 4 THEN source_at ELSE tm END || chr(10) || 'etag: ' || coalesce(tag, old) END AS headers
FROM s
"""
