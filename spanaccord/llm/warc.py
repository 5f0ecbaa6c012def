"""Operator 3: resolving not-modified revisits against the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanaccord.llm.common import cut

#: query parameters that only tell where a visitor came from (fixed values)
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: fields of a not-modified response that never replace those of the stored one (fixed values, RFC 9110 and 9111)
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: rows of one key that one window partition should hold at most, if time stamps are spread evenly
PIECE_ROWS = 200_000


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, default port, ``www.``, fragment, tracking parameters and closing slash.

    The host is lower-cased, the other parameters are sorted.  Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^[^@]*@", ""), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit("")))


def fields(headers: Column) -> Column:
    """Header fields with lower-case names; of a name given twice the last value counts; null names and values go."""
    low = F.transform(F.filter(F.map_entries(headers), lambda e: e["value"].isNotNull()), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(low, lambda e: e["key"]))
    return F.coalesce(F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(low, lambda e: e["key"] == n), -1)["value"]))), F.create_map().cast("map<string,string>"))


def _validator(headers: Column, name: str) -> Column:
    v = F.try_element_at(headers, F.lit(name))
    return F.regexp_replace(v, "^[Ww]/", "") if name == "etag" else v


def latest_before(records: DataFrame, key: str, order: list[str], carried: Column, name: str) -> DataFrame:
    """``records`` with the last non-null ``carried`` of an earlier row of the same key, in ``order`` (a number first).

    Time is cut into even pieces; a key's rows are scanned piece by piece and the last value of each piece is
    handed on through one row per key and piece, so that a key with a large share of all rows is many tasks.
    """
    at = F.col(order[0]).cast("double")
    n, lo, hi = records.agg(F.count("*"), F.min(at), F.max(at)).first()
    cuts = max(1, -(-n // PIECE_ROWS) * 4)
    width = ((hi - lo) / cuts if n and hi is not None and hi > lo else 0) or 1.0
    piece = F.coalesce(F.least(F.lit(cuts - 1), F.floor((at - F.lit(float(lo or 0))) / F.lit(float(width)))), F.lit(-1).cast("long"))
    cutup = records.withColumn("_piece", piece).withColumn("_value", carried)
    inside = Window.partitionBy(key, "_piece").orderBy(*order)
    here = cutup.withColumn("_near", F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ends = cutup.where("_value is not null").groupBy(key, "_piece").agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    seen = cutup.select(key, "_piece").distinct().join(ends, [key, "_piece"], "left")
    handed = seen.select(key, "_piece", F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    return here.join(handed, [key, "_piece"], "left").withColumn(name, F.coalesce("_near", "_far")).drop("_piece", "_value", "_near", "_far")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit: (record_id, url_key, outcome, source_id, headers map).

    ``records``: record_id long, url string, ts long, kind (``response`` or ``revisit``), status int,
    headers map<string,string>, digest string.  A revisit is joined to the latest full response (status 200)
    of its canonical URL that is earlier in (ts, record_id).  Outcomes: ``resolved``; ``orphan`` without such
    a response; ``changed`` if the first validator that both sides have (entity tag, compared weakly, then
    last-modified, then digest) differs; ``unproven`` if they share none.  Only resolved revisits have source_id
    and merged headers: those of the stored response, replaced or joined by the revisit's but for NOT_MERGED.

    A null URL or time is an orphan; a null kind is neither; null headers are empty.  Records equal in ts and
    record_id are not earlier than each other for certain, so record_id should be unique; repeated revisits
    each give a row.  Bodies are not moved: source_id names the record that holds the body.
    """
    r = records.where("kind in ('response', 'revisit')").select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind",
        F.col("status").cast("int").alias("status"), fields(F.col("headers")).alias("headers"), "digest",
    )
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct(F.col("record_id").alias("id"), "headers", "digest"))
    whole = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    found = latest_before(r.where(whole), "url_key", ["ts", "record_id"], full, "old").where("kind = 'revisit'")
    found = found.unionByName(r.where(~whole & (F.col("kind") == "revisit")).withColumn("old", F.lit(None).cast(found.schema["old"].dataType)))
    pairs = [(_validator(F.col("old.headers"), n), _validator(F.col("headers"), n)) for n in ("etag", "last-modified")] + [(F.col("old.digest"), F.col("digest"))]
    proof = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in pairs])
    outcome = F.when(F.col("old").isNull(), "orphan").when(proof.isNull(), "unproven").when(proof, "resolved").otherwise("changed")
    fresh = F.map_filter("headers", lambda k, v: ~k.isin(*NOT_MERGED))
    stored = F.map_filter("old.headers", lambda k, v: ~F.map_contains_key(fresh, k))
    ok = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "url_key", "outcome", F.when(ok, F.col("old.id")).alias("source_id"), F.when(ok, F.map_concat(stored, fresh)).alias("headers")
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a crawl that visited ``pages`` in the order of page_id.

    Each visit fetches the site's robots file, stored in full by every fourth visit and else answered as not
    modified under an entity tag that changes every 50 visits; stores the page; and asks for the page again
    under another spelling of its URL, with the old entity tag, a changed one, the old date, or no validator.
    """
    p = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("n"))
    i, text = F.col("page_id"), lambda c: c.cast("string")
    day = F.concat(F.lit("day-"), text(F.floor(i / 7)))
    tag = F.concat(F.lit('W/"'), text(F.floor(i / 50)), F.lit('"'))
    robots = F.concat(F.regexp_extract("url", "^[^/]*//[^/]*", 0), F.lit("/robots.txt"))
    def record(n, url, ts, full, headers, digest):
        kind = F.when(full, "response").otherwise("revisit")
        return F.struct((i * 3 + n).alias("record_id"), url.alias("url"), ts.alias("ts"), kind.alias("kind"), F.when(full, 200).otherwise(304).alias("status"), headers.alias("headers"), digest.alias("digest"))
    def head(**kw):
        return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k.replace("_", "-")), v)])
    none = F.lit(None).cast("string")
    often, again = i % 4 == 0, F.when(F.col("url").contains("?"), F.concat("url", F.lit("&utm_source=again"))).otherwise(F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("?utm_source=again#top")))
    rows = [
        record(0, robots, i * 10, often, F.when(often, head(ETag=tag, Content_Length=F.lit("64"), Content_Type=F.lit("text/plain"))).otherwise(head(ETag=F.regexp_replace(tag, "^W/", ""), Content_Length=F.lit("0"), Date=day)), none),
        record(1, F.col("url"), i * 10 + 1, F.lit(True), head(ETag=F.concat(F.lit('"'), "digest", F.lit('"')), Last_Modified=day, Content_Length=text(F.col("n")), Cache_Control=F.lit("max-age=60")), F.col("digest")),
        record(2, again, i * 10 + 5, F.lit(False), head(
            ETag=F.when(i % 5 < 2, F.concat(F.lit('"'), "digest", F.lit('"'))).when(i % 5 == 2, F.lit('"other"')), Last_Modified=F.when(i % 5 == 3, day), Cache_Control=F.lit("max-age=600"), Content_Length=F.lit("0")), none),
    ]
    return p.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
