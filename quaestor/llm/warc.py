"""WARC records, and the resolution of not-modified revisits.

A revisit (status 304) has no payload of its own. It takes that of the latest
earlier full response (status 200) with the same canonical URL, if the
validators agree: entity tags, compared weakly, or else Last-Modified. The
headers are the response's, with those that a 304 may renew (RFC 9110, 15.4.5)
from the revisit.

The as-of join is two running maxima. Time is cut into BINS equal parts; the last
full response of each URL and part is found by an aggregate, carried over the at
most BINS parts of a URL by one window, and a second window runs within a part.
So a URL with a third of all records is spread over as many tasks as its records
have parts. Records that can't match are dealt out by their ids, and share a part
with none that can. Payloads aren't moved: a record carries its digest and id.

Defined cases: a null or empty URL, or a null date, matches nothing ('missing');
ties in time go by record id; rows that repeat are resolved each; a revisit
without validators is resolved unchecked; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.llm.common import map_arrow, read

BINS = 512
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("latin-1").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records(content: bytes):
    """(WARC headers, HTTP status or None, HTTP headers, payload) of each record; gzip members are opened."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = line
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head += line
        warc = _headers(head)
        body = stream.read(int(warc.get("content-length") or 0))
        status, http, payload = None, {}, body
        if body.startswith(b"HTTP/"):
            top, _, payload = body.partition(b"\r\n\r\n")
            first = top.split(b"\r\n")[0].split()
            status, http = int(first[1]) if len(first) > 1 and first[1].isdigit() else None, _headers(top)
        yield warc, status, http, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, type, url, date, status, headers, payload) of all records of WARC files."""
    names = ["file", "position", "type", "url", "date", "status", "headers", "payload"]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (warc, status, http, payload) in enumerate(records(content)):
                    row = [file, k, warc.get("warc-type"), warc.get("warc-target-uri"), warc.get("warc-date"), status, list(http.items()), payload]
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, run, "file string, position long, type string, url string, date string, status int, headers map<string,string>, payload binary")


def canonical_url(url: Column) -> Column:
    """Without fragment, default port, tracking parameters, index page and last slashes; origin in lower case, parameters sorted."""
    whole = F.regexp_replace(url, "#.*$", "")
    base, query = F.regexp_extract(whole, r"^([^?]*)", 1), F.regexp_extract(whole, r"\?(.*)$", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.substring(base, F.length(origin) + 1, F.length(base)), r"/index\.html?$", "/"), "/+$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(origin), "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve_revisits(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Adds canonical_url, outcome, response_id, payload_sha256 and merged headers to (record_id, url, date, status, headers, sha256).

    date: seconds. headers: map with names in lower case. outcome: full, resolved, unchecked, mismatch, missing or other.
    """
    rows = rows.select("record_id", F.col("date").cast("long").alias("date"), "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "sha256", canonical_url(F.col("url")).alias("canonical_url"))
    low, high = rows.agg(F.min("date"), F.max("date")).first()
    low, width = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // bins))
    entries = F.array_sort(F.map_entries("headers"))
    able = F.coalesce(F.col("canonical_url") != "", F.lit(False)) & F.col("date").isNotNull()
    full = F.when(
        (F.col("status") == 200) & able,
        F.struct(F.col("date").alias("date"), F.col("record_id").alias("id"), F.col("sha256").alias("sha256"), entries.alias("headers")),
    )
    # The part of a record that can't match has a negative bin, so it is none of those below.
    of = F.when(able, F.col("canonical_url")).otherwise("")
    bin_ = F.when(able, F.floor((F.col("date") - low) / width)).otherwise(-1 - F.pmod(F.xxhash64("record_id", "sha256"), F.lit(4096))).cast("int")
    rows = rows.withColumn("full", full).withColumn("able", able).withColumn("of", of).withColumn("bin", bin_)
    # Parts with no full response take part too, so that each finds what is carried to it.
    every = rows.filter("able").groupBy("of", "bin").agg(F.max("full").alias("last"))
    before = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(F.col("of").alias("u"), F.col("bin").alias("b"), F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("of", "bin").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.join(carried, (F.col("of") == F.col("u")) & (F.col("bin") == F.col("b")), "left")
    both = both.withColumn("found", F.coalesce(F.max("full").over(inside), "carried"))
    theirs = F.map_from_entries("found.headers")
    tag = lambda m: F.regexp_replace(m["etag"], "^W/", "")
    agree = F.when(F.col("headers")["etag"].isNotNull(), F.coalesce(tag(F.col("headers")) == tag(theirs), F.lit(False))).when(
        F.col("headers")["last-modified"].isNotNull(), F.coalesce(F.col("headers")["last-modified"] == theirs["last-modified"], F.lit(False))
    )
    matchable = F.col("able") & F.col("found").isNotNull()
    outcome = (
        F.when(F.col("status") == 200, "full")
        .when(F.coalesce(F.col("status"), F.lit(0)) != 304, "other")
        .when(~matchable, "missing")
        .when(agree.isNull(), "unchecked")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    both = both.withColumn("outcome", outcome)
    taken = F.col("outcome").isin("resolved", "unchecked")
    renewed = F.map_concat(F.map_filter(theirs, lambda k, _: ~(k.isin(*RENEWED) & F.coalesce(F.map_contains_key("headers", k), F.lit(False)))), F.map_filter("headers", lambda k, _: k.isin(*RENEWED)))
    return both.select(
        "record_id",
        "canonical_url",
        "outcome",
        F.when(taken, F.col("found.id")).when(F.col("outcome") == "full", F.col("record_id")).alias("response_id"),
        F.when(taken, F.col("found.sha256")).when(F.col("outcome") == "full", F.col("sha256")).alias("payload_sha256"),
        F.when(taken, renewed).otherwise(F.col("headers")).alias("headers"),
    )


#: Captures of each page in ``as_records``.
CAPTURES = 4


def as_records(pages: DataFrame) -> DataFrame:
    """Pages as captures, one a second in order of record_id, which is 4 * page_id + capture.

    Of each page: 1 a full response; 2 a revisit with its tag, or without one if 7 divides the id; 3 a revisit with
    another tag; and 0, before the response, a revisit of every fifth page. The tag of a URL changes every 50 pages.
    """
    page, capture = F.col("page_id"), F.col("capture")
    tag = F.substring(F.md5(F.concat_ws("|", "canonical", F.floor(page / 50).cast("string")).cast("binary")), 1, 8).alias("tag")
    known = pages.select("page_id", "url", canonical_url(F.col("url")).alias("canonical"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string").alias("size"))
    each = known.select("page_id", "url", tag, "sha256", "size", F.explode(F.sequence(F.lit(0), F.lit(CAPTURES - 1))).alias("capture"))
    each = each.filter((capture > 0) | (page % 5 == 0)).withColumn("record_id", page * CAPTURES + capture)
    date = F.col("record_id").cast("string")
    full = F.create_map(F.lit("etag"), F.col("tag"), F.lit("date"), date, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"))
    short = F.create_map(F.lit("date"), date, F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"))
    own = F.when(capture == 3, F.concat(F.lit("c"), F.col("tag"))).when((capture == 0) | (page % 7 != 0), F.concat(F.lit("W/"), F.col("tag")))
    tagged = F.when(own.isNull(), short).otherwise(F.map_concat(short, F.create_map(F.lit("etag"), own)))
    return each.select(
        "record_id",
        "url",
        F.col("record_id").alias("date"),
        F.when(capture == 1, 200).otherwise(304).alias("status"),
        F.when(capture == 1, full).otherwise(tagged).alias("headers"),
        F.when(capture == 1, F.col("sha256")).alias("sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of every page; response_id is -1 where nothing was found."""
    found = resolve_revisits(as_records(read(spark, sf_dir, "pages")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(":", e["key"], e["value"]))), "|")
    return found.select("record_id", F.floor(F.col("record_id") / CAPTURES).alias("page_id"), "canonical_url", "outcome", F.coalesce("response_id", F.lit(-1)).alias("response_id"), "payload_sha256", text.alias("headers"))


SQL = r"""
WITH a AS (SELECT page_id, html, regexp_replace(url, '#.*$', '') AS u FROM pages),
b AS (SELECT *, regexp_extract(u, '^([^?]*)', 1) AS base, regexp_extract(u, '\?(.*)$', 1) AS q FROM a),
c AS (SELECT *, regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)', 1) AS o,
  list_sort([x FOR x IN string_split(q, '&') IF x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$')]) AS ps FROM b),
d AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(o), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
  || regexp_replace(regexp_replace(substr(base, length(o) + 1), '/index\.html?$', '/'), '/+$', '')
  || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS canonical_url FROM c),
e AS (SELECT page_id, canonical_url, c, page_id * 4 + c AS rid, sha256(coalesce(html, '')) AS sha, coalesce(strlen(html), 0) AS n,
  substr(md5(concat_ws('|', canonical_url, (page_id // 50)::VARCHAR)), 1, 8) AS t
  FROM d, (VALUES (0), (1), (2), (3)) v(c) WHERE c > 0 OR page_id % 5 = 0),
g AS (SELECT *, CASE WHEN c = 3 THEN 'c' || t WHEN c = 0 OR page_id % 7 <> 0 THEN t END AS tag FROM e),
f AS (SELECT r.*, p.rid AS pid, p.t AS ptag, p.sha AS psha, p.n AS pn
  FROM g r ASOF LEFT JOIN (SELECT * FROM g WHERE c = 1) p ON r.canonical_url = p.canonical_url AND r.rid > p.rid),
o AS (SELECT *, CASE WHEN c = 1 THEN 'full' WHEN pid IS NULL THEN 'missing' WHEN tag IS NULL THEN 'unchecked' WHEN tag = ptag THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN c = 3 THEN '|etag:' || tag WHEN tag IS NOT NULL THEN '|etag:W/' || tag ELSE '' END AS own FROM f)
SELECT rid AS record_id, page_id, canonical_url, outcome,
  CASE WHEN c = 1 THEN rid WHEN outcome IN ('resolved', 'unchecked') THEN pid ELSE -1 END AS response_id,
  CASE WHEN c = 1 THEN sha WHEN outcome IN ('resolved', 'unchecked') THEN psha END AS payload_sha256,
  CASE WHEN c = 1 THEN 'content-length:' || n || '|content-type:text/html|date:' || rid || '|etag:' || t
    WHEN outcome IN ('resolved', 'unchecked') THEN 'cache-control:max-age=60|content-length:' || pn || '|content-type:text/html|date:' || rid || CASE WHEN tag IS NULL THEN '|etag:' || ptag ELSE own END
    ELSE 'cache-control:max-age=60|content-length:0|date:' || rid || own END AS headers
FROM o
"""
