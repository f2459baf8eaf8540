import gzip
import random

import pytest
from pyspark.sql import functions as F

from quaestor.llm import warc

SCHEMA = "record_id bigint, url string, date bigint, status int, headers map<string,string>, sha256 string, bin string, found string"


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://A.Com:80/x/index.html?b=2&utm_source=q&a=1#top", "http://a.com/x?a=1&b=2"),
        ("https://a.com:443/", "https://a.com"),
        ("https://a.com:8443/p/?ref=x", "https://a.com:8443/p"),
        ("http://a.com/P?page=2&ref=x", "http://a.com/P?page=2"),
        ("", ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


@pytest.mark.parametrize("bins", [512, 1, 7])
def test_against_plain_search(spark, bins):
    rng, rows = random.Random(8), []
    for k in range(600):
        url = "http://hot/x" if rng.random() < 0.4 else rng.choice([f"http://h/{rng.randrange(40)}", None, ""])
        status = rng.choice([200, 200, 304, 304, 404, None])
        head = {"etag": rng.choice(["a", "W/a", "b"])} if rng.random() < 0.7 else ({"last-modified": rng.choice("xy")} if rng.random() < 0.5 else {})
        if rng.random() < 0.5:
            head |= {"date": str(k), "content-length": str(k)}
        rows.append((k, url, rng.randrange(300) if rng.random() < 0.97 else None, status, head if rng.random() < 0.95 else None, f"s{k}", "", ""))
    rows.append(rows[3])
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA), bins).collect()}
    strip = lambda t: t.removeprefix("W/") if t else t
    for i, url, date, status, head, sha, _, _ in rows:
        head = head or {}
        if status != 304:
            want = ("full", i, sha) if status == 200 else ("other", None, None)
        else:
            earlier = [r for r in rows if r[3] == 200 and r[1] == url and url and r[2] is not None and date is not None and (r[2], r[0]) < (date, i)]
            best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
            if best is None:
                want = ("missing", None, None)
            else:
                own, theirs = head, best[4] or {}
                if own.get("etag"):
                    ok = strip(own["etag"]) == strip(theirs.get("etag"))
                elif own.get("last-modified"):
                    ok = own["last-modified"] == theirs.get("last-modified")
                else:
                    ok = None
                want = ("unchecked" if ok is None else "resolved" if ok else "mismatch", None, None)
                if ok is not False:
                    want = (want[0], best[0], best[5])
                    merged = theirs | {k: v for k, v in own.items() if k in warc.RENEWED}
                    assert got[i].headers == merged
        assert (got[i].outcome, got[i].response_id, got[i].payload_sha256) == want, i


def test_read_warc(spark, tmp_path):
    def record(kind, url, body):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    one = record("response", "http://a/", b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nhello\r\nWARC/ text")
    two = record("revisit", "http://a/", b"HTTP/1.1 304 Not Modified\r\nETag: x\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(record("warcinfo", "", b"software: x") + one)
    got = warc.read_warc(spark, str(tmp_path)).orderBy("file", "position").collect()
    assert [(r.type, r.status) for r in got] == [("response", 200), ("revisit", 304), ("warcinfo", None), ("response", 200)]
    assert bytes(got[0].payload) == b"hello\r\nWARC/ text" and got[1].headers == {"etag": "x"}


def test_empty(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
