import hashlib

from retenta.llm import warc
from .conftest import rows

SCHEMA = "page_id long, url string, html string, digest string, bytes long"


def brute(data):
    payloads = [(p, (h or "").encode()) for p, _, h, *_ in data]
    first = {}
    for p, b in payloads:
        if len(b) >= 1000 and p is not None:
            first[b] = max(first.get(b, p), p)
    counts = {}
    for _, b in payloads:
        counts[b] = counts.get(b, 0) + 1
    out = []
    for p, b in payloads:
        again = counts[b] > 1 and b in first and first[b] != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def pages():
    big, odd = "<p>é</p>" * 200, "a\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n" * 40
    data = [(i, f"http://x/{i}", big) for i in range(20)]
    data += [(30, None, odd), (31, "http://y", odd), (32, "http://bad\r\nX: y", None), (33, "u", ""), (34, "u", "short"), (35, "u", "short"),
             (None, "n", "no id"), (36, "u", big + "!"), (36, "u", big + "!"), (37, "u", "x" * 1000), (38, "u", "x" * 1000), (39, "u", "y" * 999),
             (40, "u", "y" * 999), (41, "u", "z" * 300_000)]
    return [(*r, "d", 5) for r in data]


def test_round_trip_matches_brute_force(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    got = rows(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute(pages())


def test_captures_are_nested_and_whole(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    path = str(tmp_path / "archive")
    warc.write(df, path)
    records = warc.read(spark, path)
    kinds = {r["type"]: r["count"] for r in records.groupBy("type").count().collect()}
    n = len(pages())
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == n
    caps = warc.captures(records).collect()
    assert len(caps) == n and all(c["request"]["block"].startswith(b"GET ") and b"payload-bytes" in c["metadata"]["block"] for c in caps)
    whole = next(c for c in caps if b"page-id: 41" in c["metadata"]["block"])
    assert whole["response"]["block"].endswith(b"z" * 300_000)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
