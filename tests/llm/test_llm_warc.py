"""Archives: written, read back record by record, assembled and resolved."""

import base64
import gzip
import hashlib
from collections import Counter

import pytest
from oracle import DATA, duck, spark_rows
from pyspark.sql import functions as F

from corpusloom.llm import queries, warc

PAGES = "page_id long, url string, html string, digest string, type string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, min_bytes=0):
    first = {}
    for i, _, t in rows:
        t = t or ""
        first[t] = max(first.get(t, -1), -1 if i is None else i)
    out = []
    for i, _, t in rows:
        t = t or ""
        own = first[t] == (-1 if i is None else i) or len(t.encode()) < min_bytes
        out.append((i, len(t.encode()), sha(t), "response" if own else "revisit", None if own else first[t]))
    return Counter(out)


def around(spark, rows, path, **options):
    warc.write(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3), path, **options)
    got = warc.captures(spark, path, payload=True)
    flat = got.select(F.col("capture.metadata.fields")["page_id"].cast("long").alias("page_id"), "capture.reply.type", "capture.reply.record_id", "capture.reply.declared_digest", "capture.reply.digest", "capture.reply.n_bytes")
    return got.collect(), Counter(map(tuple, warc.resolved(flat, "page_id").select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()))


AWKWARD = [
    (1, "http://a.example/x?y#z", "<html>one</html>"), (2, "https://b.example", "<html>one</html>"), (3, None, None), (4, "http://c/", ""), (5, "http://d/\r\nX: y", "tail\r\n"), (6, "http://e/", "tail\r\n\r\n"),
    (7, "http://f/", "in the\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nmiddle"), (8, "http://g/", "\r\n\r\nWARC/1."), (9, "http://h/", "\r\n\r\nWARC/1.\r\n\r\nWARC/1.0\r\n\r\n"), (10, "http://i/", "é ß 日本 😀\x00\n"),
    (None, "http://j/", "<html>one</html>"), (None, "http://k/", "no id"), (None, "http://k/", "no id"), (11, "http://l/", "twice"), (11, "http://l/", "twice"), (12, "http://m/", "long " * 300_000), (13, "http://n/", "\r\n\r\nWARC"), (14, "nonsense", "\r\n"),
]


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_round_trip(spark, tmp_path, min_bytes):
    got, rows = around(spark, AWKWARD, str(tmp_path / "w"), min_bytes=min_bytes)
    assert rows == plain(AWKWARD, min_bytes)
    bodies = Counter((r.capture.metadata.fields.get("page_id"), bytes(r.payload).decode()) for r in got if r.payload is not None)
    kept = Counter((None if i is None else str(i), t or "") for i, _, t in AWKWARD)
    assert not bodies - kept and sum(bodies.values()) == sum(n for r, n in rows.items() if r[3] == "response")
    for r in got:
        c = r.capture
        assert c.n_request == c.n_metadata == 1 and c.request.http_head.startswith("GET ") and c.reply.http_head.startswith("HTTP/1.1 200")
        assert c.reply.type == "revisit" or c.reply.declared_digest == c.reply.digest


def test_copies_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", 0)
    rows = AWKWARD + [(i, "http://hot/", "hot") for i in range(100, 160)]
    assert around(spark, rows, str(tmp_path / "w"))[1] == plain(rows)


def test_empty_table(spark, tmp_path):
    assert around(spark, [], str(tmp_path / "w")) == ([], Counter())


def _archive(path, *records, gz=True):
    data = b"".join(b"WARC/1.0\r\n" + "\r\n".join(f"{k}: {v}" for k, v in [*head, ("Content-Length", len(body))]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n" for head, body in records)
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(gzip.compress(data) if gz else data)


@pytest.mark.parametrize("gz", [True, False])
def test_foreign_archives(spark, tmp_path, gz):
    """A reply that names its request, a metadata record that names the request too, a second metadata record, bytes that are no UTF-8."""
    http = [("Content-Type", "application/http; msgtype=response")]
    records = [
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x\r\n"),
        ([("WARC-Type", "request"), ("WARC-Record-ID", "<q>"), *http], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        ([("warc-type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Concurrent-To", "<q>"), ("WARC-Target-URI", "http://a/\r\n continued"), *http], b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\xff\xfe\x00\r\n\r\n"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m2>"), ("WARC-Concurrent-To", "<q>")], b"b: 2\r\n"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m1>"), ("WARC-Concurrent-To", "<z>"), ("WARC-Concurrent-To", "<r>")], b"a: 1\r\nc: d: e\r\n"),
        ([("WARC-Type", "resource"), ("WARC-Record-ID", "<s>"), ("Content-Type", "text/plain")], b""),
    ]
    _archive(tmp_path / "w" / ("a.warc.gz" if gz else "a.warc"), *records, gz=gz)
    if gz:  # one gzip member a record, as archives have them
        one = tmp_path / "w" / "a.warc.gz"
        data = gzip.decompress(one.read_bytes()).split(b"WARC/1.0\r\n")[1:]
        one.write_bytes(b"".join(gzip.compress(b"WARC/1.0\r\n" + x) for x in data))
    got = {r.capture.reply.record_id: r for r in warc.captures(spark, str(tmp_path / "w"), payload=True).collect()}
    assert set(got) == {"<r>", "<s>"}
    r, s = got["<r>"], got["<s>"]
    assert bytes(r.payload) == b"\xff\xfe\x00\r\n\r\n" and r.capture.reply.target_uri == "http://a/ continued"
    assert r.capture.request.record_id == "<q>" and r.capture.n_request == 1
    assert r.capture.metadata.record_id == "<m1>" and r.capture.metadata.fields == {"a": "1", "c": "d: e"} and r.capture.n_metadata == 2
    assert bytes(s.payload) == b"" and s.capture.request is None and s.capture.n_metadata == 0


def test_broken_archives_are_errors():
    ok = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    read = lambda *p: list(warc.whole_records(iter([("f", 0, x.encode()) for x in p])))
    assert [b for _, b in read(ok, "1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")] == [b"abc", b"x"]
    # Spark's reader may overlook a separator at the end of its buffer
    assert [b for _, b in read(ok + "\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n", "1\r\nContent-Length: 1\r\n\r\ny")] == [b"abc", b"x", b"", b"y"]
    for bad in ([ok[:-1]], ["no archive"], ["WARC/1.1\r\nA: b\r\n\r\nabc"], [ok + "more"]):
        with pytest.raises(ValueError):
            read(*bad)
    with pytest.raises(ValueError, match="gzip"):
        list(warc.whole_records(iter([("f", 9, b"1\r\nContent-Length: 30\r\n\r\nabc")])))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    assert spark_rows(queries.QUERIES["op12_warc"](spark, f"{DATA}/{sf}")) == duck(f"{DATA}/{sf}", queries.SQL["op12_warc"])
