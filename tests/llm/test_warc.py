import hashlib

from lamella.llm import warc


def pages(spark, n=900):
    rows = [(i, f"http://h{i % 3}/{i}", None if i % 50 == 0 else "é" * (i * 37 % 3000), "clash") for i in range(n)]
    return spark.createDataFrame([*rows, (None, "x", "y", "z"), (7, "again", "x" * 100_000, "z"), (7, "again", "x" * 100_000, "z")], "page_id long, url string, html string, digest string").repartition(5)


def test_records_lie_one_after_another(spark):
    rows = warc.records(warc.payloads(pages(spark))).orderBy("file", "offset").collect()
    assert len(rows) == 902
    end = {}
    for r in rows:
        assert r.offset == end.get(r.file, 0)
        end[r.file] = r.offset + r.length
    body = ("é" * (3 * 37)).encode()
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Target-URI: http://h0/3\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    one = next(r for r in rows if r.record_id == 3)
    assert (one.length, one.digest) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_audit_finds_exactly_the_damage(spark):
    found = warc.payloads(pages(spark))
    a, b = warc.records(found), warc.damaged(found)
    got = sorted((r.status, r.record_id) for r in warc.audit(a, b).collect())
    want = sorted([("altered", i) for i in range(900) if i % 97 == 5] + [("missing", i) for i in range(900) if i % 97 == 11] + [("extra", i) for i in range(900) if i % 97 == 17])
    assert got == want
    one = next(r for r in warc.audit(a, b).collect() if r.record_id == 5)
    raw = next(bytes(r.payload) for r in found.where("record_id = 5").collect())
    assert (one.expected, one.actual) == (hashlib.sha256(raw).hexdigest(), hashlib.sha256(raw[:-1] + b"!").hexdigest())
    swapped = sorted((r.status, r.record_id) for r in warc.audit(b, a).collect())
    turn = {"altered": "altered", "missing": "extra", "extra": "missing"}
    assert swapped == sorted((turn[s], i) for s, i in want)


def test_equal_replicas_and_a_lost_file(spark):
    a = warc.records(warc.payloads(pages(spark, 600)))
    assert warc.audit(a, a).count() == 0
    assert warc.audit(a.where("false"), a.where("false")).count() == 0
    assert warc.audit(a, a.where("file <> 1")).where("status <> 'missing' OR file <> 1").count() == 0
    assert warc.audit(a, a.where("file <> 1")).count() == 256
    same = {(r.file, r.hash) for r in warc.roots(a).collect()}
    assert same == {(r.file, r.hash) for r in warc.roots(a.repartition(3)).collect()}
