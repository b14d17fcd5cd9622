import gzip
import hashlib
import io

import pytest
from pyarrow import fs

from slipweave.llm import warc


def test_odd_rows(spark):
    big = "x" * 300_000
    rows = [(3, "u", "same"), (1, "u\r\nv", "same"), (2, None, None), (5, "u", ""), (None, "u", "same"), (7, "é", big), (8, "u", big), (8, "u", big), (9, "u", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")
    found = warc.deduplicate(spark, pages).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in found)
    assert got == [(0, 4, "revisit", 1), (1, 4, "response", 0), (2, 0, "response", 0), (3, 4, "revisit", 1), (5, 0, "revisit", 2), (7, 300000, "response", 0), (8, 300000, "revisit", 7), (8, 300000, "revisit", 7), (9, 6, "response", 0)]
    assert {r.payload_digest for r in found if r.page_id in (2, 5)} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}
    assert {r.page_id for r in warc.deduplicate(spark, pages, min_bytes=5).collect() if r.record_type == "revisit"} == {8}
    assert warc.deduplicate(spark, pages.limit(0)).collect() == []


def archives(folder):
    store = fs.LocalFileSystem()
    return {p.name: list(warc.records(store, str(p))) for p in sorted(folder.iterdir()) if not p.name.startswith((".", "_"))}


def test_headers_of_written_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "body"), (2, "http://b/\r\nX: y", "body"), (3, None, "other")], "page_id long, url string, html string")
    assert warc.deduplicate(spark, pages, f"file://{tmp_path}/w").count() == 3
    assert not (tmp_path / "w" / "raw").exists()
    found = {r.get("WARC-Source-Row"): r for rs in archives(tmp_path / "w" / "dedup").values() for _, r in rs}
    one, two = found["1"], found["2"]
    assert one.raw.startswith(b"WARC/1.1\r\n") and one.kind == "response" and one.payload == b"body" and b"Content-Length: 4" in one.http
    assert two.kind == "revisit" and two.payload == b"" and two.length() == 4 and two.get("WARC-Target-URI") == "http://b/%0D%0AX: y"
    assert two.get("WARC-Refers-To") == one.get("WARC-Record-ID") and two.get("WARC-Refers-To-Target-URI") == "http://a/"
    assert two.get("WARC-Refers-To-Date") == one.get("WARC-Date") and two.get("WARC-Profile").endswith("identical-payload-digest")
    assert two.get("WARC-Payload-Digest") == one.get("WARC-Payload-Digest") == "sha1:" + warc.digest(b"body")
    assert found["3"].get("WARC-Target-URI") is None and len({r.get("WARC-Record-ID") for r in found.values()}) == 3


def foreign(kind, ident, block, *lines, http=True):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", "WARC-Date: 2021-05-05T05:05:05Z", f"content-length:{len(block)}", *lines]
    return "\r\n".join(head + (["Content-Type: application/http;msgtype=response"] if http else [])).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    sha = "sha1:" + warc.digest(b"body")
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n"
    one = [
        foreign("warcinfo", "i", b"software: x\r\n", http=False),
        foreign("revisit", "early", HTTP, f"WARC-Payload-Digest: {sha.lower().replace('sha1', 'SHA1')}", "WARC-Refers-To: <urn:uuid:lost>"),
        foreign("response", "r1", HTTP + b"body", "WARC-Target-URI:http://a/", "X-Long: a", "\tb"),
        foreign("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:uuid:r1>"),
        foreign("response", "c1", chunked, f"WARC-Payload-Digest: {sha}"),
    ]
    two = [
        foreign("response", "r2", HTTP + b"body", f"WARC-Payload-Digest: {sha}", "WARC-Target-URI: http://b/"),
        foreign("revisit", "alone", HTTP, "WARC-Payload-Digest: sha1:" + warc.digest(b"nowhere"), "WARC-Refers-To: <urn:uuid:far>", "WARC-Refers-To-Target-URI: http://far/"),
        foreign("response", "md", HTTP + b"else", "WARC-Payload-Digest: md5:" + hashlib.md5(b"else").hexdigest()),
    ]
    (source / "1.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (source / "2.warc").write_bytes(b"".join(two))
    files = spark.createDataFrame([("1.warc.gz",), ("2.warc",)], "file string")
    warc.deduplicate_archives(spark, files, f"file://{source}", f"file://{tmp_path}/out")
    found = {r.get("WARC-Record-ID")[10:-1]: r for rs in archives(tmp_path / "out").values() for _, r in rs}
    kinds = {k: r.kind for k, r in found.items()}
    assert kinds == {"i": "warcinfo", "early": "revisit", "r1": "response", "q1": "request", "c1": "response", "r2": "revisit", "alone": "revisit", "md": "response"}
    for name in ("early", "r2"):
        assert (found[name].get("WARC-Refers-To"), found[name].get("WARC-Refers-To-Target-URI"), found[name].get("WARC-Refers-To-Date")) == ("<urn:uuid:r1>", "http://a/", "2021-05-05T05:05:05Z")
    assert found["alone"].get("WARC-Refers-To") == "<urn:uuid:far>" and found["alone"].get("WARC-Refers-To-Target-URI") == "http://far/"
    assert found["i"].raw == one[0] and found["q1"].raw == one[3] and found["r1"].payload == b"body" and found["r1"].http == HTTP[:-4]
    assert found["c1"].payload == chunked.partition(b"\r\n\r\n")[2]


def test_rolling(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    names = warc.write_archives(pages, f"file://{tmp_path}/r", level=0, roll_bytes=4000)
    assert names.count() > 5
    assert sorted(r.page_id for r in warc.read_archives(names, f"file://{tmp_path}/r").collect()) == list(range(40))


def test_damage(tmp_path):
    good = gzip.compress(warc.record("response", 1, "u", b"body" * 99, warc.digest(b"body" * 99), "d"))
    for data, word in ((good + good[:-9], "ends inside"), (gzip.compress(gzip.decompress(good)[:-3]), "damaged"), (gzip.compress(b"x\r\n\r\n"), "not a WARC")):
        with pytest.raises(ValueError, match=word):
            for _, raw in warc.members(io.BytesIO(data)):
                warc.Record(raw)
    wrong = warc.Record(gzip.decompress(good).replace(b"bodybody", b"bodyBody", 1))
    with pytest.raises(ValueError, match="digest differs"):
        wrong.digest()
    whole = gzip.decompress(good)
    assert [o for o, _ in warc.plain(io.BytesIO(whole * 3))] == [0, len(whole), 2 * len(whole)]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.plain(io.BytesIO(whole + whole[:-3])))


def test_many_members_in_small_reads():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 700))

    data = [warc.record("response", i, "u", b"z" * i, warc.digest(b"z" * i), "d") for i in range(0, 3000, 130)]
    packed = [gzip.compress(d) for d in data]
    got = list(warc.members(Slow(b"".join(packed))))
    assert [r for _, r in got] == data and [o for o, _ in got] == [sum(map(len, packed[:k])) for k in range(len(packed))]
