import hashlib
import struct

import pytest
import zstandard

from thalweg.llm import warc as W

BIG = "<html>" + "é boiler plate " * 100 + "</html>"
ROWS = [(1, "http://a/", BIG), (7, "http://b/ x\n", BIG), (3, "http://c/", BIG), (4, "u", "small"), (5, "u", "small"), (6, None, None), (8, "u", ""), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "\r\n\r\n" * 400), (11, "u", "\r\n\r\n" * 400), (None, "u", BIG)]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    got = {(r.page_id, r.payload_digest): r for r in W.digest(df).collect()}
    assert W.digest(df).count() == len(ROWS)
    for k, _, html in ROWS:
        b = (html or "").encode()
        r = got[k, hashlib.sha1(b).hexdigest()]
        assert r.payload_bytes == len(b)
        want = 7 if html == BIG and k != 7 else None
        assert r.refers_to == want and r.record_type == ("response" if want is None else "revisit")


def test_payloads_and_frames(spark):
    df = spark.createDataFrame(ROWS[:6], "page_id long, url string, html string").coalesce(1)
    stored = W.archives(W.plan_records(df)).collect()
    (content,) = (bytes(r.content) for r in stored)
    assert struct.unpack_from("<I", content)[0] == W.DICT_MAGIC
    back = list(W.read_archive(content))
    assert {p.decode() for h, p in back if h["warc-type"] == "response"} == {BIG, "small", ""}
    assert len(back) == 6 and all(int(h["content-length"]) == len(p) for h, p in back)


def archive(*blocks):
    d = W._dictionary(W.COMMON)
    return W.opening(W.COMMON) + b"".join(zstandard.ZstdCompressor(dict_data=d).compress(b) for b in blocks)


def test_damage_is_found():
    good = W.record("1", "response", None, "u", hashlib.sha1(b"abc").digest(), b"abc", 3)
    assert len(list(W.read_archive(archive(good, good)))) == 2
    for bad in (good.replace(b"Length: 3", b"Length: 4"), good.replace(b"abc\r\n", b"abd\r\n"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), good[:-2], b""):
        with pytest.raises(ValueError):
            list(W.read_archive(archive(bad)))
    for cut in (archive(good)[:-3], archive(good) + b"xxxxxxxxxxxx", archive(good) + b"x", archive(good)[:20]):
        with pytest.raises(ValueError):
            list(W.read_archive(cut))


def test_compressed_dictionary_and_plain_archive():
    good = W.record("1", "response", None, "u", hashlib.sha1(b"abc").digest(), b"abc", 3)
    packed = zstandard.ZstdCompressor().compress(W.COMMON)
    body = archive(good)[8 + len(W.COMMON):]
    assert len(list(W.read_archive(struct.pack("<II", W.DICT_MAGIC, len(packed)) + packed + body))) == 1
    assert len(list(W.read_archive(zstandard.ZstdCompressor().compress(good)))) == 1


def test_files_and_empty(spark, tmp_path):
    good = W.record("5", "response", None, "u", hashlib.sha1(b"abc").digest(), b"abc", 3)
    (tmp_path / "a.warc.zst").write_bytes(archive(good))
    r = W.read_files(spark, str(tmp_path)).first()
    assert (r.key, bytes(r.payload)) == (5, b"abc")
    assert W.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def foreign(kind, block, **more):
    fields = [("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:6d058047-ede2-4a13-be79-90c17c631dd4>"), ("WARC-Date", "2020-01-01T00:00:00Z"), *((k.replace("_", "-"), v) for k, v in more.items()), ("Content-Length", str(len(block)))]
    return W.header(fields) + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark):
    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<p>he\r\n7\r\nllo</p>\r\n0\r\n\r\n"
    sha = hashlib.sha1(body)
    msg = {"Content_Type": "application/http; msgtype=response"}
    blocks = [foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"), foreign("response", http, WARC_Payload_Digest="sha1:" + W._b32(sha.digest()), **msg),
              foreign("response", http, WARC_Payload_Digest="SHA1:" + sha.hexdigest(), WARC_Block_Digest="sha256:" + hashlib.sha256(http).hexdigest(), **msg), foreign("response", http, **msg),
              foreign("response", chunked, WARC_Payload_Digest="sha1:" + W._b32(sha.digest()), **msg), foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Payload_Digest="sha1:" + W._b32(sha.digest()), WARC_Refers_To="<urn:uuid:1>", **msg),
              foreign("metadata", b"via: x", WARC_Note="folded\r\n  line", WARC_Payload_Digest="crc:1"), foreign("revisit", b"", **msg)]
    plain = b"".join(zstandard.ZstdCompressor().compress(b) for b in blocks)
    got = W.records(spark.createDataFrame([("x.warc.zst", plain)], "path string, content binary")).collect()
    assert [r.record_type for r in got] == ["warcinfo", *["response"] * 4, "revisit", "metadata", "revisit"]
    assert all(bytes(r.payload) == body and r.payload_bytes == len(body) and r.payload_digest == sha.hexdigest() for r in got[1:5])
    assert got[5].payload_digest == sha.hexdigest() and got[5].payload_bytes is None and got[5].refers_to_id == "<urn:uuid:1>" and got[7].payload_digest is None
    assert {r.key for r in got} == {None} and got[0].record_id.startswith("<urn:uuid:")
    with pytest.raises(ValueError, match="payload digest"):
        list(W.read_archive(zstandard.ZstdCompressor().compress(foreign("response", http, WARC_Payload_Digest="sha1:" + "A" * 32, **msg))))
    with pytest.raises(ValueError, match="block digest"):
        list(W.read_archive(zstandard.ZstdCompressor().compress(foreign("resource", b"x", WARC_Block_Digest="md5:" + "0" * 32))))


def test_revisits_take_their_figures_from_the_response(spark, monkeypatch):
    from thalweg.llm import common

    monkeypatch.setattr(common, "HUB_ROWS", 3)
    rows = [(k, "u", BIG) for k in range(20)] + [(30, "u", "other" * 300), (31, "u", "other" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", __import__("pyspark").sql.functions.lit("clash"))
    got = {r.page_id: r for r in W.digest(df).collect()}
    assert len(got) == 22 and got[5].refers_to == 19 and got[5].payload_bytes == len(BIG.encode()) and got[30].refers_to == 31
    lost = spark.createDataFrame([(1, "a", "revisit", 2, "b", 5, "d")], "key long, record_id string, record_type string, refers_to long, refers_to_id string, payload_bytes long, payload_digest string")
    with pytest.raises(Exception, match="no response b"):
        W.resolved(lost).collect()


def test_a_revisit_of_another_digest_raises(spark):
    rows = [(1, "a", "response", None, None, 5, "aa"), (2, "b", "revisit", 1, "a", None, "bb"), (3, "c", "revisit", 1, "a", None, "aa")]
    kind = "key long, record_id string, record_type string, refers_to long, refers_to_id string, payload_bytes long, payload_digest string"
    with pytest.raises(Exception, match="another digest than its response a"):
        W.resolved(spark.createDataFrame(rows, kind)).collect()
    assert {r.key: r.payload_digest for r in W.resolved(spark.createDataFrame(rows[::2], kind)).collect()} == {1: "aa", 3: "aa"}


def test_very_long_payloads_and_clashing_columns(spark):
    big = "x<é>" * 700_000
    rows = [(1, "http://a", big, "p", 1), (2, "http://b", big, "q", 2), (3, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, key int")
    got = {r.page_id: r for r in W.digest(pages).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == got[3].record_type == "response"
    assert got[1].payload_bytes == got[2].payload_bytes == len(big.encode()) and got[3].payload_bytes == 0
