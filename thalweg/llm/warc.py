"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing deals records into archives of bounded size. Records of one payload (by SHA-1) of at least
MIN_REVISIT bytes become one response, that with the largest key, and revisits that refer to it. An
archive is a row (archive, content): the file's bytes, as Spark's binaryFile source also gives them, so
that archives live wherever Spark can read and write and no task touches a local path.

Reading takes (path, content) rows: it finds the dictionary, decodes frame by frame, and checks magic
numbers, headers, Content-Length, digests and the two line ends after each block; what does not hold
raises ValueError with the archive and the byte offset. Archives of other writers are read as well: ids of
any form, records of any type, HTTP messages (the payload is the body), digests in hex or base 32, or none.

Null payload: empty. Repeated rows and ties: a record each; all rows with the largest key of a payload are
responses. Null key: never referred to. Empty table: no archive. Very long payloads: an archive of their own.
Other columns, whatever their names: left out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Spread, limit_batches

MIN_REVISIT = 1000
#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Skippable frame that holds the dictionary (first of the magic numbers 0x184D2A50 to 0x184D2A5F reserved for .warc.zst).
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
LEVEL = 3
#: Compressed bytes handed to the decoder at once.
FEED = 16 << 10
#: Text that most records share; the dictionary is raw content.
COMMON = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
          b"WARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Record-ID: <urn:thalweg:record:>\r\nWARC-Refers-To: <urn:thalweg:record:"
          b"WARC-Target-URI: https://www.http://WARC-Payload-Digest: sha1:Content-Length: \r\n\r\n<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title></title>"
          b"<style></style><script></script></head><body><nav><ul><li><a href=\"/\"></a></li></ul></nav><div class=\"\"><article><h1></h1><p></p><b><br></article><footer></footer></body></html>")


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


@lru_cache(maxsize=4)
def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def record(key: str, kind: str, refers: str | None, uri: str, digest: bytes, payload: bytes, length: int) -> bytes:
    """One WARC record; a revisit has no block."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:thalweg:record:{key}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", uri or "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{_b32(digest)}")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:thalweg:record:{refers}>"), ("X-Payload-Length", str(length))]
        payload = b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return header(fields) + payload + b"\r\n\r\n"


def opening(dictionary: bytes) -> bytes:
    """The leading skippable frame."""
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def _same_digest(given: str, data: bytes) -> bool | None:
    """Is `algorithm:value`, in hex or base 32, the digest of the data? None for an algorithm that isn't known."""
    name, _, value = given.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    found = hashlib.new(name, data).digest()
    value = value.strip().rstrip("=")
    return value.lower() == found.hex() or value.upper() == _b32(found).rstrip("=")


def unchunked(body: bytes) -> bytes | None:
    """An HTTP body without its chunk lines; None if it isn't chunked after all."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2:end + 2 + size])
        at = end + 4 + size
    return None


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """What a record's block carries: an HTTP message's body, else the whole block."""
    if not head.get("content-type", "").lower().replace(" ", "").startswith(
        "application/http") or head["warc-type"] not in ("response", "request", "revisit"):
        return block
    top, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" in top.lower() and (plain := unchunked(body)) is not None:
        given = head.get("warc-payload-digest", "")
        if not _same_digest(given, body):  # some writers take the digest of the body as it was sent
            return plain
    return body


def parse(block: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Headers (the first of each name, folded lines joined) and payload of one decoded record."""
    head, sep, rest = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise ValueError(f"{where}: no WARC header")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] = f"{out[last]} {text.strip()}"
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise ValueError(f"{where}: bad header line")
        name = name.strip().lower()
        last = None if name in out else name
        out.setdefault(name, value.strip())
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in out:
            raise ValueError(f"{where}: no {need}")
    size = int(out["content-length"]) if out["content-length"].isdigit() else -1
    if size != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{where}: Content-Length {out['content-length']} but {len(rest) - 4} bytes and an end")
    body = rest[:-4]
    if _same_digest(out.get("warc-block-digest", ""), body) is False:
        raise ValueError(f"{where}: block digest differs")
    payload = payload_of(out, body)
    if out["warc-type"] != "revisit" and _same_digest(out.get("warc-payload-digest", ""), payload) is False:
        raise ValueError(f"{where}: payload digest differs")
    return out, payload


def read_archive(content: bytes, name: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive in order; frames are decoded one at a time."""
    import zstandard

    at, total, given = 0, len(content), None
    view = memoryview(content)
    tool = None
    while at < total:
        if total - at < 8:
            raise ValueError(f"{name}: {total - at} stray bytes at {at}")
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > total:
                raise ValueError(f"{name}: skippable frame at {at} is cut off")
            if magic == DICT_MAGIC and at == 0:
                given = bytes(view[8:8 + size])
                if given[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                    given = zstandard.ZstdDecompressor().decompressobj().decompress(given)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"{name}: no frame at {at}")
        if tool is None:
            tool = zstandard.ZstdDecompressor(
                dict_data=zstandard.ZstdCompressionDict(
                    given) if given and given[:4] == b"\x37\xa4\x30\xec" else _dictionary(given) if given else None)
        work, parts, start = tool.decompressobj(), [], at
        while not work.eof:
            if at >= total:
                raise ValueError(f"{name}: frame at {start} is cut off")
            step = view[at:at + FEED]
            try:
                parts.append(work.decompress(step))
            except zstandard.ZstdError as e:
                raise ValueError(f"{name}: frame at {start}: {e}") from e
            at += len(step)
        at -= len(work.unused_data)
        yield parse(b"".join(parts), f"{name} at {start}")


OWN_ID = "<urn:thalweg:record:"


def _key(record_id: str | None) -> int | None:
    """The key in an id that `record` wrote; None for any other."""
    found = record_id[len(OWN_ID):].rstrip(">") if record_id and record_id.startswith(OWN_ID) else ""
    return int(found) if found.lstrip("-").isdigit() else None


def plan_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """(key, uri, payload, refers) of every row; refers is the response's key for revisits, else null.

    Equal payloads meet by digest with counts and the largest key aggregated before the exchange; only
    keys and digests travel, and the payloads are joined by key, so a payload that many rows share makes
    no hot task.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(key).cast("long").alias("key"), F.coalesce(uri, F.lit("")).alias("uri"),
        body.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    ids = rows.filter(F.octet_length("payload") >= MIN_REVISIT).select("key", "digest")
    shared = ids.groupBy("digest").agg(F.max("key").alias("refers"), F.count("*").alias("n")).filter(
        (F.col("n") > 1) & F.col("refers").isNotNull()).drop("n")
    revisits = ids.join(shared, "digest").filter(~F.col("key").eqNullSafe(F.col("refers"))).distinct()
    theirs = revisits.select(F.col("key").alias("k2"), F.col("digest").alias("d2"), "refers")
    return rows.join(theirs, F.col("key").eqNullSafe(F.col("k2")) & (F.col("digest") == F.col("d2")), "left").select(
        "key", "uri", "payload", "refers")


def archives(records: DataFrame, dictionary: bytes = COMMON) -> DataFrame:
    """(archive, content) rows from (key, uri, payload, refers) rows; a task fills one archive after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        task, count, size, parts = TaskContext.get().partitionId(), 0, 0, [opening(dictionary)]

        def give() -> pa.RecordBatch:
            nonlocal count, size, parts
            out = pa.RecordBatch.from_arrays(
                [pa.array([f"{task:06d}-{count:06d}.warc.zst"]), pa.array([b"".join(parts)], pa.binary())],
                names=["archive", "content"])
            count, size, parts = count + 1, 0, [opening(dictionary)]
            return out

        for b in batches:
            for key, uri, payload, refers in zip(*(b.column(i) for i in range(4)), strict=True):
                data, to = payload.as_py(), refers.as_py()
                name = lambda k: "null" if k is None else str(k)
                kind = "response" if to is None else "revisit"
                one = record(
                    name(key.as_py()), kind, name(to), "".join(c if c > " " else "%20" for c in uri.as_py()),
                    hashlib.sha1(data).digest(), data, len(data))
                parts.append(tool.compress(one))
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    yield give()
        if size:
            yield give()

    limit_batches(records.sparkSession)
    return records.mapInArrow(run, "archive string, content binary")


ROW = pa.schema([("key", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary())])


def _stated(head: dict[str, str]) -> tuple[int | None, str | None]:
    """Payload length and hex SHA-1 that a revisit's header states."""
    size = head.get("x-payload-length", "")
    name, _, value = head.get("warc-payload-digest", "").partition(":")
    value = value.strip()
    if name.strip().lower() != "sha1":
        return int(size) if size.isdigit() else None, None
    return int(size) if size.isdigit() else None, value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def records(stored: DataFrame, with_payload: bool = True) -> DataFrame:
    """Validated records of (archive, content) rows, as `archives` or binaryFile (path, content) give them.

    Any writer's records: key and refers_to are null for ids that aren't of this module's form, the length
    and digest of a revisit are those it states (null if it states none), all others' are computed.
    """
    names = [n for n in ROW.names if with_payload or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, ROW.field(n).type) for c, n in zip(cols, names, strict=True)], names=names)

        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows, held = [], 0
                for head, payload in read_archive(content.as_py(), name.as_py()):
                    again = head["warc-type"] == "revisit"
                    size, digest = _stated(head) if again else (len(payload), hashlib.sha1(payload).hexdigest())
                    own, refers = head["warc-record-id"], head.get("warc-refers-to")
                    row = _key(own), own, head.get("warc-target-uri"), head["warc-type"], _key(refers), refers, size, digest, payload
                    rows.append(row[: len(names)])
                    held += len(payload) * with_payload
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield give(rows)
                        rows, held = [], 0
                if rows:
                    yield give(rows)

    limit_batches(stored.sparkSession)
    schema = "key long, record_id string, uri string, record_type string, refers_to long, refers_to_id string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return stored.select(stored.columns[0], "content").mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Kept records with each revisit's length and digest taken from the payload of the response it refers to.

    A revisit whose response isn't among the records, or has another digest than it states, raises.
    Responses that very many revisits refer to are met in parts.
    """
    again = found.filter("record_type = 'revisit'").select("key", "refers_to_id", F.col("payload_digest").alias("stated"), "refers_to")
    there = found.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), "payload_bytes", "payload_digest").distinct()
    met = Spread(again, "refers_to_id", "key").meet(again, there, "left")
    wrong = F.when(F.col("payload_bytes").isNull(), F.lit("no response ")).when(
        F.col("stated") != F.col("payload_digest"), F.lit("a revisit states another digest than its response "))
    fault = F.raise_error(F.concat(wrong, F.coalesce("refers_to_id", F.lit("(no id)"))))
    ok = met.select("key", F.lit("revisit").alias("record_type"), "refers_to",
        F.when(wrong.isNotNull(), fault.cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest")
    rest = found.filter("record_type <> 'revisit'").select("key", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return rest.unionByName(ok)


def read_files(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records of .warc.zst files anywhere that Spark can read."""
    return records(spark.read.format("binaryFile").load(path).select("path", "content"), with_payload)


def digest(pages: DataFrame) -> DataFrame:
    """The query's columns: every page written to archives in the shared folder and read back from them."""
    scratch = Scratch(pages.sparkSession)
    stored = scratch.keep(archives(plan_records(pages)), "warc")
    found = resolved(scratch.keep(records(stored, with_payload=False), "records"))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The query as DuckDB SQL.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN octet_length(b) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(b) >= 1000 AND page_id <> top THEN top END AS refers_to FROM p JOIN m USING (d)
"""
