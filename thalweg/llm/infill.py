"""Fill-in-the-middle: a text is cut in three at two ranks and told in another order.

The order's draws come from the id: the first four 8-digit groups of the hex sha256 of a seed and the decimal id.
A batch's UTF-8 bytes get one packed bitvector with a bit for each byte that begins a code point, and a directory
of popcounts by block (`Boundaries`). The popcount up to a text's end less that up to its start is its number of
code points; selecting two ranks gives the bytes to cut at. No text is decoded.

Forms: plain (the text as it is), psm `<P>`prefix`<S>`suffix`<M>`middle and spm `<S>`suffix`<P>`prefix`<M>`middle.
A text that holds a marker stays plain, so a told text can be read back without doubt (`restore`).

Null or empty text: empty and plain. Null id: drawn as from an empty decimal. Repeated rows and ties: the same
result each. Very long texts: whole, cuts cost a block each. Empty table: empty. Other columns, whatever their
names: left out; a key named as one of the result's columns raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import limit_batches

P, S, M = b"<P>", b"<S>", b"<M>"
SEED = "1:"
#: Hundredths of texts told in another order, and of these told suffix first.
TOLD = 90
SUFFIX_FIRST = 20
#: Words of 64 bits in a block of the popcount directory.
BLOCK = 8


class Boundaries:
    """Rank and select over the places where code points begin in a run of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        size = -(-(len(bits) + 1) // (8 * BLOCK)) * 8 * BLOCK  # at least one bit more than bytes
        self.words = np.concatenate([bits, np.zeros(size - len(bits), np.uint8)]).view(np.uint64)
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        self.directory = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before each of the bytes."""
        word, block = at >> 6, at // (64 * BLOCK)
        own = self.words.reshape(-1, BLOCK)[block]
        whole = np.where(np.arange(BLOCK) < (word % BLOCK)[:, None], np.bitwise_count(own), 0).sum(axis=1, dtype=np.int64)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.directory[block] + whole + np.bitwise_count(self.words[word] & low)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The byte where the code point of each rank (from 0) begins."""
        block = np.searchsorted(self.directory, ranks, side="right") - 1
        left = ranks - self.directory[block]
        bits = np.unpackbits(self.words.reshape(-1, BLOCK)[block].view(np.uint8), axis=1, bitorder="little")
        place = np.argmax(np.cumsum(bits, axis=1, dtype=np.int32) > left[:, None], axis=1)
        return block * 64 * BLOCK + place


def draws(key: object, seed: str = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of that form was told from."""
    if form == "plain":
        return output
    one, two = (P, S) if form == "psm" else (S, P)
    a, rest = output.removeprefix(one).split(two, 1)
    b, middle = rest.split(M, 1)
    return a + middle + b if form == "psm" else b + middle + a


def _cuts(texts: pa.Array, keys: list, seed: str, told: int, suffix_first: int) -> Iterator[tuple]:
    """text, code points, form, prefix and middle code points, and the bytes to cut at (from the text's start)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    from_, to = offsets[0], offsets[-1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[from_:to] if to > from_ else np.zeros(0, np.uint8)
    offsets = offsets - from_
    marks = Boundaries(data)
    ranks = marks.rank(offsets)
    n = np.diff(ranks)
    h = np.array([draws(k, seed) for k in keys], np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    # a rank past the text's last code point is the next text's first byte, or the end of the data
    start = ranks[:-1]
    cuts = [np.where(start + r < ranks[-1], marks.select(np.minimum(start + r, max(ranks[-1] - 1, 0))), len(data)) for r in (low, high)]
    view = memoryview(data)
    for i in range(len(texts)):
        a, b, c, d = (int(x) for x in (offsets[i], cuts[0][i], cuts[1][i], offsets[i + 1]))
        text = bytes(view[a:d])
        plain = not text or P in text or S in text or M in text or h[i, 2] % 100 >= told
        form = "plain" if plain else "spm" if h[i, 3] % 100 < suffix_first else "psm"
        yield text, int(n[i]), form, None if plain else int(low[i]), None if plain else int(high[i] - low[i]), b - a, c - a


def told(text: bytes, form: str, cut: int, end: int) -> bytes:
    prefix, middle, suffix = text[:cut], text[cut:end], text[end:]
    if form == "plain":
        return text
    return P + prefix + S + suffix + M + middle if form == "psm" else S + suffix + P + prefix + M + middle


FIELDS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}


def _run(docs: DataFrame, key: str, extra: dict, of, seed: str, share: int, suffix_first: int) -> DataFrame:
    fields = FIELDS | extra
    if key in fields:
        raise ValueError(f"the key must not be named {key}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, n, form, prefix, middle, cut, end in _cuts(b.column(1), b.column(0).to_pylist(), seed, share, suffix_first):
                rows.append((n, form, prefix, middle, *of(told(text, form, cut, end), form)))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, *fields])

    limit_batches(docs.sparkSession)
    types = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", *(f"{x} {types[t]}" for x, t in fields.items())])
    return docs.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def transform(docs: DataFrame, key: str = "doc_id", seed: str = SEED, share: int = TOLD, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and output, the told text."""
    return _run(docs, key, {"output": pa.string()}, lambda out, form: (out.decode(),), seed, share, suffix_first)


def restored(told_texts: DataFrame) -> DataFrame:
    """transform()'s rows with `text`, read back from output and form."""
    names = told_texts.columns
    if "text" in names:
        raise ValueError("there is a column named text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = [restore(o.as_py().encode(), f.as_py()) for o, f in zip(b.column("output"), b.column("form"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.binary()).cast(pa.string())], names=[*names, "text"])

    limit_batches(told_texts.sparkSession)
    return told_texts.mapInArrow(run, StructType([*told_texts.schema.fields, StructField("text", StringType())]))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""

    def hashed(out: bytes, form: str) -> tuple[str, str]:
        return hashlib.sha256(out).hexdigest(), hashlib.sha256(restore(out, form)).hexdigest()

    return _run(docs, "doc_id", {"output_sha256": pa.string(), "restored_sha256": pa.string()}, hashed, SEED, TOLD, SUFFIX_FIRST)


#: The query in SQL.
SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (
  SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM drawn),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {TOLD} THEN 'plain'
      WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM h),
part AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM part
"""
