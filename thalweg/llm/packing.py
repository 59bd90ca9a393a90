"""Packing by power-of-two decomposition.

A document's ids (its text's, then END) are cut into full sequences of MOST tokens and then into the
powers of two that make up the rest, longest first. Every piece is a sequence of its own, whose length is
a power of two, so no sequence crosses documents and none is padded. `bucket` is the length's exponent:
equal lengths batch together, as rows of a batch of any size.

Ids are those of the tokenizers library. White space before a word starts a new pre-token, so words are
encoded apart and reused from a bounded table in the worker; a text is divided only at single spaces
between other characters. Words of common alphabets are encoded by tiktoken over the same ranks (the ids
are the same and it is faster), the rest by the tokenizers library itself. A file that isn't a plain
byte-level BPE whose ids are its merges' ranks is left to the library, whole texts at a time.

Null or empty text: the single id END. Repeated rows: pieces of their own. Ties: there are none, pieces of a
row are told apart by start. Very long texts: whole. Empty table: empty. Other columns, whatever their
names: left out; a key named as one of the result's columns raises ValueError.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_batches

MOST = 2048
END = 1
WORDS_KEPT = 300_000
WORD_MOST = 64
UNSAFE = re.compile(r"\s ")
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: GPT-2's pre-token pattern, which byte-level files with use_regex stand for.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def decompose(n: int, most: int = MOST) -> list[int]:
    """Lengths that add up to n: as many of `most` as fit, then falling powers of two."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself, or from 256 up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Words(dict):
    """Word -> its ids as bytes; `lead` is what stands before each word (a space, or nothing)."""

    def __init__(self, owner: ByteCodec, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, word: str) -> bytes:
        out = self.owner.fresh(self.lead + word)
        if len(self) < WORDS_KEPT and len(word) <= WORD_MOST:
            self[word] = out
        return out


def _plain(spec: dict) -> bool:
    """Is the file a byte-level BPE that splits by PATTERN, with ids in the order of its merges?"""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(
        model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback",
            "ignore_merges")):
        return False
    merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    return all(x < y for x, y in zip(made, made[1:])) and (not made or made[0] >= 256)


class ByteCodec:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        if _plain(spec):
            letters = _byte_of_letter()
            ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
            self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.later = Words(self, ""), Words(self, " ")

    def fresh(self, piece: str) -> bytes:
        common = piece.isascii() or max(piece) < "؀"
        if common and len(piece) < 1000 and piece.replace("\n", "").isprintable():
            return np.array(self.fast.encode_ordinary(piece), np.uint32).tobytes()
        return np.array(self.lib.encode(piece, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = SAFE.split(text) if UNSAFE.search(text) or text[-1] == " " or text[0] == " " else text.split(" ")
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))


@lru_cache(maxsize=4)
def codec(path: str) -> ByteCodec:
    return ByteCodec(path)


FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32())]


def pieces(docs: DataFrame, path: str, most: int = MOST, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, bucket and, if asked for, ids (array<int>)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            keys, rows, ids = [], [], []

            def give() -> pa.RecordBatch:
                cols = [b.column(0).take(pa.array(keys, pa.int64()))]
                cols += [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(FIELDS)]
                names = [key, *(n for n, _ in FIELDS)]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                keys.clear(), rows.clear(), ids.clear()
                return pa.RecordBatch.from_arrays(cols, names=names)

            for i, t in enumerate(b.column(1)):
                data = c.encode(t.as_py() or "") + end
                total, at = len(data) // 4, 0
                for n in decompose(total, most):
                    part = data[4 * at:4 * (at + n)]
                    keys.append(i)
                    rows.append((at, n, zlib.crc32(part), total, n.bit_length() - 1))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                    at += n
                if len(rows) >= 5000:
                    yield give()
            if rows:
                yield give()

    if key in {n for n, _ in FIELDS} | {"ids", "sequence_id", "offset"}:
        raise ValueError(f"the key must not be named {key}")
    limit_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, most: int = MOST, with_ids: bool = True, key: str = "doc_id") -> DataFrame:
    """Pieces with the sequence each is, all of it from offset 0."""
    out = pieces(docs, path, most, key, with_ids=with_ids)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def batches(packed: DataFrame, tokens: int = 1 << 20) -> DataFrame:
    """Adds `batch`: sequences of one length, as many as have `tokens` tokens together, numbered from 0 in a partition and length.

    A partition is what `pack` made in one task (the upper bits of sequence_id), so no batch waits for the whole table.
    Sequences longer than `tokens`: one a batch. Null sequence_id or length: no batch (null). Empty table: empty.
    """
    per = F.greatest(F.lit(1), F.expr(f"{tokens} div length"))
    part = F.shiftright("sequence_id", 33)
    place = F.row_number().over(Window.partitionBy("length", part).orderBy("sequence_id")) - 1
    return packed.withColumn("batch", F.when(F.col("sequence_id").isNotNull() & F.col("length").isNotNull(), F.floor(place / per)))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The query's columns."""
    return pack(docs, path, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
