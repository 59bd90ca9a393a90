"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over WINDOW code points cuts a text into chunks, so that a passage that many documents
share is cut alike in all of them whatever stands before it. A chunk's inside, between its first and
last white space, is encoded once and then reused from a bounded table in the Python worker. Where two
chunks meet, what lies between the last white space of one and the first of the next is encoded anew as
one stretch. White space ends every pre-token, so the encodings agree with the whole text's exactly from
there on; a chunk without white space widens the stretch until there is some. A stretch's words are in
turn reused from a second bounded table, and only words found in neither reach the library.

The tables hold for one worker: a chunk is encoded once for each worker that meets it (and again once it
has been pushed out), never sent over the network. Exactness does not depend on them.

All this holds for files that normalise white space to one blank and lower the case, drop what lies between
words and mark words' ends; the codec reads the file, and any other kind is left to the library, whole
texts at a time.

Null or empty text: no ids, decoded to the empty text. Repeated rows and ties: one result each. Very long
texts: whole. Empty table: empty. Other columns, whatever their names: left out; a key named as one of the
result's columns raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import limit_batches

WINDOW = 12
#: Code points in a chunk on average; a power of two.
CHUNK = 512
#: Entries kept in a worker: words (each under WORD_MOST characters) and chunks (two generations).
WORDS_KEPT = 200_000
CORES_KEPT = 250_000
WORD_MOST = 64
CHUNKS_KEPT = 4000
#: Marks that often follow a word and are one pre-token there.
MARKS = frozenset(".,!?;:")
SPLIT = re.compile("[ \n]")


def cuts(text: str) -> list[int]:
    """Ends of the text's chunks, the last at the text's end."""
    n = len(text)
    if n <= CHUNK // 4:
        return [n]
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = data * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    acc = np.cumsum(x, dtype=np.uint32)  # a window's sum of mixed code points rolls
    roll = acc[WINDOW:] - acc[:-WINDOW] if n > WINDOW else acc[:0]
    roll = roll * np.uint32(0x85EBCA6B)
    at = np.flatnonzero(roll >> np.uint32(32 - CHUNK.bit_length() + 1) == 0) + WINDOW + 1
    out = at.tolist()
    if not out or out[-1] != n:
        out.append(n)
    return out


def _word_ends(spec: dict) -> bool:
    """Does the file encode words apart: white space to a blank, lower case, gaps dropped, an end mark?"""
    steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    return (steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
            and "[\\p{L}]+" in pre[0]["pattern"].get("Regex", "") and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
            and spec.get("decoder") is None and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix"))
            and not model.get("dropout") and not any(t["content"].strip() != t["content"] or " " in t["content"] for t in spec["added_tokens"]))


class ChunkCodec:
    """Encodes to decimal ids joined by a space, with the decoded text beside them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # batches are small and every core has a task
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_words = _word_ends(json.load(f))
        self.words: dict[str, tuple[str, str]] = {"": ("", "")}
        self.cores: dict[str, tuple[str, str]] = {}
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.reused = self.made = 0

    def library(self, words: list[str]) -> Iterator[tuple[str, str]]:
        for e in self.lib.encode_batch_fast(words, add_special_tokens=False):
            yield " ".join(map(str, e.ids)), self.lib.decode(e.ids, skip_special_tokens=False)

    def fresh(self, words: list[str]) -> None:
        """Encode words into `self.words`: Latin letters with at most one mark behind from their lower-case letters.

        Letters and the mark are pre-tokens of their own and lower case is what the library makes of
        them, so those parts' encodings are the word's; other words go to the library as they are.
        """
        cores, whole, need = self.cores, [], {}
        for w in words:
            mark = w[-1] if w[-1] in MARKS else ""
            core = (w[:-1] if mark else w).lower()
            if core.isalpha() and max(core) <= "\xff":
                need[w] = core, mark
            else:
                whole.append(w)
        if missing := [c for c in {c for x in need.values() for c in x if c} if c not in cores]:
            if len(cores) > CORES_KEPT:
                cores.clear()  # the cores of the words at hand are made anew
                missing = list({c for x in need.values() for c in x if c})
            cores.update(zip(missing, self.library(missing), strict=True))
        for w, (core, mark) in need.items():
            ids, dec = cores[core]
            if mark:
                i, d = cores[mark]
                ids, dec = f"{ids} {i}", f"{dec} {d}"
            self.words[w] = ids, dec
        if whole:
            self.words.update(zip(whole, self.library(whole), strict=True))

    def stretch(self, text: str) -> tuple[list[str], list[str]]:
        """Ids and decoded words of text that begins and ends at white space or an end of the document."""
        words = text.replace("\n", " ").split(" ")
        known = self.words
        if missing := [w for w in set(words) if w not in known]:
            self.fresh(missing)
        got = [known[w] for w in words]
        out = [x[0] for x in got if x[0]], [x[1] for x in got if x[0]]
        if missing:
            full = len(known) > WORDS_KEPT
            for w in missing:
                if full or len(w) > WORD_MOST:
                    del known[w]
        return out

    def chunk(self, text: str) -> tuple:
        """(head, ids, decoded, tail) of a chunk, or (text,) of one without white space."""
        found = self.young.get(text)
        if found is None:
            found = self.old.get(text)
            if found is None:
                self.made += 1
                first = SPLIT.search(text)
                if first is None:
                    found = (text,)
                else:
                    last = max(text.rfind(" "), text.rfind("\n"))
                    ids, dec = self.stretch(text[first.start():last])
                    found = (text[: first.start()], " ".join(ids), " ".join(dec), text[last + 1:])
            else:
                self.reused += 1
            if len(self.young) >= CHUNKS_KEPT:
                self.old, self.young = self.young, {}
            self.young[text] = found
        else:
            self.reused += 1
        return found

    def encode(self, text: str) -> tuple[str, str]:
        if not self.by_words:
            return next(self.library([text]))
        ids: list[str] = []
        dec: list[str] = []
        pending, start = "", 0

        def close(word: str) -> None:
            i, d = self.stretch(word)
            ids.extend(i)
            dec.extend(d)

        for end in cuts(text):
            found = self.chunk(text[start:end])
            start = end
            if len(found) == 1:
                pending += found[0]
                continue
            close(pending + found[0])
            if found[1]:
                ids.append(found[1])
                dec.append(found[2])
            pending = found[3]
        close(pending)
        return " ".join(ids), " ".join(dec)


@lru_cache(maxsize=4)
def codec(path: str) -> ChunkCodec:
    """One for each file and worker."""
    return ChunkCodec(path)


def _hex(x: str) -> str:
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = [c.encode(t or "") for t in b.column(1).to_pylist()]
            ids = pa.array([list(map(int, i.split())) for i, _ in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([d for _, d in got], pa.string())], names=[key, "ids", "decoded"])

    if key in ("ids", "decoded"):
        raise ValueError(f"the key must not be named {key}")
    limit_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The query's columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            counts, sums, texts = [], [], []
            for t in b.column(1):
                i, d = c.encode(t.as_py() or "")
                counts.append(i.count(" ") + 1 if i else 0)
                sums.append(_hex(i))
                texts.append(_hex(d))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    limit_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
