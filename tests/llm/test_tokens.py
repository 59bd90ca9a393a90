import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from thalweg.llm import bpe, packing

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
R = random.Random(5)
LONG = " ".join("".join(R.choices("abcdefghijklmnopqrstuvwxyzéß", k=R.randint(1, 9))) for _ in range(3000))
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b\n\n c\t d \r\n", "it's they'll WE'VE don't 's", "x" * 5000, "ab" * 900 + " é" * 40,
    "<|endoftext|> x <|startoftext|>y", "é é ́ x́", "\x1c a\x1db \x85 c d  e", "漢字 かな 한국어 😀👍🏽 ﬁ ΑΣ Σ", "1234567 12.5% $$$ ### a###", LONG, "pre " + LONG, LONG + "\nend", LONG.replace(" ", "\n"),
    "".join(R.choices("ab \n\té'.1漢 ", k=4000)), "".join(chr(R.randint(1, 0x2FFF)) for _ in range(3000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(4, "a")], "doc_id long, text string")


def test_word_bpe_equals_the_library(docs):
    t = Tokenizer.from_file(WORD)
    got = bpe.digest(docs, WORD).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        h = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), h(" ".join(map(str, ids))), h(t.decode(ids, skip_special_tokens=False))), repr((TEXTS[r.doc_id] or "")[:80])


def test_shared_passages_are_reused():
    c = bpe.ChunkCodec(WORD)
    c.encode(LONG)
    before = c.made
    c.encode("another start " + LONG + " and end")
    assert c.made - before <= 4 and c.reused >= before - 4


def test_packing_equals_the_library(docs):
    t = Tokenizer.from_file(BYTE)
    rows = packing.digest(docs, BYTE).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for k, x in enumerate(TEXTS):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by[k], key=lambda r: r.start)
        if k == 4:
            own = own[::2]
        assert [r.length for r in own] == packing.decompose(len(ids)) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.length & r.length - 1 == 0 and r.length <= 2048 and r.offset == 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()), repr((x or "")[:60])


def test_packed_ids_and_batches(docs):
    got = packing.batches(packing.pack(docs, BYTE), 4096).collect()
    assert all(len(r.ids) == r.length for r in got)
    sizes = {}
    for r in got:
        k = r.sequence_id >> 33, r.length, r.batch
        sizes[k] = sizes.get(k, 0) + 1
    assert all(r.length == 1 << r.bucket for r in got)
    last = {k[:2]: max(b for p, n, b in sizes if (p, n) == k[:2]) for k in sizes}
    for (p, n, b), size in sizes.items():  # all are full but the last
        assert size <= max(1, 4096 // n) and (b == last[p, n] or size == max(1, 4096 // n)) and 0 <= b <= last[p, n]
    assert max(b for *_, b in sizes) > 3


def test_batches_of_equal_sequences(spark):
    rows = [(i, 1024, 10, (i % 2 << 33) + i) for i in range(100)] + [(100, 8192, 13, 5), (101, 8192, 13, 6), (102, 4, 2, None)]
    packed = spark.createDataFrame(rows, "doc_id long, length long, bucket int, sequence_id long")
    got = packing.batches(packed, 4096).groupBy("length", "batch").count().collect()
    assert sorted((r["length"], r["batch"], r["count"]) for r in got if r["batch"] is not None) == [(1024, k, 8 if k < 12 else 4) for k in range(13)] + [(8192, 0, 1), (8192, 1, 1)]
    assert [r["length"] for r in got if r["batch"] is None] == [4] and packing.batches(packed.limit(0)).count() == 0


def test_empty_tables(docs):
    assert bpe.digest(docs.limit(0), WORD).count() == 0 and packing.digest(docs.limit(0), BYTE).count() == 0
    assert {r.doc_id: r.ids for r in bpe.encode(docs, WORD).collect()}[4] == Tokenizer.from_file(WORD).encode("a", add_special_tokens=False).ids


def test_other_kinds_of_files_are_left_to_the_library(tmp_path):
    import json

    one, two = (json.load(open(x, encoding="utf-8")) for x in (BYTE, WORD))
    assert packing._plain(one) and bpe._word_ends(two) and not packing._plain(two) and not bpe._word_ends(one)
    one["pre_tokenizer"]["add_prefix_space"] = True
    two["normalizer"]["normalizers"].pop()  # case stays
    for spec, codec in ((one, packing.ByteCodec), (two, bpe.ChunkCodec)):
        at = str(tmp_path / "other.json")
        json.dump(spec, open(at, "w", encoding="utf-8"))
        t, c = Tokenizer.from_file(at), codec(at)
        for x in ("Two Words, MORE", " it's", LONG[:500]):
            ids, got = t.encode(x, add_special_tokens=False).ids, c.encode(x)
            assert (np.frombuffer(got, "<u4").tolist() if isinstance(got, bytes) else list(map(int, got[0].split()))) == ids
    ranks = json.load(open(BYTE, encoding="utf-8"))
    ranks["model"]["merges"].reverse()
    assert not packing._plain(ranks)


def test_keys_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, ids int, start int")
    assert packing.digest(df, BYTE).count() == 2 and bpe.digest(df, WORD).first().n_tokens == 2
    for f in (lambda: packing.pieces(df, BYTE, key="start"), lambda: bpe.encode(df, WORD, key="ids")):
        with pytest.raises(ValueError, match="must not be named"):
            f()
