import hashlib
import random

import numpy as np
import pytest

from thalweg.llm import infill as I

R = random.Random(13)
TEXTS = [None, "", "a", "é", "漢", "😀", "a😀", "<P>", "x <S> y", "<M", "<P<P", "ab<", ">cd", "e\u0301 n\x00ul \ufeff", "\U0010ffff" * 700, "z" * 300_000 + "é😀" * 40_000]
TEXTS += ["".join(R.choice("ab <>PSM\né漢😀") for _ in range(R.randint(1, 400))) for _ in range(300)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "é"), (3, "other"), (-5, "minus")]


def plain(key, text):
    text = text or ""
    n = len(text)
    d = hashlib.sha256(("1:" + ("" if key is None else str(key))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in ROWS], "doc_id long, text string, form string, output string")


def test_equals_plain_slicing(docs):
    got = sorted((tuple(r) for r in I.digest(docs).collect()), key=str)
    want = sorted(((k, *(w := plain(k, t))[:4], sha(w[4]), sha(t or "")) for k, t in ROWS), key=str)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_read_back_from_output_and_form(docs):
    out = I.transform(docs)
    assert sorted((str(r["doc_id"]), r["output"]) for r in out.collect()) == sorted((str(k), plain(k, t)[4]) for k, t in ROWS)
    assert sorted((str(r["doc_id"]), r["text"]) for r in I.restored(out).collect()) == sorted((str(k), t or "") for k, t in ROWS)


def test_other_shares_and_seed(docs):
    assert {r["form"] for r in I.transform(docs, share=0).collect()} == {"plain"}
    assert {r["form"] for r in I.transform(docs, share=100, suffix_first=100).collect()} == {"plain", "spm"}
    assert I.transform(docs, seed="2:").select("output").exceptAll(I.transform(docs).select("output")).count() > 0


def test_rank_and_select_at_every_byte():
    for text in ("", "a", "é漢😀" * 400, "".join(t or "" for t in TEXTS[16:60])):
        data = np.frombuffer(text.encode(), np.uint8)
        b = I.Boundaries(data)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.arange(len(data) + 1)
        assert (b.rank(at) == np.searchsorted(starts, at)).all()
        assert (b.select(np.arange(len(starts))) == starts).all()


def test_empty_table_and_names(spark, docs):
    assert I.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        I.transform(docs.withColumnRenamed("doc_id", "n"), key="n")
    assert I.transform(docs.withColumnRenamed("form", "id 1"), key="id 1").columns[0] == "id 1"
