import random
import re
from collections import Counter

import numpy as np
import pytest

from thalweg.llm import collocations as C

R = random.Random(11)
WORDS = "the of a New YORK city é 東京 x-y <p> naïve 1999 '".split()
SEP = [" ", " ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", "!", ";", "\x0b", "\x0c", ","]


def make(n, words=WORDS):
    return "".join(R.choice(words) + R.choice(SEP) for _ in range(n))


ROWS = [(i, R.choice(["en", "de", None, "und", ""]), make(R.randint(0, 300))) for i in range(60)]
ROWS += [(100, "en", None), (101, "en", ""), (102, None, " \t .,"), (103, "fr", "one two three. " * 12), (104, "fr", "one two three. " * 12),
    (105, "es", "a a a a " * 30), (106, "es", "b " * 5000), (107, "pt", "ab cd " * 4 + "ef ab cd " * 7), (None, "en", "New York city " * 20), (109, "it", "w" * 100_000 + " q. ")] * 2


def plain(rows, least=10, most=2000):
    f, n = {}, Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] = f.get((lang, tuple(w[i:i + k])), 0) + 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(100 * b >= 50 * a for (x, q), b in f.items() if x == lang and len(q) == 3 and len(p) == 2 and b >= least and p in (q[:2], q[1:])):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, le, ri = min(cuts)
        out.append((lang, " ".join(p), a, le, ri, n[lang], score))
    done = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        done += [(lang, k + 1, *x[1:]) for k, x in enumerate(own[:most])]
    return sorted(done)


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, lang string, text string, word string").repartition(5)


@pytest.fixture(scope="module")
def wanted():
    out = plain(ROWS)
    assert len(out) > 100 and any(x[0] == "und" for x in out)
    return out


def test_counts_by_slot_equal_brute_force(docs, wanted):
    assert rows_of(C.digest(docs)) == wanted


def test_shards_equal_brute_force(docs, wanted, monkeypatch):
    monkeypatch.setattr(C, "_count_by_slot", None)
    monkeypatch.setattr(C, "_count", lambda ids, keys, near, scratch, name: C._count_by_shard(ids, keys, near, scratch, name))
    monkeypatch.setattr(C, "SHARD_LEAST", 1000)
    assert rows_of(C.digest(docs)) == wanted


@pytest.mark.parametrize("keys", [0, 45])
def test_joins_beyond_the_bound_equal_brute_force(docs, wanted, monkeypatch, keys):
    monkeypatch.setattr(C, "TABLE_KEYS", keys)
    monkeypatch.setattr(C, "_count", lambda ids, keys, near, scratch, name: C._count_by_shard(ids, keys, max(near, 1), scratch, name))
    assert rows_of(C.digest(docs)) == wanted


def test_many_pairs_stay_numbers(docs, wanted, monkeypatch):
    numbered = C._numbered

    def after_the_words(*args):
        monkeypatch.setattr(C, "TABLE_KEYS", 45)
        return numbered(*args)

    monkeypatch.setattr(C, "_numbered", after_the_words)
    monkeypatch.setattr(C, "joined", lambda docs, scratch: 1 / 0)
    monkeypatch.setattr(C, "_count", lambda ids, keys, near, scratch, name: C._count_by_shard(ids, keys, max(near, 1), scratch, name))
    assert rows_of(C.digest(docs)) == wanted


def test_first_ranks_only_and_ties_by_bytes(docs, wanted):
    got = rows_of(C.top(C.candidates(docs), 7))
    assert got == [x for x in wanted if x[1] <= 7]


def test_empty_table(spark):
    assert C.digest(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    assert C.digest(spark.createDataFrame([(1, "en", "few words")], "doc_id long, lang string, text string")).count() == 0


def test_slots_are_minimal_perfect_and_tell_strangers():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 200_000)).astype(np.uint64)
    s = C.Slots(keys)
    assert np.array_equal(np.sort(s.slot(keys)), np.arange(len(keys))) and np.array_equal(s.keys[s.find(keys)], keys)
    assert (s.find(keys ^ np.uint64(1 << 63)) == -1).all()
    assert (C.Slots(keys[:0]).find(keys[:5]) == -1).all()


def test_products_beyond_64_bits_are_exact():
    a, left, right = 10**12 + 7, 10**12 + 9, 10**13 + 1
    assert C._lowest(a, [(left, right), (left, right)]) == (1000000 * a * a // (left * right), left, right)


def test_arrays_are_summed_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN", 3)
    one = np.arange(C.BLOCK, dtype=np.int64).tobytes()
    rows = spark.createDataFrame([(b, p, bytearray(one)) for b in (0, 4) for p in range(20)], "block long, part long, counts binary")
    got = C.tree_sum(rows, 20).collect()
    assert sorted(r["block"] for r in got) == [0, 4] and all((np.frombuffer(r["counts"], np.int64) == 20 * np.arange(C.BLOCK)).all() for r in got)
