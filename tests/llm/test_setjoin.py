import random
import re

import numpy as np
import pytest

from thalweg.llm import setjoin as S


def brute(texts, words, percent):
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    s = {k: sets(t) for k, t in texts.items()}
    comp = {k: k for k in s}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in s:
        for b in s:
            if a < b and s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {k: (len(s[k]), root(k)) for k in s}


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = {0: None, 1: "", 2: " \t", 3: "Alpha", 4: "alpha", 5: "alpha beta", 6: "É", 7: "é"}
    while len(out) < n:
        base = r.choices(vocab, k=r.choice([1, 2, 3, 5, 9, 11, 12, 14, 20, 25, 60, 150, 400]))
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
                i = r.randrange(len(w))
                how = r.random()
                if how < 0.4:
                    w[i] = r.choice(vocab)
                elif how < 0.7 and len(w) > 1:
                    del w[i]
                else:
                    w.insert(i, r.choice(vocab))
            out[len(out) * 3 + 10] = " ".join(w)
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 90)])
def test_classes_equal_brute_force(spark, words, percent):
    texts = corpus(words, 260)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.classes(df, words, percent).collect()}
    assert got == brute(texts, words, percent)


def test_every_similar_pair_shares_a_signature():
    r = np.random.default_rng(2)
    for percent in (90, 80):
        plan = S.bands(percent, 100_000, 5000)
        for _ in range(1500):
            n = int(r.choice([9, 10, 11, 15, 19, 20, 21, 40, 97, 300, 1000]))
            a = r.integers(0, 2**63, n).astype(np.uint64)
            room = n * (100 - percent) // percent
            gone = int(r.integers(0, room + 1))
            more = int(r.integers(0, room + 1))
            b = np.concatenate((a[gone:], r.integers(0, 2**63, more).astype(np.uint64)))
            both, union = n - gone, n + more
            if 100 * both < percent * union:
                continue
            one, two = ({int(x) for band in S.probed(plan, len(s), percent) if band.errors for x in S.signatures(s, band)} for s in (np.unique(a), np.unique(b)))
            assert one & two or (len(a) == len(b) and not gone and not more), (n, gone, more)


def test_random_sets_rarely_meet():
    r = np.random.default_rng(3)
    plan = S.bands(80, 1 << 20, 5000)
    sets = [np.unique(r.integers(0, 2**63, int(n)).astype(np.uint64)) for n in r.integers(5, 400, 400)]
    seen, meets = {}, 0
    for k, s in enumerate(sets):
        for band in S.probed(plan, len(s), 80):
            if band.errors:
                for x in S.signatures(s, band).tolist():
                    meets += x in seen and seen[x] != k
                    seen.setdefault(x, k)
    assert meets < 20


def test_large_group_of_near_copies_stays_linear(spark):
    r = random.Random(1)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(400):
        w = list(base)
        w[r.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(w)))
    got = S.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and {x.component_id for x in got} == {0}


def test_hubs_are_split(spark, monkeypatch):
    from thalweg.llm import common

    monkeypatch.setattr(common, "HUB_ROWS", 4)
    texts = corpus(8, 200)
    base = "the one text that many others copy " * 3
    texts |= {1000 + k: base + " ".join(f"own{k}" for _ in range(k % 3)) for k in range(60)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(texts, 3, 90)


def test_very_long_texts(spark):
    r = random.Random(4)
    long = [f"word{r.randrange(5000)}" for _ in range(60_000)]
    near = list(long)
    for _ in range(600):
        near[r.randrange(len(near))] = "changed"
    texts = {1: " ".join(long), 2: " ".join(near), 3: " ".join(long[:40_000]), 4: "x" * 200_000, 5: "x" * 200_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in S.classes(df).collect()} == brute(texts, 3, 90)


def test_repeated_rows_null_ids_and_keep_one(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "p q r s t", "y"), (2, "a b c d", "z"), (3, "p q r s t", None), (None, "a b c d", "n"), (4, "", "e"), (5, "", "e")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sig string, _gone int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in S.classes(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 3, 1), (2, 2, 1), (3, 3, 1), (None, 2, None), (4, 0, 4), (5, 0, 5)], key=str)
    kept = S.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "1", "4", "5", "None", "2", "3"][:6])
    assert S.classes(df.limit(0)).count() == 0


def test_many_equal_texts_and_a_common_signature(spark, monkeypatch):
    """20,000 copies of one text, and 5,000 unlike texts that share half of their words, hot as a sample tells."""
    from thalweg.llm import setjoin as J

    monkeypatch.setattr(J, "SAMPLED", 16)
    monkeypatch.setattr(J, "HOT", 4)
    monkeypatch.setattr(J, "ACROSS_ROWS", 500)
    rng = random.Random(6)
    common = " ".join(f"c{i}" for i in range(30))
    own = {i: common + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(28)) for i in range(20_000, 25_000)}
    for k in range(20_000, 20_100, 2):  # some are alike
        own[k + 1] = own[k] + " end"
    rows = [(i, "the very same text with a few words more " + common) for i in range(20_000)] + list(own.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in J.classes(docs).collect()}
    assert all(got[i] == 0 for i in range(20_000))
    assert all(got[k] == (k - 1 if k % 2 and k < 20_100 else k) for k in own)


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Files of kept tables may be small where their rows are many, so no join may go by the files' size."""
    plans = {}

    def seen(df, name):
        found = str(df._jdf.queryExecution().executedPlan().toString())
        plans.setdefault(name, []).append(re.findall(r"BroadcastHashJoin .*?(Inner|LeftOuter)", found))
        return df

    keep = S.Scratch.keep
    monkeypatch.setattr(S.Scratch, "keep", lambda self, df, name: keep(self, seen(df, name), name))
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(30))
    texts = {i: common + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(28)) for i in range(40)}
    for k in range(0, 20, 2):
        texts[k + 1] = texts[k] + " end"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = seen(S.classes(docs), "classes").collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - 1 if k % 2 and k < 20 else k for k in texts}
    assert {"low", "split", "pairs", "held", "classes"} <= set(plans)
    assert not {name: p for name, p in plans.items() if any(p)}


def test_equal_rows_of_one_doc_id_meet_once(spark, monkeypatch):
    """Copies of a table, ids and all: neither sets nor the signatures' members across classes are there more than once."""
    kept = {}
    keep = S.Scratch.keep

    def seen(self, df, name):
        out = keep(self, df, name)
        kept.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(S.Scratch, "keep", seen)
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(30))
    texts = {i: common + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(28)) for i in range(40)}
    for k in range(0, 20, 2):
        texts[k + 1] = texts[k] + " end"
    want = {k: k - 1 if k % 2 and k < 20 else k for k in texts}

    def run(times):
        kept.clear()
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        for _ in range(times - 1):  # each copy in tasks of its own
            docs = docs.union(spark.createDataFrame(list(texts.items()), docs.schema))
        got = S.classes(docs).collect()
        assert len(got) == 40 * times and {r.doc_id: r.component_id for r in got} == want
        return {k: v for k, v in kept.items() if k in ("sets", "split", "held", "pairs")}

    assert run(6) == run(1)
