import hashlib
import random

from pyspark.sql import functions as F

from thalweg.llm import fingerprint as P


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_distance_equals_plain_edit_distance():
    r = random.Random(1)
    for _ in range(400):
        a, b = (bytes(r.choices(b"abcd", k=r.randint(0, 80))) for _ in range(2))
        assert P.distance(a, b) == plain_distance(a, b)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopé", k=r.randint(2, 9))) for _ in range(n))


def test_likeness_tells_edits_from_other_texts():
    for n in (60, 400, 5000):
        a, b = prose(1, n), prose(2, n)
        f = P.fingerprint(a)
        assert P.likeness(f, P.fingerprint(a)) == 1.0
        assert P.likeness(f, P.fingerprint(P.edited(a, b))) > 0.3
        assert P.likeness(f, P.fingerprint(b)) < 0.15
        assert P.likeness(f, P.fingerprint(a + " one more word")) > 0.8
        assert P.likeness(f, P.fingerprint(a[: len(a) // 2])) > 0.3


def test_query_follows_descending_ids(spark):
    texts = {9: prose(3, 50), 7: None, 4: "", 3: prose(4, 30), 1: "😀é" * 5, 0: "x" * 1000}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in P.digest(df).collect()}
    assert sorted(got) == sorted(texts)
    for i, k in enumerate(ids):
        t, nxt = texts[k] or "", texts[ids[(i + 1) % len(ids)]] or ""
        e = P.edited(t, nxt)
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == P.fingerprint(t) and r.edited_fingerprint == P.fingerprint(e)
        assert r.near_next == P.likeness(r.fingerprint, P.fingerprint(nxt)) and 0 <= r.near_edited <= 1


def test_many_rows_ties_and_null_ids(spark):
    rows = [(i, prose(i, 5)) for i in range(300)] + [(5, "tie"), (5, "tie"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = P.digest(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[299].near_next is not None and by[0].edited_sha256 == hashlib.sha256(P.edited(prose(0, 5), "no id").encode()).hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256(P.edited("no id", prose(299, 5)).encode()).hexdigest()


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert P.digest(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert P.digest(one.limit(0)).count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    a = prose(5, 200_000)
    rows = [(2, a, "x"), (1, a[:-100] + "changed" + a[-93:], "y"), (0, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").withColumn("guest", F.lit(1))
    got = {r.doc_id: r for r in P.digest(df).collect()}
    assert got[2].n_chars == len(a) and got[2].near_next > 0.9 and got[1].near_next == 0.0
    assert got[2].edited_sha256 == hashlib.sha256(P.edited(a, rows[1][1]).encode()).hexdigest()
    assert P.fingerprints(df).columns == ["doc_id", "text", "part", "guest", "fingerprint"]
