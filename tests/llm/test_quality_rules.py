import re

from thalweg.llm import quality_rules as Q

TEXTS = [None, "", " \n\t ", "one two three", "a b c d e a b c d e f g", "x " * 40, "# $ % & | word\n\nline\nline\nline", "é\x0bü\x0cß\r\n" * 6, "a b c d e f g h i j k l m n o p", "w%d " * 3]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_measurements_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])], "doc_id long, text string")
    rows = Q.digest(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_policies_and_ablations(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    book = Q.ledger(df)
    bits = [r.ql_failed for r in book.collect()]
    m = Q.mask("standard", 1)
    got = {r.rule: r for r in Q.ablations(book).collect()}
    for k, rule in enumerate(Q.RULES):
        assert got[rule].n_failed == sum(bool(b & m & 1 << k) for b in bits)
        assert got[rule].n_kept_without == sum(not b & m & ~(1 << k) for b in bits)


def test_keep_and_empty(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", 5)], "doc_id long, text string, ql_failed int")
    assert [tuple(r)[2] for r in Q.keep(df).collect()] == [5]
    assert Q.digest(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"word{k % 9000}" for k in range(30_000)) + "\n" + "x" * 300_000
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    r = Q.digest(df).first()
    w = long.split()
    assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), 30_000)
