"""Quality rules as a ledger of failure bits (DataFrame functions only).

Every rule is evaluated once for each document. The ledger holds the measurements and one bit for each
rule that failed; versioned policies are masks over those bits, so that changing a policy or asking what
a rule costs needs bitwise aggregation over the ledger and no second look at the texts.

Defined results. Null text: no words, all measurements 0, the bit of FEW_WORDS. Empty text: the same.
Repeated rows and ties: one ledger row each. Very long texts: whole. Empty table: empty ledger. Other columns are left alone (`ledger`
returns the given columns and adds `ql_*`; a given column of such a name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
REPEAT_SHARE = 20
WINDOW = 5
#: Rule names by bit. Bits are never reused, so that old ledgers stay readable.
RULES = ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "odd_word_length")
#: (policy, version) -> names of the rules that reject.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("standard", 1): ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "odd_word_length"),
}


def mask(policy: str, version: int) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy, version])


def _repeat_words(w: Column) -> Column:
    """Words inside a WINDOW-word run that occurs twice or more, each counted once."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashes,
        lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))), 1,
            F.size(h) - (WINDOW - 1)))

    def starts(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twin = lambda s, j, e: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        return let(pairs,
            lambda s: F.array_sort(
                F.array_remove(F.transform(
                        s, lambda e, j: F.when(twin(s, j - 1, e) | twin(s, j + 1, e), e["i"]).otherwise(F.lit(-1))),
                    -1)))

    covered = lambda h: let(
        starts(h), lambda p: F.aggregate(
            F.transform(p, lambda x,
                j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))).cast("long")),
            F.lit(0).cast("long"), lambda a, x: a + x))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(some)


def measure(text: Column) -> Column:
    """All measurements of a text as one struct, each word array built once."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")

    def of_words(w: Column) -> Column:
        return let(lines, lambda ls: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(body, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        ))

    return let(words(text), of_words)


def failures(measures: Column) -> Column:
    """Failure bits of a struct of measurements, which is evaluated once."""
    return let(measures, _bits)


def _bits(m: Column) -> Column:
    n = m["n_words"]
    tests = {
        "few_words": n < MIN_WORDS,
        "repeated_windows": 100 * m["n_repeat_words"] > REPEAT_SHARE * n,
        "many_symbols": 10 * m["n_symbols"] > n,
        "repeated_lines": (m["n_dup_lines"] >= 2) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]),
        "odd_word_length": (m["word_chars"] < 2 * n) | (m["word_chars"] > 20 * n),
    }
    bits = F.lit(0).cast("long")
    for k, name in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(tests[name], F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The given rows with `ql_measures` (struct) and `ql_failed` (bits)."""
    return docs.withColumn("ql_measures", measure(F.col(text))).withColumn("ql_failed", failures(F.col("ql_measures")))


def passes(bits: Column, policy: str = "standard", version: int = 1) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy, version))) == 0


def ablations(book: DataFrame, policy: str = "standard", version: int = 1) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that are kept without it.

    One partial aggregate over the ledger, whatever the number of rules; the result has one row a rule.
    """
    m = mask(policy, version)
    used = [r for r in RULES if m >> RULES.index(r) & 1]
    bits = F.col("ql_failed").bitwiseAND(F.lit(m))
    counts = [F.count_if(bits == 0).alias("kept")]
    for r in used:
        one = 1 << RULES.index(r)
        counts += [F.count_if(bits.bitwiseAND(F.lit(one)) != 0).alias(f"f_{r}"), F.count_if(bits == one).alias(f"o_{r}")]
    wide = book.agg(*counts)
    rows = [F.struct(
        F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"),
        (F.col("kept") + F.col(f"o_{r}")).alias("n_kept_without")) for r in used]
    return wide.select(F.inline(F.array(*rows)))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    m = F.col("ql_measures")
    base = m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", *(c.alias(n) for c, n in zip(base, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), strict=True)),
        (~passes(F.col("ql_failed"), "base", 1)).alias("base_failed"), passes(F.col("ql_failed")).alias("kept"),
            F.col("ql_failed").alias("failed_bits"),
    )


def keep(docs: DataFrame, policy: str = "standard", version: int = 1) -> DataFrame:
    """The rows that pass a policy, with their own columns."""
    return docs.filter(passes(failures(measure(F.col("text"))), policy, version))


#: The query as DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT k, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
win AS (SELECT k, i, array_to_string(ws[i:i+4], ' ') AS g FROM pos),
twice AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
gaps AS (SELECT k, least(5, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 5)) AS c FROM twice),
rep AS (SELECT k, sum(c) AS n FROM gaps GROUP BY k),
ln AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN ln USING (k) LEFT JOIN rep USING (k)),
f AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
"""
