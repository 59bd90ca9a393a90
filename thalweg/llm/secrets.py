"""Secret scan with multipart credential linking (DataFrame functions only).

Three base kinds are always reported. Weak parts (an account name, a short password, an endpoint) are
reported only when complementary parts lie within SCOPE code points of them: an interval join inside the
text. It runs over the text's own parts sorted by position with running extremes from both sides, so a
text with many parts costs a sort, never all pairs, and no row leaves its partition.

Positions are code points from 0, ends exclusive. Null or empty text: no spans. Repeated rows: each gets
its own result. Empty table: empty result. Ties: parts at one position are ordered by kind as listed. Very
long texts: whole, each value to its end. Other columns, whatever their names: left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scan

SCOPE = 200
MARK = "[SECRET]"
#: Kind -> (pattern, group that must have a least length or None, that length, part it plays).
#: Parts: access identifier, secret, endpoint. The first three kinds are the base.
KINDS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, "secret"),
    "access": (r"AKIA[A-Z0-9]{12,}", None, 0, "access"),
    "hex": (r"[0-9a-f]{32,}", None, 0, "secret"),
    "weak_id": (r"\b(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})",
            None, 0, "access"),
    "weak_secret": (r"\b(?i:pass|pwd|auth|credentials?|private_?key|key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=!@#$%^&*-]{6,})",
            None, 0, "secret"),
    "endpoint": (r"\b(?i:https?|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|redis|amqps?|mongodb|s3|ftp)://[A-Za-z0-9._~:@%/?&=+-]{3,}|\b(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}(?::[0-9]{1,5})?",
            None, 0, "endpoint"),
}
BASE = ("assign", "access", "hex")
NAMES = tuple(KINDS)
PART = {k: p for k, (_, _, _, p) in KINDS.items()}
SPAN = "array<struct<start:bigint,ord:int,end:bigint>>"


def find(text: Column, kind: str) -> Column:
    """Spans of one kind, leftmost and non-overlapping, in order."""
    pattern, group, least, _ = KINDS[kind]
    number = NAMES.index(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(h: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(h)), h, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        return let(scan(sizes, lambda a, b: a + b),
            lambda ends: F.zip_with(
                h, ends, lambda x, e: F.struct(
                (e - F.length(x)).alias("start"), F.lit(number).alias("ord"), e.alias("end"))))

    spans = let(hits, placed)
    if group:
        long_enough = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.length(g) >= least)
        spans = let(long_enough, lambda ok: F.filter(spans, lambda s, i: F.get(ok, i)))
    # Case inside a group would hide the pattern's literals from the quick test below, so it reads the same text.
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


ROLES = ("access", "secret", "endpoint", "base")
ROLE_SPAN = f"array<struct<{','.join(f'{r}:bigint' for r in ROLES)}>>"
FAR = 1 << 40


def _plays(s: Column, role: str) -> Column:
    return s["ord"] < len(BASE) if role == "base" else s["ord"].isin([NAMES.index(k) for k in NAMES if PART[k] == role])


def _nearest(parts: Column, field: str, missing: int, op) -> Column:
    """For each part and role: the running op of a field over the parts that play the role, without the part itself."""
    none = F.lit(missing).cast("long")
    seen = F.transform(parts, lambda s: F.struct(*(F.when(_plays(s, r), s[field]).otherwise(none).alias(r) for r in ROLES)))
    found = scan(seen, lambda a, b: F.struct(*(op(a[r], b[r]).alias(r) for r in ROLES)), ROLE_SPAN)
    return F.concat(F.array(F.struct(*(none.alias(r) for r in ROLES))), found)


def link(docs: DataFrame) -> DataFrame:
    """From `sec_base` and `sec_weak` adds `sec_all`: the base spans and those weak parts that have their complement in scope.

    A weak identifier needs a secret, a weak secret an identifier, and when every part is weak an
    endpoint as well; an endpoint needs both.
    """
    empty = F.array().cast(SPAN)
    parts = F.when(F.size("sec_weak") == 0, empty).otherwise(F.array_sort(F.concat("sec_base", "sec_weak")))
    out = docs.withColumn("sec_parts", parts)
    out = out.withColumn("sec_before", _nearest(F.col("sec_parts"), "end", -FAR, F.greatest))
    out = out.withColumn("sec_after", _nearest(F.reverse("sec_parts"), "start", FAR, F.least))
    out = out.withColumn("sec_after", F.slice(F.reverse("sec_after"), 2, F.size("sec_after")))
    zipped = F.arrays_zip(F.col("sec_parts").alias("p"), F.slice("sec_before", 1, F.size("sec_parts")).alias("b"), F.col("sec_after").alias("f"))

    def complete(x: Column) -> Column:
        near = {r: (x["p"]["start"] - x["b"][r] <= SCOPE) | (x["f"][r] - x["p"]["end"] <= SCOPE) for r in ROLES}
        backed = near["base"] | near["endpoint"]
        kind = lambda k: x["p"]["ord"] == NAMES.index(k)
        return (kind("weak_id") & near["secret"] & backed) | (kind("weak_secret") & near["access"] & backed) | (kind(
                "endpoint") & near["access"] & near["secret"])

    linked = F.transform(F.filter("sec_zip", complete), lambda x: x["p"])
    out = out.withColumn("sec_zip", zipped).withColumn("sec_all", F.array_sort(F.concat("sec_base", linked)))
    return out.drop("sec_zip", "sec_parts", "sec_before", "sec_after", "sec_weak")


def scan_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The given rows with `sec_base` and `sec_all`: arrays of spans sorted by start, then kind.

    Given columns of these two names are replaced, all others stay, whatever their names.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    out = out.withColumn("sec_base", F.array_sort(F.concat(*(find(t, k) for k in BASE))))
    out = link(out.withColumn("sec_weak", F.concat(*(find(t, k) for k in NAMES[len(BASE):]))))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("sec_base", "sec_all")), "sec_base", "sec_all")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(n) for n in NAMES))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(F.get(names, s["ord"]), F.lit(":"), s["start"], F.lit(":"), s["end"])))


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by MARK."""
    def body(s: Column) -> Column:
        return let(scan(F.transform(s, lambda x: x["end"]), F.greatest), lambda top: F.concat(
            F.concat_ws(
                "", F.transform(s, lambda x,
                    i: let(F.coalesce(F.get(top, i - 1), F.lit(0).cast("long")),
                            lambda at: F.when((i > 0) & (x["start"] < at), F.lit("")).otherwise(
                            F.concat(F.substring(text, (at + 1).cast("int"), (x["start"] - at).cast("int")),
                                    F.lit(MARK)))))),
            F.substring(text, (F.element_at(top, -1) + 1).cast("int"), F.length(text)),
        ))

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, body))


def redact(docs: DataFrame) -> DataFrame:
    """The given rows, secrets and linked parts masked in `text`; `n_chars`, where present, follows."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")  # own names can't clash
    out = scan_texts(row)
    hit = F.size("sec_all") > 0
    out = out.withColumn("fresh", F.when(hit, masked(F.col("text"), F.col("sec_all"))).otherwise(F.col("text")))
    fields = {"text": F.col("fresh")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(hit, F.length("fresh").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    found = scan_texts(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("sec_base", lambda s: s["ord"] == NAMES.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in BASE),
        F.sha2(written(F.col("sec_base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("sec_all")).alias("spans"))
