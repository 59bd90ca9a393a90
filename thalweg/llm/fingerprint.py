"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes cuts the UTF-8 text wherever it hits a trigger value whose
odds are 1 in the block size; each piece gives one of 64 letters. The block size doubles with the length
so that a signature has about SIZE letters, and every fingerprint also holds the signatures at two and four
times its block size, so that texts whose lengths differ several times can still be compared. Likeness
is 1 - edit distance / longer length over the signatures at the best common block size, 0 where no
GRAM letters in a row are shared or no block size is common.

Form: ``block:signature:signature at twice the block:at four times``. Null and empty texts: ``4:::``; such a pair is
equal (likeness 1). Equal texts have equal fingerprints.

Neighbours (for the edited texts) come from one exchange of the texts by ranges of doc_id; each range
gets a copy of the row beyond its end, and rows stream through a task in order. Rows without doc_id
sort last; ties, equal doc_ids, are ordered by text. Repeated rows: one result each, each the next one's
neighbour. Very long texts: whole. Empty table: empty result. Other columns, whatever their names: left out
by `digest`; `fingerprints` replaces a given column of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches

WINDOW = 7
LEAST_BLOCK = 4
SIZE = 64
GRAM = 4
#: Signatures in a fingerprint, each at twice the block size of the one before.
LEVELS = 3
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Stored bytes of one range of doc_ids, up to so many ranges; beyond, ranges grow to RANGE_BYTES_MOST, then in number again.
RANGE_BYTES = 4 << 20
RANGES_SMALL = 25_000
RANGE_BYTES_MOST = 128 << 20
#: Sampled keys a range that the cuts come from.
KEYS_A_RANGE = 50


def _mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit finalizer, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of the WINDOW bytes that end there (zeros before the start)."""
    n = len(data)
    acc = np.zeros(n, np.uint32)
    wide = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    power = 1
    for k in range(min(WINDOW, n)):
        acc[k:] += wide[: n - k] * np.uint32(power)
        power = power * 0x01000193 & 0xFFFFFFFF
    return _mix(acc)


BASE = 0x01000193
INVERSE = pow(BASE, -1, 1 << 32)
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**32; up to a million of them are kept for later texts."""
    if len(_kept.get(base, ())) <= n:
        made = np.full(max(n, 4096) + 1, base, np.uint32)
        made[0] = 1
        made = np.cumprod(made, dtype=np.uint32)
        if n > 1_000_000:
            return made[: n + 1]
        _kept[base] = made
    return _kept[base][: n + 1]


def _letters(sums: np.ndarray, ends: np.ndarray) -> str:
    """A letter for each piece of the bytes, from prefix sums: the polynomial of a piece does not depend on its place."""
    at = sums[ends]
    at[1:] -= sums[ends[:-1]]
    return LETTERS[_mix(at * _powers(BASE, int(ends[-1]))[ends]) >> np.uint32(26)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return str(LEAST_BLOCK) + ":" * LEVELS
    h = _rolling(data)
    block = LEAST_BLOCK
    while block * SIZE < n:
        block *= 2
    hits = _triggers(h, block)
    while len(hits) < SIZE // 2 - 1 and block > LEAST_BLOCK:  # too few letters tell too little
        block //= 2
        hits = _triggers(h, block)
    while len(hits) > 2 * SIZE - 3:
        block *= 2
        hits = hits[h[hits] & np.uint32(block - 1) == block - 1]
    ends = (hits if len(hits) and hits[-1] == n - 1 else np.append(hits, n - 1)) + 1
    sums = np.zeros(n + 1, np.uint32)
    np.cumsum((data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1) * _powers(INVERSE, n)[:n], dtype=np.uint32, out=sums[1:])
    out = [str(block)]
    for _ in range(LEVELS):
        out.append(_letters(sums, ends))
        block *= 2
        wide = h[ends - 1] & np.uint32(block - 1) == block - 1
        wide[-1] = True
        ends = ends[wide]
    return ":".join(out)


def _triggers(h: np.ndarray, block: int) -> np.ndarray:
    return np.flatnonzero(h & np.uint32(block - 1) == block - 1)


def _runs(s: bytes) -> bytes:
    """At most three of one letter in a row: longer runs tell nothing more."""
    if len(s) < 4:
        return s
    a = np.frombuffer(s, np.uint8)
    same = np.zeros(len(a), bool)
    same[3:] = (a[3:] == a[2:-1]) & (a[2:-1] == a[1:-2]) & (a[1:-2] == a[:-3])
    return a[~same].tobytes()


def _gram_shared(a: bytes, b: bytes) -> bool:
    k = min(GRAM, len(a), len(b))
    if not k:
        return len(a) == len(b)
    grams = {a[i:i + k] for i in range(len(a) - k + 1)}
    return any(b[i:i + k] in grams for i in range(len(b) - k + 1))


def distance(a: bytes, b: bytes) -> int:
    """Edit distance with bit-parallel columns (one bit for each letter of the shorter string)."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    peq: dict[int, int] = {}
    for i, x in enumerate(a):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    for x in b:
        eq = peq.get(x, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right = down | ~(diag | up) & full
        left = up & diag
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1 | 1) & full
        up = (left << 1) & full | ~(diag | right) & full
        down = right & diag
    return score


def likeness(one: str, two: str) -> float:
    """0 to 1; 1 exactly for equal fingerprints."""
    if one == two:
        return 1.0
    (b1, *s1), (b2, *s2) = (x.split(":") for x in (one, two))
    there = {int(b1) << k: x for k, x in enumerate(s1)}
    pairs = [(there[b], y) for k, y in enumerate(s2) if (b := int(b2) << k) in there]
    best = 0.0
    for p, q in pairs:
        a, b = _runs(p.encode()), _runs(q.encode())
        if a and b and _gram_shared(a, b):
            best = max(best, 1 - distance(a, b) / max(len(a), len(b)))
    return min(best, 0.999)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
        ("near_next", pa.float64())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range and falling doc_id; each is given out when the next one is seen."""
    held = None
    rows: list[tuple] = []

    def give() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)
        rows.clear()
        return out

    for batch in batches:
        cols = [batch.column(i) for i in range(4)]
        for i in range(batch.num_rows):
            part, key, text, guest = (c[i].as_py() for c in cols)
            if guest and held is None:  # another row with the key of the guest that was taken
                continue
            text = text or ""
            print_ = fingerprint(text)
            if held and held[0] == part:
                _, k, t, f = held
                e = edited(t, text)
                g = f if e == t else fingerprint(e)
                rows.append(
                    (k, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f, g, likeness(f, g),
                        likeness(f, print_)))
            held = None if guest else (part, key, text, print_)
            if len(rows) >= 500:
                yield give()
    if rows:
        yield give()


def _stored_bytes(docs: DataFrame) -> int:
    """Size of the tables behind the plan by their statistics, which need no scan; by the texts where these say nothing."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size < 1 << 56:
        return size
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def _cuts(keys: DataFrame, ranges: int) -> list[int]:
    """Keys that divide the rows into about equal ranges, from a sample of KEYS_A_RANGE keys a range (an array of numbers).

    The sample decides where rows are worked on, not what comes out.
    """
    n = keys.count()
    if ranges < 2 or not n:
        return []
    some = np.sort(keys.sample(min(1.0, KEYS_A_RANGE * ranges / n), seed=1).toArrow().column(0).to_numpy())
    return np.unique(some[len(some) * np.arange(1, ranges) // ranges]).tolist() if len(some) else []


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (part, key, text, guest) in falling order of doc_id within a part.

    The row after a part's last goes to that part too, as its guest. Texts are read and exchanged once; what
    the driver sees are a few keys for each range, whose number follows the table's size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("o", F.coalesce("key", F.lit(-(1 << 63)).cast("long")))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = _stored_bytes(docs)
    ranges = max(least, min(RANGES_SMALL, -(-stored // RANGE_BYTES)), -(-stored // RANGE_BYTES_MOST))
    cuts = np.array(_cuts(rows.select("o"), ranges), np.int64)

    @F.pandas_udf("int")
    def part_of(o):
        return o.map(dict(zip(o.unique(), np.searchsorted(cuts, o.unique()).tolist(), strict=True))).astype(
            "int32") if len(o) else o.astype("int32")

    tops = {r["part"]: r["o"] for r in rows.select("o", part_of("o").alias("part")).groupBy("part").agg(
        F.max("o").alias("o")).collect()}  # one for each range
    order = sorted(tops, reverse=True)
    taker = {here: order[k - 1] for k, here in enumerate(order)}  # the part before, in falling order; the last takes the first's

    @F.pandas_udf("array<int>")
    def parts_of(o):
        parts = np.searchsorted(cuts, o.to_numpy(np.int64)).tolist()
        return o.__class__([[p, taker[p]] if tops[p] == x else [p] for p, x in zip(parts, o.tolist(), strict=True)], dtype=object)

    both = rows.select(F.posexplode(parts_of("o")).alias("copy", "part"), "key", "text", "o").withColumn("guest", F.col("copy") == 1)
    return both.repartitionById(ranges, F.col("part")).sortWithinPartitions(
        "part", "guest", F.desc("o"), F.xxhash64("text"), "text").select("part", "key", "text", "guest")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: fingerprints of every text and of its edited text, and their likeness."""
    limit_batches(docs.sparkSession)
    return with_following(docs).mapInArrow(
        _stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The given rows with a `fingerprint` column."""
    @F.pandas_udf("string")
    def made(t):
        return t.map(fingerprint, na_action=None)

    limit_batches(docs.sparkSession)
    return docs.withColumn("fingerprint", made(F.coalesce(F.col(text), F.lit(""))))
