"""N-gram Jaccard join by partitions of the token universe, and the classes of documents it links.

A document is the set of its distinct word shingles, as 64-bit hashes. Sets are handled in size bands.
For a band with sizes up to U, a pair whose smaller set lies in it differs in at most H tokens, so the
universe is hashed into m segments with room for more than H errors, and every pair that is similar
enough agrees on some segment, or on one but for a single deleted token. Each segment is allotted nothing,
its exact subset, or its subset with all one-deletion neighbours:

* per band, the number y of segments with neighbourhoods (room for two errors each) and the slack k are
  chosen by the cost of signatures and of expected chance collisions among the table's rows;
* per set, k exact segments are passed over: the lightest ones, which collide most. Both sets of a pair
  rank agreeing segments alike, so of the k + 1 or more that agree one is always kept.

Signatures meet by sorting; a signature's members are linked to its first one as candidates, never to each
other. Candidates are tried in rounds: each document with its first partner, then with the first of each
of its signatures, then, where a signature's members still lie in different classes, all across those
classes. A sketch of token parities first removes pairs that differ too much (it never removes a pair
within H), and the rest are verified on the whole sets. Members of one class need no further trial.

Results. Null, empty or blank text: an empty set, n_shingles 0, linked with nothing. Rows that share a
doc_id are one node (linked through any of their texts), each with its own n_shingles. Null doc_id: the
row's own size, no component. Empty table: empty. Ties: the smallest doc_id names a class. Very long texts:
whole, their bands have few segments passed over. Other columns: left out by `classes`, left alone by
`keep_one`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HUBS_MOST, Scratch, Spread, limit_batches, unused

WORDS = 3
PERCENT = 90
SKETCH = 16  # 64-bit words of parities
PAIR_COST = 20.0  # a candidate pair's cost in signatures
#: One in so many documents tells which signatures are hot: those that HOT of them share.
SAMPLED = 1024
HOT = 32
#: Rows of one signature that one task tries with all others of it.
ACROSS_ROWS = 4096
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles (of its whole sequence if it has fewer words)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only; the six ASCII white-space bytes
    if not w:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), U64, len(w))
    k = min(words, len(w))
    acc = np.full(len(w) - k + 1, k, U64)
    for i in range(k):
        acc = _mix(acc * U64(0x9E3779B97F4A7C15) + h[i:len(w) - k + 1 + i])
    return np.unique(acc)


@dataclass(frozen=True)
class Band:
    number: int
    least: int
    most: int
    errors: int  # H
    deletions: int  # y: segments with one-deletion neighbourhoods, the first ones
    slack: int  # k

    @property
    def segments(self) -> int:
        return self.errors + 1 + self.slack - self.deletions


def _excess(mean: float, k: int) -> float:
    """Expected number of empty segments beyond the k that are passed over (Poisson, normal from 30 on)."""
    if mean > 30:
        d = (k - mean) / mean**0.5
        return mean**0.5 * (math.exp(-d * d / 2) / math.sqrt(2 * math.pi) - d * math.erfc(d / math.sqrt(2)) / 2)
    p, total = math.exp(-mean), mean - k
    for z in range(min(k, 200)):  # E[max(0, Z - k)] = mean - k + sum over z < k of (k - z) P(z)
        total += (k - z) * p
        p *= mean / (z + 1)
    return max(0.0, total)


@lru_cache(maxsize=8)
def bands(percent: int, rows: int, upto: int = 1 << 31) -> tuple[Band, ...]:
    """Size bands with their allocation, for a table of so many rows."""
    out, least = [], 1
    while least <= upto:
        most = max(least, least * 100 // percent)
        errors = most * (100 - percent) // percent
        best = None
        n, near = (least + most) / 2, max(2.0, rows / 16)
        slacks = [0, 1, 2, 3, 4, 6, 8, 12, 16, 24] + [errors // d for d in (20, 12, 8, 6, 5, 4, 3)]
        for y in range(errors // 2 + 2) if most <= 400 else (0,):
            for k in {s for s in slacks if s <= errors + 1}:
                x = errors + 1 + k - 2 * y
                if x < 0 or (x == 0 and k) or x < k:
                    continue
                m = x + y
                light = _excess(x * math.exp(-least / m), k) if x else 0.0
                # segments with neighbourhoods collide by chance when they hold at most one token
                thin = y * math.exp(-least / m) * (1 + least / m)
                cost = (x - k) + y * (1 + n / m) + PAIR_COST * near * (light**2 / max(1, x) + thin**2 / max(1, y)) / 2
                if best is None or cost < best[0]:
                    best = cost, y, k
        out.append(Band(len(out), least, most, errors, best[1], best[2]))
        least = most + 1
    return tuple(out)


def probed(plan: tuple[Band, ...], n: int, percent: int) -> list[Band]:
    """The set's own band and the lower ones that hold sizes similar enough."""
    low = -(-percent * n // 100)
    lo, hi = 0, len(plan) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if plan[mid].most >= low else (mid + 1, hi)
    out = []
    while lo < len(plan) and plan[lo].least <= n:
        out.append(plan[lo])
        lo += 1
    return out


def signatures(tokens: np.ndarray, band: Band) -> np.ndarray:
    """Signatures of a set in one band."""
    m, y = band.segments, band.deletions
    seed = U64((band.number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    deal = _mix(tokens ^ seed)
    seg = ((deal >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
    size = np.bincount(seg, minlength=m)
    order = np.argsort(seg, kind="stable")
    filled = np.flatnonzero(size)
    total = np.zeros(m, U64)
    starts = np.cumsum(size) - size
    total[filled] = np.bitwise_xor.reduceat(deal[order], starts[filled])
    name = lambda s, c: _mix(seed + s.astype(U64) * U64(0xD6E8FEB86659FD93) + c.astype(U64) * U64(0xA0761D6478BD642F))
    exact = np.arange(y, m)
    if band.slack:
        exact = exact[np.argsort(size[y:] * m + exact, kind="stable")[band.slack:]]
    parts = [_mix(total[exact] ^ name(exact, size[exact]))]
    if y:
        some = np.arange(y)
        parts.append(_mix(total[:y] ^ name(some, size[:y])))
        upto = order[: starts[y] if y < m else len(order)]
        parts.append(_mix(total[seg[upto]] ^ deal[upto] ^ name(seg[upto], size[seg[upto]] - 1)))
    return np.concatenate(parts)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the token counts in 64 * SKETCH cells."""
    cell = (_mix(tokens ^ U64(0x5851F42D4C957F2D)) >> U64(32)) * U64(64 * SKETCH) >> U64(32)
    odd = np.bincount(cell.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signature_rows(docs: DataFrame, words: int, percent: int, rows: int) -> DataFrame:
    """(sig, doc, n): one row with n for each document, under a signature of its whole set, and its others.

    A task gives signatures only for the first document of each set that it meets. A copy of that set is linked to it
    then and there: its row has that document as sig and -n, so copies don't meet at a signature however many they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = bands(percent, rows)
        seen: dict[bytes, int] = {}
        for b in batches:
            sigs, owners, whole, ids, sizes = [], [], [], [], []

            def give() -> pa.RecordBatch:
                sig = np.concatenate([_signed(np.array(whole, U64)), *map(_signed, sigs)])
                doc = pa.concat_arrays(
                    [pa.array(ids, pa.int64()),
                        pa.array(np.repeat([d for d, _ in owners], [c for _, c in owners]) if owners else [],
                            pa.int64())])
                n = pa.concat_arrays([pa.array(sizes, pa.int32()), pa.nulls(len(sig) - len(sizes), pa.int32())])
                for x in (sigs, owners, whole, ids, sizes):
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array(sig), doc, n], names=["sig", "doc", "n"])

            count = 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = shingles(text.as_py(), words)
                n = len(t)
                ids.append(key)
                mark = xxhash.xxh3_128_digest(t.tobytes())
                copy = n and key is not None and mark in seen
                sizes.append(-n if copy else n)
                whole.append(seen[mark] & 0xFFFFFFFFFFFFFFFF if copy else int.from_bytes(mark[:8], "little") if n else xxhash.xxh3_64_intdigest(repr(key)))
                if n and key is not None and not copy:
                    seen[mark] = key
                    for band in probed(plan, n, percent):
                        if band.errors:
                            s = signatures(t, band)
                            sigs.append(s)
                            owners.append((key, len(s)))
                            count += len(s)
                if count > 200_000:
                    yield give()
                    count = 0
            if ids:
                yield give()

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "sig long, doc long, n int")


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """(doc, n, cells, tokens) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, sets), pa.int32()),
                        pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                        pa.array([_signed(s) for s in sets], pa.list_(pa.int64()))],
                    names=["doc", "n", "cells", "tokens"])

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc long, n int, cells array<bigint>, tokens array<bigint>")


def maybe_similar(percent: int):
    """Condition on n_a, n_b, cells_a and cells_b that every similar pair meets.

    |A ^ B| <= (|A| + |B|) (1 - t) / (1 + t), and the parities of A and B differ in no more cells than that.
    """
    na, nb = F.col("n_a").cast("long"), F.col("n_b").cast("long")
    apart = sum((F.bit_count(F.get("cells_a", F.lit(i)).bitwiseXOR(F.get("cells_b", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def side(sets: DataFrame, x: str, *cols: str) -> DataFrame:
    return sets.select(F.col("doc").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))


def sketched(pairs: DataFrame, spread: Spread, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that their sketches don't rule out; spread deals the pairs of one b."""
    both = spread.meet(pairs.join(side(sets, "a", "n", "cells").hint("merge"), "a"), side(sets, "b", "n", "cells"))
    return both.filter(maybe_similar(percent)).select("a", "b").distinct()


def verified(pairs: DataFrame, spread: Spread, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose whole sets are similar enough; sets as from `set_rows`."""
    na, nb = F.col("n_a").cast("long"), F.col("n_b").cast("long")
    both = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    met = spread.meet(pairs.join(side(sets, "a", "n", "tokens").hint("merge"), "a"), side(sets, "b", "n", "tokens")).withColumn("both", both)
    return met.filter((F.col("both") > 0) & (100 * F.col("both") >= percent * (na + nb - F.col("both")))).select("a", "b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, comp): for each node of (a, b) edges the smallest node it can reach.

    Every round takes the smallest label around a node and then the label of that label; tables between
    rounds are written, so lost executors cost at most a round.
    """
    both = scratch.keep(edges.union(edges.select("b", "a")).toDF("doc", "other").distinct(), "edges")
    cur = scratch.keep(both.groupBy("doc").agg(F.least(F.col("doc"), F.min("other")).alias("comp")), "labels")
    spread = Spread(both, "other", "doc")
    while True:
        around = spread.meet(both, cur.select(F.col("doc").alias("other"), "comp")).groupBy("doc").agg(F.min("comp").alias("near"))
        low = scratch.keep(cur.join(around.hint("merge"), "doc").select("doc", "comp", F.least("comp", "near").alias("low")), "low")
        upper = cur.select(F.col("doc").alias("low"), F.col("comp").alias("top"))
        met = Spread(low, "low", "doc").meet(low, upper, "left")  # all members of a class may carry one label
        new = scratch.keep(met.select("doc", F.least("low", "top").alias("comp"), (F.least("low", "top") < F.col("comp")).alias("moved")), "labels")
        scratch.drop(cur)
        scratch.drop(low)
        moved = bool(new.filter("moved").limit(1).count())
        cur = new.drop("moved")
        if not moved:
            return cur


def _hot(docs: DataFrame, words: int, percent: int, rows: int) -> list[int]:
    """Signatures that very many sets share, by 1 in SAMPLED documents: no more than HUBS_MOST."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SAMPLED)) == 0)
    counts = signature_rows(some, words, percent, rows).filter("n IS NULL OR n > 0").groupBy("sig").agg(F.count("*").alias("c")).filter(F.col("c") >= HOT)
    found = counts.orderBy(F.desc("c"), "sig").limit(HUBS_MOST).collect()
    return [r["sig"] for r in found]


def _first_and_last(by_sig: DataFrame, docs: DataFrame, words: int, percent: int, rows: int, scratch: Scratch) -> DataFrame:
    """Signature rows with the first and last document of the signature: those shared by several, and each document's own.

    A signature's rows meet in a window. Those that a sample shows to be very many are summed up by partial aggregates
    instead and get the result back by broadcast; the sample decides how rows meet, not which.
    """
    real = F.when(F.col("n").isNull() | (F.col("n") >= 0), F.col("doc"))
    w = Window.partitionBy("sig")
    hot = _hot(docs, words, percent, rows) if rows > SAMPLED * HOT else []
    rest = by_sig
    if hot:
        table = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in hot], "hot long"))
        at = F.col("sig") == F.col("hot")
        rest = by_sig.join(table, at, "left_anti")
        theirs = scratch.keep(by_sig.join(table, at, "left_semi"), "hot")
        ends = theirs.groupBy(F.col("sig").alias("_s")).agg(F.min(real).alias("first"), F.max(real).alias("last"))
        theirs = theirs.join(F.broadcast(ends), F.col("sig") == F.col("_s")).drop("_s")
    met = rest.withColumn("first", F.min(real).over(w)).withColumn("last", F.max(real).over(w))
    met = met.unionByName(theirs) if hot else met
    return met.filter((F.col("first") < F.col("last")) | F.col("n").isNotNull())


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Kept tables compress so well that Spark, going by the size of their files, would send millions of their rows through the
    driver. So joins with signatures, classes and sketches are told to merge; lists of documents alone may be broadcast.
    Equal rows of one doc_id are one in what pairs are joined with, else n such rows on each side would give n * n.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    rows = docs.count()
    by_sig = signature_rows(docs, words, percent, 1 << max(4, rows.bit_length()))
    met = scratch.keep(_first_and_last(by_sig, docs, words, percent, rows, scratch), "signatures")
    info = met.filter("n IS NOT NULL").select("doc", F.abs("n").alias("n"))
    copies = met.filter("n < 0").select(F.col("doc").alias("a"), F.col("sig").alias("b")).filter("a <> b")
    shared = met.filter("first < last AND doc IS NOT NULL AND (n IS NULL OR n > 0)").select("sig", "doc", "first")
    some = shared.select("doc").distinct()
    sets = scratch.keep(set_rows(docs.join(some.withColumnRenamed("doc", "_doc"), F.col("doc_id") == F.col("_doc"), "left_semi").distinct(), words), "sets")

    first = shared.filter("doc <> first").groupBy("doc").agg(F.min("first").alias("b")).select(F.col("doc").alias("a"), "b")

    def tried(pairs: DataFrame) -> DataFrame:
        pairs = scratch.keep(pairs, "pairs")
        spread = Spread(pairs, "b", "a")
        return scratch.keep(verified(sketched(pairs, spread, sets, percent), spread, sets, percent), "links")

    links = tried(first).union(copies)
    comps = components(links, scratch)

    def with_class(members: DataFrame) -> DataFrame:
        return members.join(comps.withColumnRenamed("doc", "_d").hint("merge"), F.col("doc") == F.col("_d"), "left").withColumn(
            "comp", F.coalesce("comp", "doc")).drop("_d")

    for across in (False, True):
        labelled = with_class(shared)
        split = labelled.groupBy("sig").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("doc").alias("one")).filter("low < high")
        left = scratch.keep(labelled.drop("first").join(split.hint("merge"), "sig").select("sig", "doc", "comp", "low", "one").distinct(), "split")
        if not left.limit(1).count():
            break
        if across:
            # A class's members need no trial with each other: those outside a signature's lowest class meet all other classes.
            # The sketches are part of the join's condition: what it gives are pairs that are almost certainly similar.
            known = sets.select(F.col("doc").alias("_d"), "n", "cells")
            held = scratch.keep(left.join(known.hint("merge"), F.col("doc") == F.col("_d")).select("sig", "doc", "comp", "low", "n", "cells"), "held")
            out = scratch.keep(held.filter("comp > low").select(
                "sig", F.col("doc").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("n_a"), F.col("cells").alias("cells_a")), "out")
            other = held.select(
                "sig", F.col("doc").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("n_b"), F.col("cells").alias("cells_b"))
            # What one signature has many of is dealt in blocks, each to a task with the signature's members.
            blocks = Spread(out, "sig", "a", ACROSS_ROWS)
            pairs = blocks.meet(out, other).filter((F.col("ca") > F.col("cb")) & maybe_similar(percent)).select("a", "b").distinct()
            pairs = scratch.keep(pairs, "pairs")
            found = scratch.keep(verified(pairs, Spread(pairs, "b", "a"), sets, percent), "links")
        else:
            firsts = left.groupBy("sig", "comp").agg(F.min("doc").alias("a"))  # one of each class
            found = tried(
                firsts.join(split.select("sig", F.col("low"), "one").hint("merge"), "sig").filter("comp > low AND a <> one").select(
                    "a", F.col("one").alias("b")).distinct())
        if found.limit(1).count():
            links = links.union(found)
            comps = components(links, scratch)
    c = comps.select(F.col("doc").alias("_d"), "comp")
    return info.join(c.hint("merge"), F.col("doc") == F.col("_d"), "left").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("comp", "doc").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows with one of each class left, that with the smallest doc_id; rows without doc_id stay."""
    found = classes(docs.select("doc_id", "text"), words, percent)
    gone = unused(docs, "_gone")
    drop = found.filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(drop, F.col("doc_id") == F.col(gone), "left_anti")
