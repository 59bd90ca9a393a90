"""Phrase collocations: phrases of two and three words that hold together, scored in exact arithmetic.

Texts are lower-cased (A-Z), split into pieces at marks and line ends and into words at blanks and tabs.
Everything is per language. Counting goes level by level and is Apriori-safe: a phrase can only occur LEAST
times if its parts do, so pairs are looked at only where both words are frequent, and triples only where both
pairs are.

Frequent words get numbers from a minimal perfect hash (`Slots`) that every worker has, with the words stored
beside it for verification, so phrases travel as 64-bit keys: two word numbers, or a pair's number and a word's.
Where a level's phrases fit a table, the mappers count them by slot of its minimal perfect hash in one numpy
array each, and these arrays are summed as a tree. Larger levels are dealt by a hash of the key into shards,
and each shard is such a table of its own. Cuts of a phrase are read by slot, too.

Tables that every worker holds (frequent words, frequent pairs, one level's phrases) have at most TABLE_KEYS
keys, which is checked before they are gathered. Where there are more pairs, triples of frequent words are dealt to
shards by their first pair and get their pairs' counts by joins on the 64-bit keys. Where there are more words,
`joined` does the same by grouping and joining words; the results are the same.

Null or empty text: no words. Null language: `und`. Repeated rows: each counts. Ties in score and a: by the
phrase's bytes. Very long texts and words: whole. Empty table: empty. Other columns: unused.
"""

from __future__ import annotations

import decimal
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, limit_batches

LEAST = 10
TOP = 2000
#: A candidate goes if a longer one has at least this share of its occurrences, in hundredths.
WITHIN = 50
SCALE = 1_000_000
NO_LANG = "und"
#: Most keys of a table that every worker holds: at most 16 bytes a key, or a word and its count.
TABLE_KEYS = 1 << 22
#: Shards of a large level: as many as make TABLE_KEYS each, and up to SHARDS_LEAST of SHARD_LEAST each.
SHARDS_LEAST = 256
SHARD_LEAST = 1 << 18
#: Entries that a mapper gathers before it gives them out.
HELD = 1 << 20
#: Slots in a block of a count array, and arrays that one task sums.
BLOCK = 1 << 14
FAN = 64

BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(ord(".") if b in BREAKS else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))


def tokens(text: str) -> list[bytes]:
    """The text's words, with `.` (which no word holds) wherever a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b".", b" . ").split()


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slots:
    """A minimal perfect hash: each of n distinct 64-bit keys has a slot of its own from 0 to n - 1.

    Levels of bits: a key that is alone at its place of a level owns that bit, the others go on to the next.
    The slot is the rank of the key's bit, by a directory of popcounts. The keys are stored by slot, so that
    `find` tells keys that aren't there: -1.
    """

    def __init__(self, keys: np.ndarray):
        rest, bits, self.levels, base = keys.astype(np.uint64), [], [], 0
        while len(rest):
            m = -(-2 * len(rest) // 64) * 64
            at = (_mix(rest, len(self.levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self.levels.append((base, m))
            base += m
            rest = rest[~alone[at]]
        self.words = np.concatenate(bits) if bits else np.zeros(0, np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self.slot(keys.astype(np.uint64))] = keys

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys that the hash was made for; any slot or -1 for others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (base, m) in enumerate(self.levels):
            at = base + (_mix(keys[left], k) % np.uint64(m)).astype(np.int64)
            word, place = self.words[at >> 6], (at & 63).astype(np.uint64)
            owned = (word >> place & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << place) - np.uint64(1)))
            out[left[owned]] = (self.ranks[at >> 6] + below)[owned]
            left = left[~owned]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 for keys that aren't stored."""
        keys = keys.astype(np.uint64)
        out = self.slot(keys)
        if len(self.keys):
            out[self.keys[out] != keys] = -1
        return out


class Words:
    """Frequent words of all languages by slot: the stored words, their language and count."""

    def __init__(self, t: pa.Table, total: dict[str, int]):
        langs, words = t["lang"].to_pylist(), t["word"].to_pylist()
        marks = np.array([self.mark(a, b.encode("utf-8", "surrogatepass")) for a, b in zip(langs, words)], np.uint64)
        if len(np.unique(marks)) < len(marks):
            raise ValueError("two words have one 64-bit hash")
        self.slots = Slots(marks)
        by = np.argsort(self.slots.slot(marks))
        self.langs, self.words = pa.array(langs, pa.string()).take(pa.array(by)), pa.array(words, pa.string()).take(pa.array(by))
        self.counts = t["a"].to_numpy()[by].astype(np.int64)
        self.total = total

    @staticmethod
    def mark(lang: str, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\t" + word)

    def find(self, lang: str, words: list[bytes]) -> np.ndarray:
        out = self.slots.find(np.array([self.mark(lang, w) for w in words], np.uint64))
        some = np.flatnonzero(out >= 0)
        at = pa.array(out[some])
        asked = pa.array([words[i] for i in some], pa.binary())
        same = pc.and_(pc.equal(self.words.take(at).cast(pa.binary()), asked), pc.equal(self.langs.take(at), lang))
        out[some[~same.to_numpy(zero_copy_only=False)]] = -1
        return out


class Counted:
    """Frequent pairs by slot, with their counts."""

    def __init__(self, t: pa.Table):
        keys = t["key"].to_numpy().astype(np.uint64)
        self.slots = Slots(keys)
        self.counts = np.zeros(len(keys), np.int64)
        self.counts[self.slots.slot(keys)] = t["a"].to_numpy()


def _counted_words(docs: DataFrame) -> DataFrame:
    """lang, word, a: words by mapper, a mapper's counts being given out whenever HELD words are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def give() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                c.pop(b".", None)
                all_words, counts, size, at = list(c), list(c.values()), 0, 0
                for k, w in enumerate(all_words):
                    size += len(w)
                    if size > 4 << 20 or k - at >= 50_000 or k == len(c) - 1:
                        part = pa.array(all_words[at:k + 1], pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * (k + 1 - at), pa.string()), part, pa.array(counts[at:k + 1], pa.int64())], names=["lang", "word", "a"])
                        size, at = 0, k + 1
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                held[lang].update(tokens(text.as_py()))
            if sum(map(len, held.values())) > HELD:
                yield from give()
        yield from give()

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def _numbered(docs: DataFrame, shared) -> DataFrame:
    """ids (32-bit word numbers as bytes) and pairs (neighbours that both have a number), a row for each batch.

    -1 stands for words that aren't frequent and for ends of pieces and texts: no phrase crosses it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value, defaultdict(dict)
        for b in batches:
            langs = b.column(0).to_pylist()
            texts = [tokens(t.as_py()) for t in b.column(1)]
            fresh = defaultdict(set)
            for lang, ws in zip(langs, texts):
                fresh[lang].update(ws)
            for lang, ws in fresh.items():
                if len(known[lang]) > HELD:
                    known[lang] = {}
                new = [w for w in ws if w not in known[lang]]
                known[lang].update(zip(new, words.find(lang, new).tolist()))
                known[lang][b"."] = -1
            parts = []
            for lang, ws in zip(langs, texts):
                parts += [np.fromiter(map(known[lang].__getitem__, ws), np.int32, len(ws)), np.array([-1], np.int32)]
            x = np.concatenate(parts)
            x = x[np.concatenate([[True], (x[1:] >= 0) | (x[:-1] >= 0)])]  # runs of -1 to one
            pairs = int(np.count_nonzero((x[1:] >= 0) & (x[:-1] >= 0)))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([pairs], pa.int64())], names=["ids", "pairs"])

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "ids binary, pairs long")


def _pair_keys(x: np.ndarray) -> np.ndarray:
    both = (x[1:] >= 0) & (x[:-1] >= 0)
    return x[:-1][both].astype(np.int64) << 32 | x[1:][both]


def _triple_keys(x: np.ndarray, pairs: Counted) -> np.ndarray:
    """Keys of triples whose pairs are both frequent: the first pair's slot and the last word's."""
    both = (x[1:] >= 0) & (x[:-1] >= 0)
    keys, back = np.unique(x[:-1][both].astype(np.int64) << 32 | x[1:][both], return_inverse=True)
    slot = np.full(len(both), -1, np.int64)
    slot[both] = pairs.slots.find(keys)[back]
    safe = (slot[:-1] >= 0) & (slot[1:] >= 0)
    return slot[:-1][safe] << 32 | x[2:][safe]


def _gathered(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A mapper's distinct keys with their counts, given out whenever many are gathered."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        both, back = np.unique(np.concatenate([keys, *fresh]), return_inverse=True)
        out = np.bincount(back[len(keys):], minlength=len(both)).astype(np.int64)
        out[back[:len(keys)]] += counts
        return both, out

    for b in batches:
        for ids in b.column(0):
            fresh.append(keys_of(np.frombuffer(ids.as_py(), np.int32)))
            size += len(fresh[-1])
        if size > HELD:
            keys, counts = merged()
            fresh, size = [], 0
            if len(keys) > 4 * HELD:
                yield keys, counts
                keys, counts = keys[:0], counts[:0]
    keys, counts = merged()
    if len(keys):
        yield keys, counts


def tree_sum(arrays: DataFrame, parts: int) -> DataFrame:
    """block, part, counts (64-bit numbers as bytes) summed by block: FAN arrays a task and step."""

    def total(t: pa.Table) -> pa.Table:
        out = np.zeros(BLOCK, np.int64)
        for c in t["counts"]:
            out += np.frombuffer(c.as_buffer(), np.int64)
        return pa.table({"block": t["block"][:1].combine_chunks(), "part": t["part"][:1].combine_chunks(), "counts": pa.array([out.tobytes()], pa.binary())})

    while parts > 1:
        up = arrays.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        arrays, parts = up.groupBy("block", "part").applyInArrow(total, "block long, part long, counts binary"), -(-parts // FAN)
    return arrays


def _count_by_slot(ids: DataFrame, keys_of, scratch: Scratch, name: str) -> DataFrame:
    """key, a of a level that fits one table: mappers count by slot, their arrays are summed as a tree."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _ in _gathered(batches, keys_of):
            yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    spark = ids.sparkSession
    candidates = scratch.keep(ids.select("ids").mapInArrow(seen, "key long").distinct(), f"{name}-candidates")
    table = spark.sparkContext.broadcast(Slots(candidates.toArrow()["key"].to_numpy()))  # no more than TABLE_KEYS by the caller's check

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        out = np.zeros(-(-len(slots.keys) // BLOCK) * BLOCK, np.int64)
        for keys, counts in _gathered(batches, keys_of):
            at = slots.find(keys)
            out += np.bincount(at[at >= 0], counts[at >= 0], len(out)).astype(np.int64)
        part = TaskContext.get().partitionId()
        for k in np.flatnonzero(out.reshape(-1, BLOCK).any(axis=1)):
            block = out[k * BLOCK:(k + 1) * BLOCK].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part], pa.int64()), pa.array([block], pa.binary())], names=["block", "part", "counts"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1)):
                c = np.frombuffer(c.as_buffer(), np.int64)
                at = np.flatnonzero(c >= LEAST)
                yield pa.RecordBatch.from_arrays([pa.array(slots.keys[k * BLOCK + at].astype(np.int64)), pa.array(c[at])], names=["key", "a"])

    arrays = ids.select("ids").mapInArrow(count, "block long, part long, counts binary")
    sums = tree_sum(arrays, ids.rdd.getNumPartitions())
    out = scratch.keep(sums.select("block", "counts").mapInArrow(read, "key long, a long"), name)
    scratch.drop(candidates)
    table.destroy()
    return out


def _count_by_shard(ids: DataFrame, keys_of, occurrences: int, scratch: Scratch, name: str) -> DataFrame:
    """key, a of a larger level: keys are dealt to shards by hash, and each shard counts by slot of its own table."""
    shards = max(-(-occurrences // TABLE_KEYS), min(SHARDS_LEAST, -(-occurrences // SHARD_LEAST)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _gathered(batches, keys_of):
            to = (_mix(keys.astype(np.uint64), 97) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[by], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(ends)):
                own = by[ends[s]:ends[s + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([keys[own].tobytes()], pa.binary()), pa.array([counts[own].astype(np.uint32).tobytes()], pa.binary())], names=["shard", "keys", "counts"])

    def count(t: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.uint32)) for k, c in zip(t["keys"], t["counts"])]
        slots = Slots(np.unique(np.concatenate([k for k, _ in parts])))
        out = np.zeros(len(slots.keys), np.int64)
        for keys, counts in parts:
            out += np.bincount(slots.find(keys), counts, len(out)).astype(np.int64)
        at = np.flatnonzero(out >= LEAST)
        return pa.table({"key": slots.keys[at].astype(np.int64), "a": out[at]})

    dealt = ids.select("ids").mapInArrow(deal, "shard long, keys binary, counts binary")
    return scratch.keep(dealt.groupBy("shard").applyInArrow(count, "key long, a long"), name)


def _triples_by_shard(ids: DataFrame, occurrences: int, scratch: Scratch) -> DataFrame:
    """key (the first pair), w (the last word), a of triples where frequent pairs are more than a worker holds.

    Triples of frequent words are dealt to shards by their first pair; a shard numbers its own pairs.
    """
    shards = max(-(-occurrences // TABLE_KEYS), min(SHARDS_LEAST, -(-occurrences // SHARD_LEAST)), 1)

    def summed(pairs: np.ndarray, last: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some, back = np.unique(pairs, return_inverse=True)
        keys, at = np.unique(back.astype(np.int64) << 32 | last, return_inverse=True)
        return some[keys >> 32], keys & 0xFFFFFFFF, np.bincount(at, counts, len(keys)).astype(np.int64)

    def dealt(pairs: list[np.ndarray], last: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, w, a = summed(np.concatenate(pairs), np.concatenate(last), None)
        to = (_mix(key.astype(np.uint64), 89) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[by], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(ends)):
            own = by[ends[s]:ends[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), *(pa.array([x[own].astype(t).tobytes()], pa.binary()) for x, t in (
                (key, np.int64), (w, np.int32), (a, np.uint32)))], names=["shard", "keys", "words", "counts"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, last, size = [], [], 0
        for b in batches:
            for ids in b.column(0):
                x = np.frombuffer(ids.as_py(), np.int32)
                at = np.flatnonzero((x[:-2] >= 0) & (x[1:-1] >= 0) & (x[2:] >= 0))
                pairs.append(x[at].astype(np.int64) << 32 | x[at + 1])
                last.append(x[at + 2].astype(np.int64))
                size += len(at)
                if size > 4 * HELD:
                    yield from dealt(pairs, last)
                    pairs, last, size = [], [], 0
        if size:
            yield from dealt(pairs, last)

    def count(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t[c]])
        key, w, a = summed(read("keys", np.int64), read("words", np.int32), read("counts", np.uint32))
        often = a >= LEAST
        return pa.table({"key": key[often], "w": w[often], "a": a[often]})

    rows = ids.select("ids").mapInArrow(deal, "shard long, keys binary, words binary, counts binary")
    return scratch.keep(rows.groupBy("shard").applyInArrow(count, "key long, w long, a long"), "triples")


def _with_pairs(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, a, w, xy, yz: triples with the counts of both their pairs, by joins on the pairs' keys."""
    of = lambda key, name: pairs.select(F.col("key").alias(key), F.col("a").alias(name)).hint("merge")
    last = F.shiftleft(F.col("key").bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(F.col("w"))
    return triples.withColumn("last", last).join(of("key", "xy"), "key").join(of("last", "yz"), "last").select("key", "a", "w", "xy", "yz")


def _count(ids: DataFrame, keys_of, occurrences: int, scratch: Scratch, name: str) -> DataFrame:
    if occurrences <= TABLE_KEYS:
        return _count_by_slot(ids, keys_of, scratch, name)
    return _count_by_shard(ids, keys_of, occurrences, scratch, name)


FOUND = "lang string, phrase string, a long, l long, r long, n long, score decimal(38,0), slot long, first long, last long"


def _lowest(a: int, cuts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """The lowest score of the cuts (l, r), the first of equals, with its l and r; Python's integers are exact."""
    score, _, left, right = min((SCALE * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
    return score, left, right


def _cut(rows: DataFrame, triples: bool, shared_words, shared_pairs) -> DataFrame:
    """Candidates with the cut that counts, all read by slot: a pair's slot as `slot`, a triple's pairs as `first`, `last`.

    Without shared_pairs pairs go by their keys, and triples are rows as from `_with_pairs`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared_words.value, shared_pairs and shared_pairs.value
        for b in batches:
            key, a = b.column(0).to_numpy(), b.column(1).to_numpy()
            if triples:
                if pairs is None:
                    own, w3, xy, yz = (b.column(k).to_numpy() for k in (0, 2, 3, 4))
                    first, last = own, (own & 0xFFFFFFFF) << 32 | w3
                else:
                    first, w3 = key >> 32, key & 0xFFFFFFFF
                    own = pairs.slots.keys[first].astype(np.int64)
                    last = pairs.slots.find((own & 0xFFFFFFFF) << 32 | w3)
                    xy, yz = pairs.counts[first], pairs.counts[last]
                w1, w2 = own >> 32, own & 0xFFFFFFFF
                parts = [(words.counts[w1], yz), (xy, words.counts[w3])]
                spoken, slot = [w1, w2, w3], None
            else:
                w1, w2 = key >> 32, key & 0xFFFFFFFF
                parts, spoken = [(words.counts[w1], words.counts[w2])], [w1, w2]
                slot, first, last = key if pairs is None else pairs.slots.find(key), None, None
            cuts = zip(*[zip(x.tolist(), y.tolist()) for x, y in parts])
            best = [_lowest(n, c) for n, c in zip(a.tolist(), cuts)]
            langs = words.langs.take(pa.array(w1))
            phrase = pc.binary_join_element_wise(*[words.words.take(pa.array(w)) for w in spoken], " ")
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([
                langs, phrase, b.column(1), pa.array([x[1] for x in best], pa.int64()), pa.array([x[2] for x in best], pa.int64()),
                pa.array([words.total[x] for x in langs.to_pylist()], pa.int64()), pa.array([decimal.Decimal(x[0]) for x in best], pa.decimal128(38, 0)),
                *(none if x is None else pa.array(x) for x in (slot, first, last))], names=[f.split()[0] for f in FOUND.split(", ")])

    return rows.mapInArrow(run, FOUND)


def _kept(pairs: DataFrame, triples: DataFrame, on: list[str], first: list[str], last: list[str]) -> DataFrame:
    """Pairs that no triple holds often enough, and all triples. `on` names a pair, `first` and `last` the pairs in a triple."""
    halves = [triples.select(*[F.col(x).alias(y) for x, y in zip(names, on)], F.col("a").alias("_longer")) for names in (first, last)]
    longer = halves[0].unionByName(halves[1]).groupBy(*on).agg(F.max("_longer").alias("_longer"))
    stay = pairs.join(longer, on, "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < WITHIN * F.col("a")))
    cols = ["lang", "phrase", "a", "l", "r", "n", "score"]
    return stay.select(*cols).unionByName(triples.select(*cols))


def top(candidates: DataFrame, most: int = TOP) -> DataFrame:
    """Each language's first `most` by score, a and phrase; parts of a language are cut to `most` before they meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    for keys in (["lang", part], ["lang"]):
        candidates = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)
    return candidates.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def _spoken(docs: DataFrame) -> DataFrame:
    """lang, w (words of a piece), a row for each piece: the plain reading, for tables beyond TABLE_KEYS."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    piece = F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]"))
    t = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), piece.alias("piece"))
    return t.select("lang", F.filter(F.split("piece", r"[\x20\x09]+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)


def _grams(spoken: DataFrame, n: int) -> DataFrame:
    """lang, w1 to wn, a of phrases that occur LEAST times."""
    names = [f"w{k + 1}" for k in range(n)]
    starts = F.sequence(F.lit(0), F.size("w") - n)
    each = spoken.filter(F.size("w") >= n).select("lang", F.explode(F.transform(
        starts, lambda i: F.struct(*[F.get("w", i + k).alias(x) for k, x in enumerate(names)]))).alias("g")).select("lang", "g.*")
    return each.groupBy("lang", *names).agg(F.count("*").alias("a")).filter(F.col("a") >= LEAST)


def joined(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Scored candidates by grouping and joining alone, whatever the number of phrases."""
    spoken = scratch.keep(_spoken(docs), "spoken")
    one, two, three = (scratch.keep(_grams(spoken, n), f"grams-{n}") for n in (1, 2, 3))
    total = spoken.groupBy("lang").agg(F.sum(F.size("w")).cast("long").alias("n"))

    def part(t: DataFrame, of: DataFrame, names: list[str], as_name: str) -> DataFrame:
        own = [f"w{k + 1}" for k in range(len(names))]
        return t.join(of.select("lang", *[F.col(x).alias(y) for x, y in zip(own, names)], F.col("a").alias(as_name)), ["lang", *names])

    def scored(t: DataFrame, names: list[str], cuts: list[tuple[str, str]]) -> DataFrame:
        big = "decimal(38,0)"
        score = [F.expr(f"cast({SCALE} * cast(a as {big}) * cast(a as {big}) as {big}) div cast(cast({x} as decimal(19,0)) * cast({y} as decimal(19,0)) as {big})") for x, y in cuts]
        best = F.array_min(F.array(*[F.struct(s.cast(big).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (s, (x, y)) in enumerate(zip(score, cuts))]))
        return t.withColumn("best", best).join(total, "lang").select(
            "lang", *names, F.concat_ws(" ", *names).alias("phrase"), "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))

    pairs = scored(part(part(two, one, ["w1"], "x"), one, ["w2"], "y"), ["w1", "w2"], [("x", "y")])
    t = part(part(part(part(three, one, ["w1"], "x"), two, ["w2", "w3"], "yz"), two, ["w1", "w2"], "xy"), one, ["w3"], "z")
    triples = scored(t, ["w1", "w2", "w3"], [("x", "yz"), ("xy", "z")])
    return _kept(pairs, triples, ["lang", "w1", "w2"], ["lang", "w1", "w2"], ["lang", "w2", "w3"])


def candidates(docs: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all phrases that stay."""
    spark = docs.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark)
    words = scratch.keep(_counted_words(docs), "words")
    frequent = words.filter(F.col("a") >= LEAST)
    if frequent.count() > TABLE_KEYS:
        return joined(docs, scratch)
    table = frequent.toArrow()
    sums = words.groupBy("lang").agg(F.sum("a").alias("n")).join(frequent.select("lang").distinct(), "lang", "left_semi")
    shared = spark.sparkContext.broadcast(Words(table, {r["lang"]: r["n"] for r in sums.collect()}))
    ids = scratch.keep(_numbered(docs, shared), "ids")
    scratch.drop(words)
    near = ids.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    pairs = _count(ids, _pair_keys, near, scratch, "pairs")
    size, near = pairs.agg(F.count("*"), F.coalesce(F.sum("a"), F.lit(0))).first()
    if size > TABLE_KEYS:
        held, triples = None, _triples_by_shard(ids, near, scratch)
    else:
        held = spark.sparkContext.broadcast(Counted(pairs.toArrow()))
        triples = _count(ids, lambda x: _triple_keys(x, held.value), near, scratch, "triples")
    cut = [_cut(pairs, False, shared, held), _cut(triples if held else _with_pairs(triples, pairs), True, shared, held)]
    out = scratch.keep(_kept(*cut, ["slot"], ["first"], ["last"]), "candidates")
    for t in (ids, pairs, triples):
        scratch.drop(t)
    return out


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return top(candidates(docs))


#: The query in SQL.
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
spoken AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
each AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM spoken),
total AS (SELECT lang, count(*) AS n FROM each GROUP BY lang),
one AS MATERIALIZED (SELECT lang, w[i] AS w1, count(*) AS a FROM each GROUP BY ALL),
two AS MATERIALIZED (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS a FROM each WHERE i < len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
three AS MATERIALIZED (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS a FROM each WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.a, x.a AS l, y.a AS r, 1 AS k
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE NOT EXISTS (SELECT 1 FROM three b WHERE b.lang = t.lang AND b.w1 = t.w1 AND b.w2 = t.w2 AND 100 * b.a >= {WITHIN} * t.a)
    AND NOT EXISTS (SELECT 1 FROM three b WHERE b.lang = t.lang AND b.w2 = t.w1 AND b.w3 = t.w2 AND 100 * b.a >= {WITHIN} * t.a)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, x.a, yz.a, 1
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two yz ON yz.lang = t.lang AND yz.w1 = t.w2 AND yz.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, xy.a, z.a, 2
  FROM three t JOIN two xy ON xy.lang = t.lang AND xy.w1 = t.w1 AND xy.w2 = t.w2 JOIN one z ON z.lang = t.lang AND z.w1 = t.w3),
scored AS (SELECT *, {SCALE}::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
