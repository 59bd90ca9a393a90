"""URL filters: exact membership of a URL's keys in a list, through a cascade of Bloom filters and without joins.

A rule is a host and a path. It fits its host and all subdomains if the URL's path starts with the rule's. So a URL
asks for the keys host ending + path beginning, of the shapes (labels, path length) that rules have, and the longest
that is listed wins (of equally long ones that with the longer host; of a key that is both allowed and blocked, block).

The cascade is exact over all keys that the corpus asks for. Its first level is a Bloom filter of the listed keys. The
corpus is scanned with it once, and of all its keys only those that pass, but aren't listed, move: they are the second
level. Listed keys that pass the second are the third, and so on until a level lets nothing through that it shouldn't.
A key is listed if the first level that it fails is an even one (counted from 1). Keys are 128-bit hashes.

The cascade is dealt by hash into shards, each made in one task from at most about SHARD_KEYS keys. Workers hold at most
HELD_BYTES of it: a larger one is applied in several passes over the URLs, each written to the shared folder.

Null URL, or one without `://`: host and path empty, no rule. Repeated rows: a verdict each. Very long URLs: whole.
Null rules, rules without a host: none. No rules at all, or an empty table: the default verdict, or no rows. Other
columns: left out but the key; a key named as one of the result's columns raises ValueError.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_batches

ALLOW, BLOCK = "allow", "block"
#: Listed keys and false positives that a shard's task takes on average.
SHARD_KEYS = 1 << 19
#: Bytes of the cascade that a worker holds in one pass.
HELD_BYTES = 64 << 20
#: Bits a key and hash functions: of the first level (1 key in 120 passes wrongly), and of the others (1 in 7).
FIRST_LEVEL = (10, 7)
LATER_LEVELS = (4, 3)
KIND = "shard long, h1 long, h2 long"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """Bits of one level; `level` sets its hash functions apart from the others'."""

    def __init__(self, level: int, size: int, bits: np.ndarray | None = None):
        per, hashes = FIRST_LEVEL if level == 0 else LATER_LEVELS
        self.level, self.size, self.hashes = level, size, hashes
        self.m = max(64, -(-size * per // 64) * 64)
        self.bits = np.zeros(self.m // 8, np.uint8) if bits is None else bits

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        one, two = _mix(keys[:, 0], self.level), _mix(keys[:, 1], self.level) | np.uint64(1)
        for k in range(self.hashes):
            yield ((one + np.uint64(k) * two) % np.uint64(self.m)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return out


def cascade(listed: np.ndarray, others: np.ndarray) -> list[Bloom]:
    """Levels that tell the listed keys from the others (n x 2 hashes each)."""
    levels, into, against = [], listed, others
    while len(into) or not levels:
        level = Bloom(len(levels), len(into))
        level.add(into)
        levels.append(level)
        into, against = against[level.has(against)], into
        if len(levels) > 200:
            raise ValueError("a listed and another key have one hash")
    return levels


def member(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    out, left = np.zeros(len(keys), bool), np.arange(len(keys))
    for k, level in enumerate(levels):
        passed = level.has(keys[left])
        out[left[~passed]] = k % 2 == 1
        left = left[passed]
    out[left] = len(levels) % 2 == 1
    return out


def marks(keys: list[str]) -> np.ndarray:
    """128-bit hashes, a row each."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys), ">u8").astype(np.uint64).reshape(-1, 2)


def asked(host: str, path: str, shapes: dict[int, list[int]]) -> Iterator[tuple[str, str]]:
    """Host endings and path beginnings of the shapes (labels, path lengths) that listed keys have."""
    ends = [0, *(i + 1 for i, c in enumerate(host) if c == ".")]
    for labels, lengths in shapes.items():
        if labels <= len(ends) and host:
            for n in lengths:
                if n > len(path):
                    break
                yield host[ends[-labels]:], path[:n]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(keys[:, 1], 255) % np.uint64(shards)).astype(np.int64)


def _rows(keys: np.ndarray, shards: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(_shard(keys, shards)), pa.array(keys[:, 0].astype(np.int64)), pa.array(keys[:, 1].astype(np.int64))], names=["shard", "h1", "h2"])


def _levels(rows: DataFrame, first_only: bool) -> DataFrame:
    """The shards' levels of the rows' keys (shard, h1, h2, listed)."""

    def make(t: pa.Table) -> pa.Table:
        keys = np.stack([t["h1"].to_numpy(), t["h2"].to_numpy()], axis=1).astype(np.uint64)
        is_listed = t["listed"].to_numpy()
        listed = np.unique(keys[is_listed], axis=0)
        both, first = np.unique(np.concatenate([listed, keys[~is_listed]]), axis=0, return_index=True)
        others = both[first >= len(listed)]  # a listed key comes first among its equals
        made = cascade(listed, others[:0] if first_only else others)
        return pa.table({"shard": pa.array([t["shard"][0].as_py()] * len(made), pa.int64()), "level": pa.array([x.level for x in made], pa.int32()),
            "size": pa.array([x.size for x in made], pa.int64()), "bits": pa.array([x.bits.tobytes() for x in made], pa.binary())})

    return rows.groupBy("shard").applyInArrow(make, "shard long, level int, size long, bits binary")


class Held(dict):
    """The levels of some shards, by shard."""

    def __init__(self, t: pa.Table):
        super().__init__()
        for shard, level, size, bits in sorted(zip(*(t[c].to_pylist() for c in ("shard", "level", "size", "bits")))):
            self.setdefault(shard, []).append(Bloom(level, size, np.frombuffer(bits, np.uint8)))

    def members(self, keys: np.ndarray, shards: int) -> np.ndarray:
        """Which keys are listed, as far as their shards are held here."""
        out, to = np.zeros(len(keys), bool), _shard(keys, shards)
        by = np.argsort(to, kind="stable")
        at, first = np.unique(to[by], return_index=True)
        for s, own in zip(at.tolist(), np.split(by, first[1:])):
            if s in self:
                out[own] = member(self[s], keys[own])
        return out


class Cascade:
    """Exact membership of the lists' keys among all keys that the URLs ask for.

    lists: (list, host, path), list naming what a key is listed as; urls: (host, path).
    """

    def __init__(self, lists: DataFrame, urls: DataFrame, scratch: Scratch):
        self.spark, self.scratch = lists.sparkSession, scratch
        known = scratch.keep(lists.filter(F.col("host") != "").select("list", "host", F.coalesce("path", F.lit("")).alias("path")).distinct(), "lists")
        self.names = sorted(r["list"] for r in known.select("list").distinct().collect())
        self.shapes: dict[int, list[int]] = defaultdict(list)  # at most a host's labels times a path's lengths
        shape = known.select(F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("n")).distinct()
        for r in shape.orderBy("labels", "n").collect():
            self.shapes[r["labels"]].append(r["n"])
        self.shards = shards = max(1, -(-known.count() // SHARD_KEYS))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _rows(marks([f"{x} {h}{p}" for x, h, p in zip(*(c.to_pylist() for c in b.columns))]), shards)

        listed = known.mapInArrow(hashed, KIND).withColumn("listed", F.lit(True))
        first = scratch.keep(_levels(listed, first_only=True), "first-level")
        passed = [scratch.keep(self._passing(urls, held).distinct(), "passed") for held in self._held(first)]
        rows = listed
        for t in passed:
            rows = rows.unionByName(t.withColumn("listed", F.lit(False)))
        self.rows = scratch.keep(_levels(rows, first_only=False), "cascade")

    def _held(self, rows: DataFrame) -> Iterator:
        """Broadcasts of as many shards as HELD_BYTES allow, one after another."""
        sizes = rows.groupBy("shard").agg(F.sum(F.length("bits")).alias("n")).orderBy("shard").collect()  # a row for SHARD_KEYS keys
        group, n = [], 0
        for k, r in enumerate(sizes):
            group.append(r["shard"])
            n += r["n"]
            if k + 1 == len(sizes) or n + sizes[k + 1]["n"] > HELD_BYTES:
                t = rows.filter(F.col("shard").between(group[0], group[-1])).toArrow()
                yield self.spark.sparkContext.broadcast(Held(t))
                group, n = [], 0

    def _passing(self, urls: DataFrame, held) -> DataFrame:
        """Keys of the URLs that pass the first level."""
        shapes, names, shards = dict(self.shapes), self.names, self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = {f"{x} {h}{p}" for host, path in zip(*(c.to_pylist() for c in b.columns)) for h, p in asked(host, path, shapes) for x in names}
                found = marks(list(keys))
                yield _rows(found[held.value.members(found, shards)], shards)

        return urls.select("host", "path").mapInArrow(run, KIND)

    def look_up(self, urls: DataFrame, key: str) -> DataFrame:
        """key, host, path and, by list, the longest key that is listed (of equals that with the longer host), else null."""
        shapes, names, shards = dict(self.shapes), self.names, self.shards
        cols = [f"in_{x}" for x in names]
        schema = ", ".join([f"`{key}` {urls.schema[key].dataType.simpleString()}", "host string", "path string", *(f"`{c}` string" for c in cols)])
        out = urls.select(key, "host", "path", *[F.lit(None).cast("string").alias(c) for c in cols])
        for held in self._held(self.rows):

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    best = [[(len(x), len(x.split("/", 1)[0]), x) if x is not None else (-1,) for x in c.to_pylist()] for c in b.columns[3:]]
                    tried = [(i, k, h, p) for i, (host, path) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
                             for h, p in asked(host, path, shapes) for k in range(len(names))]
                    found = held.value.members(marks([f"{names[k]} {h}{p}" for _, k, h, p in tried]), shards)
                    for at in np.flatnonzero(found):
                        i, k, h, p = tried[at]
                        best[k][i] = max(best[k][i], (len(h) + len(p), len(h), h + p))
                    new = [pa.array([x[-1] if x[0] >= 0 else None for x in c], pa.string()) for c in best]
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], *new], names=[key, "host", "path", *cols])

            out = self.scratch.keep(out.mapInArrow(run, schema), "looked-up")
        return out


def judge(pages: DataFrame, rules: DataFrame, hosts: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict of each URL.

    rules: (verdict, host, path). hosts: a column `host`; URLs of these hosts and their subdomains that no rule fits are
    blocked. All others are allowed.
    """
    if key in ("host", "path", "rule", "verdict") or key.startswith("in_"):
        raise ValueError(f"the key must not be named {key}")
    limit_batches(pages.sparkSession)
    host, path = parts(F.col(url))
    urls = pages.select(key, host.alias("host"), path.alias("path"))
    lists = rules.filter(F.col("verdict").isin(ALLOW, BLOCK)).select(F.col("verdict").alias("list"), "host", "path")
    if hosts is not None:
        lists = lists.unionByName(hosts.select(F.lit("listed").alias("list"), "host", F.lit("").alias("path")))
    cascade = Cascade(lists, urls, Scratch(pages.sparkSession))
    found = cascade.look_up(urls, key)
    none = F.lit(None).cast("string")
    allow, block, listed = (F.col(f"in_{x}") if x in cascade.names else none for x in (ALLOW, BLOCK, "listed"))

    def rank(rule: Column) -> Column:
        return F.struct(F.coalesce(F.char_length(rule), F.lit(-1)), F.char_length(F.substring_index(rule, "/", 1)))

    by_block = block.isNotNull() & (rank(block) >= rank(allow))  # of the same key, block
    return found.select(
        key, "host", "path", F.when(by_block, block).otherwise(allow).alias("rule"),
        F.when(by_block | (allow.isNull() & listed.isNotNull()), BLOCK).otherwise(ALLOW).alias("verdict"))


#: The query's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words that put a host of the table on the list of blocked hosts, where they are a part of a label between hyphens.
HOST_WORDS = ["adult", "ads", "bets", "casino", "gambling", "pills", "poker", "porn", "spam", "xxx"]


def listed_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    host, _ = parts(F.col(url))
    words = F.array(*[F.lit(w) for w in HOST_WORDS])
    return pages.select(host.alias("host")).filter(F.arrays_overlap(F.split("host", "[.-]"), words)).distinct()


def digest(pages: DataFrame) -> DataFrame:
    """The query's columns."""
    rules = pages.sparkSession.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(pages, rules, listed_hosts(pages))


_FITS = "(p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)"
#: The query in SQL.
SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(map(str, RULES))}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
judged AS (
  SELECT p.page_id, p.host, p.path, (
      SELECT max(struct_pack(n := length(r.host || r.path), h := length(r.host), v := r.verdict, rule := r.host || r.path))
      FROM rules r WHERE {_FITS}) AS best
  FROM p)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best.rule IS NOT NULL THEN best.v
  WHEN list_has_any(regexp_split_to_array(host, '[.-]'), {HOST_WORDS}) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
