"""Main text of web pages: host suffix arrays over page token streams, with markup as a hint.

A page becomes a stream of text blocks in page order, and each block a stream of words. Each block is
known by its markup as content (in an article or main element), as furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) or as neither. The streams of a host's pages are
concatenated, and suffix arrays find what recurs on another page of the host: over the blocks, runs of
RUN_BLOCKS blocks or RUN_CHARS characters; over the words (with a mark at each block's end), strings of
RUN_WORDS tokens or more wherever they begin and end. Of the blocks that markup leaves open, in pages
without content markup, covered blocks and words are boilerplate and the unique runs are kept. Blocks that
markup knows stand: an article may quote a passage that other pages have too.

A host's pages are split into groups of about GROUP_BYTES by a hash of the page (a third of all pages may
be one host's). What recurs across the groups of a split host comes from an index of its shortest runs by
hash: a run long enough recurs only if its runs of three blocks do, or its one or two blocks of RUN_CHARS
characters, or its windows of RUN_WORDS tokens, so hashes of these with the least and greatest page hash
tell whether two different pages have them. The result doesn't depend on the grouping.

Null, empty or blank html: empty text. A page without host: the empty host. Repeated rows and ties: one
result each; equal pages of a host count as one, so copies don't make each other boilerplate. Very long
pages: whole, in a group of their own. Empty table: empty. Other columns, whatever their names: left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Spread, limit_batches

GROUP_BYTES = 512 << 10
#: Hosts of more than one group that are broadcast; beyond, they are joined by exchange.
BROADCAST_HOSTS = 50_000
#: A recurring run is boilerplate from this many blocks or characters on.
RUN_BLOCKS = 3
RUN_CHARS = 30
#: A recurring string is boilerplate from this many tokens on, wherever it begins (a power of two).
RUN_WORDS = 32

#: Elements whose content is text to the parser, up to their own end tag or the page's end.
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
#: Elements that are left out with all that they hold, if they end at all; svg and math may close themselves.
DROPPED = frozenset("template svg select button object canvas math".split())
FOREIGN = frozenset("svg math".split())
FLAT = frozenset("select button".split())
#: A tag from its `<` on. A quote counts only after `=`, and one that nothing closes is a letter like others; no part of
#: the pattern gives back what it took, so a tag costs its length.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
COMMENT_END = re.compile(r"--!?>")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose ends matter; all others only part blocks.
TRACKED = frozenset("address article aside dialog div footer form header li main menu nav ol section table td ul fieldset figure details p pre blockquote dl dd".split())
#: Elements that an open paragraph ends at, if it hasn't ended before.
ENDS_P = TRACKED | frozenset("center dir dt h1 h2 h3 h4 h5 h6 hgroup hr search summary tr th thead tbody tfoot caption figcaption".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset address header".split())
#: Furniture that whole pages may be wrapped in, so an article inside it is one all the same.
WRAPS = frozenset("form fieldset address header".split())
#: Furniture that is part of an article it stands in.
PARTS = frozenset("address header".split())
NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|commentlist|complementary|consent|contentinfo|cookies?|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation"
    r"|newsletter|notice|pagination|popup|promo|promoted|recommended|related|replies|reply|respond|search|share|sharing|sidebar|signup|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:$|[\s_-])",
        re.I)
OPEN, CONTENT, AWAY = 0, 1, 2


#: Names of an element that holds an article's text whatever else they say, where a page has no other content.
BODY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|post|story|text)(?:$|[\s_-])", re.I)
#: What names are asked about: everything; furniture, but not whether an article may stand in it; nor where they say body.
ALL_NAMES, INSIDE_ONLY, NOT_OF_BODIES = 2, 1, 0


def _names(attributes: str) -> list[str]:
    return [x for a, b, c in NAMED.findall(attributes) for x in (a or b or c).split()]


def _named(names: list[str]) -> bool:
    """Do the names say furniture? `has-sidebar` and the like speak of a layout, not of the element."""
    return any(WORDS.search(x) for x in names if not x.lower().startswith(("has-", "with-", "no-", "without-")))


def _main_role(attributes: str) -> bool:
    return bool(re.search(r"role\s*=\s*[\"']?(?:main|article)\b|itemprop\s*=\s*[\"']?articleBody", attributes, re.I))


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, what markup says) of a page's blocks in order.

    Names alone may be wrong about an element that holds the page's only article, or its body: if nothing turns
    out to be content, names of its ancestors are not asked, and then not those of elements also named as a body.
    """
    out = _blocks(page, ALL_NAMES)
    if not any(s == CONTENT for _, s in out) and re.search(r"<(?:article|main)\b|role\s*=\s*[\"']?(?:article|main)\b|articleBody", page or "", re.I):
        for asked in (INSIDE_ONLY, NOT_OF_BODIES):
            again = _blocks(page, asked)
            if any(s == CONTENT for _, s in again):
                return again
    return out


def scan(source: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, is it an end tag, attributes) of each tag that counts, in one pass; the rest as text before ''.

    What the text between two yields skips: comments, declarations, elements in RAW and DROPPED. A `<` that begins no tag is
    text; a tag that never ends is left out with what follows, as are comments and RAW elements that never end. DROPPED
    elements that never end are tags like others.
    """
    at, text_from, size = 0, 0, len(source)
    before: list[str] = []
    endless: set[str] = set()  # names in DROPPED without a further end tag
    while (lt := source.find("<", at)) >= 0 and lt + 1 < size:
        nxt = source[lt + 1]
        if nxt in "!?" or nxt == "/" and lt + 2 < size and not (source[lt + 2].isascii() and source[lt + 2].isalpha()):
            before.append(source[text_from:lt])
            if source.startswith("<!--", lt):
                if source.startswith((">", "->"), lt + 4):
                    at = source.index(">", lt) + 1
                else:
                    end = COMMENT_END.search(source, lt + 4)
                    at = end.end() if end else size
            else:
                end = source.find(">", lt)
                at = end + 1 if end >= 0 else size
            text_from = at
            before.append(" ")
            continue
        if not (nxt == "/" or nxt.isascii() and nxt.isalpha()):
            at = lt + 1
            continue
        m = TAG.match(source, lt)
        if m is None:
            before.append(source[text_from:lt])
            text_from = size
            break
        shut, name, attributes = bool(m[1]), m[2].lower(), m[3]
        before.append(source[text_from:lt])
        at = text_from = m.end()
        if not shut and name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
            close = TAG.match(source, end.start()) if end else None
            at = text_from = close.end() if close else size
            before.append(" ")
        elif not shut and name in DROPPED and name not in endless and not (name in FOREIGN and attributes.endswith("/")):
            end = _matching(source, name, at)
            if end is None:
                endless.add(name)
            else:
                at = text_from = end
            before.append(" ")
        elif name in DROPPED:
            before.append(" ")
        else:
            yield "".join(before), name, shut, attributes
            before = []
    before.append(source[text_from:])
    yield "".join(before), "", False, ""


def _matching(source: str, name: str, at: int) -> int | None:
    """Where the element that began before `at` ends, the ends of others of its name inside counted off; None if there is no end.

    Buttons and selections don't hold others of their name: the next one ends them, and what lies between stays.
    """
    depth, last = 1, None
    for m in re.compile(f"<(/?){name}(?=[\\s/>])[^>]*>", re.I).finditer(source, at):
        if m[1]:
            depth -= 1
            last = m.end()
            if not depth:
                return last
        elif name in FLAT:
            return at
        elif not m[0].endswith("/>"):
            depth += 1
    return last


def _blocks(page: str | None, asked: int) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tracked elements that are open: name, state inside, does it shut articles out
    opened: Counter[str] = Counter()  # how many of each name are open
    barred = 0  # open elements that shut articles out
    state = OPEN

    def close() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, state))

    def shut_to(name: str) -> None:
        nonlocal state, barred
        while True:
            last, _, bars = stack.pop()
            opened[last] -= 1
            barred -= bars
            if last == name:
                break
        state = stack[-1][1] if stack else OPEN

    for text, name, shut, attributes in scan(page or ""):
        if text:
            parts.append(text)
        if name in INLINE:
            continue
        if name == "br":
            parts.append(" ")
            continue
        close()
        if not shut and name in ENDS_P and stack and stack[-1][0] == "p":
            shut_to("p")
        if name not in TRACKED:
            continue
        if shut:
            if opened[name]:
                shut_to(name)
            continue
        if attributes.endswith("/"):
            continue
        names = _names(attributes) if attributes else []
        named = _named(names) and not (asked == NOT_OF_BODIES and any(BODY.search(x) for x in names))
        main = name == "main" or bool(attributes) and bool(re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I))
        bars = False
        if main:
            state = CONTENT
        elif name == "article" or attributes and _main_role(attributes):
            bars = named
            state = AWAY if named or barred else CONTENT
        elif name in FURNITURE and not (state == CONTENT and name in PARTS and not named) or named:
            bars = name in FURNITURE and name not in WRAPS or named and asked == ALL_NAMES
            state = AWAY
        stack.append((name, state, bars))
        opened[name] += 1
        barred += bars
    close()
    return out


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length of the ranked prefixes."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - k)] = rank[k:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        steps = np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64)))
        rank[order] = np.cumsum(steps)
        if n == 0 or rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order (0 for the first)."""
    n = len(tokens)
    t = tokens.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place, o, out, h = place.tolist(), order.tolist(), [0] * n, 0
    for i in range(n):
        p = place[i]
        if not p:
            h = 0
            continue
        j = o[p - 1]
        while i + h < n and j + h < n and t[i + h] == t[j + h]:
            h += 1
        out[p] = h
        h -= h > 0
    return np.array(out, np.int64)


def covered(streams: list[list[str]]) -> list[np.ndarray]:
    """For each page's blocks: does a long run over them recur on another page?"""
    known: dict[str, int] = {}
    tokens: list[int] = []
    page: list[int] = []
    sizes: list[int] = []
    for p, s in enumerate(streams):
        for b in s:
            tokens.append(known.setdefault(b, len(known)))
            sizes.append(len(b))
            page.append(p)
        tokens.append(-1 - p)  # ends of pages are all different
        sizes.append(0)
        page.append(p)
    arr = np.array(tokens, np.int64)
    order = suffix_array(arr)
    lcp = common_prefixes(arr, order).tolist()
    longest = [0] * len(tokens)
    for step in (1, -1):  # nearest suffix of another page, from either side
        shared, last = 0, None
        seq = range(len(tokens)) if step == 1 else range(len(tokens) - 1, -1, -1)
        here = 0  # common prefix with the nearest suffix of another page
        for r in seq:
            edge = lcp[r] if step == 1 else (lcp[r + 1] if r + 1 < len(tokens) else 0)
            p = page[order[r]]
            shared = edge if last is not None and p != last else min(here, edge)
            if p != last:
                here = shared
            else:
                here = min(here, edge)
            longest[order[r]] = max(longest[order[r]], here)
            last = p
    marks = np.zeros(len(tokens) + 1, np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    for i, n in enumerate(longest):
        if n >= RUN_BLOCKS or n and total[i + n] - total[i] >= RUN_CHARS:
            marks[i] += 1
            marks[i + n] -= 1
    hit = np.cumsum(marks[:-1]) > 0
    out, at = [], 0
    for s in streams:
        out.append(hit[at:at + len(s)])
        at += len(s) + 1
    return out


def _hash(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def shortest_runs(host: str, stream: list[str]) -> Iterator[tuple[int, int, int]]:
    """(first block, blocks, hash) of the runs that every long run of the stream's blocks is made of."""
    raw = [b.encode("utf-8", "surrogatepass") for b in stream]
    start = host.encode("utf-8", "surrogatepass")
    for i in range(len(stream)):
        for n in range(1, min(RUN_BLOCKS, len(stream) - i) + 1):
            if n == RUN_BLOCKS or sum(map(len, stream[i:i + n])) >= RUN_CHARS:
                yield i, n, _hash(b"\n".join((start, *raw[i:i + n])))


def words_of(stream: list[str]) -> list[str]:
    """The stream's words, with a mark at each block's end."""
    return [w for b in stream for w in (*b.split(" "), "\n")]


def covered_words(streams: list[list[str]]) -> list[np.ndarray]:
    """For each page's tokens (`words_of`): do RUN_WORDS tokens over them recur on another page?

    The suffixes are ranked by their first RUN_WORDS tokens only: a longer string recurs where all such
    windows of it do, so the order beyond them is not needed.
    """
    known: dict[str, int] = {}
    tokens: list[int] = []
    page: list[int] = []
    for p, s in enumerate(streams):
        tokens += [known.setdefault(w, len(known)) for w in s]
        tokens.append(-1 - p)
        page += [p] * (len(s) + 1)
    n = len(tokens)
    rank = np.unique(np.array(tokens, np.int64), return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < RUN_WORDS:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - k)] = rank[k:]
        rank = np.unique(rank * (n + 1) + second + 1, return_inverse=True)[1].astype(np.int64)
        k *= 2
    p = np.array(page, np.int64)
    lo, hi = np.full(n + 1, n, np.int64), np.full(n + 1, -1, np.int64)
    np.minimum.at(lo, rank, p)
    np.maximum.at(hi, rank, p)
    return _spread(lo[rank] < hi[rank], [len(s) for s in streams])


def _spread(starts: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """Which tokens lie in a window that begins at one of the starts; each stream has one more place at its end."""
    marks = np.zeros(len(starts) + RUN_WORDS + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + RUN_WORDS, -1)
    hit = np.cumsum(marks) > 0
    ends = np.cumsum([n + 1 for n in lengths])
    return [hit[e - n - 1:e - 1] for n, e in zip(lengths, ends.tolist(), strict=True)]


def window_hashes(host: str, tokens: list[str]) -> np.ndarray:
    """A hash of each window of RUN_WORDS tokens."""
    memo: dict[str, int] = {}
    first = xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"))
    h = np.array([memo.get(w) or memo.setdefault(
            w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), first)) for w in tokens], np.uint64)
    k = 1
    while k < RUN_WORDS:
        if len(h) <= k:
            return np.empty(0, np.int64)
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15) ^ h[k:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        k *= 2
    return h.view(np.int64)


def main_texts(pages: list[tuple[list[str], bytes]], host: str = "", elsewhere: frozenset[int] = frozenset()) -> list[str]:
    """Main text of each page of a host's group from (blocks, what markup says of each).

    elsewhere: hashes of shortest runs that recur on another page of the host, in whichever group.
    """
    place: dict[tuple, int] = {}  # equal pages are one
    which = [place.setdefault((tuple(bs), states), len(place)) for bs, states in pages]
    streams = [[b for b, s in zip(bs, states, strict=True) if s != CONTENT] for bs, states in place]
    texts = {}
    if all(CONTENT in states for _, states in place):  # nothing is left open
        streams, hits, words, inside = [], [], [], []
    else:
        hits, words = covered(streams), [words_of(s) for s in streams]
        inside = covered_words(words)
    for k, (bs, states) in enumerate(place):
        if CONTENT in states:
            texts[k] = "\n".join(b for b, s in zip(bs, states, strict=True) if s == CONTENT)
            continue
        stream, hit, gone = streams[k], hits[k], inside[k]
        if elsewhere:
            for i, n, h in shortest_runs(host, stream):
                if h in elsewhere:
                    hit[i:i + n] = True
            found = window_hashes(host, words[k])
            starts = np.zeros(len(words[k]) + 1, bool)
            starts[:len(found)] = [h in elsewhere for h in found.tolist()]
            gone = gone | _spread(starts, [len(words[k])])[0]
        kept, at = [], 0
        for b, s, h in zip(bs, states, hit.tolist(), strict=True):
            end = at + b.count(" ") + 1
            if s == OPEN and not h:
                if gone[at:end].any():
                    b = " ".join(w for w, g in zip(words[k][at:end], gone[at:end].tolist(), strict=True) if not g)
                if b:
                    kept.append(b)
            at = end + 1
        texts[k] = "\n".join(kept)
    return [texts[k] for k in which]


PARSED = "page_id long, url string, host string, body string, states binary"
HOST = r"^(?:[a-zA-Z][\w+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies, states = [], []
        for h in b.column(3):
            got = blocks(h.as_py())
            bodies.append("\n".join(x for x, _ in got))
            states.append(bytes(s for _, s in got))
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array(bodies, pa.string()), pa.array(states, pa.binary())],
            names=["page_id", "url", "host", "body", "states"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, least and greatest hash of its pages, group if one of the group's texts depends on it)."""
    for b in batches:
        seen: dict[tuple[int, str | None], tuple[int, int]] = {}

        def note(h: int, group: str | None, page: int) -> None:
            lo, hi = seen.get((h, group), (page, page))
            seen[h, group] = (min(lo, page), max(hi, page))

        for group, host, body, states in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            bs = body.split("\n") if states else []
            page = _hash(states + b"\n" + body.encode("utf-8", "surrogatepass"))
            left = bytes(s for s in states if s != CONTENT)
            stream = [x for x, s in zip(bs, states, strict=True) if s != CONTENT]
            open_ = CONTENT not in states
            for i, n, h in shortest_runs(host, stream):
                note(h, group if open_ and OPEN in left[i:i + n] else None, page)
            for h in window_hashes(host, words_of(stream)).tolist():
                note(h, group if open_ else None, page)
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in seen], pa.int64()), pa.array([lo for lo, _ in seen.values()], pa.int64()),
                pa.array([hi for _, hi in seen.values()], pa.int64()), pa.array([g for _, g in seen], pa.string())],
            names=["run", "lo", "hi", "group"])


def _group(table: pa.Table, runs: pa.Table | None = None) -> pa.Table:
    bodies, states = table.column("body").to_pylist(), table.column("states").to_pylist()
    host = table.column("host")[0].as_py() if table.num_rows else ""
    texts = main_texts(
        [(b.split("\n") if s else [], s) for b, s in zip(bodies, states, strict=True)], host,
        frozenset(runs.column("run").to_pylist() if runs else ()))
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"),
            "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every (page_id, url, html) row."""
    limit_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1)).alias("host")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host, F.col("html").cast("string"))
    weight = F.octet_length(F.coalesce("html", F.lit("")))
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(weight.cast("long")) / F.lit(GROUP_BYTES)).alias("parts"))
    scratch = Scratch(pages.sparkSession)
    hot = scratch.keep(sizes.filter("parts > 1"), "hosts")
    n_hot = hot.count()
    few = n_hot <= BROADCAST_HOSTS  # else both sides are dealt by host for the join, and again by group
    salted = rows.mapInArrow(_parse, PARSED).join(F.broadcast(hot) if few else hot, "host", "left")
    # One column, so that the rows are dealt by group: a partitioning by host would keep a hot host in one task.
    group = F.concat_ws(" ", "host", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))))
    dealt = salted.select(group.alias("group"), "host", "page_id", "url", "body", "states").groupBy("group")
    out = "page_id long, url string, text string, n_chars long"
    if not n_hot:
        return dealt.applyInArrow(lambda t: _group(t), out)
    runs = salted.filter("parts > 1").select(group.alias("group"), "host", "body", "states").mapInArrow(
        _runs, "run long, lo long, hi long, group string")
    runs = scratch.keep(runs.groupBy("run", "group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "runs")
    shared = runs.groupBy("run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("run")
    # A run that all of a large host's groups have meets its verdict in parts.
    told = Spread(runs, "run", "group").meet(runs.filter("group IS NOT NULL").select("run", "group"), shared)
    return dealt.cogroup(told.select("group", "run").groupBy("group")).applyInArrow(lambda t, r: _group(t, r), out)
