"""Quotation linking for conversations (DataFrame functions only).

Each message's lines carry a quote level (the number of leading '>'). A passage is a longest run of
written lines of one level; normalised (reflowed to one line, white space and case evened out) it is
hashed and joined to the passages that messages wrote themselves, so a quotation that was wrapped anew
still finds its original. A passage that nobody wrote as a whole is looked up line by line. Within the
conversation the origin is the first earlier message that wrote it, else the other conversations that
did; of these the source is the one with most of the message's lines, the smallest conv_id of equal ones.
A message answers the message that most of its shallowest quoted lines come from, or else the message
before it. Conversations come out in reply order (a message, then its answers depth first) without quotes
or the lines that introduce them. n_quoted and n_linked count lines.

A conversation of any length is ranked by ranges of its messages rather than in one task (`Groups`).
Own lines are reduced to one row for each conversation and hash before the join, so a line that a third
of all messages share joins as one row. Answers that follow one another form runs; only runs that a quote
attaches elsewhere need the graph, whose paths are found by doubling with tables written between rounds.
Sources are sought once for each set of quoted lines, among two conversations of each set of lines told, and
not by a set's commonest line alone, so many quotes of a line that many wrote are not all joined to each other.

Null text: an empty message. Ties: equal (conv_id, turn) are ordered by role, then text. Null conv_id: one
conversation of its own; null turn: first. Repeated rows: messages of their own. Empty table: empty. Very
long texts: all lines count, whatever their length. Other columns, whatever their names: left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Groups, Scratch, let

MARK = r"^[ \t]{0,3}(?:>[ \t]?)+"
INTRODUCES = r"(?i)^(?:on|am|le|el|at)\b.*\b(?:wrote|writes|schrieb|écrit|escribió)[ \t]?:$"


def parse(text: Column) -> Column:
    """Array of (level, content) of the lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    return F.transform(lines, lambda x: let(F.regexp_extract(x, MARK, 0), lambda m: F.struct(
        F.length(F.regexp_replace(m, "[^>]", "")).alias("level"), F.substring(x, F.length(m) + 1, F.length(x)).alias("content"))))


def normal(content: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(content, r"\s+", " ")))


def passages(parsed: Column) -> Column:
    """Array of (level, lines): the longest runs of written lines of one level, each line normalised."""
    def cut(xs: Column) -> Column:
        at = lambda i, f: F.get(xs, i)[f]
        opens = lambda i: (at(i, "t") != "") & ((i == 0) | (at(i - 1, "t") == "") | (at(i - 1, "level") != at(i, "level")))
        starts = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), opens)
        written = lambda s, e: F.filter(F.transform(F.slice(xs, s + 1, e - s), lambda x: x["t"]), lambda t: t != "")
        return let(starts, lambda st: F.transform(st, lambda s, k: F.struct(
            at(s, "level").alias("level"), written(s, F.coalesce(F.get(st, k + 1), F.size(xs))).alias("lines"))))

    return let(F.transform(parsed, lambda x: F.struct(x["level"].alias("level"), normal(x["content"]).alias("t"))), cut)


def unquoted(parsed: Column) -> Column:
    """What the message says itself, without blank edges."""
    own = F.filter(parsed, lambda x,
        i: (x["level"] == 0) & ~(F.btrim(x["content"]).rlike(
            INTRODUCES) & (F.coalesce(F.get(parsed, i + 1)["level"], F.lit(0)) > 0)))
    return F.btrim(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), F.lit(" \t\r\n"))


def messages(conversations: DataFrame, groups: Groups) -> DataFrame:
    """The rows with their place in the conversation (`pos`, from 1), level and content of each line."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    return groups.numbered(conversations.select("conv_id", "turn", "role", "text"), order, "pos").withColumn("lines", parse(F.col("text")))


#: Conversations that wrote a line from which on it is common.
COMMON = 64


def _first_two(df: DataFrame, by: str, *order: Column | str) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("nth <= 2").drop("nth")


def _two_least(df: DataFrame, by: str, of: str, scratch: Scratch) -> DataFrame:
    """(by, of): the two least values in each group, by partial aggregates."""
    least = scratch.keep(df.groupBy(by).agg(F.min(of).alias(of)), "least")
    above = df.join(least.select(F.col(by).alias("_b"), F.col(of).alias("_l")), F.col(by) == F.col("_b")).filter(F.col(of) > F.col("_l"))
    return least.unionByName(above.groupBy(by).agg(F.min(of).alias(of)))


def sources(far: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, n_far, source_conv_id) from quoted units (conv_id, pos, k, whole, h, n) and own ones (conv_id, h).

    k is the passage's number; where another conversation has the whole passage, its lines don't count. Conversations
    that wrote one of a set's rarer lines are met by it, and their common lines are then looked up. One that wrote none
    of the rarer lines counts by its common ones alone, as do all with the same common lines, so the two smallest
    numbers of these do (two, since a message isn't its own conversation's source): sets of common lines meet
    kinds of conversations, not conversations.
    """
    told = own.filter("conv_id IS NOT NULL").select(F.col("conv_id").alias("src"), "h")
    who = told.groupBy(F.col("h").alias("wh")).agg(F.count("*").alias("convs"), F.min("src").alias("lo"), F.max("src").alias("hi"))
    other = ~F.col("lo").eqNullSafe(F.col("conv_id")) | ~F.col("hi").eqNullSafe(F.col("conv_id"))
    known = far.join(who, F.col("h") == F.col("wh")).filter(other)
    best = F.max("whole").over(Window.partitionBy("conv_id", "pos", "k"))  # a passage's units
    lines = known.withColumn("best", best).filter("whole = best").groupBy("conv_id", "pos", "h", "convs").agg(F.sum("n").alias("n"))
    sets = lines.groupBy("conv_id", "pos").agg(
        F.sum("n").alias("n_far"),
        F.sort_array(F.collect_list(F.struct((-F.col("convs")).alias("c"), "h", "n"))).alias("set"))
    sets = scratch.keep(sets.withColumn("sig", F.xxhash64("set")), "quoted")
    asked = scratch.keep(
        sets.dropDuplicates(["sig"]).select("sig", F.explode("set").alias("x")).select(
            "sig", "x.h", "x.n", (F.col("x.c") < -COMMON).alias("common")), "asked")
    ask = asked.groupBy("h").agg(F.max("common").alias("common"))
    told = told.join(ask, "h")
    kinds = told.groupBy("src").agg(F.xxhash64(F.sort_array(F.collect_list("h"))).alias("kind"), F.xxhash64(F.sort_array(F.collect_list(F.when(F.col("common"), F.col("h"))))).alias("common_kind"))
    kinds = scratch.keep(kinds, "kinds")
    told = scratch.keep(told.join(_two_least(kinds, "kind", "src", scratch).select("src").distinct(), "src", "left_semi").select("src", "h", "common"), "told")
    rare = asked.filter("NOT common").select("sig", "h", "n").join(told.select("h", "src"), "h").groupBy("sig", "src").agg(F.sum("n").alias("n"))
    rare = scratch.keep(rare, "rare")
    frequent = asked.filter("common").select("sig", "h", "n")
    also = rare.select("sig", "src").join(frequent, "sig").join(told.filter("common").select("src", "h"), ["src", "h"]).select("sig", "src", "n")
    few = _two_least(kinds, "common_kind", "src", scratch).select("src").distinct()
    alone = frequent.join(told.filter("common").join(few, "src", "left_semi").select("h", "src"), "h").groupBy("sig", "src").agg(F.sum("n").alias("n"))
    rest = rare.unionByName(also).groupBy("sig", "src").agg(F.sum("n").alias("n")).unionByName(alone)
    best = _first_two(rest.groupBy("sig", "src").agg(F.max("n").alias("n")), "sig", F.col("n").desc(), "src")
    best = best.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "src"))).alias("two"))
    one, two = (F.get("two", F.lit(k))["src"] for k in (0, 1))
    return sets.join(best, "sig").select(
        "conv_id", "pos", "n_far", F.when(one.eqNullSafe(F.col("conv_id")), two).otherwise(one).alias("source_conv_id"))


def links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, n_quoted, n_linked, parent, source_conv_id): where each quoting message's passages come from."""
    cut = rows.select("conv_id", "pos", F.posexplode(passages(F.col("lines"))).alias("k", "p"))
    cut = cut.select(
        "conv_id", "pos", "k", "p.level", F.xxhash64(F.array_join("p.lines", " ")).alias("passage"),
        F.transform("p.lines", lambda x: F.xxhash64(x)).alias("hs"))
    said = cut.filter("level = 0").select("conv_id", "pos", F.explode(F.array_distinct(F.concat(F.array("passage"), "hs"))).alias("h"))
    own = scratch.keep(said.groupBy("conv_id", "h").agg(F.min("pos").alias("first")), "own")
    unit = lambda h, whole, n: F.struct(h.alias("h"), F.lit(whole).alias("whole"), n.alias("n"))
    singly = F.when(F.size("hs") > 1, F.transform("hs", lambda h: unit(h, False, F.lit(1)))).otherwise(F.array())
    units = cut.filter("level > 0").select(
        "conv_id", "pos", "k", "level", F.inline(F.concat(F.array(unit(F.col("passage"), True, F.size("hs"))), singly)))
    units = units.groupBy("conv_id", "pos", "k", "level", "whole", "h").agg(F.sum("n").alias("n"))
    o = own.select(F.col("conv_id").alias("oc"), F.col("h").alias("oh"), "first")
    near = units.join(
        o, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("h") == F.col("oh")) & (F.col("first") < F.col("pos")),
        "left").select("conv_id", "pos", "k", "level", "whole", "h", "n", "first")
    passage = Window.partitionBy("conv_id", "pos", "k")
    found = near.withColumn("as_whole", F.max(F.when(F.col("whole"), F.col("first"))).over(passage)).withColumn(
        "any", F.max("first").over(passage)).withColumn("units", F.count("*").over(passage))
    found = scratch.keep(found, "found")
    votes = found.filter("CASE WHEN as_whole IS NOT NULL OR units = 1 THEN whole ELSE NOT whole END")
    per = votes.groupBy("conv_id", "pos", "first").agg(F.min("level").alias("level"), F.sum("n").alias("n"))
    best = per.groupBy("conv_id", "pos").agg(
        F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("first").isNotNull(), F.col("n")).otherwise(0)).alias("n_near"),
        F.max(F.when(F.col("first").isNotNull(), F.struct(-F.col("level"), "n", "first"))).alias("top"))
    away = found.filter("as_whole IS NULL AND first IS NULL AND (any IS NULL OR NOT whole)")
    far = sources(away.select("conv_id", "pos", "k", "whole", "h", "n"), own, scratch)
    f = far.select(F.col("conv_id").alias("sc"), F.col("pos").alias("sp"), "n_far", "source_conv_id")
    best = best.join(f, F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("pos") == F.col("sp")), "left")
    return best.select(
        "conv_id", "pos", "n_quoted", (F.col("n_near") + F.coalesce("n_far", F.lit(0))).alias("n_linked"),
        F.col("top.first").alias("parent"), "source_conv_id")


def _paths(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, run, path) from (conv_id, run, parent, up): the steps from the conversation's start to each run."""
    step = F.struct((-F.coalesce("parent", F.lit(0))).alias("back"), F.col("run").alias("at"))
    cur = scratch.keep(runs.select("conv_id", "run", "up", F.array(step).alias("path")), "runs")
    while cur.filter("up IS NOT NULL").limit(1).count():
        above = cur.select(F.col("conv_id").alias("c2"), F.col("run").alias("r2"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        joined = cur.join(above, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("r2")), "left")
        done, cur = cur, scratch.keep(
            joined.select("conv_id", "run", F.col("up2").alias("up"),
                F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path")),
            "runs")
        scratch.drop(done)
    return cur.drop("up")


def ordered(conversations: DataFrame) -> DataFrame:
    """A row for each message: conv_id, reply_order, turn, role, reply_to (turn), n_quoted, n_linked, source_conv_id, text."""
    scratch = Scratch(conversations.sparkSession)
    groups = Groups(conversations.select("conv_id"), "conv_id", scratch)
    rows = messages(conversations, groups)
    found = links(rows, scratch)
    f = found.select(F.col("conv_id").alias("fc"), F.col("pos").alias("fp"), "n_quoted", "n_linked", "parent", "source_conv_id")
    linked = rows.join(f, F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("pos") == F.col("fp")), "left")
    linked = linked.select(
        "conv_id", "pos", "turn", "role", unquoted(F.col("lines")).alias("text"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "parent", "source_conv_id")
    starts = (F.col("pos") == 1) | (F.col("parent") < F.col("pos") - 1)
    msgs = scratch.keep(groups.last_marked(linked, "pos", F.coalesce(starts, F.lit(False)), "run"), "messages")
    heads = msgs.filter("run = pos").select("conv_id", "run", F.when(F.col("pos") > 1, F.col("parent")).alias("parent"))
    place = msgs.select(F.col("conv_id").alias("pc"), F.col("pos").alias("pp"), F.col("run").alias("up"), F.col("turn").alias("parent_turn"))
    runs = heads.join(
        place, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("parent") == F.col("pp")), "left").select(
        "conv_id", "run", "parent", "up")
    paths = _paths(runs, scratch).select(F.col("conv_id").alias("xc"), F.col("run").alias("xr"), "path")
    out = msgs.join(paths, F.col("conv_id").eqNullSafe(F.col("xc")) & (F.col("run") == F.col("xr")))
    answers = F.when(F.col("pos") > 1, F.coalesce("parent", F.col("pos") - 1))
    out = out.withColumn("answers", answers).join(place, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("answers") == F.col("pp")), "left")
    out = groups.numbered(out.drop("pc", "pp", "up", "xc", "xr"), [F.col("path"), F.col("pos")], "reply_order")
    return out.select(
        "conv_id", F.col("reply_order").cast("long").alias("reply_order"), "turn", "role",
        F.col("parent_turn").alias("reply_to"), F.col("n_quoted").cast("long").alias("n_quoted"),
        F.col("n_linked").cast("long").alias("n_linked"), "source_conv_id", "text")
