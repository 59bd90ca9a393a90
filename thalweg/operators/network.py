"""River networks: linking segments, traversal, order, graphs with shared junctions, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import Endless, drop, fixpoint, keep, together, walk

OUTLET = 0


class InvalidNetwork(ValueError):
    """The records break a rule that the operators rely on."""


def link(ends: DataFrame, strict: bool = True) -> DataFrame:
    """(cat, tostream) from end points (cat, x1, y1, x2, y2): a segment drains into the one that starts at its end.

    No match drains off the map (0). Several matches diverge: an error if strict, else the smallest cat.
    """
    heads = ends.groupBy(F.col("x1").alias("hx"), F.col("y1").alias("hy")).agg(F.min("cat").alias("to"), F.count("*").alias("n"))
    out = ends.join(heads, (F.col("x2") == F.col("hx")) & (F.col("y2") == F.col("hy")), "left").select(
        "cat", F.coalesce("to", F.lit(OUTLET)).cast("long").alias("tostream"), F.coalesce("n", F.lit(0)).alias("n"))
    if strict and (bad := out.filter("n > 1").select("cat").limit(5).collect()):
        raise InvalidNetwork(f"diverging: several segments start where {sorted(r.cat for r in bad)} end")
    return out.select("cat", "tostream")


def link_rounded(ends: DataFrame, digits: int = 2) -> DataFrame:
    """As `link`, end points matched after rounding, a segment never to itself, the largest cat of several."""
    k = lambda c: F.round(c, digits)
    heads = ends.select(k("x1").alias("hx"), k("y1").alias("hy"), F.col("cat").alias("to"))
    j = ends.join(heads, (k("x2") == F.col("hx")) & (k("y2") == F.col("hy")) & (F.col("to") != F.col("cat")), "left")
    return j.groupBy("cat").agg(F.coalesce(F.max("to"), F.lit(OUTLET)).cast("long").alias("tostream"))


def headwaters(seg: DataFrame) -> DataFrame:
    """Segments that none drains into."""
    return seg.join(seg.select(F.col("tostream").alias("_t")).distinct(), F.col("cat") == F.col("_t"), "left_anti")


def distances(seg: DataFrame) -> DataFrame:
    """(cat, s, depth, root): length and segments from each upstream end to the outlet, by pointer doubling.

    Every round doubles the hop, so rounds grow with the logarithm of the deepest path. A cycle raises.
    """
    start = seg.select(
        "cat", F.nullif("tostream", F.lit(OUTLET)).alias("next"), F.col("len").cast("double").alias("s"),
        F.lit(1).cast("long").alias("depth"), F.col("cat").alias("root"))

    def step(cur: DataFrame) -> DataFrame:
        to = cur.select(
            F.col("cat").alias("c2"), F.col("next").alias("n2"), F.col("s").alias("s2"), F.col("depth").alias("d2"),
            F.col("root").alias("r2"))
        moved = cur.filter("next IS NOT NULL").join(to, F.col("next") == F.col("c2"), "left")
        moved = moved.select(
            "cat", F.col("n2").alias("next"), (F.col("s") + F.coalesce("s2", F.lit(0.0))).alias("s"),
            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root"))
        return cur.filter("next IS NULL").unionByName(moved)

    rounds = max(2, seg.count().bit_length() + 1)  # no path without a cycle is longer than the segments are many
    return fixpoint(start, step, "next IS NOT NULL", rounds).select("cat", "s", "depth", "root")


def vertex_distances(v: DataFrame, seg: DataFrame) -> DataFrame:
    """(cat, seq, s): each vertex's distance to the outlet; v: (cat, seq, s_up), seg: (cat, tostream, len)."""
    foot = distances(seg).join(seg.select("cat", "len"), "cat").select("cat", (F.col("s") - F.col("len")).alias("_foot"))
    return v.join(foot, "cat").select("cat", "seq", (F.col("_foot") + F.col("s_up")).alias("s"))


def ancestors(seg: DataFrame, cat: int) -> DataFrame:
    """The segment and all that drain into it (cat, level), level 0 first: steps to it, by doubling."""
    up = F.when((F.col("cat") != cat) & (F.col("tostream") != OUTLET), F.col("tostream"))
    start = seg.select("cat", up.alias("next"), up.isNotNull().cast("int").alias("level"), F.col("cat").alias("root"))

    def step(cur: DataFrame) -> DataFrame:
        to = cur.select(F.col("cat").alias("c2"), F.col("next").alias("n2"), F.col("level").alias("l2"), F.col("root").alias("r2"))
        moved = cur.filter("next IS NOT NULL").join(to, F.col("next") == F.col("c2"), "left")
        moved = moved.select(
            "cat", F.col("n2").alias("next"), (F.col("level") + F.coalesce("l2", F.lit(0))).alias("level"),
            F.coalesce("r2", "root").alias("root"))
        return cur.filter("next IS NULL").unionByName(moved)

    return fixpoint(start, step, "next IS NOT NULL").filter(F.col("root") == cat).select("cat", "level")


def downstream_paths(seg: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, ord, cat) of the path from each head to the outlet; a cycle raises."""
    steps = seg.filter(F.col("tostream") != OUTLET).select(F.col("cat").alias("node"), F.col("tostream").alias("to"))
    try:
        path = walk(steps, heads.select(F.col("cat").alias("start")))
    except Endless as e:
        raise InvalidNetwork("a path does not end: the network has a cycle") from e
    return path.select(F.col("start").alias("head"), F.col("i").alias("ord"), F.col("node").alias("cat"))


def profile_distance(paths: DataFrame, seg: DataFrame) -> DataFrame:
    """(head, ord, cat, len, s): distance from each segment's upstream end to the path's mouth."""
    w = Window.partitionBy("head").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    return paths.join(seg.select("cat", "len"), "cat").select("head", "ord", "cat", "len", F.sum("len").over(w).alias("s"))


def assemble_profile(paths: DataFrame, v: DataFrame, values: list[str]) -> DataFrame:
    """Vertices of each path upstream to downstream (head, i, cat, s, values), s from the mouth.

    v: (cat, seq, s_up, values), s_up the distance to the segment's downstream end. The first vertex of
    every segment but the path's first repeats the one before and goes.
    """
    length = v.groupBy("cat").agg(F.max("s_up").alias("_len"))
    w = Window.partitionBy("head").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    p = paths.join(length, "cat").withColumn("_below", F.coalesce(F.sum("_len").over(w), F.lit(0.0)))
    j = p.join(v, "cat").withColumn(
        "_first", F.row_number().over(Window.partitionBy("head", "ord").orderBy("seq")) == 1).filter(
        "ord = 0 OR NOT _first")
    i = F.row_number().over(Window.partitionBy("head").orderBy("ord", "seq")) - 1
    return j.select("head", i.alias("i"), "cat", (F.col("_below") + F.col("s_up")).alias("s"), *values)


def strahler(seg: DataFrame) -> DataFrame:
    """(cat, ord): 1 at headwaters; below, the largest order that flows in, one more if it flows in twice.

    By tree contraction. A segment with all but one of its donors known is a function of the last one's
    order x, which has the form `low` if x < at, else max(low + 1, x); such functions compose to the same
    form, so chains of them shorten by half each round while known segments are taken in by those below.
    Rounds grow with the logarithm of the number of segments, however long the chains are. A round writes one
    table of the segments still open and those that have just become known.
    """
    donors = seg.filter(F.col("tostream") != OUTLET).groupBy(F.col("tostream").alias("t")).agg(
        F.count("*").alias("need"), F.sum("cat").alias("left"))
    none = F.lit(None).cast("int")
    cur = keep(seg.join(donors, F.col("cat") == F.col("t"), "left").select(
        "cat", "tostream", F.coalesce("need", F.lit(0)).cast("int").alias("need"), F.coalesce("left", F.lit(0)).alias("left"),
        F.lit(0).alias("top"), F.lit(0).alias("times"), F.when(F.col("need").isNull(), 1).alias("ord"),
        F.lit(None).cast(seg.schema["cat"].dataType).alias("child"), none.alias("at"), none.alias("low")), "order")
    rounds, tables = 4 * max(2, seg.count().bit_length() + 1), []
    while True:
        tables.append(cur)
        known = cur.filter("ord IS NOT NULL")
        done = together(tables).filter("ord IS NOT NULL").select("cat", "ord")
        if not cur.filter("ord IS NULL").limit(1).count():
            return done
        if not (rounds := rounds - 1):
            raise InvalidNetwork("the network has a cycle")
        # donors that have just become known, taken in by what they drain into
        given = known.filter(F.col("tostream") != OUTLET).groupBy(F.col("tostream").alias("t"), F.col("ord").alias("o")).agg(
            F.count("*").cast("int").alias("n"), F.sum("cat").alias("ids"))
        given = given.groupBy("t").agg(
            F.sum("n").cast("int").alias("came"), F.sum("ids").alias("ids"), F.max(F.struct("o", "n")).alias("m"))
        # what the segment that a function waits for has become: known, or a function itself
        c = done.select(F.col("cat").alias("c2"), F.col("ord").alias("o2")).unionByName(cur.filter("ord IS NULL AND child IS NOT NULL").select(
            F.col("cat").alias("c2"), F.col("child").alias("ch2"), F.col("at").alias("at2"), F.col("low").alias("low2")), allowMissingColumns=True)
        t = cur.filter("ord IS NULL").join(given, F.col("cat") == F.col("t"), "left").join(c, F.col("child") == F.col("c2"), "left")
        o, n = F.col("m.o"), F.col("m.n")
        times = F.when(o.isNull() | (o < F.col("top")), F.col("times")).when(o > F.col("top"), n).otherwise(F.col("times") + n)
        t = t.withColumns({"times": times, "top": F.greatest("top", F.coalesce(o, F.lit(0))),
            "need": F.col("need") - F.coalesce("came", F.lit(0)), "left": F.col("left") - F.coalesce("ids", F.lit(0))})
        twice = (F.col("times") >= 2).cast("int")
        waits = F.col("child").isNotNull()
        x = F.coalesce("o2", "low2")  # what a composed function gives below its own step
        value = F.when(x < F.col("at"), F.col("low")).otherwise(F.greatest(F.col("low") + 1, x))
        above = F.col("low2") + 1  # the inner function gives max(above, x) from at2 on
        step_at = F.when(above < F.col("at"), F.col("at")).when(
            (F.col("low2") >= F.col("at")) & (F.col("low2") <= F.col("low")), value + 1).otherwise(F.col("at2"))
        ord_ = F.when(F.col("need") == 0, F.col("top") + twice).when(waits & F.col("o2").isNotNull(), value)
        both = waits & F.col("o2").isNull() & F.col("ch2").isNotNull()
        fresh = ~waits & (F.col("need") == 1)
        nxt = t.select(
            "cat", "tostream", "need", "left", "top", "times", ord_.alias("ord"),
            F.when(both, F.col("ch2")).when(fresh, F.col("left")).otherwise(F.col("child")).alias("child"),
            F.when(both, step_at).when(fresh, F.col("top") + 2 * twice).otherwise(F.col("at")).alias("at"),
            F.when(both, value).when(fresh, F.col("top") + twice).otherwise(F.col("low")).alias("low"))
        cur = keep(nxt, "order")


def upstream_sum(seg: DataFrame, value: str) -> DataFrame:
    """(cat, total): value summed over each segment and all that drain into it, by doubling."""
    start = seg.select("cat", F.nullif("tostream", F.lit(OUTLET)).alias("next"), F.col(value).cast("double").alias("total"))

    def step(cur: DataFrame) -> DataFrame:
        live = cur.filter("next IS NOT NULL")
        gain = live.groupBy(F.col("next").alias("gc")).agg(F.sum("total").alias("gain"))
        to = cur.select(F.col("cat").alias("c2"), F.col("next").alias("n2"))
        moved = live.join(to, F.col("next") == F.col("c2"), "left").select("cat", F.col("n2").alias("next"), "total")
        return cur.filter("next IS NULL").unionByName(moved).join(gain, F.col("cat") == F.col("gc"), "left").select(
            "cat", "next", (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"))

    return fixpoint(start, step, "next IS NOT NULL").select("cat", "total")


def select_paths(seg: DataFrame, cat: int, direction: str = "downstream") -> DataFrame:
    """(head, ord, cat): the path from a segment to the outlet, or from each headwater above it down to it."""
    if not seg.filter(F.col("cat") == cat).limit(1).count():
        raise InvalidNetwork(f"no segment {cat}")
    if direction == "downstream":
        return downstream_paths(seg, seg.filter(F.col("cat") == cat))
    if direction != "upstream":
        raise ValueError("direction must be downstream or upstream")
    inside = seg.join(ancestors(seg, cat).select("cat"), "cat", "left_semi").withColumn(
        "tostream", F.when(F.col("cat") == cat, OUTLET).otherwise(F.col("tostream")))
    return downstream_paths(inside, headwaters(inside))


def cycles(seg: DataFrame) -> DataFrame:
    """Segments whose way down doesn't end, whether they lie on a circle or drain into one."""
    steps = seg.select(F.col("cat").alias("node"), F.nullif("tostream", F.lit(OUTLET)).alias("to"))
    hop = keep(steps, "hop")
    for _ in range(max(2, seg.count().bit_length() + 1)):  # no way down is longer than the segments are many
        on = hop.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
        hop, done = keep(hop.filter("to IS NOT NULL").join(on, F.col("to") == F.col("n2")).select("node", F.col("t2").alias("to")), "hop"), hop
        drop(done)
    return seg.join(hop.filter("to IS NOT NULL").select(F.col("node").alias("cat")), "cat", "left_semi")


def build_graph(v: DataFrame, tostream: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): junction values move to the upstream node, the last vertex goes unless the segment leaves the map.

    v: (cat, seq, values); tostream: (cat, tostream). nodes: (id, values as arrays, the outlet with nulls, but 0
    for the distances s and s_upstream); edges: (src, dst, cat, seq, values). Raises if nothing drains off the map.
    """
    if not tostream.filter(F.col("tostream") == OUTLET).limit(1).count():
        raise InvalidNetwork("no segment drains off the map")
    ends = v.withColumn("_last", F.max("seq").over(Window.partitionBy("cat"))).withColumn(
        "_firsts", F.min("seq").over(Window.partitionBy("cat")))
    j = ends.join(tostream, "cat")
    nodes = j.filter("seq = _firsts").select(F.col("cat").alias("id"), *(F.array(c).alias(c) for c in values))
    outlet = v.sparkSession.range(1).select(
        F.lit(OUTLET).cast("long").alias("id"),
        *(F.array(F.lit(0 if c in ("s", "s_upstream") else None).cast(v.schema[c].dataType)).alias(c) for c in values))
    edges = j.filter(f"seq > _firsts AND (seq < _last OR tostream = {OUTLET})").select(
        F.col("cat").alias("src"), F.col("tostream").alias("dst"), "cat", "seq", *values)
    return nodes.unionByName(outlet), edges


def offmap_inflow(v: DataFrame) -> DataFrame:
    """Segments whose first vertex has negative accumulation: water comes from outside."""
    return v.groupBy("cat").agg(F.min_by("A", "seq").alias("a0")).filter("a0 < 0").select("cat")


def validate(v: DataFrame, assume_complete: bool = False) -> tuple[DataFrame, int]:
    """Vertices with A made positive, and the number with no elevation; missing A raises, as does inflow from off the map unless accepted."""
    missing = v.filter("A IS NULL OR isnan(A)").select("cat").distinct().limit(20).collect()
    if missing:
        raise InvalidNetwork(f"no accumulation on some vertices of {sorted(r.cat for r in missing)}")
    if not assume_complete and (cats := offmap_inflow(v).limit(20).collect()):
        raise InvalidNetwork(f"inflow from off the map into {sorted(r.cat for r in cats)}")
    return v.withColumn("A", F.abs("A")), v.filter("z IS NULL OR isnan(z)").count()


def check_acyclic(seg: DataFrame) -> None:
    """Raises if a path does not end."""
    distances(seg.withColumn("len", F.lit(1.0)))
