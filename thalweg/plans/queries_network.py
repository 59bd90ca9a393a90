"""Queries over networks, grids, divides, heads and validation data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import divides as D
from ..operators import evaluate as E
from ..operators import heads as H
from ..operators import incision as I
from ..operators import kernels as K
from ..operators import metrics as M
from ..operators import network as N
from ..operators import routing as R
from ..operators import sequence as S
from ..operators import spill as P
from .iterate import keep
from .views import SQL, cells, points, segments, side, sql, table, vertices

Q: dict = {}
O: dict = {}

def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f
    return add


# ---- networks

ENDS = ", ends AS (SELECT c_custkey AS cat, c_custkey % 1000 AS x1, c_custkey // 1000 AS y1, (c_custkey // 2) % 1000 AS x2, (c_custkey // 2) // 1000 AS y2 FROM customer WHERE c_custkey > 0)"


def ends(spark, d):
    k, h = F.col("c_custkey"), F.expr("c_custkey div 2")
    return table(spark, d, "customer").filter("c_custkey > 0").select(k.alias("cat"), (k % 1000).alias("x1"), F.expr("c_custkey div 1000").alias("y1"), (h % 1000).alias("x2"), F.expr("(c_custkey div 2) div 1000").alias("y2"))


@query("j1_link_endpoints", "WITH" + ENDS[1:] + " SELECT a.cat, coalesce(b.cat, 0) AS tostream FROM ends a LEFT JOIN ends b ON a.x2 = b.x1 AND a.y2 = b.y1")
def j1(spark, d):
    return N.link(ends(spark, d))


@query("j3_link_rounded", "WITH" + ENDS[1:] + " SELECT a.cat, coalesce(max(b.cat), 0) AS tostream FROM ends a LEFT JOIN ends b ON round(a.x2 / 7.0, 2) = round(b.x1 / 7.0, 2) AND round(a.y2 / 7.0, 2) = round(b.y1 / 7.0, 2) AND a.cat <> b.cat GROUP BY a.cat")
def j3(spark, d):
    e = ends(spark, d)
    return N.link_rounded(e.select("cat", *((F.col(c) / 7.0).alias(c) for c in ("x1", "y1", "x2", "y2"))))


DOWN = ", down(cat, at_, s, depth) AS (SELECT cat, cat, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM segments UNION ALL SELECT d.cat, g.tostream, d.s + g.len, d.depth + 1 FROM down d JOIN segments g ON g.cat = d.at_)"


@query("g1_distance_to_outlet", sql(DOWN + " SELECT cat, CAST(s AS DOUBLE) AS s, depth FROM down WHERE at_ = 0", "segments", recursive=True))
def g1(spark, d):
    return N.distances(segments(spark, d)).select("cat", "s", "depth")


@query("g2_bfs_upstream", sql(", up(cat, level) AS (SELECT cat, 0 FROM segments WHERE cat = 5 UNION ALL SELECT s.cat, level + 1 FROM up JOIN segments s ON s.tostream = up.cat) SELECT cat, level FROM up", "segments", recursive=True))
def g2(spark, d):
    return N.ancestors(segments(spark, d), 5)


@query("g3_upstream_subnetwork", sql(", up(cat) AS (SELECT CAST(3 AS BIGINT) UNION ALL SELECT s.cat FROM up JOIN segments s ON s.tostream = up.cat) SELECT segments.* FROM segments JOIN up USING (cat)", "segments", recursive=True))
def g3(spark, d):
    seg = segments(spark, d)
    return seg.join(N.ancestors(seg, 3).select("cat"), "cat", "left_semi")


@query("g4_downstream_path", sql(", p(cat, ord) AS (SELECT max(cat), 0 FROM segments UNION ALL SELECT tostream, ord + 1 FROM p JOIN segments USING (cat) WHERE tostream > 0) SELECT CAST(ord AS INT) AS ord, cat FROM p", "segments", recursive=True))
def g4(spark, d):
    seg = segments(spark, d)
    return N.downstream_paths(seg, seg.agg(F.max("cat").alias("cat"))).select("ord", "cat")


_levels = "".join(f", l{i} AS (SELECT s.cat, s.tostream, CASE WHEN k.top IS NULL THEN 1 WHEN k.n >= 2 THEN k.top + 1 ELSE k.top END AS ord FROM segments s LEFT JOIN (SELECT tostream, max(ord) AS top, count(*) FILTER (ord = m) AS n FROM (SELECT *, max(ord) OVER (PARTITION BY tostream) AS m FROM l{i - 1}) GROUP BY tostream) k ON k.tostream = s.cat)" for i in range(1, 16))


@query("g5_strahler_order", sql(", l0 AS (SELECT cat, tostream, 1 AS ord FROM segments)" + _levels + " SELECT cat, CAST(ord AS INT) AS ord FROM l15", "segments"))
def g5(spark, d):
    return N.strahler(segments(spark, d))


@query("g6_headwaters", sql(" SELECT cat, tostream, len FROM segments a WHERE NOT EXISTS (SELECT 1 FROM segments b WHERE b.tostream = a.cat)", "segments"))
def g6(spark, d):
    return N.headwaters(segments(spark, d))


@query("g6_path_selection", sql(", h AS (SELECT cat FROM segments a WHERE NOT EXISTS (SELECT 1 FROM segments b WHERE b.tostream = a.cat)), p(head, ord, cat) AS (SELECT cat, 0, cat FROM h UNION ALL SELECT head, ord + 1, tostream FROM p JOIN segments USING (cat) WHERE cat <> 3 AND tostream > 0), e AS (SELECT head, max(ord) AS n FROM p WHERE cat = 3 GROUP BY head) SELECT head, CAST(ord AS INT) AS ord, cat FROM p JOIN e USING (head) WHERE ord <= n", "segments", recursive=True))
def g6_paths(spark, d):
    return N.select_paths(segments(spark, d), 3, "upstream")


@query("x2_cycles", sql(", t AS (SELECT cat, CASE WHEN cat % 700 = 5 THEN cat * 2 + 1 ELSE tostream END AS tostream FROM segments), ok(cat) AS (SELECT cat FROM t WHERE tostream = 0 OR tostream NOT IN (SELECT cat FROM t) UNION SELECT t.cat FROM ok JOIN t ON t.tostream = ok.cat) SELECT cat, tostream FROM t WHERE cat NOT IN (SELECT cat FROM ok)", "segments", recursive=True))
def x2(spark, d):
    t = segments(spark, d).select("cat", F.when(F.col("cat") % 700 == 5, F.col("cat") * 2 + 1).otherwise(F.col("tostream")).alias("tostream"))
    return N.cycles(t)


@query("g7_graph_edges", sql(", v AS (SELECT *, max(seq) OVER (PARTITION BY cat) AS last, CASE WHEN cat % 10 = 0 THEN 0 ELSE cat // 2 END AS dst FROM vertices WHERE cat > 0) SELECT cat AS src, dst, cat, CAST(seq AS INT) AS seq, z FROM v WHERE seq > 0 AND (seq < last OR dst = 0)", "vertices"))
def g7(spark, d):
    v = vertices(spark, d).filter("cat > 0")
    to = v.select("cat").distinct().select("cat", F.when(F.col("cat") % 10 == 0, 0).otherwise(F.expr("cat div 2")).cast("long").alias("tostream"))
    return N.build_graph(v.select("cat", "seq", "z"), to, ["z"])[1]


@query("io22_subnetwork", sql(", v AS (SELECT *, max(seq) OVER (PARTITION BY cat) AS last, CASE WHEN cat % 10 = 0 THEN 0 ELSE cat // 2 END AS dst FROM vertices WHERE cat > 0), e AS (SELECT cat AS src, dst, cat, CAST(seq AS INT) AS seq, z FROM v WHERE seq > 0 AND (seq < last OR dst = 0)) SELECT * FROM e WHERE src % 3 < 2 AND (dst % 3 < 2 AND dst IN (SELECT cat FROM v) OR dst = 0)", "vertices"))
def io22(spark, d):
    from ..sources.network import subnetwork

    v = vertices(spark, d).filter("cat > 0")
    to = v.select("cat").distinct().select("cat", F.when(F.col("cat") % 10 == 0, 0).otherwise(F.expr("cat div 2")).cast("long").alias("tostream"))
    return subnetwork(*N.build_graph(v.select("cat", "seq", "z"), to, ["z"]), to.filter("cat % 3 < 2"))[1]


@query("x16_coverage", sql(", up(cat, anc) AS (SELECT cat, cat FROM segments UNION ALL SELECT s.tostream, anc FROM up JOIN segments s ON s.cat = up.cat WHERE s.tostream > 0), n AS (SELECT o_custkey AS cat, count(*) AS n, max(o_totalprice) AS a FROM orders GROUP BY 1), t AS (SELECT up.cat, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS n_cells FROM up LEFT JOIN n ON n.cat = up.anc GROUP BY up.cat) SELECT t.cat, n.a AS max_area, n_cells, round(n_cells / greatest(1.0, n.a), 9) AS ratio FROM t JOIN n USING (cat)", "segments", recursive=True))
def x16(spark, d):
    from ..operators.diagnostics import coverage

    o = table(spark, d, "orders")
    t = coverage(segments(spark, d), o.select(F.col("o_custkey").alias("cat"), F.col("o_totalprice").alias("A")), o.select(F.col("o_custkey").alias("lab")))
    return t.select("cat", "max_area", "n_cells", F.round("ratio", 9).alias("ratio"))


@query("v2_offmap_inflow", sql(" SELECT cat FROM vertices WHERE seq = 0 AND A * (CASE WHEN cat % 9 = 4 THEN -1 ELSE 1 END) < 0", "vertices"))
def v2(spark, d):
    return N.offmap_inflow(vertices(spark, d).withColumn("A", F.when(F.col("cat") % 9 == 4, -F.col("A")).otherwise(F.col("A"))))


@query("w13_outlet_elevation", sql(", f AS (SELECT tostream AS node, min(len) AS low FROM segments GROUP BY tostream), o AS (SELECT DISTINCT tostream AS node FROM segments) SELECT o.node, CAST(low AS DOUBLE) - 0.0004 AS z FROM o JOIN f USING (node) WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.cat = o.node)", "segments"))
def w13(spark, d):
    seg = segments(spark, d)
    out = seg.groupBy(F.col("cat").alias("node")).agg(F.count("*").alias("n_out"))
    nodes = seg.select(F.col("tostream").alias("node")).distinct().join(out, "node", "left").select("node", F.lit(None).cast("double").alias("z"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    inflow = seg.select(F.col("tostream").alias("node"), F.col("len").cast("double").alias("z"))
    return S.set_outlet_elevations(nodes, inflow).filter("n_out = 0").select("node", "z")


# ---- routing

NODES = """, off(k, dr, dc, w) AS (VALUES (0, -1, 0, 1.0::DOUBLE), (1, -1, 1, 0.707106781::DOUBLE), (2, 0, 1, 1.0::DOUBLE), (3, 1, 1, 0.707106781::DOUBLE), (4, 1, 0, 1.0::DOUBLE), (5, 1, -1, 0.707106781::DOUBLE), (6, 0, -1, 1.0::DOUBLE), (7, -1, -1, 0.707106781::DOUBLE)),
cand AS (SELECT a.r, a.c, b.r * @N + b.c AS to_, k, w * (a.z - b.z) AS slope FROM cells a, off, cells b WHERE b.r = a.r + dr AND b.c = a.c + dc),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY slope DESC, k) = 1),
nodes AS (SELECT CAST(a.r * @N + a.c AS BIGINT) AS node, a.r, a.c, a.z, CAST(CASE WHEN slope > 0 THEN to_ ELSE a.r * @N + a.c END AS BIGINT) AS recv, CASE WHEN slope > 0 THEN 1 + k % 2 ELSE 0 END AS flc FROM cells a LEFT JOIN best b ON a.r = b.r AND a.c = b.c)"""
AREA = """, anc(top, node) AS (SELECT node, node FROM nodes UNION ALL SELECT a.top, n.node FROM anc a JOIN nodes n ON n.recv = a.node AND n.node <> n.recv),
area AS (SELECT top AS node, count(*) AS ncontrib FROM anc GROUP BY top), full_ AS (SELECT nodes.*, ncontrib FROM nodes JOIN area USING (node))"""
SRC = ", src AS (SELECT node, r, c FROM full_ f WHERE ncontrib >= 10 AND NOT EXISTS (SELECT 1 FROM full_ d WHERE d.recv = f.node AND d.node <> f.node AND d.ncontrib >= 10))"


def nodes(spark, d):
    return R.receivers(cells(spark, d), side(spark, d))


def routed(spark, d):
    return keep(R.accumulate(keep(nodes(spark, d), "nodes")), "routed")


@query("r2_d8_receivers", sql(NODES + " SELECT node, r, c, z, recv, CAST(flc AS INT) AS flc FROM nodes", "cells"))
def r2(spark, d):
    return nodes(spark, d)


@query("r3_receivers_from_directions", sql(""", t AS (SELECT r, c, (r * 5 + c * 3) % 11 - 2 AS d FROM cells), co(d, dr, dc) AS (VALUES (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1), (8, 0, 1))
SELECT CAST(t.r * @N + t.c AS BIGINT) AS node, CAST(coalesce(b.r * @N + b.c, t.r * @N + t.c) AS BIGINT) AS recv, CASE WHEN b.r IS NULL THEN 0 WHEN dr <> 0 AND dc <> 0 THEN 2 ELSE 1 END AS flc FROM t LEFT JOIN co ON co.d = abs(t.d) LEFT JOIN cells b ON b.r = t.r + dr AND b.c = t.c + dc""", "cells"))
def r3(spark, d):
    t = cells(spark, d).withColumn("d", (F.col("r") * 5 + F.col("c") * 3) % 11 - 2)
    return R.receivers_from_directions(t, side(spark, d)).select("node", "recv", "flc")


@query("r4_encode_directions", sql(NODES + ", co(d, dr, dc) AS (VALUES (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1), (8, 0, 1)) SELECT r, c, coalesce(d, 0) AS d FROM nodes LEFT JOIN co ON recv // @N - r = dr AND recv % @N - c = dc", "cells"))
def r4(spark, d):
    return R.directions(nodes(spark, d), side(spark, d))


@query("r5_contributing_area", sql(NODES + AREA + " SELECT node, ncontrib FROM full_", "cells", recursive=True))
def r5(spark, d):
    return routed(spark, d).select("node", "ncontrib")


@query("r7_flow_distance", sql(NODES + ", dn(node, at_, fd) AS (SELECT node, recv, CASE flc WHEN 2 THEN sqrt(2.0) WHEN 1 THEN 1.0 ELSE 0.0 END FROM nodes UNION ALL SELECT d.node, n.recv, fd + CASE n.flc WHEN 2 THEN sqrt(2.0) ELSE 1.0 END FROM dn d JOIN nodes n ON n.node = d.at_ WHERE n.recv <> n.node) SELECT node, round(max(fd), 6) AS fd FROM dn GROUP BY node", "cells", recursive=True))
def r7(spark, d):
    return routed(spark, d).select("node", F.round("fd", 6).alias("fd"))


@query("r8_sources", sql(NODES + AREA + SRC + " SELECT node, r, c FROM src", "cells", recursive=True))
def r8(spark, d):
    return R.sources(routed(spark, d), 10).select("node", "r", "c")


CHAN = AREA + """, on_ AS (SELECT * FROM full_ WHERE ncontrib >= 10), deg AS (SELECT o.node, o.recv, o.r, o.c, (SELECT count(*) FROM on_ d WHERE d.recv = o.node AND d.node <> o.node) AS indeg FROM on_ o),
walk(link, node, i) AS (SELECT node, node, 0 FROM deg WHERE indeg <> 1 UNION ALL SELECT w.link, n.recv, i + 1 FROM walk w JOIN deg n ON n.node = w.node WHERE n.recv <> n.node AND (i = 0 OR n.indeg < 2)),
lk AS (SELECT link, row_number() OVER (ORDER BY link) AS cat, arg_max(node, i) AS end_ FROM walk GROUP BY link HAVING count(*) >= 2)"""


@query("r12_network_links", sql(NODES + CHAN + " SELECT a.cat, a.link, a.end_ AS \"end\", coalesce(b.cat, 0) AS tostream FROM lk a LEFT JOIN lk b ON b.link = a.end_", "cells", recursive=True))
def r12(spark, d):
    n = routed(spark, d)
    return R.links(n, R.sources(n, 10))[1]


@query("io7_link_lines", sql(NODES + CHAN + ", t AS (SELECT a.cat, a.link, a.end_, coalesce(b.cat, 0) AS tostream FROM lk a LEFT JOIN lk b ON b.link = a.end_) SELECT cat, link % @N + 0.5::DOUBLE AS x1, @N - (link // @N) - 0.5::DOUBLE AS y1, end_ % @N + 0.5::DOUBLE AS x2, @N - (end_ // @N) - 0.5::DOUBLE AS y2, tostream FROM t", "cells", recursive=True))
def io7(spark, d):
    from ..sources.network import link_lines
    from ..sources.raster import Region

    n, size = routed(spark, d), side(spark, d)
    return link_lines(*R.links(n, R.sources(n, 10)), n, Region(0.0, float(size), 1.0, 1.0, size, size)).drop("wkt")


ORDERS = AREA + """, ch AS (SELECT node, recv FROM full_ WHERE ncontrib >= 10), ar AS (SELECT p.node, d.node AS donor FROM ch p LEFT JOIN ch d ON d.recv = p.node AND d.node <> p.node),
so(it, node, ord) AS (SELECT 0, node, 1 FROM ch UNION ALL SELECT (SELECT max(it) + 1 FROM so), node, CASE WHEN o[1] IS NULL THEN 1 WHEN o[1] = o[2] THEN o[1] + 1 ELSE o[1] END FROM (SELECT ar.node, list_sort(list(s.ord), 'DESC', 'NULLS LAST') AS o FROM ar LEFT JOIN so s ON s.node = ar.donor GROUP BY ar.node) WHERE (SELECT max(it) FROM so) < 3 * @N),
net AS (SELECT node, recv, arg_max(ord, it) AS ord FROM so JOIN ch USING (node) GROUP BY ALL), j AS (SELECT node, count(donor) <> 1 OR any_value(ch.recv) = node AS junction FROM ar JOIN ch USING (node) GROUP BY node)"""


@query("r9_stream_network", sql(NODES + ORDERS + " SELECT node, recv, CAST(max(ord) AS INT) AS ord, junction FROM net JOIN j USING (node) GROUP BY ALL", "cells", recursive=True))
def r9(spark, d):
    return H.stream_network(routed(spark, d), 10)


@query("r10_upstream_junctions", sql(NODES + AREA + """, ch AS (SELECT node, recv FROM full_ WHERE ncontrib >= 10), j AS (SELECT p.node, count(d.node) <> 1 OR any_value(p.recv) = p.node AS junction, max(d.node) AS donor FROM ch p LEFT JOIN ch d ON d.recv = p.node AND d.node <> p.node GROUP BY p.node),
u(node, at_) AS (SELECT node, node FROM j UNION ALL SELECT u.node, j.donor FROM u JOIN j ON j.node = u.at_ WHERE NOT junction) SELECT u.node, at_ AS junction FROM u JOIN j ON j.node = u.at_ WHERE j.junction""", "cells", recursive=True))
def r10(spark, d):
    return H.upstream_junctions(keep(H.stream_network(routed(spark, d), 10), "network"))


@query("r14_first_order_valleys", sql(NODES + AREA + SRC + " SELECT node, node AS junction FROM src", "cells", recursive=True))
def r14(spark, d):
    return H.first_order_valleys(routed(spark, d), 10)


@query("r6_ordered_stack", sql(NODES + AREA + """, own AS (SELECT node, recv, ncontrib, CASE WHEN recv = node THEN (sum(ncontrib) OVER (PARTITION BY recv = node ORDER BY node)) - ncontrib ELSE 1 + coalesce(sum(ncontrib) OVER (PARTITION BY recv, recv = node ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS k FROM full_),
st(node, place) AS (SELECT node, k FROM own WHERE recv = node UNION ALL SELECT o.node, place + k FROM st JOIN own o ON o.recv = st.node AND o.node <> o.recv) SELECT node, CAST(place AS BIGINT) AS place FROM st""", "cells", recursive=True))
def r6(spark, d):
    from ..operators.diagnostics import ordered_stack

    return ordered_stack(routed(spark, d))


@query("so2_heads_by_elevation", sql(NODES + AREA + SRC + " SELECT node, z, row_number() OVER (ORDER BY z DESC, node) AS place FROM src JOIN nodes USING (node)", "cells", recursive=True))
def so2(spark, d):
    n = routed(spark, d)
    return H.by_elevation(R.sources(n, 10), n)


@query("v14_mask_missing", sql(NODES + AREA + " SELECT r, c, CAST(CASE WHEN (r + c) % 5 <> 0 THEN ncontrib END AS DOUBLE) AS ncontrib FROM full_", "cells", recursive=True))
def v14(spark, d):
    n = routed(spark, d)
    return R.mask_missing(n.select("r", "c", F.col("ncontrib").cast("double").alias("ncontrib")), n.select("r", "c", F.when((F.col("r") + F.col("c")) % 5 != 0, F.col("z")).alias("z")), "ncontrib")


@query("x24_apexes", sql(NODES + AREA + SRC + """, dn(node, at_, fd) AS (SELECT node, recv, CASE flc WHEN 2 THEN sqrt(2.0) WHEN 1 THEN 1.0 ELSE 0.0 END FROM nodes UNION ALL SELECT d.node, n.recv, fd + CASE n.flc WHEN 2 THEN sqrt(2.0) ELSE 1.0 END FROM dn d JOIN nodes n ON n.node = d.at_ WHERE n.recv <> n.node), fds AS (SELECT node, max(fd) AS fd FROM dn GROUP BY node),
m AS (SELECT a.top, max(round(fd, 6)) AS far FROM anc a JOIN src ON src.node = a.top JOIN fds ON fds.node = a.node GROUP BY a.top) SELECT top AS node, round(far - fd, 5) AS flow FROM m JOIN fds ON fds.node = m.top""", "cells", recursive=True))
def x24(spark, d):
    from ..operators.diagnostics import apexes

    n = routed(spark, d)
    return apexes(n, R.sources(n, 10)).select("node", F.round("flow", 5).alias("flow"))


@query("j9_snap_to_channel", sql(NODES + AREA + ", p AS (SELECT id, x % @N AS x, y % @N AS y FROM suppliers), n AS (SELECT p.id AS id_a, f.node AS id_b, sqrt(power(p.x - f.c, 2) + power(p.y - f.r, 2)) AS d FROM p JOIN full_ f ON ncontrib BETWEEN 10 AND 100 AND sqrt(power(p.x - f.c, 2) + power(p.y - f.r, 2)) <= 6) SELECT id_a, id_b, round(d, 6) AS d FROM n QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY d, id_b) = 1", "suppliers", "cells", recursive=True))
def j9(spark, d):
    n, size = routed(spark, d), side(spark, d)
    p = points(spark, d, "supplier").select("id", (F.col("x") % size).alias("x"), (F.col("y") % size).alias("y"))
    channel = n.select(F.col("node").alias("id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "ncontrib")
    return E.snap_to_channel(p, channel, 6.0, 10, 100).select("id_a", "id_b", F.round("d", 6).alias("d"))


@query("io6_stream_raster", sql(NODES + CHAN + " SELECT CAST(w.node // @N AS INT) AS r, CAST(w.node % @N AS INT) AS c, max(cat) AS cat FROM walk w JOIN lk USING (link) GROUP BY w.node", "cells", recursive=True))
def io6(spark, d):
    n = routed(spark, d)
    at, numbered = R.links(n, R.sources(n, 10))
    return at.join(numbered, "link").groupBy("node").agg(F.max("cat").alias("cat")).select(F.expr(f"cast(node div {side(spark, d)} as int)").alias("r"), (F.col("node") % side(spark, d)).cast("int").alias("c"), "cat")


LAB = CHAN + """, own AS (SELECT w.node, max(cat) AS lab FROM walk w JOIN lk USING (link) GROUP BY w.node),
go(node, at_) AS (SELECT node, node FROM nodes UNION ALL SELECT g.node, n.recv FROM go g JOIN nodes n ON n.node = g.at_ WHERE n.recv <> n.node AND NOT EXISTS (SELECT 1 FROM own WHERE own.node = g.at_)),
lab AS (SELECT nodes.node, nodes.r, nodes.c, coalesce(max(own.lab), -1) AS lab FROM nodes JOIN go USING (node) LEFT JOIN own ON own.node = go.at_ GROUP BY ALL)"""


def labels(spark, d, n=None):
    n = routed(spark, d) if n is None else n
    return keep(R.basin_labels(n, *R.links(n, R.sources(n, 10))), "labels")


@query("r13_drainage_divides", sql(NODES + LAB + " SELECT a.r, a.c, a.lab, a.lab >= 0 AND EXISTS (SELECT 1 FROM lab b WHERE abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 AND b.lab >= 0 AND b.lab <> a.lab) AS divide FROM lab a", "cells", recursive=True))
def r13(spark, d):
    return R.divides(labels(spark, d))


@query("r20_upslope_sets", sql(NODES + AREA + " SELECT top, node FROM anc", "cells", recursive=True))
def r20(spark, d):
    n = keep(nodes(spark, d), "nodes")
    return R.ancestor_closure(n, n)


@query("r19_trace_down", sql(NODES + ", w(start, i, node) AS (SELECT node, 0, node FROM nodes UNION ALL SELECT start, i + 1, n.recv FROM w JOIN nodes n ON n.node = w.node WHERE n.recv <> n.node AND i < 500) SELECT start, CAST(i AS INT) AS i, node FROM w", "cells", recursive=True))
def r19(spark, d):
    n = routed(spark, d)
    return R.walk_down(n, n).select("start", "i", "node")


@query("r17_nearest_drainage", sql(NODES + AREA + """, go(node, at_) AS (SELECT node, node FROM full_ UNION ALL SELECT g.node, n.recv FROM go g JOIN full_ n ON n.node = g.at_ WHERE n.recv <> n.node AND n.ncontrib < 10),
e AS (SELECT g.node, f.node AS drain, f.z FROM go g JOIN full_ f ON f.node = g.at_ WHERE f.ncontrib >= 10) SELECT n.node, drain, n.z - e.z AS height FROM nodes n LEFT JOIN e USING (node)""", "cells", recursive=True))
def r17(spark, d):
    n = routed(spark, d)
    return R.nearest_drainage(n, n.filter("ncontrib >= 10")).select("node", "drain", "height")


@query("x4_descent_slope", sql(NODES + " SELECT a.node, round((a.z - b.z) / CASE a.flc WHEN 2 THEN sqrt(2.0) ELSE 1 END, 6) AS slope FROM nodes a JOIN nodes b ON b.node = a.recv WHERE a.recv <> a.node", "cells"))
def x4(spark, d):
    from ..operators.diagnostics import descent_slopes

    return descent_slopes(nodes(spark, d)).select("node", F.round("slope", 6).alias("slope"))


@query("x20_giver_receiver", sql(NODES + " SELECT CAST(c * @N + r AS BIGINT) AS giver, CAST((recv % @N) * @N + recv // @N AS BIGINT) AS receiver FROM nodes WHERE recv <> node", "cells"))
def x20(spark, d):
    from ..operators.diagnostics import givers

    n = side(spark, d)
    return givers(nodes(spark, d), n, n)


@query("ag2_donor_count", sql(NODES + " SELECT recv AS node, count(*) AS n FROM nodes WHERE recv <> node GROUP BY recv", "cells"))
def ag2(spark, d):
    from ..operators.diagnostics import donor_counts

    return donor_counts(nodes(spark, d))


@query("ag10_block_mean", sql(" SELECT CAST(r // 5 AS INT) AS br, CAST(c // 5 AS INT) AS bc, round(avg(z), 6) AS z FROM cells WHERE r < @N // 5 * 5 AND c < @N // 5 * 5 GROUP BY r // 5, c // 5", "cells"))
def ag10(spark, d):
    return R.block_mean(cells(spark, d), 5, side(spark, d), side(spark, d)).select("br", "bc", F.round("z", 6).alias("z"))


def _curvature_sql() -> str:
    kern = R.curvature_kernels(2.0, 1.0)
    rows = ", ".join(f"({i}, {j}, {', '.join(repr(w) + '::DOUBLE' for w in ws)})" for i, j, ws in kern)
    sums = ", ".join(f"sum(b.z * k{n}) AS {n}" for n in "abxyz")
    return sql(f""", kn(dr, dc, ka, kb, kx, ky, kz) AS (VALUES {rows}), f AS (SELECT t.r, t.c, {sums} FROM cells t, kn, cells b WHERE b.r = t.r + dr AND b.c = t.c + dc GROUP BY t.r, t.c),
g AS (SELECT t.r, t.c, count(*) AS n FROM cells t JOIN cells b ON abs(b.r - t.r) <= 2 AND abs(b.c - t.c) <= 2 GROUP BY t.r, t.c), p AS (SELECT f.*, n, y * y + z * z AS p FROM f JOIN g USING (r, c))
SELECT r, c, round(CASE WHEN n = 25 THEN (2 * a * z * z - 2 * x * y * z + 2 * b * y * y) / nullif(p * sqrt(p + 1), 0) END, 5) AS curvature FROM p""", "cells")


@query("r11_tangential_curvature", _curvature_sql())
def r11(spark, d):
    return R.tangential_curvature(cells(spark, d), 2.0, 1.0).select("r", "c", F.round("curvature", 5).alias("curvature"))


@query("ag11_curvature_quantile", _curvature_sql().replace("SELECT r, c, round(", "SELECT round(quantile_cont(").replace(", 5) AS curvature FROM p", ", 0.9), 5) AS threshold FROM p"))
def ag11(spark, d):
    return R.curvature_threshold(R.tangential_curvature(cells(spark, d), 2.0, 1.0), 0.9).select(F.round("threshold", 5).alias("threshold"))


FILL_LEVEL = sql(""", p AS (SELECT r, c, r * @N + c AS node, CASE WHEN (r * 7 + c * 3) % 17 = 0 THEN z - 300 ELSE z END AS z FROM cells), adj AS (SELECT a.node, a.z, b.node AS nb FROM p a JOIN p b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.node <> b.node),
lv(node, lvl) USING KEY (node) AS (SELECT node, z FROM adj GROUP BY node, z HAVING count(*) < 8 UNION SELECT a.node, min(greatest(a.z, lv.lvl)) FROM lv JOIN adj a ON a.nb = lv.node LEFT JOIN recurring.lv AS old ON old.node = a.node WHERE old.lvl IS NULL OR greatest(a.z, lv.lvl) < old.lvl GROUP BY a.node)
SELECT p.r, p.c, p.z, coalesce(lvl, p.z) AS filled FROM p LEFT JOIN lv USING (node)""", "cells", recursive=True)


def pitted(spark, d):
    return cells(spark, d).withColumn("z", F.when((F.col("r") * 7 + F.col("c") * 3) % 17 == 0, F.col("z") - 300).otherwise(F.col("z")))


@query("r1_fill_level", FILL_LEVEL)
def r1(spark, d):
    return R.fill_flat(pitted(spark, d))


@query("r1_fill_by_passes", FILL_LEVEL)
def r1p(spark, d):
    return P.fill_by_passes(pitted(spark, d), side(spark, d), tile=64)


@query("r1_fill_gradient")
def r1g(spark, d):
    return P.fill_by_passes(pitted(spark, d), side(spark, d), 0.01, tile=64)


@query("e1_evolve")
def e1(spark, d):
    return I.evolve_tiled(cells(spark, d), 2, side(spark, d), cellsize=10.0)


def eroding(spark, d):
    """Routed terrain with pits dug into it after the water has found its way, and the erosion of each cell."""
    z = F.when((F.col("r") * 5 + F.col("c") * 3) % 11 == 0, F.col("z") - 60).otherwise(F.col("z"))
    step = F.when(F.col("flc") == 2, F.sqrt(F.lit(2.0))).otherwise(1.0)
    return routed(spark, d).select("node", "r", "c", z.alias("z"), "recv", (0.5 * F.sqrt(F.col("ncontrib").cast("double")) / step).alias("erosion"))


@query("e2_incise", sql(NODES + AREA + """, er AS (SELECT node, r, c, recv, CASE WHEN (r * 5 + c * 3) % 11 = 0 THEN z - 60 ELSE z END AS z, 0.5 * sqrt(ncontrib) / CASE flc WHEN 2 THEN sqrt(2.0) ELSE 1.0 END AS e FROM full_),
st(node, y) AS (SELECT node, z FROM er WHERE recv = node UNION ALL SELECT d.node, greatest(st.y, (d.z + d.e * st.y) / (1 + d.e)) FROM st JOIN er d ON d.recv = st.node AND d.node <> d.recv)
SELECT node, er.r, er.c, round(y, 5) AS z FROM st JOIN er USING (node)""", "cells", recursive=True))
def e2(spark, d):
    return I.incise(eroding(spark, d), side(spark, d)).withColumn("z", F.round("z", 5))


# ---- divides

EDGES = """, ed AS (SELECT CAST(a.r * @W + a.c + 1 AS BIGINT) AS a, CAST((a.r + 1) * @W + a.c + 1 AS BIGINT) AS b FROM lab a JOIN lab b ON b.r = a.r AND b.c = a.c + 1 WHERE a.lab <> b.lab
UNION ALL SELECT CAST((a.r + 1) * @W + a.c AS BIGINT), CAST((a.r + 1) * @W + a.c + 1 AS BIGINT) FROM lab a JOIN lab b ON b.r = a.r + 1 AND b.c = a.c WHERE a.lab <> b.lab)"""


@query("dv1_divide_edges", sql(NODES + LAB + EDGES + " SELECT a, b FROM ed", "cells", recursive=True))
def dv1(spark, d):
    return D.edges(labels(spark, d), side(spark, d))


@query("dv3_diagonal_corners", sql(NODES + ", g AS (SELECT node, r, c, recv // @N - r AS dr, recv % @N - c AS dc FROM nodes) SELECT CAST((r + CASE WHEN dr > 0 THEN 1 ELSE 0 END) * @W + c + CASE WHEN dc > 0 THEN 1 ELSE 0 END AS BIGINT) AS corner, CAST(arg_max(CASE WHEN dr * dc > 0 THEN 1 ELSE 2 END, node) AS INT) AS fx FROM g WHERE abs(dr) = 1 AND abs(dc) = 1 GROUP BY 1", "cells"))
def dv3(spark, d):
    return D.diagonal_corners(nodes(spark, d), side(spark, d))


@query("dv5_corner_degree", sql(NODES + LAB + EDGES + ", x AS (SELECT a AS corner FROM ed UNION ALL SELECT b FROM ed) SELECT corner, count(*) AS degree FROM x GROUP BY corner", "cells", recursive=True))
def dv5(spark, d):
    return D.corners(D.edges(labels(spark, d), side(spark, d)))


@query("dv5_segments", sql(NODES + LAB + EDGES + """, e AS (SELECT DISTINCT a * 2147483648 + b AS id, a, b FROM ed), x AS (SELECT id, unnest([a, b]) AS corner FROM e), p AS (SELECT corner, min(id) AS i, max(id) AS k FROM x GROUP BY corner HAVING count(*) = 2), q AS (SELECT i AS a, k AS b FROM p UNION ALL SELECT k, i FROM p),
reach(id, at_) AS (SELECT id, id FROM e UNION SELECT r.id, q.b FROM reach r JOIN q ON q.a = r.at_), s AS (SELECT id, min(at_) AS seg FROM reach GROUP BY id) SELECT seg, count(*) AS n FROM s GROUP BY seg""", "cells", recursive=True))
def dv5_segments(spark, d):
    return D.segments(D.edges(labels(spark, d), side(spark, d)), side(spark, d) + 1).groupBy("seg").agg(F.count("*").alias("n"))


HILL = """, hs(node, at_, d) AS (SELECT node, node, 0.0::DOUBLE FROM full_ UNION ALL SELECT g.node, n.recv, g.d + CASE b.flc WHEN 2 THEN sqrt(2.0) ELSE 1.0 END FROM hs g JOIN full_ b ON b.node = g.at_ AND b.ncontrib < 10 AND b.recv <> b.node JOIN full_ n ON n.node = g.at_),
hd AS (SELECT g.node, n.z - f.z AS height, g.d AS dist FROM hs g JOIN full_ f ON f.node = g.at_ JOIN nodes n ON n.node = g.node WHERE f.ncontrib >= 10)"""
SIDES = """, sd AS (SELECT CAST(a.r * @W + a.c + 1 AS BIGINT) AS a, CAST((a.r + 1) * @W + a.c + 1 AS BIGINT) AS b, a.node AS n1, b.node AS n2 FROM lab a JOIN lab b ON b.r = a.r AND b.c = a.c + 1 WHERE a.lab <> b.lab
UNION ALL SELECT CAST((a.r + 1) * @W + a.c AS BIGINT), CAST((a.r + 1) * @W + a.c + 1 AS BIGINT), a.node, b.node FROM lab a JOIN lab b ON b.r = a.r + 1 AND b.c = a.c WHERE a.lab <> b.lab),
dm AS (SELECT sd.*, x.height AS hr1, y.height AS hr2, (x.height + y.height) / 2 AS hr, (x.dist + y.dist) / 2 AS fd, abs(x.height - y.height) / nullif(x.height + y.height, 0) AS dai FROM sd LEFT JOIN hd x ON x.node = n1 LEFT JOIN hd y ON y.node = n2)"""


def hillslopes(spark, d, n=None):
    n = routed(spark, d) if n is None else n
    return keep(R.nearest_drainage(n, n.filter("ncontrib >= 10")), "hillslopes")


@query("dv9_divide_metrics", sql(NODES + LAB + HILL + SIDES + " SELECT a, b, n1, n2, hr1, hr2, hr, round(fd, 6) AS fd, round(dai, 6) AS dai FROM dm", "cells", recursive=True))
def dv9(spark, d):
    n = routed(spark, d)
    t = M.divide_metrics(D.edges(labels(spark, d, n), side(spark, d)), hillslopes(spark, d, n), side(spark, d))
    return t.withColumns({c: F.round(c, 6) for c in ("fd", "dai")})


@query("dv10_divide_metrics_by_segment", sql(NODES + LAB + HILL + SIDES + """, e AS (SELECT DISTINCT a * 2147483648 + b AS id, a, b FROM sd), x AS (SELECT id, unnest([a, b]) AS corner FROM e), p AS (SELECT corner, min(id) AS i, max(id) AS k FROM x GROUP BY corner HAVING count(*) = 2), q AS (SELECT i AS a, k AS b FROM p UNION ALL SELECT k, i FROM p),
reach(id, at_) AS (SELECT id, id FROM e UNION SELECT r.id, q.b FROM reach r JOIN q ON q.a = r.at_), s AS (SELECT id, min(at_) AS seg FROM reach GROUP BY id)
SELECT seg, count(hr) AS n, round(avg(hr), 5) AS hr, round(avg(fd), 5) AS fd, round(avg(dai), 5) AS dai FROM dm JOIN s ON s.id = dm.a * 2147483648 + dm.b GROUP BY seg""", "cells", recursive=True))
def dv10(spark, d):
    n = routed(spark, d)
    e = keep(D.edges(labels(spark, d, n), side(spark, d)), "edges")
    t = M.divide_metrics(e, hillslopes(spark, d, n), side(spark, d))
    return M.metrics_by(t, D.segments(e), "seg").withColumns({c: F.round(c, 5) for c in ("hr", "fd", "dai")})


TIMES = """, tm AS (SELECT lab, node, dist, atan(height / dist) AS slope, dist * 0.2 / ((0.0001 * (1 + node % 3)) * sin(atan(height / dist))) AS tau_adv, dist * dist * 0.2 / ((0.0001 * (1 + node % 3)) * 1.5) AS tau_diff FROM hd JOIN lab USING (node) WHERE height > 0 AND dist > 0 AND lab >= 0)"""


@query("rp1_recession_priors", sql(NODES + LAB + HILL + TIMES + """, pe AS (SELECT *, tau_diff / tau_adv AS peclet FROM tm), sh(share) AS (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)),
q AS (SELECT lab, count(*) AS n, """ + ", ".join(f"quantile_cont({c}, [0.05, 0.5, 0.95]) AS {c}" for c in ("dist", "slope", "tau_adv", "tau_diff", "peclet")) + """ FROM pe GROUP BY lab)
SELECT lab, n, [0.05, 0.5, 0.95][k]::DOUBLE AS share, """ + ", ".join(f"round({c}[k], 4) AS {c}" for c in ("dist", "slope", "tau_adv", "tau_diff", "peclet")) + " FROM q, (VALUES (1), (2), (3)) t(k)", "cells", recursive=True))
def rp1(spark, d):
    n = routed(spark, d)
    t = hillslopes(spark, d, n).join(labels(spark, d, n).filter("lab >= 0").select("node", "lab"), "node")
    got = M.recession_priors(M.recession_times(t, "0.0001 * (1 + node % 3)", "0.2", "1.5"), "lab")
    return got.withColumns({c: F.round(c, 4) for c in ("dist", "slope", "tau_adv", "tau_diff", "peclet")})


@query("rp2_width_function", sql(NODES + LAB + HILL + " SELECT lab, CAST(floor(round(dist / 2.0, 9)) AS INT) AS bin, count(*) AS n FROM hd JOIN lab USING (node) WHERE lab >= 0 GROUP BY ALL", "cells", recursive=True))
def rp2(spark, d):
    return M.width_function(hillslopes(spark, d).join(labels(spark, d).filter("lab >= 0").select("node", "lab"), "node"), "lab", 2.0)


@query("x18_segment_classes", sql(NODES + LAB + EDGES + """, e AS (SELECT DISTINCT a * 2147483648 + b AS id, a, b FROM ed), x AS (SELECT id, unnest([a, b]) AS corner FROM e), p AS (SELECT corner, min(id) AS i, max(id) AS k FROM x GROUP BY corner HAVING count(*) = 2), q AS (SELECT i AS a, k AS b FROM p UNION ALL SELECT k, i FROM p),
reach(id, at_) AS (SELECT id, id FROM e UNION SELECT r.id, q.b FROM reach r JOIN q ON q.a = r.at_), s AS (SELECT id, min(at_) AS seg FROM reach GROUP BY id), dg AS (SELECT corner, count(*) AS d FROM x GROUP BY corner),
m AS (SELECT seg, corner, count(*) AS m FROM s JOIN x USING (id) GROUP BY seg, corner), bare AS (SELECT DISTINCT (r + i) * @W + c + j AS corner FROM lab, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) WHERE lab = -1),
n AS (SELECT seg, count(*) AS n FROM s GROUP BY seg) SELECT seg, any_value(n) AS n, count(DISTINCT m.corner) FILTER (d <> 2 OR m = 1) < 2 AS ring, bool_or(bare.corner IS NOT NULL) AS beside_missing FROM m JOIN dg USING (corner) JOIN n USING (seg) LEFT JOIN bare ON bare.corner = m.corner GROUP BY seg""", "cells", recursive=True))
def x18(spark, d):
    from ..operators.diagnostics import classify_segments

    lab, n = labels(spark, d), side(spark, d)
    e = keep(D.edges(lab, n), "edges")
    seg = keep(D.segments(e), "segments")
    return classify_segments(seg, D.segment_ends(seg, D.corners(e)), lab, n)


def half(here: str, other: str, f: str) -> str:
    """The half of a doubled corner that an edge ends in."""
    return f"{here} * 2 + CASE WHEN {f} IS NULL THEN 0 WHEN {other} // @W < {here} // @W THEN 0 WHEN {other} // @W > {here} // @W THEN 1 WHEN ({other} > {here}) = ({f} = 1) THEN 0 ELSE 1 END"


@query("dv7_divide_order", sql(NODES + LAB + EDGES + """, g AS (SELECT node, r, c, recv // @N - r AS dr, recv % @N - c AS dc FROM nodes), fx AS (SELECT (r + CASE WHEN dr > 0 THEN 1 ELSE 0 END) * @W + c + CASE WHEN dc > 0 THEN 1 ELSE 0 END AS corner, arg_max(CASE WHEN dr * dc > 0 THEN 1 ELSE 2 END, node) AS fx FROM g WHERE abs(dr) = 1 AND abs(dc) = 1 GROUP BY 1),
sp AS (SELECT HALF1 AS a, HALF2 AS b FROM ed LEFT JOIN fx f ON f.corner = ed.a LEFT JOIN fx h ON h.corner = ed.b), e AS (SELECT DISTINCT least(a, b) * 2147483648 + greatest(a, b) AS id, least(a, b) AS a, greatest(a, b) AS b FROM sp),
x AS (SELECT id, unnest([a, b]) AS corner FROM e), p AS (SELECT corner, min(id) AS i, max(id) AS k FROM x GROUP BY corner HAVING count(*) = 2), q AS (SELECT i AS a, k AS b FROM p UNION ALL SELECT k, i FROM p), reach(id, at_) AS (SELECT id, id FROM e UNION SELECT r.id, q.b FROM reach r JOIN q ON q.a = r.at_), s AS (SELECT id, min(at_) AS seg FROM reach GROUP BY id),
dg AS (SELECT corner, count(*) AS d FROM (SELECT unnest([a, b]) AS corner FROM sp) GROUP BY corner), m AS (SELECT seg, corner, count(*) AS m FROM s JOIN x USING (id) GROUP BY seg, corner), n AS (SELECT seg, count(*) AS n FROM s GROUP BY seg),
sg AS (SELECT seg, min(corner) FILTER (d <> 2 OR m = 1) AS u, max(corner) FILTER (d <> 2 OR m = 1) AS v, bool_or(d = 1 AND (d <> 2 OR m = 1)) AS leaf FROM m JOIN dg USING (corner) GROUP BY seg),
sd AS (SELECT seg, unnest([u, v]) AS corner FROM sg WHERE u <> v),
o(it, seg, ord, dd) AS (SELECT 0, seg, CASE WHEN leaf THEN 1 END, CASE WHEN leaf THEN n END FROM sg JOIN n USING (seg) WHERE u <> v
UNION ALL SELECT it + 1, o.seg, coalesce(o.ord, w.ord), coalesce(o.dd, w.dd + n.n) FROM o JOIN n USING (seg) LEFT JOIN (SELECT seg, min(ord) AS ord, arg_min(far, (ord, far)) AS dd FROM (SELECT max(seg) FILTER (o.ord IS NULL) AS seg, max(far) AS far, list_sort(list(o.ord) FILTER (o.ord IS NOT NULL), 'DESC') AS os, os[1] + CASE WHEN os[1] = os[2] THEN 1 ELSE 0 END AS ord FROM (SELECT *, o.dd AS far FROM sd JOIN o USING (seg)) o GROUP BY corner HAVING count(*) FILTER (o.ord IS NULL) = 1 AND count(o.ord) > 0) GROUP BY seg) w ON w.seg = o.seg WHERE it < (SELECT count(*) FROM sg))
SELECT sg.seg, CAST(coalesce(max(ord), 0) AS BIGINT) AS ord, CAST(coalesce(max(dd), 0) AS DOUBLE) AS dd FROM sg LEFT JOIN o ON o.seg = sg.seg GROUP BY sg.seg""".replace("HALF1", half("ed.a", "ed.b", "f.fx")).replace("HALF2", half("ed.b", "ed.a", "h.fx")), "cells", recursive=True))
def dv7(spark, d):
    n = routed(spark, d)
    lab = keep(R.basin_labels(n, *R.links(n, R.sources(n, 10))), "labels")
    e = keep(D.split_crossings(D.edges(lab, side(spark, d)), D.diagonal_corners(n, side(spark, d)), side(spark, d)), "edges")
    deg = keep(D.corners(e), "corners")
    return D.order(keep(D.segment_ends(D.segments(e, 2 * (side(spark, d) + 1)), deg), "ends"), deg, "strahler")


# ---- heads

def split_sql(source: str, least: int) -> str:
    """Scores t (cat, seq, score) of the splits of profiles (cat, seq, s, z)."""
    return f""", b AS (SELECT cat, seq, s AS x0, z AS y0, count(*) OVER (PARTITION BY cat) AS n, avg(s) OVER (PARTITION BY cat) AS mx, avg(z) OVER (PARTITION BY cat) AS my FROM {source}),
p AS (SELECT cat, seq, n, x0 - mx AS x, y0 - my AS y FROM b WHERE n >= {2 * least}), q AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS dx, coalesce(y - lag(y) OVER w, 0) AS dy FROM p WINDOW w AS (PARTITION BY cat ORDER BY seq)),
h AS (SELECT cat, seq, n, regr_sxx(y, x) OVER a AS hx, regr_sxy(y, x) OVER a AS hxy, regr_syy(y, x) OVER a AS hy, regr_r2(y, x) OVER f AS r2, sum(dx * dx) OVER a AS ddx, sum(dx * dy) OVER a AS dxy, sum(dy * dy) OVER a AS ddy FROM q
  WINDOW a AS (PARTITION BY cat ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY cat ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT cat, seq, r2 - ((power(hxy / hx, 2) * ddx - 2 * hxy / hx * dxy + ddy) / greatest(hy - hxy * hxy / hx, 1e-10) - 2) / 2 AS score FROM h WHERE seq >= {least} AND n - seq >= {least})"""


SPLIT = split_sql("vertices", 10)


def split_input(spark, d):
    return vertices(spark, d).select(F.col("cat").alias("profile"), F.col("seq").alias("i"), F.col("s").alias("chi"), "z")


@query("ch5_chi_split", sql(SPLIT + " SELECT cat AS profile, CAST(arg_max(seq, (score, -seq)) AS INT) AS i, round(max(score), 5) AS score FROM t GROUP BY cat", "vertices"))
def ch5(spark, d):
    return H.chi_split(split_input(spark, d)).select("profile", "i", F.round("score", 5).alias("score"))


@query("ch6_uppermost_split", sql(SPLIT + ", u AS (SELECT *, max(score) OVER (PARTITION BY cat) AS top, lag(score) OVER w AS a, lead(score) OVER w AS b FROM t WINDOW w AS (PARTITION BY cat ORDER BY seq)) SELECT cat AS profile, CAST(coalesce(min(seq) FILTER (k), arg_max(seq, (score, -seq))) AS INT) AS i, round(coalesce(arg_min(score, seq) FILTER (k), max(score)), 5) AS score FROM (SELECT *, score >= 0.9 * top AND (a IS NULL OR score >= a) AND (b IS NULL OR score >= b) AS k FROM u) GROUP BY cat", "vertices"))
def ch6(spark, d):
    return H.uppermost_split(split_input(spark, d)).select("profile", "i", F.round("score", 5).alias("score"))


@query("ch4_heads_single_precision")
def ch4(spark, d):
    n = routed(spark, d)
    return H.heads_from_valleys(n, H.first_order_valleys(n, 10), 10, 3, min_profile_nodes=7, precision=32)


def heads_sql(feet: str, pick: str) -> str:
    """Heads hd (node) of the valleys above the sources: profiles end at ft (cat, foot), pick chooses a split (cat, seq) of each."""
    return AREA + SRC + """, dn(node, at_, sa, sb) AS (SELECT node, recv, CASE flc WHEN 1 THEN 1 ELSE 0 END, CASE flc WHEN 2 THEN 1 ELSE 0 END FROM nodes UNION ALL SELECT d.node, n.recv, sa + CASE n.flc WHEN 1 THEN 1 ELSE 0 END, sb + CASE n.flc WHEN 2 THEN 1 ELSE 0 END FROM dn d JOIN nodes n ON n.node = d.at_ WHERE n.recv <> n.node),
fds AS (SELECT node, max(sa + sb) AS steps, arg_max(sa + sb * sqrt(2.0), sa + sb) AS fd FROM dn GROUP BY node), tops AS (SELECT a.top AS cat, arg_max(a.node, (fd, -a.node)) AS hill FROM anc a JOIN src ON src.node = a.top JOIN fds ON fds.node = a.node GROUP BY a.top)""" + feet + """,
way(cat, seq, node, most) AS (SELECT cat, 0, hill, x.steps - y.steps FROM tops JOIN ft USING (cat) JOIN fds x ON x.node = hill JOIN fds y ON y.node = foot UNION ALL SELECT cat, seq + 1, n.recv, most FROM way JOIN nodes n USING (node) WHERE seq < most AND n.recv <> n.node),
prof AS (SELECT w.cat, seq, w.node, f.z, CASE WHEN seq < most THEN CASE flc WHEN 2 THEN sqrt(2.0) ELSE 1.0 END * power(1000.0 / ncontrib, 0.525) ELSE 0 END AS term FROM way w JOIN full_ f USING (node)),
chi AS (SELECT *, sum(term) OVER (PARTITION BY cat ORDER BY seq DESC) AS s FROM prof)""" + split_sql("chi", 3) + pick + """, hd AS (SELECT DISTINCT chi.node FROM pick JOIN chi USING (cat, seq) JOIN nodes n ON n.node = chi.node WHERE n.recv <> n.node)
SELECT n.node, n.r, n.c FROM hd JOIN nodes n USING (node) WHERE NOT EXISTS (SELECT 1 FROM anc a JOIN hd g ON g.node = a.node WHERE a.top = hd.node AND a.node <> hd.node)"""


BEST_SPLIT = ", pick AS (SELECT cat, arg_max(seq, (score, -seq)) AS seq FROM t GROUP BY cat)"
UPPERMOST_SPLIT = """, u AS (SELECT *, max(score) OVER (PARTITION BY cat) AS top, lag(score) OVER w AS la, lead(score) OVER w AS lb FROM t WINDOW w AS (PARTITION BY cat ORDER BY seq)),
pick AS (SELECT cat, coalesce(min(seq) FILTER (k), arg_max(seq, (score, -seq))) AS seq FROM (SELECT *, score >= 0.9 * top AND (la IS NULL OR score >= la) AND (lb IS NULL OR score >= lb) AS k FROM u) GROUP BY cat)"""
AT_SOURCE = ", ft AS (SELECT cat, cat AS foot FROM tops)"
AT_NEXT_JUNCTION = """, ch AS (SELECT node, recv FROM full_ WHERE ncontrib >= 10), jn AS (SELECT p.node, count(d.node) <> 1 OR any_value(p.recv) = p.node AS junction FROM ch p LEFT JOIN ch d ON d.recv = p.node AND d.node <> p.node GROUP BY p.node),
dw(cat, at_) AS (SELECT cat, recv FROM tops JOIN nodes ON node = cat UNION ALL SELECT cat, n.recv FROM dw JOIN jn ON jn.node = at_ JOIN nodes n ON n.node = at_ WHERE NOT junction), ft AS (SELECT cat, at_ AS foot FROM dw JOIN jn ON jn.node = at_ WHERE junction)"""


@query("ch7_heads_to_next_junction", sql(NODES + heads_sql(AT_NEXT_JUNCTION, UPPERMOST_SPLIT), "cells", recursive=True))
def ch7_extended(spark, d):
    n = routed(spark, d)
    return H.heads_from_valleys(n, H.first_order_valleys(n, 10), 10, 3, extend_to_junction=True, rule="uppermost")


@query("ch7_first_order_heads", sql(NODES + heads_sql(AT_SOURCE, BEST_SPLIT), "cells", recursive=True))
def ch7(spark, d):
    return H.first_order_heads(routed(spark, d), 10, 3)


@query("r15_valleys")
def r15(spark, d):
    n = routed(spark, d)
    return H.valleys(n.withColumn("gate", F.col("z").cast("long") % 3 > 0), "gate", 8, 2)


# ---- validation

PAIR = "sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))"


@query("j8_nearest_reference", sql(f", n AS (SELECT a.id AS id_a, b.id AS id_b, {PAIR} AS d FROM suppliers a JOIN customers b ON {PAIR} <= 40) SELECT id_a, id_b, round(d, 6) AS d FROM n QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY d, id_b) = 1", "suppliers", "customers"))
def j8(spark, d):
    return E.nearest(points(spark, d, "supplier"), points(spark, d, "customer"), 40.0).select("id_a", "id_b", F.round("d", 6).alias("d"))


@query("ag18_recall_precision", sql(f""", n AS (SELECT a.id AS ida, b.id AS idb, {PAIR} AS d FROM suppliers a JOIN customers b ON {PAIR} <= 20)
SELECT (SELECT count(*) FROM suppliers) AS n_known, (SELECT count(*) FROM customers) AS n_found, round((SELECT count(DISTINCT ida) FROM n) / (SELECT count(*) FROM suppliers), 6) AS recall, round((SELECT count(DISTINCT idb) FROM n) / (SELECT count(*) FROM customers), 6) AS precision,
round((SELECT median(m) FROM (SELECT min(d) AS m FROM n GROUP BY ida)), 6) AS median_d""", "suppliers", "customers"))
def ag18(spark, d):
    t = E.match_quality(points(spark, d, "customer"), points(spark, d, "supplier"), 20.0)
    return t.select("n_known", "n_found", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "median_d")))


@query("j10_snap_to_max", sql(", p AS (SELECT id, CAST(x % @N AS INT) AS r, CAST(y % @N AS INT) AS c FROM suppliers), m AS (SELECT id, b.r, b.c, b.z FROM p JOIN cells b ON abs(b.r - p.r) <= 2 AND abs(b.c - p.c) <= 2) SELECT id, r, c, z FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY z DESC, r, c) = 1", "suppliers", "cells"))
def j10(spark, d):
    n = side(spark, d)
    p = points(spark, d, "supplier").select("id", (F.col("x") % n).cast("int").alias("r"), (F.col("y") % n).cast("int").alias("c"))
    return E.snap_to_max(p, cells(spark, d), 2, "z")


@query("j11_points_in_hull", sql(" SELECT id, x, y FROM customers WHERE (800 - 100) * (y - 100) - (200 - 100) * (x - 100) >= 0 AND (500 - 800) * (y - 200) - (900 - 200) * (x - 800) >= 0 AND (100 - 500) * (y - 900) - (100 - 900) * (x - 500) >= 0", "customers"))
def j11(spark, d):
    return E.within_hull(points(spark, d, "customer"), E.hull([(100.0, 100.0), (800.0, 200.0), (500.0, 900.0), (500.0, 400.0)]))


@query("ag15_radial_spectrum")
def ag15(spark, d):
    t = cells(spark, d).withColumn("block", F.expr("cast(r div 16 * 4096 + c div 16 as int)"))
    whole = t.groupBy("block").agg(F.count("*").alias("n")).filter("n = 256").select("block")
    return E.radial_spectrum(t.join(whole, "block"))


@query("j11_points_in_hull_of_points", sql(""", p AS (SELECT id, x, y FROM suppliers), u AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM (SELECT DISTINCT x, y FROM p) a, (SELECT DISTINCT x, y FROM p) b WHERE (a.x, a.y) <> (b.x, b.y)),
hl AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE (x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) < 0))
SELECT id, x, y FROM customers c WHERE NOT EXISTS (SELECT 1 FROM hl WHERE (x2 - x1) * (c.y - y1) - (y2 - y1) * (c.x - x1) < 0)""", "suppliers", "customers"))
def j11_points(spark, d):
    return E.within_hull(points(spark, d, "customer"), points(spark, d, "supplier"))


@query("j2_point_sample", sql(", p AS (SELECT id, x * @N / 960.0::DOUBLE AS x, y * @N / 960.0::DOUBLE AS y FROM customers), g AS (SELECT id, CASE WHEN x <= @N AND y <= @N THEN least(CAST(floor(@N - y) AS INT), @N - 1) END AS r, CASE WHEN x <= @N AND y <= @N THEN least(CAST(floor(x) AS INT), @N - 1) END AS c FROM p) SELECT id, z FROM g LEFT JOIN cells USING (r, c)", "customers", "cells"))
def j2(spark, d):
    from ..functions.scalar import cell_of

    n = side(spark, d)
    p = points(spark, d, "customer").withColumn("x", F.col("x") * n / 960.0).withColumn("y", F.col("y") * n / 960.0)
    r, c = cell_of(F.col("x"), F.col("y"), 0.0, float(n), 1.0, 1.0, n, n)
    return p.select("id", r.alias("r"), c.alias("c")).join(cells(spark, d), ["r", "c"], "left").select("id", "z")


@query("ag9_distinct_basins", sql(NODES + LAB + " SELECT a.r, a.c, count(DISTINCT b.lab) AS n FROM lab a JOIN lab b ON abs(b.r - a.r) <= 2 AND abs(b.c - a.c) <= 2 GROUP BY a.r, a.c", "cells", recursive=True))
def ag9(spark, d):
    return E.distinct_near(labels(spark, d), "lab", 2)


@query("ag12_auc", "WITH a AS (SELECT o_totalprice AS s FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_totalprice AS s FROM orders WHERE o_orderstatus <> 'F'), n AS (SELECT s, count(*) AS k FROM b GROUP BY s), c AS (SELECT s, sum(k) OVER (ORDER BY s) AS upto, k FROM n) SELECT round(sum((SELECT coalesce(max(upto), 0) FROM c WHERE c.s < a.s) + 0.5 * (SELECT coalesce(max(k), 0) FROM c WHERE c.s = a.s)) / (count(*) * (SELECT count(*) FROM b)), 6) AS auc FROM a")
def ag12(spark, d):
    t = table(spark, d, "orders").select(F.col("o_totalprice").alias("s"), (F.col("o_orderstatus") == "F").alias("p"))
    return E.auc(t, "s", "p").select(F.round("auc", 6).alias("auc"))


@query("ag14_structure_function", sql(", l AS (SELECT unnest([1, 2, 3, 5, 8, 12]) AS lag), p AS (SELECT lag, power(a.z - b.z, 2) AS q FROM l, cells a JOIN cells b ON (b.r = a.r + lag AND b.c = a.c) OR (b.r = a.r AND b.c = a.c + lag)) SELECT CAST(lag AS INT) AS lag, round(avg(q), 4) AS gamma, count(*) AS n FROM p GROUP BY lag", "cells"))
def ag14(spark, d):
    return E.structure_function(cells(spark, d), [1, 2, 3, 5, 8, 12]).select("lag", F.round("gamma", 4).alias("gamma"), "n")


@query("ag13_hurst", sql(", l AS (SELECT unnest([1, 2, 3, 5, 8, 12]) AS lag), p AS (SELECT lag, avg(power(a.z - b.z, 2)) AS g FROM l, cells a JOIN cells b ON (b.r = a.r + lag AND b.c = a.c) OR (b.r = a.r AND b.c = a.c + lag) GROUP BY lag) SELECT round(regr_slope(ln(g), ln(lag)) / 2, 6) AS hurst, round(corr(ln(lag), ln(g)), 6) AS r FROM p", "cells"))
def ag13(spark, d):
    return E.hurst(E.structure_function(cells(spark, d), [1, 2, 3, 5, 8, 12])).select(F.round("hurst", 6).alias("hurst"), F.round("r", 6).alias("r"))


@query("j16_edge_overlap", "WITH a AS (SELECT DISTINCT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b FROM lineitem WHERE l_linenumber = 1), t AS (SELECT DISTINCT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b FROM lineitem WHERE l_quantity > 40), n AS (SELECT (SELECT count(*) FROM a) AS o, (SELECT count(*) FROM t) AS u, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM t)) AS both_) SELECT round(both_ / u, 6) AS recall, round(both_ / o, 6) AS precision, round(both_ / (o + u - both_), 6) AS jaccard, both_ AS \"both\" FROM n")
def j16(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"), "l_linenumber", "l_quantity")
    t = E.edge_overlap(li.filter("l_linenumber = 1"), li.filter("l_quantity > 40"))
    return t.select(*(F.round(c, 6).alias(c) for c in ("recall", "precision", "jaccard")), "both")


@query("x22_usable_resolution", "WITH t AS (SELECT c_mktsegment AS method, c_nationkey AS res, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS recall FROM customer GROUP BY 1, 2), o AS (SELECT *, min(CASE WHEN recall >= 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY method ORDER BY res) AS ok FROM t) SELECT method, max(res) AS res FROM o WHERE ok = 1 GROUP BY method")
def x22(spark, d):
    t = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").alias("res")).agg(F.avg((F.col("c_acctbal") > 0).cast("double")).alias("recall"))
    return E.usable_resolution(t, 0.8)


@query("x23_density_matched", "WITH t AS (SELECT s_nationkey % 4 AS method, CAST(s_suppkey AS DOUBLE) AS density, s_acctbal AS metric FROM supplier), n AS (SELECT *, lead(density) OVER w AS d2, lead(metric) OVER w AS m2 FROM t WINDOW w AS (PARTITION BY method ORDER BY density)) SELECT method, round(metric + (50.5 - density) / (d2 - density) * (m2 - metric), 6) AS metric FROM n WHERE density <= 50.5 AND d2 > 50.5")
def x23(spark, d):
    t = table(spark, d, "supplier").select((F.col("s_nationkey") % 4).alias("method"), F.col("s_suppkey").cast("double").alias("density"), F.col("s_acctbal").alias("metric"))
    return E.at_density(t, 50.5).select("method", F.round("metric", 6).alias("metric"))


# Despiking needs a point's window alone; smoothing goes step by step over all vertices, ends fixed at the nodes' values:
# each edge starts at the mean of its first two values and ends at the last one's floor.
W11_ALPHA, W11_STEPS = 0.35, 5
W11_NODES = ", nd AS (SELECT cat, (max(z) FILTER (seq = 0) + coalesce(max(z) FILTER (seq = 1), max(z) FILTER (seq = 0))) / 2 AS l, floor(arg_max(z, seq)) AS r FROM vertices GROUP BY cat)"


def _w11_sql() -> str:
    body = W11_NODES + """, w AS (SELECT cat, seq, z, list(z) OVER (PARTITION BY cat ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near, count(*) OVER (PARTITION BY cat) AS n FROM vertices),
m AS (SELECT *, list_median(near) AS md FROM w), sp AS (SELECT *, list_median(list_transform(near, lambda x: abs(x - md))) AS mad FROM m),
b AS (SELECT *, seq > 0 AND seq < n - 1 AND n > 2 AND mad > 0 AND abs(0.6745 * (z - md) / mad) > 2 AS bad FROM sp),
g AS (SELECT *, list(CASE WHEN NOT bad THEN z END) OVER (PARTITION BY cat ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS good FROM b),
y0 AS (SELECT g.cat, seq, n, l, r, CASE WHEN n = 1 THEN (l + r) / 2 WHEN seq = 0 THEN l WHEN seq = n - 1 THEN r WHEN bad THEN list_median(list_filter(good, lambda x: x IS NOT NULL)) ELSE z END AS y FROM g JOIN nd ON nd.cat = g.cat)"""
    for k in range(W11_STEPS):
        body += f", y{k + 1} AS (SELECT cat, seq, n, l, r, CASE WHEN seq = 0 OR seq = n - 1 THEN y ELSE y + {W11_ALPHA} * (0.5 * (lag(y) OVER q + lead(y) OVER q) - y) END AS y FROM y{k} WINDOW q AS (PARTITION BY cat ORDER BY seq))"
    return sql(body + f" SELECT cat, CAST(seq AS INT) AS seq, round(y, 6) AS z FROM y{W11_STEPS}", "vertices")


@query("w11_clean_edges", _w11_sql())
def w11(spark, d):
    v = keep(vertices(spark, d), "vertices")
    first = F.max(F.when(F.col("seq") == 0, F.col("z")))
    second = F.max(F.when(F.col("seq") == 1, F.col("z")))
    ends = v.groupBy("cat").agg(((first + F.coalesce(second, first)) / 2).alias("left"), F.floor(F.max_by("z", "seq")).cast("double").alias("right"))
    return K.clean_edges(v, 5, alpha=W11_ALPHA, steps=W11_STEPS, ends=ends).withColumn("z", F.round("z", 6))


assert SQL
