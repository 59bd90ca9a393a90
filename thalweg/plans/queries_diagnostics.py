"""Queries over the diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as G
from ..operators import routing as R
from ..operators import slopearea as A
from .iterate import keep
from .queries_network import AREA, LAB, NODES, labels, nodes, routed
from .queries_profile import CLOUD, SLOPE
from .views import cells, points, segments, side, sql, table, vertices, vertices_xy

Q: dict = {}
O: dict = {}
SLOPE_XY = SLOPE + ", cl AS (SELECT cat, seq, s / 1000 AS x, log10(A) AS la, log10(slope) AS ls FROM sl WHERE A > 0 AND slope > 0)"


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f
    return add


@query("x1_segment_topology", sql(NODES + AREA + """, g AS (SELECT *, r // 6 * 1000 + c // 8 + 1 AS seg FROM full_), b AS (SELECT g.seg, CASE WHEN g.recv = g.node THEN 0 ELSE h.seg END AS to_, g.ncontrib, g.node FROM g JOIN g h ON h.node = g.recv WHERE g.recv = g.node OR h.seg <> g.seg)
SELECT CAST(seg AS BIGINT) AS seg, CAST(to_ AS BIGINT) AS tostream FROM b QUALIFY row_number() OVER (PARTITION BY seg ORDER BY ncontrib DESC, node) = 1""", "cells", recursive=True))
def x1(spark, d):
    n = routed(spark, d).withColumn("seg", (F.expr("r div 6") * 1000 + F.expr("c div 8") + 1).cast("long"))
    return G.segment_topology(n)


@query("x3_two_hops", sql(" SELECT a.cat, coalesce(nullif(b.tostream, 0), nullif(a.tostream, 0), a.cat) AS anchor FROM segments a LEFT JOIN segments b ON b.cat = a.tostream", "segments"))
def x3(spark, d):
    return G.two_hops(segments(spark, d))


@query("x7_slope_area_knee", sql(CLOUD + """, e AS (SELECT min(la) AS lo, max(la) AS hi FROM cl), b AS (SELECT CAST(floor((la - lo) / ((hi - lo) / 15)) AS INT) AS bin, la, ls FROM cl, e WHERE la < hi), m AS (SELECT bin, median(la) AS x, median(ls) AS y FROM b GROUP BY bin HAVING count(*) >= 30),
l AS (SELECT *, -(y - lag(y) OVER (ORDER BY bin)) / (x - lag(x) OVER (ORDER BY bin)) AS t FROM m), p AS (SELECT bin AS pb, x AS px FROM m ORDER BY y DESC, bin LIMIT 1)
SELECT round(px, 6) AS peak_x, round(arg_min(x, bin) FILTER (bin > pb AND t >= 0.2), 6) AS knee_x FROM l, p GROUP BY px""", "vertices"))
def x7(spark, d):
    return G.knee(A.cloud(vertices(spark, d)), 15, 30).select(F.round("peak_x", 6).alias("peak_x"), F.round("knee_x", 6).alias("knee_x"))


@query("r18_tributary_steps", sql(", p AS (SELECT cat, seq, CAST(floor(A + z * 10) AS BIGINT) AS n FROM vertices), t AS (SELECT *, lead(n) OVER (PARTITION BY cat ORDER BY seq) - n - 1 AS tr FROM p) SELECT cat AS path, CAST(seq AS INT) AS i, n AS ncontrib, tr AS tributary FROM t WHERE tr >= 0.2 * n", "vertices"))
def r18(spark, d):
    p = vertices(spark, d).select(F.col("cat").alias("path"), F.col("seq").alias("i"), F.floor(F.col("A") + F.col("z") * 10).cast("long").alias("ncontrib"))
    return G.tributary_steps(p)


@query("r23_cross_divide_contrast", sql(NODES + LAB + " SELECT a.r, a.c, max(abs(x.z - y.z)) AS contrast FROM lab a JOIN lab b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.lab <> b.lab JOIN cells x ON x.r = a.r AND x.c = a.c JOIN cells y ON y.r = b.r AND y.c = b.c GROUP BY a.r, a.c", "cells", recursive=True))
def r23(spark, d):
    n = routed(spark, d)
    lab = R.basin_labels(n, *R.links(n, R.sources(n, 10)))
    return G.cross_contrast(lab.join(n.select("node", "z"), "node"), "z")


@query("r22_valley_axes", "WITH p AS (SELECT c_nationkey AS id, CAST(c_custkey * 6151 % 1000 AS DOUBLE) AS x, c_acctbal AS y FROM customer), m AS (SELECT id, count(*) AS n, var_pop(x) AS a, var_pop(y) AS d, covar_pop(x, y) AS b FROM p GROUP BY id), e AS (SELECT id, n, sqrt((a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b)) AS l, sqrt(greatest(0, (a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b))) AS s FROM m) SELECT id, n, round(l, 3) AS long, round(s, 3) AS short, round(l / s, 4) AS aspect FROM e")
def r22(spark, d):
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), (F.col("c_custkey") * 6151 % 1000).cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return G.valley_axes(p).select("id", "n", F.round("long", 3).alias("long"), F.round("short", 3).alias("short"), F.round("aspect", 4).alias("aspect"))


@query("r24_gradient_laplacian", sql(" SELECT o.r, o.c, round(sqrt(power(e.z - w.z, 2) + power(n.z - s.z, 2)) / 2, 6) AS gradient, n.z + e.z + s.z + w.z - 4 * o.z AS laplacian FROM cells o JOIN cells n ON n.r = o.r - 1 AND n.c = o.c JOIN cells s ON s.r = o.r + 1 AND s.c = o.c JOIN cells e ON e.r = o.r AND e.c = o.c + 1 JOIN cells w ON w.r = o.r AND w.c = o.c - 1", "cells"))
def r24(spark, d):
    return G.surface(cells(spark, d)).select("r", "c", F.round("gradient", 6).alias("gradient"), "laplacian")


@query("r24_gaussian_smooth", sql(" SELECT a.r, a.c, round(sum(b.z * exp(-(power(a.r - b.r, 2) + power(a.c - b.c, 2)) / 2.0)) / sum(exp(-(power(a.r - b.r, 2) + power(a.c - b.c, 2)) / 2.0)), 6) AS z FROM cells a JOIN cells b ON abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY a.r, a.c", "cells"))
def r24s(spark, d):
    return G.smooth(cells(spark, d), 1.0).select("r", "c", F.round("z", 6).alias("z"))


@query("r21_rims", sql(NODES + AREA + """, m AS (SELECT a.top, n.node, n.r, n.c FROM anc a JOIN nodes n ON n.node = a.node)
SELECT x.top, x.node, round(sqrt(power(x.r - t.r, 2) + power(x.c - t.c, 2)), 6) AS linear FROM m x JOIN nodes t ON t.node = x.top WHERE (SELECT count(*) FROM m y WHERE y.top = x.top AND abs(y.r - x.r) <= 1 AND abs(y.c - x.c) <= 1) < 9""", "cells", recursive=True))
def r21(spark, d):
    n = routed(spark, d)
    return G.rims(n, n).select("top", "node", F.round("linear", 6).alias("linear"))


@query("j12_signature_match", sql(", m AS (SELECT a.id AS id_a, b.id AS id_b, power((a.x - b.x) / 30, 2) + power((a.y - b.y) / 50, 2) AS d2 FROM suppliers a, customers b) SELECT id_a, id_b, round(d2, 8) AS d2 FROM m WHERE d2 < 1 QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY d2, id_b) = 1", "suppliers", "customers"))
def j12(spark, d):
    return G.signature_match(points(spark, d, "supplier"), points(spark, d, "customer"), {"x": 30.0, "y": 50.0}).select("id_a", "id_b", F.round("d2", 8).alias("d2"))


@query("x14_outcome_census", sql(NODES + AREA + ", t AS (SELECT flc, CASE WHEN ncontrib >= 10 THEN 'channel' WHEN ncontrib = 1 THEN 'ridge' ELSE 'slope' END AS outcome FROM full_) SELECT CAST(flc AS INT) AS flc, outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY flc), 9) AS share FROM t GROUP BY flc, outcome", "cells", recursive=True))
def x14(spark, d):
    outcome = F.when(F.col("ncontrib") >= 10, "channel").when(F.col("ncontrib") == 1, "ridge").otherwise("slope")
    return G.outcome_census(routed(spark, d).withColumn("outcome", outcome), "flc", "outcome").withColumn("share", F.round("share", 9))


@query("x13_area_ratio", "WITH t AS (SELECT o_totalprice AS f, log10(o_totalprice / (100.0 * o_custkey)) AS x FROM orders WHERE o_totalprice > 0 AND o_custkey > 0) SELECT round(quantile_cont(x, 0.25), 6) AS p25, round(median(x), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(avg(CASE WHEN abs(x) <= log10(2) THEN 1.0 ELSE 0.0 END), 6) AS close, round(avg(CASE WHEN f < 150000 THEN 1.0 ELSE 0.0 END), 6) AS below FROM t")
def x13(spark, d):
    t = table(spark, d, "orders").select("o_totalprice", (F.lit(100.0) * F.col("o_custkey")).alias("known"))
    return G.area_ratio(t, "o_totalprice", "known", star=150000.0).select(*(F.round(c, 6).alias(c) for c in ("p25", "p50", "p75", "mean", "sd", "close", "below")))


STICK = """, kn AS (SELECT k, lo2 + k * (hi2 - lo2) / 49 AS kn FROM (SELECT max(x) FILTER (rn = 2) AS lo2, max(x) FILTER (rn = n - 1) AS hi2 FROM m), range(50) t(k)),
f AS (SELECT k, any_value(kn) AS kn, count(*) FILTER (x <= kn) AS nl, count(*) AS n, min(x) AS x0, max(x) AS x1, regr_slope(y, greatest(0, x - kn)) AS b, regr_intercept(y, greatest(0, x - kn)) AS h,
  regr_syy(y, greatest(0, x - kn)) - power(regr_sxy(y, greatest(0, x - kn)), 2) / regr_sxx(y, greatest(0, x - kn)) AS rss, regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x) AS line FROM m, kn GROUP BY k),
s AS (SELECT *, 1 - rss / line AS R, least(kn - x0, x1 - kn) / (x1 - x0) AS edge FROM f WHERE nl >= 2 AND n - nl >= 2 AND n >= 6 ORDER BY rss, k LIMIT 1)"""


@query("sa4_binned_break", sql(CLOUD + """, e AS (SELECT min(la) AS lo, max(la) AS hi FROM cl), b AS (SELECT CAST(floor((la - lo) / ((hi - lo) / 18)) AS INT) AS bin, la, ls FROM cl, e WHERE la < hi), g AS (SELECT bin, median(la) AS x, median(ls) AS y FROM b GROUP BY bin HAVING count(*) >= 8), m AS (SELECT *, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM g)""" + STICK
    + " SELECT round(kn, 6) AS \"logA_star\", round(-b, 6) AS theta, round(h, 6) AS \"hillslope_logS\", round(R, 6) AS \"R\", round(edge, 6) AS edge, R >= 0.3 AND edge >= 0.1 AND -b BETWEEN 0.2 AND 1.5 AS accepted FROM s", "vertices"))
def sa4_break(spark, d):
    return A.binned_break(A.cloud(vertices(spark, d))).select(*(F.round(c, 6).alias(c) for c in ("logA_star", "theta", "hillslope_logS", "R", "edge")), "accepted")


@query("sa6_tent", """WITH cl AS (SELECT log10(o_custkey + 1) AS la, 1 - abs(log10(o_custkey + 1) - 2) + (o_orderkey % 7) / 50.0 AS ls FROM orders), e AS (SELECT min(la) AS lo, max(la) AS hi FROM cl), b AS (SELECT least(11, CAST(floor((la - lo) / ((hi - lo) / 12)) AS INT)) AS bin, la, ls FROM cl, e), g AS (SELECT bin, median(la) AS x, median(ls) AS y FROM b GROUP BY bin HAVING count(*) >= 2),
m AS (SELECT *, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM g), q AS (SELECT rn AS p, x AS px, y AS py FROM m WHERE rn > 2 AND rn < n - 1),
f AS (SELECT p, px, py, regr_slope(y, x) FILTER (rn <= p) AS up, regr_slope(y, x) FILTER (rn >= p) AS down, regr_intercept(y, x) FILTER (rn >= p) AS b, regr_syy(y, x) FILTER (rn <= p) - power(regr_sxy(y, x) FILTER (rn <= p), 2) / regr_sxx(y, x) FILTER (rn <= p) + regr_syy(y, x) FILTER (rn >= p) - power(regr_sxy(y, x) FILTER (rn >= p), 2) / regr_sxx(y, x) FILTER (rn >= p) AS rss2, regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x) AS line FROM q, m GROUP BY p, px, py),
r AS (SELECT *, rss2 - power(py - (down * px + b), 2) AS rss FROM f WHERE up > 0.05 AND down < -0.10 ORDER BY rss, p LIMIT 1) SELECT round(px, 6) AS peak, round(1 - rss / line, 6) AS "R", round(-down, 6) AS theta FROM r WHERE 1 - rss / line >= 0.5""")
def sa6(spark, d):
    x = F.log10(F.col("o_custkey") + 1)
    cloud = table(spark, d, "orders").select(x.alias("logA"), (1 - F.abs(x - 2) + (F.col("o_orderkey") % 7) / 50.0).alias("logS"))
    return A.tent(cloud).select(*(F.round(c, 6).alias(c) for c in ("peak", "R", "theta")))


HOLLOWS = "SELECT id, x, y, (id % 17) / 10.0 AS la, (id % 11) / 10.0 AS ls FROM "


@query("sa9_false_negatives", sql(", c AS (" + HOLLOWS + "customers), h AS (" + HOLLOWS + "suppliers), m AS (SELECT c.id, bool_or(h.id IS NOT NULL) AS missed FROM c LEFT JOIN h ON power((c.la - h.la) / 0.3, 2) + power((c.ls - h.ls) / 0.3, 2) + (power(c.x - h.x, 2) + power(c.y - h.y, 2)) / 90000 < 1 GROUP BY c.id) SELECT id % 40 AS seg, count(*) AS n, count(*) FILTER (missed) AS n_missed, round(count(*) FILTER (missed) / count(*), 9) AS share FROM m GROUP BY 1 HAVING count(*) >= 8", "customers", "suppliers"))
def sa9(spark, d):
    of = lambda t: points(spark, d, t).withColumn("logA", (F.col("id") % 17) / 10.0).withColumn("logS", (F.col("id") % 11) / 10.0)
    return G.false_negatives(of("customer").withColumn("seg", F.col("id") % 40), of("supplier"))[1].withColumn("share", F.round("share", 9))


@query("so8_top_segments", sql(" SELECT cat, len FROM segments ORDER BY len DESC, cat LIMIT 15", "segments"))
def so8(spark, d):
    return G.top_by(segments(spark, d), "len", 15).select("cat", "len")


@query("x15_slope_floor_sweep", sql(CLOUD + ", f AS (SELECT unnest([-8.0, -6.0, -5.0, -4.0, -3.0])::DOUBLE AS floor) SELECT floor, count(*) FILTER (ls >= floor) AS n FROM cl, f GROUP BY floor", "vertices"))
def x15(spark, d):
    return G.slope_floor_sweep(A.cloud(vertices(spark, d)), [-8.0, -6.0, -5.0, -4.0, -3.0]).select("floor", "n")


@query("x21_detection_by_scale", "WITH t AS (SELECT o_totalprice + 1 AS ratio, o_orderstatus = 'F' AS found FROM orders), e AS (SELECT log10(min(ratio)) AS lo, log10(max(ratio)) AS hi FROM t) SELECT CAST(least(11, floor((log10(ratio) - lo) / ((hi - lo) / 12))) AS INT) AS bin, count(*) AS n, round(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 8) AS share FROM t, e GROUP BY 1")
def x21(spark, d):
    t = table(spark, d, "orders").select((F.col("o_totalprice") + 1).alias("ratio"), (F.col("o_orderstatus") == "F").alias("found"))
    return G.detection_by_scale(t).select("bin", "n", F.round("share", 8).alias("share"))


@query("dv8_wrap", sql(", q AS (SELECT cat, seq, avg(x) OVER n AS x, avg(y) OVER n AS y FROM verticesxy WINDOW n AS (PARTITION BY cat ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), d AS (SELECT cat, seq, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM q WINDOW w AS (PARTITION BY cat ORDER BY seq)) SELECT cat, CAST(seq AS INT) AS seq, round(acos(greatest(-1, least(1, (ax * bx + ay * by_) / sqrt((ax * ax + ay * ay) * (bx * bx + by_ * by_))))), 5) AS angle FROM d", "vertices", "verticesxy"))
def dv8(spark, d):
    return G.wrap(vertices_xy(spark, d)).select("cat", "seq", F.round("angle", 5).alias("angle"))


@query("sa10_split_comparison", sql(SLOPE_XY + ", t AS (SELECT *, x > (SELECT median(x) FROM cl) AS far FROM cl) SELECT CAST(far AS INT) AS side, count(*) AS n, round(median(ls), 6) AS \"median_logS\", round(regr_slope(ls, la), 6) AS theta FROM t GROUP BY far", "vertices"))
def sa10(spark, d):
    v = vertices_xy(spark, d)
    cloud = keep(A.cloud(v).join(v.select("cat", "seq", "x"), ["cat", "seq"]), "cloud")
    return G.compare_sides(G.spatial_halves(cloud)).select("side", "n", F.round("median_logS", 6).alias("median_logS"), F.round("theta", 6).alias("theta"))


@query("sa5_accumulate_and_prune")
def sa5(spark, d):
    seg = segments(spark, d)
    area = F.log10(F.col("o_orderkey") * 31 % 997 + 1)
    slope = -1 - 0.5 * F.greatest(F.lit(0.0), area - 1.8) + (F.col("o_orderkey") % 7 - 3) / 100.0
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("cat"), F.col("o_orderkey").alias("seq"), area.alias("logA"), slope.alias("logS"))
    return G.accumulate_and_prune(seg, v, least=60)


@query("x24_apex_control", sql(NODES + AREA + """, dn(node, at_, fd) AS (SELECT node, recv, CASE flc WHEN 2 THEN sqrt(2.0) WHEN 1 THEN 1.0 ELSE 0.0 END FROM nodes UNION ALL SELECT d.node, n.recv, fd + CASE n.flc WHEN 2 THEN sqrt(2.0) ELSE 1.0 END FROM dn d JOIN nodes n ON n.node = d.at_ WHERE n.recv <> n.node), fds AS (SELECT node, max(fd) AS fd FROM dn GROUP BY node),
src AS (SELECT node, ncontrib FROM full_ f WHERE ncontrib >= 10 AND NOT EXISTS (SELECT 1 FROM full_ d WHERE d.recv = f.node AND d.node <> f.node AND d.ncontrib >= 10)), q AS (SELECT quantile_cont(ncontrib, 0.1) AS lo, quantile_cont(ncontrib, 0.9) AS hi FROM src),
pool AS (SELECT node FROM full_, q WHERE ncontrib BETWEEN lo AND hi), gr AS (SELECT 'heads' AS grp, node FROM src UNION ALL SELECT 'control', node FROM pool),
fl AS (SELECT a.top, max(round(u.fd, 6)) - max(round(t.fd, 6)) AS flow FROM anc a JOIN fds u ON u.node = a.node JOIN fds t ON t.node = a.top GROUP BY a.top)
SELECT grp AS "group", count(*) AS n, round(avg(flow), 4) AS mean, round(stddev_pop(flow), 4) AS sd, round(stddev_pop(flow) / avg(flow), 4) AS cv FROM gr JOIN fl ON fl.top = gr.node GROUP BY grp""", "cells", recursive=True))
def x24_control(spark, d):
    n = routed(spark, d)
    return G.apex_control(n, R.sources(n, 10), most=None).withColumns({c: F.round(c, 4) for c in ("mean", "sd", "cv")})


@query("ag16_drainage_density", sql(NODES + AREA + " SELECT round(sum(CASE WHEN ncontrib >= 10 THEN CASE flc WHEN 2 THEN sqrt(2.0) WHEN 1 THEN 1.0 ELSE 0.0 END ELSE 0.0 END) / count(*), 6) AS density FROM full_", "cells", recursive=True))
def ag16(spark, d):
    return G.drainage_density(routed(spark, d), 10).select(F.round("density", 6).alias("density"))


@query("d7_node_index", sql(" SELECT r, c, row_number() OVER (ORDER BY r, c) - 1 AS idx FROM cells", "cells"))
def d7(spark, d):
    return G.node_index(cells(spark, d))


@query("x6_chi_to_base", sql(NODES + AREA + """, dn(node, at_, t) AS (SELECT node, recv, CASE WHEN recv = node THEN 0.0::DOUBLE ELSE CASE flc WHEN 2 THEN sqrt(2.0) ELSE 1.0 END * power(1000.0 / ncontrib, 0.525) END FROM full_
UNION ALL SELECT d.node, n.recv, t + CASE n.flc WHEN 2 THEN sqrt(2.0) ELSE 1.0 END * power(1000.0 / n.ncontrib, 0.525) FROM dn d JOIN full_ n ON n.node = d.at_ WHERE n.recv <> n.node) SELECT node, round(max(t), 4) AS chi FROM dn GROUP BY node""", "cells", recursive=True))
def x6(spark, d):
    step = F.when(F.col("flc") == 2, F.sqrt(F.lit(2.0))).otherwise(1.0)
    t = G.downstream_sum(routed(spark, d), step * F.pow(1000.0 / F.col("ncontrib"), F.lit(0.525)))
    return t.select("node", F.round("total", 4).alias("chi"))


@query("x11_claimed_catchments", sql(NODES + AREA + ", m AS (SELECT node FROM full_ WHERE ncontrib BETWEEN 6 AND 30) SELECT a.node, a.top AS mouth FROM anc a JOIN m ON m.node = a.top JOIN full_ f ON f.node = a.top QUALIFY row_number() OVER (PARTITION BY a.node ORDER BY f.ncontrib DESC, a.top) = 1", "cells", recursive=True))
def x11(spark, d):
    n = routed(spark, d)
    return G.claimed_cells(n, n.filter("ncontrib BETWEEN 6 AND 30"))


@query("x17_stream_corners", sql(NODES + AREA + " SELECT DISTINCT CAST((r + i) * @W + c + j AS BIGINT) AS corner FROM full_, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) WHERE ncontrib >= 10", "cells", recursive=True))
def x17(spark, d):
    return G.stream_corners(routed(spark, d).filter("ncontrib >= 10"), side(spark, d))


@query("x19_distance_to_channel", sql(NODES + AREA + " SELECT a.node AS id_a, round(min(sqrt(power(a.r - b.r, 2) + power(a.c - b.c, 2))), 6) AS d FROM full_ a JOIN full_ b ON b.ncontrib >= 40 GROUP BY a.node", "cells", recursive=True))
def x19(spark, d):
    n = keep(routed(spark, d).select("node", "r", "c", "ncontrib"), "routed")
    return G.distance_to_channel(n, n.filter("ncontrib >= 40")).select(F.col("node").alias("id_a"), F.round("d", 6).alias("d"))


@query("x5_criteria_drift", "SELECT s_nationkey AS res, count(*) AS n, round(median(s_acctbal), 6) AS median, round(quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25), 6) AS iqr, round(stddev_pop(s_acctbal) / nullif(avg(s_acctbal), 0), 6) AS cv FROM supplier GROUP BY s_nationkey")
def x5(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_nationkey").alias("res"), F.col("s_acctbal").alias("v"))
    return G.criteria_drift(t, "res", "v").select("res", "n", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"), F.round("cv", 6).alias("cv"))


@query("v15_floodplain_cut", "WITH c AS (SELECT o_totalprice AS z, o_custkey % 10 / 4000.0 AS slope FROM orders), p AS (SELECT unnest(range(51)) AS k, unnest(q) AS q FROM (SELECT quantile_cont(z, [" + ", ".join(str(k / 50) for k in range(51)) + "]) AS q FROM c)), b AS (SELECT c.*, least(49, (SELECT count(*) FROM p WHERE p.q <= c.z) - 1) AS band FROM c), s AS (SELECT band, avg(CASE WHEN slope < 0.001 THEN 1.0 ELSE 0.0 END) AS share FROM b GROUP BY band), m AS (SELECT min(band) AS band FROM s WHERE share < 0.4) SELECT CAST(m.band AS INT) AS band, round(p.q, 4) AS z FROM m JOIN p ON p.k = m.band")
def v15(spark, d):
    t = table(spark, d, "orders").select(F.col("o_totalprice").alias("z"), (F.col("o_custkey") % 10 / 4000.0).alias("slope"))
    return G.floodplain_cut(t).select(F.col("band").cast("int").alias("band"), F.round("z", 4).alias("z"))


@query("j15_basin_cells", sql(NODES + LAB + " SELECT lab, count(*) AS n, min(node) AS first FROM lab GROUP BY lab", "cells", recursive=True))
def j15(spark, d):
    return G.basin_cells(labels(spark, d))


@query("v8_slope_area_filters", sql(CLOUD + " SELECT cat, CAST(seq AS INT) AS seq, round(la, 6) AS logA FROM cl WHERE ls >= log10(0.0001) AND la <= log10(40)", "vertices"))
def v8(spark, d):
    return A.cloud(vertices(spark, d), min_slope=1e-4, max_area=40.0).select("cat", "seq", F.round("logA", 6).alias("logA"))


assert nodes
