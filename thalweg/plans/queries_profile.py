"""Queries over profiles: windows along vertices and slope-area analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import accumulation_label, steady_state_slope
from ..operators import sequence as S
from ..operators import slopearea as A
from .views import cells, segments, sql, table, vertices, vertices_xy

Q: dict = {}
O: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f
    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


VXY = ("vertices", "verticesxy")


@query("w1_segment_distances", sql(""", d AS (SELECT cat, seq, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS st FROM verticesxy WINDOW w AS (PARTITION BY cat ORDER BY seq)),
e AS (SELECT cat, seq, sum(st) OVER (PARTITION BY cat ORDER BY seq) AS sd FROM d)
SELECT cat, CAST(seq AS INT) AS seq, round(sd, 4) AS s_down, round(max(sd) OVER (PARTITION BY cat) - sd, 4) AS s_up FROM e""", *VXY))
def w1(spark, d):
    return S.segment_distances(vertices_xy(spark, d)).select("cat", "seq", F.round("s_down", 4).alias("s_down"), F.round("s_up", 4).alias("s_up"))


@query("w2_moving_average", sql(" SELECT cat, CAST(seq AS INT) AS seq, round(avg(z) OVER (PARTITION BY cat ORDER BY s RANGE BETWEEN 50000.25 PRECEDING AND 50000.25 FOLLOWING), 6) AS z_smooth FROM vertices", "vertices"))
def w2(spark, d):
    return S.moving_average(vertices(spark, d), "z", 100000.5, "z_smooth").select("cat", "seq", *r6("z_smooth"))


SLOPE = """, h AS (SELECT *, s - lag(s) OVER w AS h1, lead(s) OVER w - s AS h2, lag(z) OVER w AS z1, lead(z) OVER w AS z2 FROM vertices WINDOW w AS (PARTITION BY cat ORDER BY seq)),
sl AS (SELECT cat, seq, s, z, A, -(CASE WHEN h1 IS NULL THEN (z2 - z) / nullif(h2, 0) WHEN h2 IS NULL THEN (z - z1) / nullif(h1, 0)
  ELSE (h1 * h1 * z2 + (h2 * h2 - h1 * h1) * z - h2 * h2 * z1) / nullif(h1 * h2 * (h1 + h2), 0) END) AS slope FROM h)"""


@query("w4_channel_slope", sql(SLOPE + " SELECT cat, CAST(seq AS INT) AS seq, round(slope, 6) AS slope FROM sl", "vertices"))
def w4(spark, d):
    return S.channel_slope(vertices(spark, d)).select("cat", "seq", *r6("slope"))


@query("w5_chi", sql(""", n AS (SELECT cat, seq, power(1.0 / A, 0.5) * abs(s - lead(s) OVER (PARTITION BY cat ORDER BY seq)) AS t FROM vertices)
SELECT cat, CAST(seq AS INT) AS seq, round(coalesce(sum(t) OVER (PARTITION BY cat ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 4) AS chi FROM n""", "vertices"))
def w5(spark, d):
    return S.chi(vertices(spark, d)).select("cat", "seq", F.round("chi", 4).alias("chi"))


@query("w6_densify", sql(""", e AS (SELECT cat, min(s) AS lo, max(s) AS hi, greatest(ceil((max(s) - min(s)) / 20000.0) + 1, 2) AS n FROM vertices GROUP BY cat),
st AS (SELECT cat, lo, hi, n, unnest(range(CAST(n AS BIGINT))) AS k FROM e), stp AS (SELECT cat, k, CASE WHEN k = n - 1 THEN hi ELSE lo + k * ((hi - lo) / (n - 1)) END AS at_ FROM st),
iv AS (SELECT cat, s, z, lead(s) OVER w AS s2, lead(z) OVER w AS z2 FROM vertices WINDOW w AS (PARTITION BY cat ORDER BY s)),
j AS (SELECT stp.cat, k, at_, z + (at_ - s) / (s2 - s) * (z2 - z) AS z, row_number() OVER (PARTITION BY stp.cat, k ORDER BY s DESC) AS rn FROM stp JOIN iv ON stp.cat = iv.cat AND at_ >= s AND at_ <= s2 AND s2 > s)
SELECT cat, CAST(k AS BIGINT) AS seq, round(at_, 2) AS s, round(z, 3) AS z FROM j WHERE rn = 1""", "vertices"))
def w6(spark, d):
    return S.densify(vertices(spark, d), 20000.0, ["z"]).select("cat", "seq", F.round("s", 2).alias("s"), F.round("z", 3).alias("z"))


@query("w12_coarsen", sql(""", e AS (SELECT cat, min(s) AS lo, max(s) AS hi, greatest(1, round_even(0.1 * count(*), 0)) AS m FROM vertices GROUP BY cat HAVING count(*) >= 3),
st AS (SELECT cat, lo, hi, m, unnest(range(1, CAST(m AS BIGINT) + 1)) AS k FROM e), stp AS (SELECT cat, m, k, lo + k * ((hi - lo) / (m + 1)) AS at_ FROM st),
iv AS (SELECT cat, s, z, lead(s) OVER w AS s2, lead(z) OVER w AS z2 FROM vertices WINDOW w AS (PARTITION BY cat ORDER BY s)),
j AS (SELECT stp.cat, m, k, at_, z + (at_ - s) / (s2 - s) * (z2 - z) AS z, row_number() OVER (PARTITION BY stp.cat, k ORDER BY s DESC) AS rn FROM stp JOIN iv ON stp.cat = iv.cat AND at_ >= s AND at_ <= s2 AND s2 > s)
SELECT cat, CAST(m AS BIGINT) - k AS seq, round(at_, 4) AS s, round(z, 4) AS z FROM j WHERE rn = 1""", "vertices"))
def w12(spark, d):
    return S.coarsen(vertices(spark, d), 0.1, ["z"]).select("cat", "seq", F.round("s", 4).alias("s"), F.round("z", 4).alias("z"))


@query("w14_runs_above", sql(""", f AS (SELECT cat, seq, row_number() OVER (PARTITION BY cat ORDER BY seq) AS i FROM vertices WHERE z > 20)
SELECT cat, CAST(min(seq) AS INT) AS run_start, CAST(max(seq) AS INT) AS run_end, count(*) AS n FROM f GROUP BY cat, seq - i HAVING count(*) > 2""", "vertices"))
def w14(spark, d):
    return S.runs_above(vertices(spark, d), F.col("z") > 20, 2)


@query("w15_running_peak", sql(""", p AS (SELECT cat, seq, z, max(z) OVER (PARTITION BY cat ORDER BY seq) AS peak FROM vertices),
q AS (SELECT cat, seq, peak, bool_and(z < 0.8 * peak) OVER w AS low, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY cat ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT cat, arg_min(peak, seq) AS peak, CAST(min(seq) AS INT) AS seq FROM q WHERE low AND n = 5 GROUP BY cat""", "vertices"))
def w15(spark, d):
    return S.running_peak(vertices(spark, d), "z")


@query("w16_within_reach", sql(", f AS (SELECT r, c, CAST(z AS BIGINT) % 11 = 0 AS d FROM cells) SELECT r, c, " + ", ".join(
    f"EXISTS (SELECT 1 FROM f b WHERE b.d AND b.{p} = f.{p} AND b.{o} {op} f.{o} AND abs(b.{o} - f.{o}) <= 3) AS w_{n}" for n, p, o, op in (("left", "r", "c", "<="), ("right", "r", "c", ">="), ("up", "c", "r", "<="), ("down", "c", "r", ">="))) + " FROM f", "cells"))
def w16(spark, d):
    return S.within(cells(spark, d).withColumn("d", F.col("z").cast("long") % 11 == 0), "d", 3).select("r", "c", "w_left", "w_right", "w_up", "w_down")


@query("w7_downstream_profile", sql(""", up(head, cat, ord) AS (SELECT s.cat, s.cat, 0 FROM segments s WHERE NOT EXISTS (SELECT 1 FROM segments t WHERE t.tostream = s.cat)
UNION ALL SELECT head, tostream, ord + 1 FROM up JOIN segments USING (cat) WHERE tostream > 0)
SELECT head, CAST(ord AS INT) AS ord, up.cat, len, CAST(sum(len) OVER (PARTITION BY head ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS s FROM up JOIN segments s ON s.cat = up.cat""", "segments", recursive=True))
def w7(spark, d):
    from ..operators.network import downstream_paths, headwaters, profile_distance

    seg = segments(spark, d)
    return profile_distance(downstream_paths(seg, headwaters(seg)), seg)


CLOUD = SLOPE + ", cl AS (SELECT cat, seq, log10(A) AS la, log10(slope) AS ls FROM sl WHERE A > 0 AND slope > 0)"


@query("sa1_slope_area", sql(CLOUD + " SELECT cat, CAST(seq AS INT) AS seq, round(la, 6) AS logA, round(ls, 6) AS logS FROM cl", "vertices"))
def sa1(spark, d):
    return A.cloud(vertices(spark, d)).select("cat", "seq", *r6("logA", "logS"))


FIT = """, ends AS (SELECT quantile_cont(la, 0.05) AS lo, quantile_cont(la, 0.95) AS hi FROM cl), kn AS (SELECT k, lo + k * (hi - lo) / 199 AS kn FROM ends, range(200) t(k)),
fit AS (SELECT k, any_value(kn) AS kn, count(*) AS n, count(*) FILTER (la <= kn) AS nl, regr_slope(ls, greatest(0, la - kn)) AS b, regr_intercept(ls, greatest(0, la - kn)) AS h,
  regr_syy(ls, greatest(0, la - kn)) - power(regr_sxy(ls, greatest(0, la - kn)), 2) / regr_sxx(ls, greatest(0, la - kn)) AS rss FROM cl, kn GROUP BY k),
best AS (SELECT * FROM fit WHERE nl >= 10 AND n - nl >= 10 ORDER BY rss, k LIMIT 1)"""


@query("sa2_slope_area_break", sql(CLOUD + FIT + " SELECT CAST(k AS INT) AS k, round(kn, 6) AS logA_star, round(power(10, kn), 4) AS A_star, round(-b, 6) AS theta, round(h, 6) AS hillslope_logS, round(rss, 4) AS rss, n FROM best", "vertices"))
def sa2(spark, d):
    return A.fit_break(A.cloud(vertices(spark, d))).select("k", F.round("logA_star", 6).alias("logA_star"), F.round("A_star", 4).alias("A_star"), *r6("theta", "hillslope_logS"), F.round("rss", 4).alias("rss"), "n")


@query("sa3_transitions", sql(""", t AS (SELECT cat, seq, A, x, y, lag(A) OVER w AS pa, lag(x) OVER w AS px, lag(y) OVER w AS py, min(A) OVER (PARTITION BY cat) AS a0, max(A) OVER (PARTITION BY cat) AS a1 FROM verticesxy WINDOW w AS (PARTITION BY cat ORDER BY seq))
SELECT cat, round(px + (12.5 - pa) / (A - pa) * (x - px), 4) AS x, round(py + (12.5 - pa) / (A - pa) * (y - py), 4) AS y FROM t WHERE a0 < 12.5 AND a1 >= 12.5 AND A >= 12.5 AND pa < 12.5""", *VXY))
def sa3(spark, d):
    return A.transitions(vertices_xy(spark, d), 12.5).select("cat", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("sa4_binned_medians", sql(CLOUD + """, e AS (SELECT min(la) AS lo, max(la) AS hi FROM cl), b AS (SELECT CAST(floor((la - lo) / ((hi - lo) / 18)) AS INT) AS bin, la, ls FROM cl, e WHERE la < hi)
SELECT bin, count(*) AS n, round(median(la), 6) AS x, round(median(ls), 6) AS y FROM b GROUP BY bin HAVING count(*) >= 8""", "vertices"))
def sa4(spark, d):
    return A.binned_medians(A.cloud(vertices(spark, d))).select("bin", "n", *r6("x", "y"))


@query("sa7_snap_dedup", sql(""", p AS (SELECT id, x, y, (id * 31 % 101) / 100.0 AS R FROM customers), g AS (SELECT CAST(round(x / 50) AS BIGINT) AS gx, CAST(round(y / 50) AS BIGINT) AS gy, *, row_number() OVER (PARTITION BY round(x / 50), round(y / 50) ORDER BY R DESC, id) AS rn FROM p)
SELECT gx, gy, id, CAST(R AS DOUBLE) AS R, x, y FROM g WHERE rn = 1""", "customers"))
def sa7(spark, d):
    from .views import points

    return A.snap_dedup(points(spark, d, "customer").withColumn("R", (F.col("id") * 31 % 101) / 100), 50.0)


@query("x8_area_survival", """WITH v AS (SELECT CAST(o_custkey % 400 + 1 AS DOUBLE) AS A FROM orders), e AS (SELECT log10(min(A)) AS lo, log10(max(A)) AS hi, count(*) AS n FROM v),
ks AS (SELECT CAST(k AS INT) AS k, lo + k * ((hi - lo) / 59) AS la, n FROM e, range(60) t(k)) SELECT k, round(power(10, la), 4) AS a, round((SELECT count(*) FROM v WHERE log10(A) >= la - 1e-9) / n, 8) AS p FROM ks""")
def x8(spark, d):
    v = table(spark, d, "orders").select((F.col("o_custkey") % 400 + 1).cast("double").alias("A"))
    return A.area_survival(v).select("k", F.round("a", 4).alias("a"), F.round("p", 8).alias("p"))


@query("w17_local_log_slope", """WITH t AS (SELECT o_custkey % 37 + 1 AS t, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT 1 AS cat, t, log10(t) AS x, log10(n) AS y FROM t),
h AS (SELECT t, x - lag(x) OVER w AS h1, lead(x) OVER w - x AS h2, y, lag(y) OVER w AS y1, lead(y) OVER w AS y2 FROM l WINDOW w AS (ORDER BY t))
SELECT t, round(CASE WHEN h1 IS NULL THEN (y2 - y) / h2 WHEN h2 IS NULL THEN (y - y1) / h1 ELSE (h1 * h1 * y2 + (h2 * h2 - h1 * h1) * y - h2 * h2 * y1) / (h1 * h2 * (h1 + h2)) END, 6) AS slope FROM h""")
def w17(spark, d):
    counts = table(spark, d, "orders").groupBy((F.col("o_custkey") % 37 + 1).alias("t")).agg(F.count("*").alias("n"))
    t = counts.select(F.lit(1).alias("cat"), "t", F.col("t").alias("seq"), F.log10("t").alias("x"), F.log10("n").alias("y"))
    return S.gradient(t, "y", "x", "slope").select("t", *r6("slope"))


@query("x10_chi_steepness", sql(""", n AS (SELECT cat, seq, z, power(1.0 / A, 0.5) * abs(s - lead(s) OVER (PARTITION BY cat ORDER BY seq)) AS t FROM vertices),
c AS (SELECT cat, seq, z, coalesce(sum(t) OVER (PARTITION BY cat ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x FROM n),
h AS (SELECT cat, seq, x - lag(x) OVER w AS h1, lead(x) OVER w - x AS h2, z, lag(z) OVER w AS z1, lead(z) OVER w AS z2 FROM c WINDOW w AS (PARTITION BY cat ORDER BY seq))
SELECT cat, CAST(seq AS INT) AS seq, round(CASE WHEN h1 IS NULL THEN (z2 - z) / nullif(h2, 0) WHEN h2 IS NULL THEN (z - z1) / nullif(h1, 0) ELSE (h1 * h1 * z2 + (h2 * h2 - h1 * h1) * z - h2 * h2 * z1) / nullif(h1 * h2 * (h1 + h2), 0) END, 4) AS ksn FROM h""", "vertices"))
def x10(spark, d):
    return S.gradient(S.chi(vertices(spark, d)), "z", "chi", "ksn").select("cat", "seq", F.round("ksn", 4).alias("ksn"))


ROLL = """, n AS (SELECT cat, seq, z, power(1.0 / A, 0.5) * abs(s - lead(s) OVER (PARTITION BY cat ORDER BY seq)) AS t FROM vertices),
c AS (SELECT cat, seq, z, coalesce(sum(t) OVER (PARTITION BY cat ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x FROM n)"""


def _gradient_sql(source: str, y: str, out: str, name: str) -> str:
    return f""", h{name} AS (SELECT *, x - lag(x) OVER w AS h1, lead(x) OVER w - x AS h2, lag({y}) OVER w AS y1, lead({y}) OVER w AS y2 FROM {source} WINDOW w AS (PARTITION BY cat ORDER BY seq)),
{name} AS (SELECT cat, seq, z, x, {"ksn, " if out != "ksn" else ""}CASE WHEN h1 IS NULL THEN (y2 - {y}) / nullif(h2, 0) WHEN h2 IS NULL THEN ({y} - y1) / nullif(h1, 0) ELSE (h1 * h1 * y2 + (h2 * h2 - h1 * h1) * {y} - h2 * h2 * y1) / nullif(h1 * h2 * (h1 + h2), 0) END AS {out} FROM h{name})"""


@query("x10_rollovers", sql(ROLL + _gradient_sql("c", "z", "ksn", "k1") + _gradient_sql("k1", "ksn", "kc", "k2") + " SELECT cat, CAST(arg_max(seq, (abs(kc), -seq)) AS INT) AS seq, round(arg_max(kc, (abs(kc), -seq)), 3) AS ksn_change FROM k2 WHERE kc IS NOT NULL GROUP BY cat", "vertices"))
def x10_rollovers(spark, d):
    return S.rollovers(S.chi(vertices(spark, d))).select("cat", "seq", F.round("ksn_change", 3).alias("ksn_change"))


@query("x9_windowed_regression_slope", sql(" SELECT cat, CAST(seq AS INT) AS seq, round(abs(CASE WHEN count(*) OVER w >= 3 THEN regr_slope(z, s) OVER w END), 6) AS slope FROM vertices WINDOW w AS (PARTITION BY cat ORDER BY s RANGE BETWEEN 60000 PRECEDING AND 60000 FOLLOWING)", "vertices"))
def x9(spark, d):
    return S.windowed_slope(vertices(spark, d), 120000.0).select("cat", "seq", *r6("slope"))


@query("f1_steady_state_slope", sql(" SELECT cat, CAST(seq AS INT) AS seq, round(power(0.001 / 0.00001, 1.0) * power(A, -0.5), 6) AS slope FROM vertices", "vertices"))
def f1(spark, d):
    return vertices(spark, d).select("cat", "seq", F.round(steady_state_slope(1e-5, 0.5, 1.0, 1e-3, F.col("A")), 6).alias("slope"))


@query("f2_accumulation_label", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Drainage area (m^2)' WHEN 1 THEN 'Drainage area (km^2)' WHEN 2 THEN 'Discharge (m^3/s)' WHEN 3 THEN 'Discharge (ft^3/s)' ELSE 'Flow accumulation' END AS label FROM customer""")
def f2(spark, d):
    unit = F.get(F.array(*map(F.lit, ("m2", "km2", "cumecs", "cfs", "other"))), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, d, "customer").select("c_custkey", accumulation_label(unit).alias("label"))


@query("io11_drop_coincident", sql(", q AS (SELECT cat, seq, round(z) AS x, 0.0 AS y FROM vertices), l AS (SELECT *, lag(x) OVER (PARTITION BY cat ORDER BY seq) AS px FROM q), k AS (SELECT cat, seq, x FROM l WHERE px IS NULL OR px <> x) SELECT cat, CAST(seq AS INT) AS seq, x FROM k QUALIFY count(*) OVER (PARTITION BY cat) >= 2", "vertices"))
def io11(spark, d):
    return S.drop_coincident(vertices(spark, d).select("cat", "seq", F.round("z").alias("x"), F.lit(0.0).alias("y"))).select("cat", "seq", "x")


@query("ks1_steepness_pieces")
def ks1(spark, d):
    from ..operators.metrics import steepness

    return steepness(S.chi(vertices(spark, d)), penalty=2000.0, least=4)
