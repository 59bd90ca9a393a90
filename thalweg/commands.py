"""The whole commands in one call each, with their usual defaults, over the operators."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.scalar import ACCUMULATION_LABELS
from .operators import heads as H
from .operators import incision as I
from .operators import kernels as K
from .operators import network as N
from .operators import routing as R
from .operators import sequence as S
from .operators import slopearea as A
from .plans.iterate import keep
from .sources.network import write_json, write_profiles, write_subnetwork


class NothingFound(ValueError):
    """A command found no head, transition or fit."""


def link_network(lines: DataFrame) -> DataFrame:
    """(cat, tostream) of polylines (cat, seq, x, y), linked where one ends and another starts."""
    ends = lines.groupBy("cat").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    return N.link(ends.select("cat", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")))


def profiles(v: DataFrame, seg: DataFrame, cat: int, direction: str = "downstream",
    values: tuple[str, ...] = ("z", "A"), dx_target: float | None = None, window: float | None = None) -> DataFrame:
    """Long profiles (head, i, cat, s, values) from a segment down to the outlet, or from each headwater down to it.

    Segments are resampled to dx_target and smoothed over a window, each on its own, before they are joined.
    """
    paths = N.select_paths(seg, cat, direction)
    t = S.segment_distances(v).select("cat", "seq", F.col("s_down").alias("s"), *values)
    if dx_target:
        t = S.densify(t, dx_target, list(values))
    names = list(values)
    if window:
        for x in values:
            t = S.moving_average(t, x, window, f"{x}_smoothed")
            names.append(f"{x}_smoothed")
    t = t.withColumn("s_up", F.max("s").over(Window.partitionBy("cat")) - F.col("s"))
    return N.assemble_profile(paths, t, names)


#: Plot -> the columns that it needs and shows (x, y); the values' logarithms are the plot's affair.
PLOTS = {"LongProfile": ("s", "z"), "SlopeAccum": ("A", "slope"), "SlopeDistance": ("s", "slope"), "AccumDistance": ("s", "A")}


def plot_tables(profile: DataFrame, plots: tuple[str, ...] = tuple(PLOTS), units: str = "m2") -> dict[str, DataFrame]:
    """plot -> (head, i, x, y, x_label, y_label), distances in km; smoothed values where there are any.

    A plot whose values the profile lacks is left out with a warning. Plots of area show positive ones only.
    """
    area = dict(ACCUMULATION_LABELS).get(units, "Flow accumulation")
    labels = {"s": "Distance from mouth [km]", "z": "Elevation [m]", "A": area, "slope": "Slope [-]"}
    out = {}
    for name in plots:
        if name not in PLOTS:
            raise ValueError(f"no plot {name}")
        if lacking := [c for c in PLOTS[name] if c not in profile.columns]:
            warnings.warn(f"plot {name} needs {', '.join(lacking)}; left out", stacklevel=2)
            continue
        shown = [F.col("s") / 1000 if c == "s" else F.col(f"{c}_smoothed" if f"{c}_smoothed" in profile.columns else c) for c in PLOTS[name]]
        kept = profile.filter(F.col("A") > 0) if "A" in PLOTS[name] else profile
        out[name] = kept.select(
            "head", "i", *(c.alias(n) for c, n in zip(shown, "xy")),
            *(F.lit(labels[c]).alias(f"{n}_label") for c, n in zip(PLOTS[name], "xy")))
    return out


def fluvial_profiler(
    v: DataFrame, seg: DataFrame, cat: int, direction: str = "downstream", values: tuple[str, ...] = ("z", "A"),
    dx_target: float | None = None, window: float | None = None,
                     outfile: str | None = None, outjson: str | None = None,
                         plots: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The profiles and the plots' tables; writes the text table and the sub-network's node-link records if asked."""
    got = keep(profiles(v, seg, cat, direction, values, dx_target, window), "profiles")
    if outfile:
        write_profiles(got, outfile)
    if outjson:
        write_subnetwork(
            *N.build_graph(v.select("cat", "seq", *values), seg.select("cat", "tostream"), list(values)),
            got.select("cat").distinct(), outjson, keep_outlet=direction != "upstream")
    return got, plot_tables(got, plots)


def channel_heads(source: DataFrame, method: str = "slope_area", *, ncols: int | None = None, threshold: int = 100,
    a_0: float = 1000.0, m_over_n: float = 0.525, n_connecting_nodes: int = 10, min_segment_length: int = 10,
                  window_radius: float = 7.0, tan_curv_threshold: float = 0.1, cellsize: float = 1.0,
                      window: float = 0.0, min_slope: float = 1e-4, max_area: float | None = None,
                      head_rule: str = "global",
                  min_profile_nodes: int = 0, extend_to_junction: bool = False, filled: DataFrame | None = None,
                      curvature: DataFrame | None = None, direction: DataFrame | None = None,
                      precision: int = 64, fill_dem: bool = True, fill_slope: float = 1e-4, with_routing: bool = False):
    """Where channels begin.

    slope_area: source are vertices (cat, seq, s, x, y, z, A); the break's area and its crossings (cat, x, y, a_star).
    divides: source are cells (r, c, z); heads (node, r, c) in the valley of each source. Profiles have
    at least twice min_segment_length and one nodes unless min_profile_nodes says otherwise.
    The terrain's depressions are filled first, rising by fill_slope, unless fill_dem is False. with_routing gives
    (heads, filled cells (r, c, z), routed nodes) instead of the heads alone.
    dreich: as divides, valleys chosen by tangential curvature.
    filled (r, c, z), curvature (r, c, curvature) and direction (r, c, d: D8 codes) take the place of the
    terrain, of what would be computed, and of steepest descent; direction must cover the same rows and
    columns. precision: 32 for single-precision profiles and regressions.
    """
    if method == "slope_area":
        cloud = keep(A.cloud(source, window or None, min_slope=min_slope, max_area=max_area), "cloud")
        best = A.fit_break(cloud).first() if cloud.limit(20).count() == 20 else None
        if best is None:
            raise NothingFound("too few points for a break")
        return A.transitions(source, best.A_star).withColumn("a_star", F.lit(best.A_star))
    if method not in ("divides", "dreich"):
        raise ValueError("method must be slope_area, divides or dreich")
    if filled is not None:
        surface = filled
    else:
        surface = keep(K.fill(source, fill_slope, cellsize).select("r", "c", F.col("filled").alias("z")), "filled") if fill_dem else source
    if direction is None:
        nodes = R.receivers(surface, ncols)
    else:
        same_extent(direction, source)
        codes = direction.select(F.col("r").alias("_r"), F.col("c").alias("_c"), "d")
        nodes = R.receivers_from_directions(
            surface.join(codes, (F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c")), "left").select(
                "r", "c", "z", "d"), ncols)
    nodes = keep(R.accumulate(keep(nodes, "nodes"), cellsize), "routed")
    if method == "divides":
        found = H.first_order_valleys(nodes, threshold)
        min_profile_nodes = min_profile_nodes or 2 * min_segment_length + 1
    else:
        curved = (R.tangential_curvature(surface, window_radius, cellsize) if curvature is None else curvature).select(
            F.col("r").alias("_r"), F.col("c").alias("_c"), "curvature")
        gated = nodes.join(curved, (F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c")), "left").drop(
            "_r", "_c").withColumn("gate", F.col("curvature") > tan_curv_threshold)
        found = H.valleys(keep(gated, "gated"), "gate", threshold, n_connecting_nodes)
    heads = keep(H.heads_from_valleys(
            nodes, keep(found, "valleys"), threshold, min_segment_length, a_0, m_over_n, cellsize, min_profile_nodes,
            extend_to_junction, head_rule, precision), "heads")
    if not heads.limit(1).count():
        raise NothingFound("no channel heads")
    return (heads, surface, nodes) if with_routing else heads


def same_extent(a: DataFrame, b: DataFrame) -> None:
    """Raises unless two grids of cells (r, c) cover the same rows and columns."""
    ends = [tuple(t.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()) for t in (a, b)]
    if ends[0] != ends[1]:
        raise ValueError(f"grids differ: rows and columns {ends[0]} and {ends[1]}")


def route(cells: DataFrame, ncols: int, min_slope: float = 0.0, cellsize: float = 1.0) -> DataFrame:
    """(node, r, c, z, recv, flc, ncontrib, fd, root) of the filled surface."""
    z = K.fill(cells, min_slope, cellsize).select("r", "c", F.col("filled").alias("z"))
    return R.accumulate(keep(R.receivers(z, ncols), "nodes"), cellsize)


#: Cells of a raster that one task evolves.
RASTER_CELLS = 256 * 256


def evolve(cells: DataFrame, nsteps: int = 0, k: float = 1e-5, m: float = 0.5, n: float = 1.0, uplift: float = 1e-3,
    dt: float = 1000.0, min_slope: float = 1e-4, cellsize: float = 1.0, boundary: str | None = "edges",
    record_every: int = 0) -> DataFrame:
    """Cells (raster_id, step, r, c, z) after nsteps of landscape evolution, with snapshots if asked for; no step leaves them as they are.

    boundary: edges, mask (a boolean column fixed) or None. Rasters of a column raster_id, and one of up to RASTER_CELLS
    cells, are evolved in a task each; a larger one goes through many tasks, step by step.
    """
    more = {"m": m, "n": n, "uplift": uplift, "dt": dt, "min_slope": min_slope, "cellsize": cellsize}
    if "raster_id" in cells.columns or not nsteps or cells.limit(RASTER_CELLS + 1).count() <= RASTER_CELLS:
        cells = cells if "raster_id" in cells.columns else cells.withColumn("raster_id", F.lit(1).cast("long"))
        return K.evolve(cells, nsteps, boundary, record_every, k, **more)
    ncols = cells.agg(F.max("c")).first()[0] + 1
    rates = cells.drop("z")
    recorded = sorted({nsteps - 1, *(range(0, nsteps, record_every) if record_every else ())})
    out, cur, done = None, cells, 0
    for step in recorded:
        z = I.evolve_tiled(cur, step + 1 - done, ncols, k, boundary=boundary, **more)
        done = step + 1
        shot = z.select(F.lit(1).cast("long").alias("raster_id"), F.lit(step).alias("step"), "r", "c", F.col("z").cast("float").cast("double").alias("z"))
        out = shot if out is None else out.unionByName(shot)
        cur = rates.join(z, ["r", "c"])
    return out


def clean_coarsen(v: DataFrame, despike_window: int = 100, despike_k: float = 2.0, alpha: float = 0.85,
    n_iters: int = 2000, keep_fraction: float = 0.1, ends: DataFrame | None = None) -> DataFrame:
    """Edges (cat, seq, s, z) despiked, smoothed between their ends and resampled to a fraction of their vertices.

    ends: (cat, left, right), values of the nodes at an edge's ends; by default the edge's own.
    """
    clean = K.clean_edges(v, despike_window, despike_k, alpha, n_iters, ends)
    return S.coarsen(v.drop("z").join(clean, ["cat", "seq"]), keep_fraction, ["z"])


def clean_network(nodes: DataFrame, edges: DataFrame, outlet_drop: float = 4e-4, keep_fraction: float = 0.1,
    outjson: str | None = None, **cleaning) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with outlets given an elevation below their inflow, edges cleaned between their nodes' elevations and coarsened.

    Written if asked, NaN as such.

    nodes: (node, z); edges: (src, dst, cat, seq, s, z).
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    inflow = edges.groupBy("dst", "cat").agg(F.max_by("z", "seq").alias("z")).select(F.col("dst").alias("node"), "z")
    fixed = S.set_outlet_elevations(
        nodes.select("node", "z").join(out, "node", "left").fillna(0, ["n_out"]), inflow, outlet_drop).select(
        "node", "z")
    at = [fixed.select(F.col("node").alias(x), F.col("z").alias(y)) for x, y in (("src", "left"), ("dst", "right"))]
    ends = edges.select("cat", "src", "dst").distinct().join(at[0], "src", "left").join(at[1], "dst", "left").select("cat", "left", "right")
    done = clean_coarsen(edges.select("cat", "seq", "s", "z"), keep_fraction=keep_fraction, ends=ends, **cleaning)
    links = done.join(edges.select("cat", "src", "dst").distinct(), "cat").select("src", "dst", "cat", "seq", "s", "z")
    if outjson:
        write_json(fixed.select(F.col("node").alias("id"), F.array("z").alias("z")), links, outjson, strict=False)
    return fixed, links
