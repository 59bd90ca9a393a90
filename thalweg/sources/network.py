"""Networks in and out: topology tables, profiles as text, node-link JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite
from ..operators.network import OUTLET, InvalidNetwork, build_graph, validate
from ..operators.sequence import drop_coincident, segment_distances
from .raster import Region, cell_centres, sample


def topology(df: DataFrame) -> DataFrame:
    """(cat, tostream) of a table that must have both."""
    if missing := {"cat", "tostream"} - set(df.columns):
        raise InvalidNetwork(f"no column {', '.join(sorted(missing))}: link the network first")
    return df.select(F.col("cat").cast("long").alias("cat"), F.col("tostream").cast("long").alias("tostream"))


def read_records(lines: DataFrame, rasters: dict[str, DataFrame | None], region: Region, accum_mult: float = 1.0,
    assume_complete: bool = False) -> DataFrame:
    """Vertices (cat, seq, x, y, s_down, s_up and one column a raster) of lines (cat, seq, x, y), validated where A is among them.

    A raster that is None is left out, as if its name weren't given.
    """
    rasters = {name: cells for name, cells in rasters.items() if cells is not None}
    v = drop_coincident(lines.filter("cat IS NOT NULL").select("cat", "seq", "x", "y"))
    for name, cells in rasters.items():
        v = sample(v, cells.withColumnRenamed("v", name), region, name)
    if "A" in rasters:
        v = v.withColumn("A", F.col("A") * accum_mult)
        v, _ = validate(v.withColumn("z", F.col("z") if "z" in rasters else F.lit(0.0)), assume_complete)
        v = v if "z" in rasters else v.drop("z")
    return segment_distances(v)


def write_profiles(profile: DataFrame, path: str) -> None:
    """Space-separated text in order of path and vertex, a segment that several paths share written with the first of them."""
    first = profile.groupBy("cat").agg(F.min("head").alias("head"))
    profile.join(first, ["cat", "head"]).withColumn("cat", F.col("cat").cast("long")).orderBy("head", "i").drop(
        "head", "i").write.mode("overwrite").option("sep", " ").option("header", True).csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, also inside arrays."""
    def safe(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(F.col(name))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
            return F.transform(name, finite)
        return F.col(name)

    return df.select(*(safe(f.name, f.dataType).alias(f.name) for f in df.schema.fields))


def read_segments(lines: DataFrame, rasters: dict[str, DataFrame | None], region: Region, accum_mult: float = 1.0,
    assume_complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, topology) of lines without a topology: as `read_records`, every segment draining to 0."""
    v = read_records(lines, rasters, region, accum_mult, assume_complete)
    return v, v.select("cat").distinct().withColumn("tostream", F.lit(0).cast("long"))


def read_graph(lines: DataFrame, table: DataFrame, rasters: dict[str, DataFrame], region: Region,
    accum_mult: float = 1.0, assume_complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a linked network in one call."""
    v = read_records(lines, rasters, region, accum_mult, assume_complete)
    return build_graph(v, topology(table), [c for c in v.columns if c not in ("cat", "seq")])


def write_json(nodes: DataFrame, edges: DataFrame, path: str, strict: bool = True) -> None:
    """Node-link records as JSON lines in two folders; edges carry their vertices' values as arrays in order.

    strict: NaN and infinities become null; otherwise they are written as "NaN" and the like.
    """
    values = [c for c in edges.columns if c not in ("src", "dst", "cat", "seq")]
    arrays = edges.groupBy("src", "dst", "cat").agg(F.array_sort(F.collect_list(F.struct("seq", *values))).alias("v"))  # a segment's vertices
    links = arrays.select(F.col("src").alias("source"), F.col("dst").alias("target"), "cat", *(F.col(f"v.{c}").alias(c) for c in values))
    for name, df in (("nodes", nodes), ("links", links)):
        (json_safe(df) if strict else df).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")


def subnetwork(nodes: DataFrame, edges: DataFrame, cats: DataFrame, keep_outlet: bool = True) -> tuple[DataFrame, DataFrame]:
    """The nodes of some segments (cat), with or without the outlet, and the edges between them."""
    ids = cats.select(F.col("cat").alias("id"))
    if keep_outlet:
        ids = ids.unionByName(nodes.sparkSession.range(1).select(F.lit(OUTLET).cast("long").alias("id")))
    e = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), e.select(*edges.columns)


def write_subnetwork(nodes: DataFrame, edges: DataFrame, cats: DataFrame, path: str, keep_outlet: bool = True) -> None:
    """`subnetwork` as node-link records. Downstream paths keep the outlet, what lies upstream of a segment does not."""
    write_json(*subnetwork(nodes, edges, cats, keep_outlet), path)


def link_lines(all_cells: DataFrame, numbered: DataFrame, nodes: DataFrame, region: Region) -> DataFrame:
    """(cat, x1, y1, x2, y2, tostream, wkt): each link as a polyline through its cells' centres."""
    at = all_cells.join(numbered, "link").join(cell_centres(nodes.select("node", "r", "c"), region).select("node", "x", "y"), "node")
    lines = at.groupBy("cat", "tostream").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))  # a link's own cells
    text = F.concat(F.lit("LINESTRING ("),
        F.array_join(F.transform("p", lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), ", "),
        F.lit(")"))
    end = lambda k, c: F.element_at("p", k)[c]
    return lines.select(
        "cat", end(1, "x").alias("x1"), end(1, "y").alias("y1"), end(-1, "x").alias("x2"), end(-1, "y").alias("y2"),
        "tostream", text.alias("wkt"))


def field_heads(table: DataFrame, site: str, least_northing: float | None = None, most_northing: float | None = None) -> DataFrame:
    """(x, y) of surveyed heads (site, northing, easting) whose site holds a name, above or below a northing."""
    t = table.filter(F.col("site").contains(site))
    t = t if least_northing is None else t.filter(F.col("northing") > least_northing)
    t = t if most_northing is None else t.filter(F.col("northing") < most_northing)
    return t.select(F.col("easting").cast("double").alias("x"), F.col("northing").cast("double").alias("y"))


def document(nodes: DataFrame, links: DataFrame) -> str:
    """One node-link document on the driver, for networks that fit it."""
    rows = lambda df: ", ".join(
        r.j for r in json_safe(df).select(
            F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator())
    return f'{{"directed": true, "multigraph": false, "graph": {{}}, "nodes": [{rows(nodes)}], "links": [{rows(links)}]}}'


def read_document(spark: SparkSession, path: str, node_values: list[str], edge_values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a node-link document; its edges may be called links or edges, null stays null."""
    node = f"array<struct<id:bigint{''.join(f',`{v}`:array<double>' for v in node_values)}>>"
    edge = f"array<struct<source:bigint,target:bigint,cat:bigint{''.join(f',`{v}`:array<double>' for v in edge_values)}>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"nodes {node}, links {edge}, edges {edge}").alias("d"))
    return doc.select(F.inline("d.nodes")), doc.select(F.inline(F.coalesce("d.links", "d.edges")))
