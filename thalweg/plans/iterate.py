"""Bounded iteration: tables between rounds are written to the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="thalweg-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table once and read it back: later plans start from files that outlive executors."""
    at = f"{shared_dir(df.sparkSession)}/thalweg-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def together(tables: list[DataFrame]) -> DataFrame:
    """Kept tables of one schema as one scan, whose plan doesn't grow with their number."""
    folders = [f for df in tables for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}]
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*folders)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that keep() gave and that nothing will read again."""
    session = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/thalweg-" in f}:
        at = session._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)


def fixpoint(df: DataFrame, step: Callable[[DataFrame], DataFrame], open_rows: str, most: int = 64) -> DataFrame:
    """Repeat step until no row meets `open_rows`; a doubling step needs log2 of the longest path."""
    cur = keep(df)
    for _ in range(most):
        if not cur.filter(open_rows).limit(1).count():
            return cur
        done, cur = cur, keep(step(cur))
        drop(done)
    raise ValueError(f"rows are still open after {most} rounds: the graph has a cycle")


class Endless(ValueError):
    """A path that should end leads in a circle."""


def prefix_sums(df: DataFrame, order: list, value, name: str) -> DataFrame:
    """The rows with `name`: the sum of value (a column) over the rows up to each, by order (no two rows alike).

    Rows are sorted in ranges; what is carried from range to range is one number each.
    """
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = keep(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = t.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select(
        F.col("_range").alias("_r2"),
        F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_before"))  # a row a range
    return t.join(F.broadcast(before), F.col("_range") == F.col("_r2")).withColumn(
        name, F.col("_before") + F.sum("_value").over(w)).drop("_value", "_range", "_r2", "_before")


def walk(steps: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, i, node): the path from each start (start) along steps (node, to), itself first, at most `most` steps.

    starts may have a column node, where the path called start begins, and a column most, its own bound.

    By doubling: round k adds to all places found so far those 2^k steps on, and the steps are joined to
    themselves, leaving out those that have come to an end. Rounds grow with the logarithm of the longest
    path; a circle raises Endless unless `most` bounds the path.
    """
    size = steps.count()
    there = steps.select(F.col("node").alias("n2")).distinct()
    jump = keep(steps.select("node", "to").join(there, F.col("to") == F.col("n2"), "left").select(
            "node", "to", F.col("n2").isNull().alias("ends")), "jump")
    first = F.col("node" if "node" in starts.columns else "start").alias("node")
    bound = F.col("most").cast("int").alias("most") if "most" in starts.columns else F.lit(most).cast("int").alias("most")
    parts = [keep(starts.select("start", F.lit(0).alias("i"), first, bound).distinct(), "walk")]
    bounded = most is not None or "most" in starts.columns
    reach = 1
    while most is None or reach <= most:
        here = jump.select(F.col("node").alias("n2"), "to", "ends")
        old = together(parts).filter(F.col("most").isNull() | (F.col("i") + reach <= F.col("most")))
        more = keep(old.join(here, F.col("node") == F.col("n2")).select(
                "start", (F.col("i") + reach).alias("i"), F.col("to").alias("node"), "most"), "walk")
        if not more.limit(1).count():
            break
        if not bounded and reach > size:
            raise Endless("a path leads in a circle")
        parts.append(more)
        on = jump.select(F.col("node").alias("n2"), F.col("to").alias("t2"), F.col("ends").alias("e2"))
        done, jump = jump, keep(
            jump.filter("NOT ends").join(on, F.col("to") == F.col("n2")).select(
                "node", F.col("t2").alias("to"), F.col("e2").alias("ends")), "jump")
        drop(done)
        reach *= 2
    return together(parts).drop("most")


def nearest_below(steps: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, at): the first marked node (node) on each node's path along steps (node, to; null: the end), itself first.

    Null where there is none. By doubling; only rows still under way are joined.
    """
    m = marked.select(F.col("node").alias("m")).distinct()
    start = steps.join(m, F.col("node") == F.col("m"), "left").select(
        "node", F.when(F.col("m").isNull(), F.col("to")).alias("jump"), F.col("m").alias("at"))

    def step(cur: DataFrame) -> DataFrame:
        on = cur.select(F.col("node").alias("n2"), F.col("jump").alias("j2"), F.col("at").alias("a2"))
        moved = cur.filter("jump IS NOT NULL").join(on, F.col("jump") == F.col("n2"), "left").select(
            "node", F.col("j2").alias("jump"), F.col("a2").alias("at"))
        return cur.filter("jump IS NULL").unionByName(moved)

    return fixpoint(start, step, "jump IS NOT NULL").drop("jump")
