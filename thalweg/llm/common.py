"""Shared pieces: scratch tables in the shared folder, Arrow batch limits, in-row scans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to Python, so that batches of very long texts stay small.
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 2000
WHITE = " \t\n\x0b\x0c\r"
#: Rows of one key from which it is a hub, and the most hubs there can be.
HUB_ROWS = 500
HUBS_MOST = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and bytes: one bound for all operators, smaller ones stay.

    Plans are built lazily and read the setting when they run, so operators must not each set their own.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_BATCH_ROWS), ("maxBytesPerBatch", ARROW_BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:  # the default, or one written with a unit
            spark.conf.set(name, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one in local mode where none is configured, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="thalweg-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables written once to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/thalweg-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a table that keep() returned and that nothing will read again."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles() if self.root.rsplit("/", 1)[-1] in x}:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            at.getFileSystem(hadoop).delete(at, True)


class Spread:
    """Joins rows to a side by a key that hubs may dominate: a hub's rows are dealt to several parts by `other`.

    A key with more than HUB_ROWS rows (or as many as are given), or more than 1 in HUBS_MOST of all rows, is a hub; there can be no
    more than HUBS_MOST of them, which bounds what is broadcast. A hub's row of the side goes to all its parts.
    `rows` is a kept table; joins merge sorted rows at every size, so that plans don't change with it.
    """

    def __init__(self, rows: DataFrame, key: str, other: str, hub_rows: int = HUB_ROWS):
        self.key, self.other = key, other
        most = max(hub_rows, -(-rows.count() // HUBS_MOST))
        loads = rows.groupBy(key).agg(F.count("*").alias("_load")).filter(F.col("_load") > most)
        hubs = [(r[key], -(-r["_load"] // most)) for r in loads.collect()]
        kind = rows.schema[key].dataType.simpleString()
        self.hubs = F.broadcast(rows.sparkSession.createDataFrame(hubs, f"_hub {kind}, _parts int")) if hubs else None

    def meet(self, rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
        """rows, with the key and `other`, joined to a side that has the key (how: inner or left)."""
        if self.hubs is None:
            return rows.join(side.hint("merge"), self.key, how)
        parts = F.coalesce("_parts", F.lit(1))
        at = F.col(self.key) == F.col("_hub")
        dealt = rows.join(self.hubs, at, "left").withColumn("_part", F.pmod(F.xxhash64(self.other), parts).cast("int")).drop("_hub", "_parts")
        copies = side.join(self.hubs, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hub", "_parts")
        return dealt.join(copies.hint("merge"), [self.key, "_part"], how).drop("_part")


#: Rows of one group that a window takes in one task; larger groups are ranked by ranges.
GROUP_ROWS = 100_000


class Groups:
    """Numbers and running marks in the groups of a column, whatever a group's size.

    Groups of up to `most` rows are windows. Larger ones, of which there can be no more than HUBS_MOST, are
    sorted in ranges or taken in blocks of `most` rows, with a number carried from one to the next.
    """

    def __init__(self, df: DataFrame, by: str, scratch: Scratch):
        self.by, self.scratch = by, scratch
        self.most = max(GROUP_ROWS, -(-df.count() // HUBS_MOST))
        found = [(r[by],) for r in df.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") > self.most).collect()]
        self.large = F.broadcast(df.sparkSession.createDataFrame(found, f"_large {df.schema[by].dataType.simpleString()}")) if found else None

    def numbered(self, df: DataFrame, order: list[Column], name: str) -> DataFrame:
        """The rows with their number, from 1, in their group by order."""
        by = self.by
        is_large = F.col(by).eqNullSafe(F.col("_large"))
        small = df if self.large is None else df.join(self.large, is_large, "left_anti")
        out = small.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
        if self.large is None:
            return out
        keys = [F.col(by).asc_nulls_first(), *order]
        hot = df.join(self.large, is_large, "left_semi").repartitionByRange(*keys).sortWithinPartitions(*keys)
        at = self.scratch.keep(hot.withColumn("_at", F.monotonically_increasing_id()), "ranges")
        part = F.shiftright("_at", 33)  # the range; the rest is the place in it
        runs = at.groupBy(part.alias("_part"), F.col(by).alias("_by")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
        earlier = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))  # a row for each group and range that meet
        j = at.withColumn("_p", part).join(F.broadcast(before), (F.col("_p") == F.col("_part")) & F.col(by).eqNullSafe(F.col("_by")))
        return out.unionByName(j.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_from") + 1).cast("int").alias(name)))

    def last_marked(self, df: DataFrame, place: str, marked: Column, name: str) -> DataFrame:
        """The rows with the last marked place up to their own in their group; places are numbers from 1."""
        by = self.by
        t = df.withColumn("_mark", F.when(marked, F.col(place))).withColumn("_block", F.floor((F.col(place) - 1) / self.most))
        out = t.withColumn(name, F.max("_mark").over(Window.partitionBy(by, "_block").orderBy(place)))
        if self.large is not None:
            tops = t.join(self.large, F.col(by).eqNullSafe(F.col("_large")), "left_semi").groupBy(
                F.col(by).alias("_by"), F.col("_block").alias("_b")).agg(F.max("_mark").alias("_top"))
            earlier = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
            carried = tops.withColumn("_carried", F.max("_top").over(earlier)).drop("_top")  # a row for each block of a large group
            out = out.join(
                F.broadcast(carried), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b")),
                "left").withColumn(name, F.coalesce(name, "_carried")).drop("_by", "_b", "_carried")
        return out.drop("_mark", "_block")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of anything but the six ASCII white-space characters; null or blank text: an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))


def scan(values: Column, op, kind: str = "array<bigint>", block: int = 128) -> Column:
    """Inclusive running op (associative) over an array of the given type.

    Two levels of blocks keep the cost of appending near n * block instead of n * n.
    """

    def run(xs: Column) -> Column:
        empty = F.array().cast(kind)
        grow = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.element_at(acc, -1), x))))
        return F.aggregate(xs, empty, grow)

    def blocked(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(block)), lambda b: run(F.slice(xs, b + 1, F.lit(block))))
        return let(parts,
            lambda p: let(run(F.transform(p, lambda x: F.element_at(x, -1))),
                lambda ends: F.flatten(
                F.transform(p, lambda x,
                        i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: op(F.get(ends, i - 1), v)))))))

    return let(values, lambda xs: F.when(F.size(xs) <= 1, xs).when(F.size(xs) <= block, run(xs)).otherwise(blocked(xs)))
