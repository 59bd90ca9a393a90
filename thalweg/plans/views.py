"""Grids, networks and profiles derived from the star-schema tables, and the same as DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(spark: SparkSession, sf_dir: str) -> int:
    """Rows and columns of the terrain: about sixteen line items a cell."""
    return max(8, math.isqrt(table(spark, sf_dir, "lineitem").count() // 16))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain (r, c, z): a ramp down to the south with deterministic relief."""
    n = side(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % n).cast("int").alias("r"), (F.col("l_partkey") % n).cast("int").alias("c"),
        F.col("l_quantity").cast("long").alias("q"))
    return rows.groupBy("r", "c").agg((F.lit(40) * (n - 1 - F.col("r")) + F.sum("q") % 97).cast("double").alias("z"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A converging binary tree (cat, tostream, len) whose root drains to 0."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter("c_custkey > 0").select(
        k.alias("cat"), F.expr("c_custkey div 2").alias("tostream"), (10 + k * 37 % 50).alias("len"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles (cat, seq, s, z, A): a user's events in time, value as elevation."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", us.alias("us"))
    first = F.min("us").over(Window.partitionBy("user_id"))
    seq = F.row_number().over(w) - 1
    return rows.select(
        F.col("user_id").alias("cat"), seq.alias("seq"), ((F.col("us") - first) / F.lit(1e6)).alias("s"),
        F.col("value").alias("z"), (seq + 1).cast("double").alias("A"))


def vertices_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with plane coordinates: x along the profile, y across it."""
    return vertices(spark, sf_dir).withColumn("x", F.col("s") / 1000).withColumn("y", (F.col("seq") % 7).cast("double"))


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Points (id, x, y) in a 1000 by 1000 square from the keys of supplier or customer."""
    key = F.col({"supplier": "s_suppkey", "customer": "c_custkey"}[name])
    a, b = {"supplier": (7919, 104729), "customer": (6151, 9973)}[name]
    return table(spark, sf_dir, name).select(
        key.alias("id"), (key * a % 1000).cast("double").alias("x"), (key * b % 1000).cast("double").alias("y"))


#: The views as common table expressions.
SQL = {
    "cells": "side AS (SELECT greatest(8, CAST(floor(sqrt(count(*) // 16)) AS INT)) AS n FROM lineitem), cells AS (SELECT CAST(l_orderkey % n AS INT) AS r, CAST(l_partkey % n AS INT) AS c, CAST(40 * (n - 1 - l_orderkey % n) + sum(CAST(l_quantity AS BIGINT)) % 97 AS DOUBLE) AS z FROM lineitem, side GROUP BY n, l_orderkey % n, l_partkey % n)",
    "segments": "segments AS (SELECT c_custkey AS cat, c_custkey // 2 AS tostream, 10 + c_custkey * 37 % 50 AS len FROM customer WHERE c_custkey > 0)",
    "vertices": "vertices AS (SELECT user_id AS cat, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS s, value AS z, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS A FROM events)",
    "verticesxy": "verticesxy AS (SELECT *, s / 1000 AS x, CAST(seq % 7 AS DOUBLE) AS y FROM vertices)",
    "suppliers": "suppliers AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7919 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 1000 AS DOUBLE) AS y FROM supplier)",
    "customers": "customers AS (SELECT c_custkey AS id, CAST(c_custkey * 6151 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 9973 % 1000 AS DOUBLE) AS y FROM customer)",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL over the named views; body may go on with further expressions after a comma.

    @N stands for the terrain's columns, @W for the corners in a row.
    """
    body = body.replace("@N", "(SELECT n FROM side)").replace("@W", "((SELECT n FROM side) + 1)")
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(SQL[n] for n in names) + body
