"""Views of the driver's tables in the shapes of particle data, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked positions: a user is a particle and a day is a frame."""
    e = table(spark, sf_dir, "events")
    frame = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    rows = e.groupBy(frame.alias("frame"), F.col("user_id").alias("particle"))
    rows = rows.agg((F.sum(F.round(F.col("value") * 100).cast("long")) / (100.0 * F.count("*"))).alias("x"), F.count("*").cast("double").alias("y"), F.max("value").alias("z"))
    # the material follows from the particle: as a key it would be one that joins by frame and particle lack, and rows would be dealt again for them
    return rows.select(F.when(F.col("particle") % 4 == 0, "gel").otherwise("sed").alias("material"), "*")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations: the first three components of a vector, ten times, by label as frame."""
    at = lambda i: (10 * F.get("embedding", i).cast("double")).alias("xyz"[i])
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("frame"), F.col("vec_id").alias("id"), at(0), at(1), at(2))


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A height field: price over quantity and discount, by line number as frame."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linenumber").cast("long").alias("frame"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100 + 0.0).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))


TRACKS = """(select case when user_id % 4 = 0 then 'gel' else 'sed' end as material, date_diff('day', date '2024-01-01', ts::date)::bigint as frame, user_id as particle,
  sum(round(value * 100)::bigint)::double / (100.0::double * count(*)) as x, count(*)::double as y, max(value) as z from events group by all)"""
POINTS = "(select label::bigint as frame, vec_id as id, 10 * embedding[1]::double as x, 10 * embedding[2]::double as y, 10 * embedding[3]::double as z from embeddings)"
SURFACE = "(select l_linenumber::bigint as frame, l_quantity as x, l_discount * 100 + 0.0 as y, l_extendedprice / 1000 as z from lineitem)"
