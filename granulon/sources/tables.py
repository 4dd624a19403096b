"""Readers and writers of the formats that particle pipelines exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "z double, y double, x double, mass double, raw_mass double, size_x double, size_y double, size_z double"


def tile_csv(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Space-separated tile files, with hv, material and frame from names like hv00012_sed_t0003.csv."""
    rows = spark.read.schema(schema).option("sep", " ").option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"hv(\d+)_(gel|sed)_t(\d+)", 0)
    part = lambda k: F.regexp_extract(name, r"hv(\d+)_(gel|sed)_t(\d+)", k)
    return rows.select("*", part(1).cast("long").alias("hv"), part(2).alias("material"), part(3).cast("long").alias("frame"))


def union_tiles(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def id_list(spark: SparkSession, path: str, set_name: str) -> DataFrame:
    """One id a line after any number of header lines that are not numbers."""
    return spark.read.text(path).select(F.lit(set_name).alias("set_name"), F.expr("try_cast(trim(value) as bigint)").alias("particle")).where("particle is not null")


def locator_text(spark: SparkSession, path: str, px: float) -> DataFrame:
    """White-space-separated x, y, z in pixels with the frame in the file's name, in microns."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(*(F.get(parts, i).try_cast("double").alias(c) for i, c in enumerate("xyz")), F.regexp_extract(F.col("_metadata.file_name"), r"t(\d+)", 1).cast("long").alias("frame"))
    return rows.where("x is not null").select("frame", *((F.col(c) * px).alias(c) for c in "xyz"))


def rheology_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a rheometer's XML; a measure's unit comes as its attribute."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def yaml_counts(spark: SparkSession, path: str) -> DataFrame:
    """(hv, particle_count) of one log a tile; -1 where the locating stage is absent."""

    def parse(batches):
        import pandas as pd
        import yaml

        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                doc = yaml.safe_load(text) or {}
                rows.append((doc.get("hv"), int((doc.get("locating") or {}).get("particles", -1))))
            yield pd.DataFrame(rows, columns=["hv", "particle_count"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "hv long, particle_count long")


def append_log(stage_log: DataFrame, path: str) -> None:
    stage_log.write.mode("append").partitionBy("stage").parquet(path)


def write_strain(strain: DataFrame, path: str) -> None:
    """Replace just the partitions that the table holds."""
    keys = ["strain_type", "ref", "cur", "replicate"]
    strain.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_strain(spark: SparkSession, path: str, **keys) -> DataFrame:
    rows = spark.read.parquet(path)
    for k, v in keys.items():
        rows = rows.where(F.col(k) == v)
    return rows


def write_tracks(tracks: DataFrame, path: str) -> None:
    tracks.write.mode("overwrite").partitionBy("material", "frame").parquet(path)


def xyz_lines(rows: DataFrame, columns: list[str], species: str | None = None, order: str = "particle") -> DataFrame:
    """(frame, value): the lines of an extended XYZ file for each frame: count, property line, rows in order. No frame is gathered."""
    lead = [F.lit(species)] if species else []
    body = rows.select("frame", F.lit(2).alias("part"), F.col(order).alias("k"), F.concat_ws(" ", *lead, *(F.col(c).cast("string") for c in columns)).alias("value"))
    props = ("species:S:1:" if species else "") + ":".join(f"{c}:R:1" for c in columns)
    counts = rows.groupBy("frame").agg(F.count("*").alias("n")).select("frame", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("n").cast("string").alias("v")), F.struct(F.lit(1).alias("part"), F.lit(f"Properties={props}").alias("v")))).alias("h"))
    head = counts.select("frame", "h.part", F.lit(None).cast("long").alias("k"), F.col("h.v").alias("value"))
    return head.unionByName(body)


def write_xyz(rows: DataFrame, path: str, columns: list[str], species: str | None = None, order: str = "particle") -> None:
    """A folder for each frame with its lines in order; a range of one frame's rows is one task, so frames are written in parallel."""
    lines = xyz_lines(rows, columns, species, order)
    lines.repartition("frame").sortWithinPartitions("frame", "part", "k").select("frame", "value").write.mode("overwrite").partitionBy("frame").text(path)
