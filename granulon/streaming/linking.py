"""Trajectories of a stream of frames: each micro-batch continues the tracks that the one before left.

The tracks are a table in a shared folder, not a group's state in one task: a frame of any size is linked by the same joins as in batch work,
and no track is cut at the border of a tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.operators.linking import continue_tracks, no_tracks


def _batches(spark, folder: str) -> list[int]:
    """Numbers of the batches that a folder holds whole, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in files.listStatus(path)]
    return sorted(int(n.partition("=")[2]) for p, n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def link_stream(stream: DataFrame, folder: str, checkpoint: str, search: float, memory: int, by: str = "material", **options):
    """Start linking a stream of locations (frame, by, id, x, y, z); returns its ``writeStream``, to be triggered and started.

    ``folder/linked`` gets the locations with their particle, ``folder/late`` those of frames that the tracks have passed, ``folder/tracks``
    what the next batch needs; each by batch. A frame comes whole in one batch: rows of it in a later one are late. A batch that is tried again
    starts from the tracks of the batch before and writes over what it left, so every location is linked once. Rows without frame, ``by`` or a
    finite place are late as well. Folder and checkpoint belong together: a new checkpoint needs a new folder.
    """

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        at = lambda kind, n: f"{folder}/{kind}/batch={n}"
        rows = rows.select("frame", by, "id", "x", "y", "z").persist()
        before = [n for n in _batches(spark, f"{folder}/tracks") if n < batch]
        tracks = spark.read.parquet(at("tracks", before[-1])) if before else no_tracks(rows, by)
        passed = tracks.agg(F.max("seen")).first()[0]
        fits = F.expr(f"frame is not null and {by} is not null and " + " and ".join(f"abs({c}) < double('inf')" for c in "xyz"))
        fits = F.coalesce(fits & (F.lit(True) if passed is None else F.col("frame") > passed), F.lit(False))
        rows.where(~fits).write.mode("overwrite").parquet(at("late", batch))
        linked = None
        for frame in sorted(r[0] for r in rows.where(fits).select("frame").distinct().collect()):
            new, tracks = continue_tracks(tracks, rows.where(fits & (F.col("frame") == frame)), search, memory, frame, by, **options)
            linked = new if linked is None else linked.unionByName(new)
        if linked is not None:
            linked.write.mode("overwrite").parquet(at("linked", batch))
            tracks.write.mode("overwrite").parquet(at("tracks", batch))
            for n in before[:-1]:
                _remove(spark, at("tracks", n))
        rows.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
