"""Tables dealt by particle once, so that pairs of frames and trajectories need no shuffle afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_store(rows: DataFrame, name: str, path: str, buckets: int, key: str = "particle", order: str = "frame") -> DataFrame:
    """Write a table of trajectories in buckets of its key, sorted by key and ``order``, and return it; ``path`` lies in a shared folder.

    Joins and windows by the key read bucket beside bucket: choose as many buckets as let one fit a task's memory at the table's full size. Rows of
    a null key share a bucket. One task writes one bucket, as one file.
    """
    dealt = rows.repartition(buckets, key).sortWithinPartitions(key, order)
    dealt.write.bucketBy(buckets, key).sortBy(key, order).option("path", path).mode("overwrite").format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)
