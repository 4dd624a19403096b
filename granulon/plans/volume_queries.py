"""Queries of the volume source: tables written as image stacks and read again, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.operators import volume
from granulon.operators.lineage import shared_folder
from granulon.plans.adapters import table
from granulon.sources import volumes


def _slices(s, d) -> DataFrame:
    """Vectors as slices of one row of pixels, in the volume of their label, two channels: the vector and its square."""
    rows = table(s, d, "embeddings").where("size(embedding) > 0").select(F.col("label").cast("long").alias("hv"), F.col("vec_id").cast("int").alias("z0"), F.col("embedding").cast("array<float>").alias("v"))

    def pixels(batches):
        for batch in batches:
            vectors = [np.asarray(v, "float32") for v in batch.column("v").to_pylist()]
            for channel in (0, 1):
                images = [v * v if channel else v for v in vectors]
                same = lambda x, t: pa.array([x] * len(images), t)
                wide = pa.array([len(v) for v in images], pa.int32())
                columns = [batch.column("hv"), batch.column("z0"), same(0, pa.int32()), same(0, pa.int32()), same(1, pa.int32()), same(1, pa.int32()), wide, same("float32", pa.string()), pa.array([v.tobytes() for v in images], pa.binary()), same(channel, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=volumes.NAMES)

    return rows.mapInArrow(pixels, volumes.COLUMNS)


def _stored(s, d) -> DataFrame:
    path = f"{shared_folder(s)}/volumes-{uuid.uuid4().hex}"
    volumes.write_volumes(_slices(s, d), path)
    return volumes.read_volumes(s, path)


def register(add) -> None:
    vector = "(select label::bigint as hv, vec_id as z, embedding::float[] as v from embeddings where len(embedding) > 0)"
    add(
        "volume_store",
        "hv z:i channel:i ny:i nx:i",
        lambda s, d: _stored(s, d).select("hv", F.col("z0").alias("z"), "channel", "ny", "nx"),
        f"select hv, z, channel, 1 as ny, len(v) as nx from {vector}, range(2) r(channel)",
    )
    add(
        "volume_strip",
        "hv z:i mean:r",
        lambda s, d: volume.voxels(_stored(s, d).where("hv in (2, 5) and channel = 1 and z0 >= 100").drop("channel")).groupBy("hv", "z").agg(F.avg("v").alias("mean")),
        f"select hv, z, list_avg(list_transform(v, lambda x: (x * x)::double)) as mean from {vector} where hv in (2, 5) and z >= 100",
    )
