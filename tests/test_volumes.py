"""Volumes as a data source: round trips, foreign files, pushed filters, and files of attempts that never committed."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from granulon.operators import volume
from granulon.sources import volumes

BLOCKS = f"{volume.BLOCK}, channel int"


def block(hv, z0, a, channel=0, y0=0, x0=0):
    return (hv, z0, y0, x0, *a.shape, a.dtype.name, a.tobytes(), channel)


def slices(df):
    return sorted((r.hv if r.hv is not None else -1, r.channel, r.z0, r.y0, r.x0, r.ny, r.nx, r.dtype, bytes(r.data)) for r in df.collect())


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32", "float64"])
def test_round_trip(spark, tmp_path, dtype):
    rng = np.random.default_rng(1)
    stacks = [(hv, c, z, (rng.random((3, 4, 5)) * 200).astype(dtype)) for hv in (0, 12, None) for c in (0, 1) for z in (0, 3)]
    rows = spark.createDataFrame([block(hv, z, a, c, 7, 450) for hv, c, z, a in stacks], BLOCKS)
    volumes.write_volumes(rows, str(tmp_path / "v"))
    want = sorted((-1 if hv is None else hv, c, z + k, 7, 450, 4, 5, dtype, a[k].tobytes()) for hv, c, z, a in stacks for k in range(3))
    assert slices(volumes.read_volumes(spark, str(tmp_path / "v"))) == want
    assert slices(volumes.read_volumes(spark, str(tmp_path / "v"), strip_bytes=100)) == want  # no slice lost or read twice between strips


def test_filters_reach_the_reader(spark, tmp_path):
    rows = spark.createDataFrame([block(hv, 0, np.full((40, 8, 8), hv, "uint16"), c) for hv in (1, 2) for c in (0, 1)], BLOCKS)
    volumes.write_volumes(rows, str(tmp_path / "v"))
    got = volumes.read_volumes(spark, str(tmp_path / "v")).where("hv = 2 and channel = 1 and z0 >= 10 and z0 < 13 and ny = 8")
    assert [(r.hv, r.channel, r.z0) for r in got.orderBy("z0").collect()] == [(2, 1, z) for z in (10, 11, 12)]
    reader = volumes.Reader(str(tmp_path / "v"), 1 << 20)
    other = EqualTo(("ny",), 8)
    assert list(reader.pushFilters([EqualTo(("hv",), 2), EqualTo(("channel",), 1), GreaterThanOrEqual(("z0",), 10), LessThan(("z0",), 13), other])) == [other]
    parts = list(reader.partitions())
    assert len(parts) == 1  # the other three files are left out by name
    assert [row[1] for row in reader.read(parts[0])] == [10, 11, 12]


def test_pixels_that_are_filtered_out_are_not_read(spark, tmp_path, monkeypatch):
    volumes.write_volumes(spark.createDataFrame([block(5, 0, np.zeros((30, 6, 6)))], BLOCKS), str(tmp_path / "v"))
    read = []
    plain = volumes.pixels
    monkeypatch.setattr(volumes, "pixels", lambda file, page: read.append(page.z) or plain(file, page))
    reader = volumes.Reader(str(tmp_path / "v"), 1000)
    assert not list(reader.pushFilters([LessThan(("z0",), 4)]))
    for part in reader.partitions():
        list(reader.read(part))
    assert sorted(read) == [0, 1, 2, 3]


def test_probability_field(spark, tmp_path):
    p = np.random.default_rng(2).random((4, 3, 5, 2)).astype("float32")
    np.save(tmp_path / "hv00007_prob.npy", p)
    np.save(tmp_path / "plain.npy", p[..., 0])
    every = volumes.read_volumes(spark, str(tmp_path), strip_bytes=150)
    want = [(-1, 0, z, 0, 0, 3, 5, "float32", p[z, :, :, 0].tobytes()) for z in range(4)] + [(7, c, z, 0, 0, 3, 5, "float32", np.ascontiguousarray(p[z, :, :, c]).tobytes()) for z in range(4) for c in (0, 1)]
    assert slices(every) == sorted(want)
    assert slices(every.where("channel = 1 and z0 in (0, 2)")) == sorted(w for w in want if w[1] == 1 and w[2] in (0, 2))
    voxel = volume.voxels(every.where("hv = 7 and channel = 0").drop("channel")).toPandas()
    assert len(voxel) == 60 and all(abs(p[int(r.z), int(r.y), int(r.x), 0] - r.v) < 1e-7 for r in voxel.itertuples())


def test_classic_big_endian_stack(spark, tmp_path):
    """Two pages of two strips each, as other programs write them."""
    a = np.arange(24, dtype=">u2").reshape(2, 4, 3)
    body, at, heads = b"MM" + struct.pack(">HI", 42, 8), 8, []
    size = 2 + 9 * 12 + 4
    for k in range(2):
        strips = at + size
        pixels = strips + 16
        tags = [(256, 3, 3), (257, 3, 4), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, strips), (277, 3, 1), (278, 3, 2), (279, 4, strips + 8)]
        head = struct.pack(">H", 9)
        for tag, kind, v in tags:
            many = 2 if tag in (273, 279) else 1
            head += struct.pack(">HHI", tag, kind, many) + (struct.pack(">HH", v, 0) if kind == 3 else struct.pack(">I", v))
        head += struct.pack(">I", pixels + 24 if k == 0 else 0)
        heads.append(head + struct.pack(">IIII", pixels, pixels + 12, 12, 12) + a[k].tobytes())
        at = pixels + 24
    (tmp_path / "hv00003_c2.tif").write_bytes(body + b"".join(heads))
    got = slices(volumes.read_volumes(spark, str(tmp_path)))
    assert got == [(3, 2, z, 0, 0, 4, 3, "uint16", a[z].astype("<u2").tobytes()) for z in range(2)]


def test_only_committed_files_count(spark, tmp_path):
    path = str(tmp_path / "v")
    one = spark.createDataFrame([block(1, 0, np.ones((2, 2, 2)))], BLOCKS)
    volumes.write_volumes(one, path)
    writer = volumes.Writer(path, volumes.NAMES, False)
    lost = writer.write(iter([block(1, 9, np.zeros((1, 2, 2)))]))  # an attempt whose executor was lost
    assert len(slices(volumes.read_volumes(spark, path))) == 2
    writer.abort([lost, None])
    assert not set(lost.files) & set(os.listdir(path))
    volumes.write_volumes(spark.createDataFrame([block(2, 0, np.ones((1, 2, 2)))], BLOCKS), path, mode="append")
    assert [r[0] for r in slices(volumes.read_volumes(spark, path))] == [1, 1, 2]
    volumes.write_volumes(one, path)
    assert [r[0] for r in slices(volumes.read_volumes(spark, path))] == [1, 1]
    assert len(os.listdir(path)) == 2  # what was replaced is gone


def test_empty_and_foreign(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert volumes.read_volumes(spark, str(tmp_path / "empty")).count() == 0
    volumes.write_volumes(spark.createDataFrame([], BLOCKS), str(tmp_path / "none"))
    assert volumes.read_volumes(spark, str(tmp_path / "none")).count() == 0
    np.save(tmp_path / "flat.npy", np.zeros(3))
    with pytest.raises(Exception, match="flat.npy"):
        volumes.read_volumes(spark, str(tmp_path / "flat.npy")).count()
