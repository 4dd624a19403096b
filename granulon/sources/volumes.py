"""Image stacks and probability fields as a data source: ``spark.read.format("granulon_volumes").load(folder)``.

Reads gray uncompressed TIFF stacks (classic and big, both byte orders) and ``.npy`` arrays of (z, y, x) or, for probability fields, (z, y, x, channel).
A row is one slice of one channel, in the columns of ``operators.volume.BLOCK`` with nz = 1, and ``channel``. hv and a TIFF's channel come from names like
hv00012_c1.tif (null and 0 without); z is the place in the file unless the page says another, as the pages of the writer do.

A partition is a range of bytes of one file and takes the slices that begin in it, so the driver only lists files. Filters on hv and channel leave out
whole files by their names; those on hv, channel and z0 are applied to page headers before pixels are read. Other filters stay with Spark.

The writer appends pages to one file for each run of (hv, channel) in a task. A table is the files that a commit names: those of failed or repeated
attempts are never read. Files are opened through Arrow's file systems, so a path is a URI or a folder that driver and executors share.

Defined results: an empty folder has no rows; a slice without pixels is a page without bytes; a file that is neither of the two formats, is compressed,
tiled or has several samples a pixel is an error that names it.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from granulon.operators.volume import BLOCK

COLUMNS = f"{BLOCK}, channel int"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: Bytes of a file that one task reads.
STRIP_BYTES = 64 << 20
#: Fixed values of the TIFF format: bytes of each field type, and sample formats with numpy's kinds.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
WHOLE = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 339


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Page:
    """One slice of a file: its place, its shape, and where its bytes are."""

    z: int
    y: int
    x: int
    ny: int
    nx: int
    dtype: np.dtype
    strips: list[tuple[int, int]]
    channels: int = 0  # of an array whose last axis is the channel


class At(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


def tiff_pages(file, path: str):
    """Headers of a stack's pages, without pixels."""
    file.seek(0)
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count, entry, word = ("Q", 20, 8) if big else ("H", 12, 4)
    z = 0
    while at:
        file.seek(at)
        lead = struct.calcsize("<" + count)
        n = struct.unpack(order + count, file.read(lead))[0]
        raw = file.read(n * entry + word)
        fields = {}
        for i in range(n):
            one = raw[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(order + "HH", one[:4])
            many = struct.unpack(order + ("Q" if big else "I"), one[4 : entry - word])[0]
            fields[tag] = kind, many, one[entry - word :]

        def value(tag: int, default=None):
            if tag not in fields:
                return default
            kind, many, inside = fields[tag]
            size = FIELD_BYTES[kind] * many
            if size > word:
                file.seek(struct.unpack(order + ("Q" if big else "I"), inside)[0])
                inside = file.read(size)
            return inside[:size] if kind not in WHOLE else list(struct.unpack(f"{order}{many}{WHOLE[kind]}", inside[:size]))

        if value(COMPRESSION, [1])[0] != 1 or value(SAMPLES, [1])[0] != 1 or OFFSETS not in fields:
            raise ValueError(f"{path}: page {z} is compressed, tiled or has several samples a pixel")
        dtype = np.dtype(f"{order}{KINDS[value(FORMAT, [1])[0]]}{value(BITS, [1])[0] // 8}")
        placed = re.match(rb"z=(-?\d+) y=(-?\d+) x=(-?\d+)", value(DESCRIPTION, b""))
        place = [int(v) for v in placed.groups()] if placed else [z, 0, 0]
        yield Page(*place, value(HEIGHT)[0], value(WIDTH)[0], dtype, list(zip(value(OFFSETS), value(COUNTS), strict=True)))
        z += 1
        at = struct.unpack(order + ("Q" if big else "I"), raw[n * entry :])[0]


def npy_pages(file, path: str):
    """The slices of an array as pages."""
    file.seek(0)
    version = np.lib.format.read_magic(file)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if fortran or len(shape) not in (3, 4) or dtype.hasobject:
        raise ValueError(f"{path}: not an array of (z, y, x) or (z, y, x, channel) in C order")
    start, size = file.tell(), int(np.prod(shape[1:])) * dtype.itemsize
    for z in range(shape[0]):
        yield Page(z, 0, 0, shape[1], shape[2], dtype, [(start + z * size, size)], shape[3] if len(shape) == 4 else 0)


def pixels(file, page: Page) -> bytes:
    parts = []
    for offset, size in page.strips:
        file.seek(offset)
        parts.append(file.read(size))
    return b"".join(parts)


def named(path: str) -> dict:
    """hv and channel of a file by its name."""
    name = path.rsplit("/", 1)[-1]
    hv, channel = re.search(r"hv(\d+)", name), re.search(r"_c(\d+)", name)
    return {"hv": int(hv[1]) if hv else None, "channel": int(channel[1]) if channel else 0}


class Reader(DataSourceReader):
    TESTS = {EqualTo: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w, In: lambda v, w: v in w}

    def __init__(self, path: str, strip: int):
        self.path, self.strip, self.filters = path, strip, []

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            if type(f) in self.TESTS and f.attribute in (("hv",), ("channel",), ("z0",)) and value is not None and not (isinstance(value, tuple) and None in value):
                self.filters.append((type(f).__name__, f.attribute[0], value))
            else:
                yield f

    def _passes(self, **known) -> bool:
        tests = {k.__name__: t for k, t in self.TESTS.items()}
        return all(column not in known or (known[column] is not None and tests[kind](known[column], value)) for kind, column, value in self.filters)

    def files(self) -> list[tuple[str, int]]:
        fs, root = opened(self.path)
        own = fs.get_file_info(root)
        if own.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [own] if own.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        lists = [f for f in found if f.base_name.startswith("_committed-")]
        listed = {name for f in lists for name in json.loads(fs.open_input_file(f.path).read())}
        return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith((".tif", ".tiff", ".npy")) and (not lists or f.base_name in listed))

    def partitions(self):
        wanted = [(path, size) for path, size in self.files() if self._passes(**({"hv": named(path)["hv"]} if path.endswith(".npy") else named(path)))]
        return [At(path, start, start + self.strip) for path, size in wanted for start in range(0, size + 1, self.strip)]

    def read(self, partition):
        if partition is None:  # no file is left
            return
        path, start, end = partition.value
        fs, _ = opened(self.path)
        own = named(path)
        with fs.open_input_file(path) as file:
            for page in (npy_pages if path.endswith(".npy") else tiff_pages)(file, path):
                first = page.strips[0][0] if page.strips else 0
                if not start <= first < end or not self._passes(z0=page.z):
                    continue
                wanted = [c for c in (range(page.channels) if page.channels else [own["channel"]]) if self._passes(channel=c)]
                if not wanted:
                    continue
                image = np.frombuffer(pixels(file, page), page.dtype).astype(page.dtype.newbyteorder("="))
                for c in wanted:
                    data = image.reshape(page.ny, page.nx, page.channels)[:, :, c] if page.channels else image
                    yield (own["hv"], page.z, page.y, page.x, 1, page.ny, page.nx, page.dtype.name, np.ascontiguousarray(data).tobytes(), c)


@dataclass
class Written(WriterCommitMessage):
    files: list


class Stack:
    """A big TIFF that is only ever appended to: a page's header knows where the next one begins, so one page waits."""

    def __init__(self, stream):
        self.stream, self.at, self.waiting = stream, 16, None
        stream.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))

    def add(self, image: np.ndarray, z: int, y: int, x: int) -> None:
        self._flush(last=False)
        self.waiting = image, f"z={z} y={y} x={x}\0".encode().ljust(9, b"\0")

    def _flush(self, last: bool) -> None:
        if self.waiting is None:
            return
        image, text = self.waiting
        kind = {v: k for k, v in KINDS.items()}[image.dtype.kind]
        whole = [(WIDTH, image.shape[1]), (HEIGHT, image.shape[0]), (BITS, 8 * image.dtype.itemsize), (COMPRESSION, 1), (PHOTOMETRIC, 1)]
        header = 8 + 11 * 20 + 8
        data = self.at + header + len(text)
        after = [(OFFSETS, data), (SAMPLES, 1), (ROWS, image.shape[0]), (COUNTS, image.nbytes), (FORMAT, kind)]
        pack = lambda pairs: b"".join(struct.pack("<HHQQ", tag, 16, 1, v) for tag, v in pairs)
        fields = pack(whole) + struct.pack("<HHQQ", DESCRIPTION, 2, len(text), self.at + header) + pack(after)
        end = data + image.nbytes
        self.stream.write(struct.pack("<Q", 11) + fields + struct.pack("<Q", 0 if last else end) + text)
        self.stream.write(image.tobytes())
        self.at, self.waiting = end, None

    def close(self) -> None:
        self._flush(last=True)
        self.stream.close()


class Writer(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path, columns, overwrite

    def write(self, iterator):
        fs, root = opened(self.path)
        fs.create_dir(root)
        files, stack, of = [], None, None
        for values in iterator:
            row = dict(zip(self.columns, values, strict=True))
            now = row["hv"], row.get("channel") or 0
            if stack is None or now != of:
                if stack is not None:
                    stack.close()
                lead = "" if now[0] is None else f"hv{now[0]:05d}"
                files.append(f"{lead}_c{now[1]}-{uuid.uuid4().hex.translate(str.maketrans('abcdef', 'ghijkl'))}.tif")
                stack, of = Stack(fs.open_output_stream(f"{root}/{files[-1]}")), now
            block = np.frombuffer(row["data"], np.dtype(row["dtype"])).reshape(row["nz"], row["ny"], row["nx"])
            for k, plane in enumerate(block):
                stack.add(plane, row["z0"] + k, row["y0"], row["x0"])
        if stack is not None:
            stack.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root)
        before = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file] if self.overwrite else []
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}") as out:
            out.write(json.dumps(files).encode())
        for f in before:
            if f.base_name not in files:
                fs.delete_file(f.path)

    def abort(self, messages) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                fs.delete_file(f"{root}/{f}")


class Volumes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "granulon_volumes"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("strip_bytes", STRIP_BYTES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Volumes)


def read_volumes(spark: SparkSession, path: str, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format(Volumes.name()).option("strip_bytes", strip_bytes).load(path)


def write_volumes(blocks: DataFrame, path: str, mode: str = "overwrite", slab: int = 256) -> None:
    """Blocks (``channel`` optional; other columns are left out). ``slab`` slices of a (hv, channel) stay together, so files are few and a hot hv is dealt to many tasks.

    With ``overwrite`` the new list of files is written before the old one goes: a reader that starts in between sees both.
    """
    register(blocks.sparkSession)
    keys = [c for c in ("hv", "channel") if c in blocks.columns]
    rows = blocks.select(*(c for c in NAMES if c in blocks.columns)).repartition(*keys, F.floor(F.col("z0") / slab)).sortWithinPartitions(*keys, "z0")
    rows.write.format(Volumes.name()).mode("append" if mode == "append" else "overwrite").save(path)
