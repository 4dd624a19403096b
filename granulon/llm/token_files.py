"""Token files: documents' ids in doc_id order, coded with Simple-8b, written and read by Spark's own file writers.

A file is a Parquet file of frames. A frame holds whole documents, about ``FRAME`` ids of them: their doc_ids and lengths,
the coded words, each block's first word, and escaped values. Files are shards in doc_id order: shard and frame numbers
give every frame's place, so a frame decodes without any other. Because Spark's committer writes the frames, files
appear whole or not at all, on any file system.

Defined results: a null or empty text has just the end id; a null doc_id sorts first; rows that share a doc_id stay
separate documents in order of their texts; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.llm import simple8b
from granulon.llm.tokens import encode_with_end

FRAME = 1 << 20
FRAMES = "shard int, frame int, start long, n_ids long, doc_ids array<bigint>, doc_lengths array<bigint>, words binary, blocks binary, escapes binary"
DOCS = "doc_id long, start long, n_tokens long, ids binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the files. Only raw texts are shuffled, once, by ranges of the key."""

    def frames(batches):
        shard = TaskContext.get().partitionId()
        frame = start = 0
        held_ids, held_docs, held = [], [], 0

        def flush():
            nonlocal frame, start, held_ids, held_docs, held
            ids = np.concatenate(held_ids)
            words, blocks, escapes = simple8b.encode(ids)
            row = {"shard": shard, "frame": frame, "start": start, "n_ids": len(ids), "doc_ids": [d for d, _ in held_docs], "doc_lengths": [n for _, n in held_docs], "words": words.astype("<u8").tobytes(), "blocks": blocks.astype("<u4").tobytes(), "escapes": escapes.astype("<u8").tobytes()}
            frame, start, held_ids, held_docs, held = frame + 1, start + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, ids, begin in encode_with_end(tokenizer, batch.column(1), end_id):
                lengths = np.diff(begin)
                done = 0
                while done < len(lengths):
                    # as many documents as fill the frame, one at least
                    n = max(1, int(np.searchsorted(begin[done + 1 :] - begin[done], FRAME - held, side="right")))
                    n = min(n, len(lengths) - done)
                    held_ids.append(ids[begin[done] : begin[done + n]])
                    held_docs += zip(keys[first + done : first + done + n], lengths[done : done + n].tolist(), strict=True)
                    held += int(begin[done + n] - begin[done])
                    done += n
                    if held >= FRAME or done < len(lengths):
                        yield flush()
        if held_docs:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("blocks", pa.binary()), ("escapes", pa.binary())])
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    ordered.mapInArrow(frames, FRAMES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers)."""
    frames = spark.read.schema(FRAMES).parquet(path)
    # one row for each shard, of which there are as many as write tasks
    before, table = 0, []
    for r in frames.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        table.append((r["shard"], before))
        before += r["n"]
    base = spark.createDataFrame(table, "shard int, base long")

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = simple8b.decode(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["blocks"], "<u4"), np.frombuffer(r["escapes"], "<u8"), r["n_ids"]).astype("<u4")
                lengths = np.array(r["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["base"] + r["start"] + ends - lengths), pa.array(lengths), blob], names=["doc_id", "start", "n_tokens", "ids"])

    return frames.join(F.broadcast(base), "shard").select(*[c for c in frames.columns if c not in ("shard", "frame")], "base").mapInArrow(documents, DOCS)
