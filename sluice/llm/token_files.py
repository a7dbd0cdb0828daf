"""Token ids in a compressed binary format, in ascending order of the documents' keys.

A file row is a frame: whole documents up to about ``FRAME_IDS`` ids, their keys
and lengths, and the coded blocks of :mod:`sluice.llm.coder` with the number of
ids and the checksum of each. Frames and blocks decode on their own, and a
damaged one is found by its checksum. Frames are spread over range partitions of
the key; a frame knows how many ids of its partition come before it.

Null texts count as empty; an empty document is its end id. Null keys come
first. Rows with the same key follow each other in the order of their texts. A
document longer than a frame is a frame of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sluice.llm import coder
from sluice.llm import texts as X
from sluice.llm.tokens import END_ID, encoder, vocabulary

FRAME_IDS = 1 << 18
LANES = 4096  # blocks coded side by side

FRAME = "part int, ids_before bigint, keys array<bigint>, sizes array<bigint>, blocks array<binary>, block_ids array<int>, block_crcs array<bigint>"


def write_tokens(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Tokenize whole texts, append the end id to each document and write all ids by ascending key."""
    path = path or vocabulary()
    kind = to_arrow_schema(X.schema(FRAME))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, end_id), TaskContext.get().partitionId()
        keys, sizes, ids, held, before, ready, lanes = [], [], [], 0, 0, [], 0

        def close() -> None:
            nonlocal keys, sizes, ids, held, before, lanes
            blocks = coder.split(np.concatenate(ids)) if ids else []
            ready.append((before, keys, sizes, blocks))
            lanes += len(blocks)
            before, keys, sizes, ids, held = before + held, [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ready, lanes
            coded = coder.encode([b for *_, blocks in ready for b in blocks])
            rows, at = [], 0
            for first, names, counts, blocks in ready:
                own = coded[at : at + len(blocks)]
                at += len(blocks)
                rows.append({"part": part, "ids_before": first, "keys": names, "sizes": counts, "blocks": [b for b, _, _ in own], "block_ids": [n for _, n, _ in own], "block_crcs": [c for _, _, c in own]})
            ready, lanes = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

        for batch, body, at in X.steps(batches):
            found, counts = encode(body, at)
            names, upto, low = batch.column("key").to_pylist(), np.cumsum(counts), 0
            while low < len(names):
                done = int(upto[low - 1]) if low else 0
                high = min(len(names), max(low + 1, int(np.searchsorted(upto, done + FRAME_IDS - held, "right"))))
                keys += names[low:high]
                sizes += counts[low:high].tolist()
                ids.append(found[done : upto[high - 1]])
                held += int(upto[high - 1]) - done
                low = high
                if held >= FRAME_IDS * 7 // 8:
                    close()
                if lanes >= LANES:
                    yield from flush()
        if keys:
            close()
        yield from flush()

    ordered = X.prepared(df, key, text).repartitionByRange("key").sortWithinPartitions("key", "text")
    ordered.mapInArrow(frames, X.schema(FRAME)).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: ``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit)."""
    frames = spark.read.schema(X.schema(FRAME)).parquet(folder)
    sizes = frames.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("shift"))
    return frames.join(F.broadcast(shifts), "part").mapInArrow(_documents, X.schema("key bigint, start bigint, n_tokens bigint, ids binary"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ready, lanes = [], 0
        for row in range(batch.num_rows):
            frame = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
            ready.append(frame)
            lanes += len(frame["blocks"])
            if lanes >= LANES or row == batch.num_rows - 1:
                blocks = coder.decode([b for f in ready for b in zip(f["blocks"], f["block_ids"], f["block_crcs"])])
                at = 0
                for f in ready:
                    own = blocks[at : at + len(f["blocks"])]
                    at += len(own)
                    ids = np.concatenate(own).astype("<u4").tobytes() if own else b""
                    counts = np.array(f["sizes"], np.int64)
                    begin = np.cumsum(counts) - counts
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(f["keys"], pa.int64()),
                            pa.array(begin + f["shift"] + f["ids_before"], pa.int64()),
                            pa.array(counts),
                            pa.array([ids[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), counts.tolist())], pa.binary()),
                        ],
                        names=["key", "start", "n_tokens", "ids"],
                    )
                ready, lanes = [], 0

