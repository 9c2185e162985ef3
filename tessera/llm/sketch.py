"""A count of hashed items in a fixed number of buckets: an upper bound of how often any item occurs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets, and counters in one row while partial counts are added.
BUCKETS, SLAB, LANES = 1 << 18, 1 << 12, 64


def bucket_counts(docs: DataFrame, items: Callable[[], Callable[[str | None], np.ndarray]]) -> np.ndarray:
    """How many items (64-bit hashes, ``items()(text)``) of all texts fall into each bucket: ``BUCKETS`` numbers.

    Tasks count in one array each, which is cut into slabs; slabs are added in two steps, so that no task reads those of
    all others. What the driver gets has a fixed size.
    """
    from tessera.llm.common import texts_of

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, held, size = items(), np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for text in texts_of(batch):
                held.append(bucket_of(of(text)))
                size += len(held[-1])
                if size > BUCKETS:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        slabs = [(i, counts[i * SLAB : (i + 1) * SLAB]) for i in range(BUCKETS // SLAB)]
        slabs = [(i, c.tobytes()) for i, c in slabs if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in slabs], pa.int32()), pa.array([c for _, c in slabs], pa.binary())], ["slab", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLAB, np.int64)
        for c in part["counts"]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"slab": part["slab"].iloc[:1], "counts": [total.tobytes()]})

    parts = docs.select("text").mapInArrow(run, "slab int, counts binary").withColumn("lane", F.spark_partition_id() % LANES)
    sums = parts.groupBy("slab", "lane").applyInPandas(add, "slab int, counts binary").groupBy("slab").applyInPandas(add, "slab int, counts binary")
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():  # BUCKETS // SLAB rows
        out[r["slab"] * SLAB : (r["slab"] + 1) * SLAB] = np.frombuffer(r["counts"], np.int64)
    return out


def bucket_of(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - 18)).astype(np.int64)


def heavy_above(counts: np.ndarray) -> int:
    """Items in buckets of more than this count as heavy; all others occur at most so often.

    A bucket of rare items only holds about the mean; six standard deviations above it are left for chance.
    """
    mean = float(counts.sum()) / BUCKETS
    return 16 + int(mean + 6 * mean**0.5)
