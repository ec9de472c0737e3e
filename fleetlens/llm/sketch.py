"""How common word windows are, as a table of fixed size.

Every window's hash falls into one of 2 ** BITS counters.  Tasks count all windows of their
rows and pass on the counters well above their mean; the sums that lie well above the global
mean are the heavy counters.  A byte per counter is broadcast, 16 MB whatever the input.  Operators use the levels only to order windows
(rare before common), so that an uncounted or shared counter costs time, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm import words
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import trimmed

BITS = 24
_BATCH = 1 << 21
#: standard deviations above the mean from which a counter is passed on, and is heavy
LOCAL, GLOBAL = 3, 6
#: counters below this are never heavy
LEAST = 16


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << BITS) - 1)).astype(np.int32)


def _above(total: int, deviations: int, least: int) -> float:
    mean = total / (1 << BITS)
    return max(least, mean + deviations * mean ** 0.5)


def _count(text: str, k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int32)
        held: list[np.ndarray] = []
        total = size = 0

        def settle() -> None:
            """Count a batch in sorted order, which walks the counters once."""
            if held:
                at = np.sort(np.concatenate(held))
                heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                counts[at[heads]] += np.diff(np.append(heads, len(at))).astype(np.int32)
                held.clear()

        for b in batches:
            for w in words.chunks(b.column(text), lower):
                h, _ = words.grams(w, k, short=True)
                if len(h):
                    held.append(bucket(h))
                size, total = size + len(h), total + len(h)
                if size >= _BATCH:
                    settle()
                    size = 0
        settle()
        if total:
            keep = np.flatnonzero(counts >= _above(total, LOCAL, 3))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keep, -1), pa.int64()), pa.array(np.append(counts[keep], total), pa.int64())],
                                             names=["bucket", "n"])

    return trimmed(run)


def levels(docs: DataFrame, text: str, k: int, scratch: Scratch, lower: bool = False) -> Broadcast:
    """Level of every counter as int8: 0 for the others, 1, 2, ... for each doubling of a heavy one."""
    sums = scratch.write(docs.select(text).mapInArrow(_count(text, k, lower), "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")), "sketch")
    total = sums.where("bucket = -1").first()
    floor = _above(total["n"] if total else 0, GLOBAL, LEAST)
    found = sums.where((F.col("bucket") >= 0) & (F.col("n") >= floor)).toPandas()
    scratch.drop("sketch")
    table = np.zeros(1 << BITS, np.int8)
    table[found["bucket"].to_numpy(np.int64)] = np.minimum(np.log2(found["n"].to_numpy(np.float64) / floor).astype(np.int8) + 1, 60)
    return docs.sparkSession.sparkContext.broadcast(table)

