"""Best-fit packing of token pieces by exact-complement hashing.

Pieces are planned by their lengths alone: the histogram of lengths has at most ``capacity``
rows, whatever the input.  From the longest length down, the gap behind a piece is looked up
among the sums of one, two and three available lengths; what fills it exactly is consumed as
often as the counts allow.  What no combination fills is packed best fit: the longest
available length that fits, again and again.  The plan is a bounded list of patterns with
multiplicities.  Pieces are then numbered within their length by distributed prefix sums, and
the number says which sequence of which pattern a piece belongs to.

Defined results: a null text is empty and packs as its end token; repeated rows are packed as
often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm import tokenise
from fleetlens.llm.ranks import numbered
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import trimmed

CAPACITY = 2048
#: buckets in which the pieces of one length are numbered
BUCKETS = 1024


class Pattern(NamedTuple):
    lengths: tuple[int, ...]
    times: int


class _Lengths:
    """Available lengths with counts, and the sums of pairs of them, looked up by exact complement."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self.sorted = [int(x) for x in np.flatnonzero(self.count)]

    def take(self, lengths: tuple[int, ...]) -> int:
        """Consume these lengths together as often as their counts allow."""
        times = min(int(self.count[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            self.count[x] -= times
        for x in set(lengths):
            if not self.count[x]:
                self.sorted.remove(x)
        return times

    def one(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.count[gap] else None

    def two(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the longest first length."""
        half = self.count[(gap + 1) // 2:gap] > 0
        pairs = np.flatnonzero(half & (self.count[gap - np.arange((gap + 1) // 2, gap)] > 0)) + (gap + 1) // 2
        for x in pairs[::-1]:
            if 2 * x != gap or self.count[x] > 1:
                return int(x), gap - int(x)
        return None

    def three(self, gap: int) -> tuple[int, ...] | None:
        for x in reversed(self.sorted[:bisect.bisect_left(self.sorted, gap - 1)]):
            if 3 * x < gap:
                return None
            if not self.count[x]:
                continue
            self.count[x] -= 1
            pair = self.two(gap - x)
            self.count[x] += 1
            if pair and pair[0] <= x:
                return (x, *pair)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use every piece once; each fills at most ``capacity``."""
    left = _Lengths(counts, capacity)
    out: list[Pattern] = []
    if left.count[capacity]:
        out.append(Pattern((capacity,), left.take((capacity,))))
    while left.sorted:
        longest = left.sorted[-1]
        left.count[longest] -= 1
        gap = capacity - longest
        found = left.one(gap) or left.two(gap) or left.three(gap)
        rest, best = gap, []
        while not found and (at := bisect.bisect_right(left.sorted, rest)):
            # best fit of the residual, which may be filled exactly in the end
            while at and not left.count[left.sorted[at - 1]]:
                at -= 1
            if not at:
                break
            best.append(left.sorted[at - 1])
            left.count[best[-1]] -= 1
            rest -= best[-1]
        for x in best:
            left.count[x] += 1
        left.count[longest] += 1
        lengths = (longest, *(found or best))
        out.append(Pattern(lengths, left.take(lengths)))
    return out


class _Places:
    """Where the n-th piece of each length goes."""

    def __init__(self, patterns: list[Pattern]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for p in patterns:
            offset = 0
            for x in p.lengths:
                rows.append((x, used.get(x, 0), sequence, offset))
                used[x] = used.get(x, 0) + p.times
                offset += x
            sequence += p.times
        rows.sort()
        self.length, self.first, self.sequence, self.offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((),) * 4))
        self.key = (self.length << 44) + self.first

    def at(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 44) + number, "right") - 1
        return self.sequence[i] + number - self.first[i], self.offset[i]


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenise.tokenizer(path)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, ids, off in t.encode(b.column("text")):
                docs = len(off) - 1
                size = np.diff(off) + 1
                cut = np.concatenate([[0], np.cumsum(size)])
                whole = np.insert(ids, off[1:], end).astype("<u4")
                count = -(-size // capacity)
                doc = np.repeat(np.arange(docs), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                # pieces lie one behind the other, so their lengths are the offsets of the binary column
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [
                    None, pa.py_buffer(np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int64)), pa.py_buffer(whole)])
                assert cut[-1] == length.sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + len(doc))), b.column("id").take(pa.array(first + doc)), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), data.cast(pa.binary())],
                    names=["uid", "id", "piece", "start", "length", "ids"])
                uid += len(doc)

    return trimmed(run)


def _placed(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.at(b.column("length").to_numpy(), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             names=["uid", "sequence_id", "offset"])

    return trimmed(run)


class Packed(NamedTuple):
    pieces: DataFrame  #: uid, id, piece, start, length, ids (little-endian unsigned 32-bit)
    places: DataFrame  #: uid, sequence_id, offset

    def joined(self) -> DataFrame:
        return self.pieces.join(self.places, "uid").drop("uid")


def pack(df: DataFrame, scratch: Scratch, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end: int = 0, buckets: int = BUCKETS) -> Packed:
    """Tokenise every text, append ``end``, cut what is longer than ``capacity``, and pack all pieces."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    pieces = scratch.write(docs.mapInArrow(
        _pieces(tokenizer, capacity, end), f"uid long, id {kind}, piece int, start long, length long, ids binary"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    places = df.sparkSession.sparkContext.broadcast(_Places(plan(counts, capacity)))
    small = pieces.select("uid", "length").withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    placed = numbered(small, ["length"], "bucket", ["uid"], "number").select("uid", "length", "number").mapInArrow(
        _placed(places), "uid long, sequence_id long, offset long")
    return Packed(pieces, placed)
