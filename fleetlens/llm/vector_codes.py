"""Product codes of vectors: exact nearest codebook entries by sliced and intersected bitmasks.

Components are integers, ``floor(256 * x)``.  A vector is cut into ``PARTS`` equal parts, and
each part position has a codebook of at most 64 entries, so that a set of entries is one
uint64.  Per dimension the entries' coordinates are sorted and carry prefix masks: the mask at
place i holds the first i entries.  A part looks for its nearest entry with a radius: two
binary searches a dimension give the slice of coordinates within the radius, the two prefix
masks there differ in just these entries, and the slices' masks are ANDed over the dimensions.
What is left is every entry in the box around the part, hence every one within the radius.  A
best distance within the radius is therefore exact; otherwise the part tries again with that
distance as radius, or with twice the radius where the box was empty.

Codebooks are refined by rounds of assignment and componentwise floor means: tasks hand on
counts and sums by (part, entry, position), which do not grow with the rows of a task.  Nothing
is cached: each round reads the vectors again.

Defined results: a vector that is null, or has a null, NaN or infinite component, is dropped; so
is one whose length is not that of the first kept vector (by id) with a positive multiple of
``PARTS`` components.  Rows without an id come last among the first; rows that share an id are
ordered by their components; repeated rows get equal codes, and each counts in the means.
Fewer than 64 kept vectors make a smaller codebook, none an empty result.  Scaled components are
held to +-2^26 or, beyond 256 components, less, so that no squared distance overflows.  Columns
other than the named ones are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.words import trimmed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: rows searched together
_BLOCK = 4096
_ONE = np.uint64(1)
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


class Slices:
    """Entries of one part position, ready for exact nearest-entry searches."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("an entry mask has 64 bits")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.coordinates = np.take_along_axis(entries, order, axis=0).T.copy()
        bits = _ONE << order.T.astype(np.uint64)
        self.prefix = np.zeros((entries.shape[1], len(entries) + 1), np.uint64)
        np.bitwise_or.accumulate(bits, axis=1, out=self.prefix[:, 1:])
        self.radius = self._first_radius()

    def _first_radius(self) -> int:
        """The median distance of an entry to its nearest other one; any value is exact, this one is quick."""
        gaps = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(gaps, np.iinfo(np.int64).max)
        return max(1, int(np.sqrt(float(np.median(gaps.min(axis=1)))))) if len(gaps) > 1 else 1

    def box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ from each row by at most its radius in every dimension."""
        mask = np.full(len(x), ~np.uint64(0))
        for d, (sorted_, prefix) in enumerate(zip(self.coordinates, self.prefix)):
            low = prefix[np.searchsorted(sorted_, x[:, d] - radius, "left")]
            high = prefix[np.searchsorted(sorted_, x[:, d] + radius, "right")]
            mask &= high & ~low
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of every row (ties: the lower one) and the squared distance to it."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        open_, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(open_):
            rows = x[open_]
            mask = self.box(rows, radius)
            inside = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(inside)
            found, head = np.unique(row, return_index=True)
            distance = ((rows[row] - self.entries[entry]) ** 2).sum(axis=1)
            best = np.minimum.reduceat(distance, head) if len(head) else distance
            hit = np.flatnonzero(distance == np.repeat(best, np.diff(np.append(head, len(row)))))
            first = hit[np.unique(row[hit], return_index=True)[1]]  # entries ascend within a row
            exact = best <= radius[found] ** 2
            at = open_[found[exact]]
            code[at], error[at] = entry[first[exact]], best[exact]
            wider = np.minimum(radius * 2 + 1, np.int64(1) << 31)
            root = np.ceil(np.sqrt(best.astype(np.float64))).astype(np.int64)
            wider[found] = root + (root * root < best)
            left = np.ones(len(open_), bool)
            left[found[exact]] = False
            open_, radius = open_[left], wider[left]
        return code, error


def _limit(width: int) -> int:
    """Largest scaled component for which ``width`` squared differences still add up within 62 bits."""
    return 1 << min(26, (62 - (width - 1).bit_length()) // 2 - 1)


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """Scaled whole components, rows x PARTS x positions."""
    flat = np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)
    top = float(_limit(width))
    return np.clip(np.floor(flat * SCALE), -top, top).astype(np.int64)


def _assigned(column: pa.Array, books: list[Slices], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(components, codes, errors) of the rows, a block at a time."""
    parts = len(books)
    for at in range(0, len(column), _BLOCK):
        x = _integers(column.slice(at, _BLOCK), width).reshape(-1, parts, width // parts)
        found = [book.nearest(x[:, p]) for p, book in enumerate(books)]
        yield x, np.stack([c for c, _ in found], axis=1), np.sum([e for _, e in found], axis=0)


def _sums(codebooks: np.ndarray, width: int):
    """Counts and sums by part, entry and position of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Slices(b) for b in codebooks]
        count = np.zeros(codebooks.shape[:2], np.int64)
        total = np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            for x, code, _ in _assigned(batch.column("vector"), books, width):
                for p in range(len(books)):
                    np.add.at(total[p], code[:, p], x[:, p])
                    count[p] += np.bincount(code[:, p], minlength=count.shape[1])
        part, entry, position = (i.ravel() for i in np.indices(total.shape))
        n = np.repeat(count.ravel(), total.shape[2])
        used = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[used], pa.int64()) for v in (part, entry, position, n, total.ravel())],
                                         names=["part", "entry", "position", "n", "total"])

    return trimmed(run)


def _coded(codebooks: np.ndarray, width: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Slices(b) for b in codebooks]
        size = 2 * len(books)
        for batch in batches:
            at = 0
            for x, code, error in _assigned(batch.column("vector"), books, width):
                text = np.ascontiguousarray(_HEX[code].reshape(-1))
                offsets = np.arange(len(x) + 1, dtype=np.int32) * size
                codes = pa.Array.from_buffers(pa.string(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
                rest = [batch.column(c).slice(at, len(x)) for c in carried]
                yield pa.RecordBatch.from_arrays([*rest, codes, pa.array(error, pa.int64())], names=[*carried, "code", "error"])
                at += len(x)

    return trimmed(run)


class Codes(NamedTuple):
    rows: DataFrame  #: the carried columns, ``code`` and ``error`` of every kept vector
    codebooks: np.ndarray  #: parts x entries x positions, whole numbers

    @property
    def sha256(self) -> str:
        """Digest of all components in order, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, carry: dict[str, Column], id_col: str = "vec_id", vector_col: str = "embedding",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all kept vectors by codebooks that start at the vectors of the smallest ids."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vector.alias("vector"), *(c.alias(f"carry_{n}") for n, c in carry.items()))
    for odd in ("NaN", "Infinity", "-Infinity"):  # unknown, hence dropped, where a component is null
        rows = rows.where(~F.array_contains("vector", F.lit(float(odd))))
    size = F.size("vector")
    rows = rows.where((size > 0) & (size % parts == 0))
    order = [F.col("id").asc_nulls_last(), F.col("vector").asc()]
    first = rows.select("id", "vector").orderBy(*order).limit(1).collect()
    names = [f"carry_{n}" for n in carry]
    if not first:
        none = rows.select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
        return Codes(none.toDF(*carry, "code", "error"), np.zeros((parts, 0, 0), np.int64))
    width = len(first[0]["vector"])
    rows = rows.where(size == width)
    seeds = rows.select("id", "vector").orderBy(*order).limit(entries).collect()
    whole = _integers(pa.array([r["vector"] for r in seeds], pa.list_(pa.float64())), width)
    books = whole.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        found = (rows.select("vector").mapInArrow(_sums(books, width), "part long, entry long, position long, n long, total long")
                 .groupBy("part", "entry", "position")
                 .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
        books = books.copy()
        for r in found:  # parts x entries x positions at most
            books[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    coded = rows.select("vector", *names).mapInArrow(_coded(books, width, names), ", ".join(filter(None, [kinds, "code string, error long"])))
    return Codes(coded.toDF(*carry, "code", "error"), books)


def label_errors(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """``rows`` with ``label_error``, the errors summed over equal labels (nulls together; null beyond a long).

    The sums are partial aggregates; rows meet them in an ordinary join, which adaptive
    execution turns into a broadcast by measured size, or splits where one label is hot.
    """
    sums = rows.groupBy(F.col(label_col).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return rows.join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")
