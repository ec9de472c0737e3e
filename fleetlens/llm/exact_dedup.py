"""Exact deduplication as a grace hash join of a table with itself.

1. Map: every task keeps a table of the distinct texts of its own rows, bounded in bytes,
   and emits each of them once (an *entry*) plus one small row per document (a *member*)
   that names its entry.  Copies inside a task never reach the shuffle as texts, so a
   group that holds a third of all rows costs one entry per task and table.
2. Entries are shuffled by their hash.  Every reducer partitions its records into buckets,
   recursively by further bits of the hash and through spill files, until a bucket fits an
   open-addressing table that compares complete contents.
3. Members join the outcome of their entry by the entry's number.

The map output is written to the shared folder first, so that entry numbers stay the same
when executors are lost and tasks run again.

Defined results: a null text counts as empty; of equal texts the row with the largest id
stays (null ids are smallest, and among rows with the same id exactly one stays); an empty
table gives an empty result; other columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import trimmed

#: bytes of distinct texts a map task holds before it emits its table
LOCAL_BYTES = 32 << 20
#: bytes of records a reducer holds before it partitions them into spill files
BUCKET_BYTES = 64 << 20
FANOUT_BITS = 4


class Dedup(NamedTuple):
    decisions: DataFrame  #: id, keep_id, group_size, kept, text_sha256
    survivors: DataFrame  #: the kept rows with all columns of the input


def exact_dedup(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                local_bytes: int = LOCAL_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Dedup:
    """Group rows by equal text, without change, and keep one row of each group."""
    names = df.columns
    key, text = names.index(id_col), names.index(text_col)
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("top", T.BooleanType()),
                           T.StructField("hash", T.LongType()), T.StructField("size", T.LongType()), *plain.schema.fields])
    arrow = _local_tables(f"c{key}", f"c{text}", local_bytes)
    rows = scratch.write(plain.mapInArrow(arrow, _nullable(schema)), "entries")
    entries = rows.where("size is not null")
    texts = entries.select("uid", F.col(f"c{key}").alias("id"), "size", "hash", F.col(f"c{text}").alias("text"))
    groups = scratch.write(texts.repartition("hash").mapInArrow(
        _grace(bucket_bytes), f"uid long, winner long, keep_id {plain.schema[key].dataType.simpleString()}, group_size long, sha string"), "groups")
    decisions = rows.where("top is not null").select("uid", "top", F.col(f"c{key}").alias(id_col)).join(groups, "uid").select(
        F.col(id_col), "keep_id", "group_size", (F.col("top") & (F.col("uid") == F.col("winner"))).alias("kept"),
        F.col("sha").alias("text_sha256"))
    keep = groups.where("uid = winner").select("uid")
    survivors = entries.join(keep, "uid", "left_semi").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
    return Dedup(decisions, survivors)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary()).fill_null(b"").to_pylist()


def _rank(i) -> tuple:
    """Order of ids: nulls first."""
    return (i is not None, i if i is not None else 0)


def _local_tables(key: str, text: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        table: dict = {}
        held = 0
        source: dict[int, pa.RecordBatch] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            # an entry carries the columns of its own kept row; a member only its id
            fields = list(source.values())[0].schema
            uid, top, ids, at = [], [], [], {}
            for e in table.values():
                best = max(range(len(e[1])), key=lambda m: _rank(e[1][m]))
                for m, i in enumerate(e[1]):
                    uid.append(e[0]), top.append(m == best), ids.append(i)
                at.setdefault(e[2][best][0], []).append((e[2][best][1], e[0], e[3], len(e[1])))
            n = len(uid)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(top, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
                + [pa.array(ids, f.type) if f.name == key else pa.nulls(n, f.type) for f in fields],
                names=["uid", "top", "hash", "size", *fields.names])
            for b, picks in at.items():
                rows = source[b].take(pa.array([p[0] for p in picks], pa.int64()))
                k = len(picks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[1] for p in picks], pa.int64()), pa.nulls(k, pa.bool_()),
                     pa.array([p[2] for p in picks], pa.int64()), pa.array([p[3] for p in picks], pa.int64()), *rows.columns],
                    names=["uid", "top", "hash", "size", *fields.names])

        for b, batch in enumerate(batches):
            source[b] = batch
            held += batch.nbytes
            for r, (i, t) in enumerate(zip(batch.column(key).to_pylist(), _bytes(batch.column(text)))):
                e = table.get(t)  # the dictionary compares whole texts
                if e is None:
                    e = table[t] = (number, [], [], xxhash.xxh3_64_intdigest(t) - (1 << 63))
                    number += 1
                e[1].append(i), e[2].append((b, r))
            if held >= limit:
                yield from emit()
                table, held, source = {}, 0, {}
        if table:
            yield from emit()

    return trimmed(run)


class _Table:
    """Open addressing with linear probing; equal hashes are told apart by their whole contents."""

    def __init__(self) -> None:
        self.mask, self.slots = 1023, [-1] * 1024
        self.hash: list[int] = []
        self.text: list[bytes] = []
        self.best: list[tuple] = []  # (rank of id, -uid, id)
        self.size: list[int] = []
        self.uids: list[list[int]] = []

    def add(self, h: int, text: bytes, uid: int, i, size: int) -> None:
        at = h & self.mask
        while (s := self.slots[at]) >= 0 and not (self.hash[s] == h and self.text[s] == text):
            at = (at + 1) & self.mask
        mine = (_rank(i), -uid, i)
        if s >= 0:
            self.size[s] += size
            self.uids[s].append(uid)
            if mine[:2] > self.best[s][:2]:
                self.best[s] = mine
            return
        self.slots[at] = len(self.hash)
        self.hash.append(h), self.text.append(text), self.best.append(mine), self.size.append(size), self.uids.append([uid])
        if 2 * len(self.hash) > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = [-1] * (self.mask + 1)
            for s, x in enumerate(self.hash):
                at = x & self.mask
                while self.slots[at] >= 0:
                    at = (at + 1) & self.mask
                self.slots[at] = s

    def rows(self) -> Iterator[tuple]:
        for text, best, size, uids in zip(self.text, self.best, self.size, self.uids):
            sha = hashlib.sha256(text).hexdigest()
            for uid in uids:
                yield uid, -best[1], best[2], size, sha


class _Bucket:
    """Records of one bucket: in memory, or behind a spill file once its parent holds too much."""

    def __init__(self, folder: str):
        self.folder, self.rows, self.bytes, self.path = folder, [], 0, ""
        self.low, self.high = 1 << 64, -(1 << 64)  # of the hashes

    def add(self, row: tuple) -> int:
        self.rows.append(row)
        self.low, self.high = min(self.low, row[0]), max(self.high, row[0])
        self.bytes += len(row[1]) + 100
        return len(row[1]) + 100

    def spill(self) -> None:
        self.path = self.path or tempfile.mkstemp(dir=self.folder)[1]
        with open(self.path, "ab") as f:
            for row in self.rows:
                pickle.dump(row, f, protocol=5)
        self.rows = []

    def __iter__(self) -> Iterator[tuple]:
        if self.path:
            with open(self.path, "rb") as f:
                while True:
                    try:
                        yield pickle.load(f)
                    except EOFError:
                        break
            os.remove(self.path)
        yield from self.rows


def _buckets(rows: Iterator[tuple], depth: int, limit: int, folder: str) -> Iterator[tuple]:
    """Partition by the next bits of the hash; finish the buckets that fit, and recurse into the others."""
    parts = [_Bucket(folder) for _ in range(1 << FANOUT_BITS)]
    shift, held = FANOUT_BITS * depth, 0
    for row in rows:
        held += parts[(row[0] >> shift) & ((1 << FANOUT_BITS) - 1)].add(row)
        if held > limit:
            for p in parts:
                p.spill()
            held = 0
    for p in parts:
        # copies of one text share all bits, and further bits would not part them: the table, which holds a text once, takes them
        if p.bytes > limit and p.low < p.high and FANOUT_BITS * (depth + 2) <= 60:
            yield from _buckets(iter(p), depth + 1, limit, folder)
        else:
            table = _Table()
            for row in p:
                table.add(*row)
            yield from table.rows()
        p.rows = []


def _grace(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: list = []

        def records() -> Iterator[tuple]:
            for b in batches:
                fields[:] = [b.schema.field("id").type]
                yield from zip(b.column("hash").to_pylist(), _bytes(b.column("text")), b.column("uid").to_pylist(),
                               b.column("id").to_pylist(), b.column("size").to_pylist())

        folder = tempfile.mkdtemp(prefix="grace-")  # scratch of this task alone
        try:
            out: list[tuple] = []
            for row in _buckets(records(), 0, limit, folder):
                out.append(row)
                if len(out) >= 10_000:
                    yield _outcome(out, fields[0])
                    out = []
            if out:
                yield _outcome(out, fields[0])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return trimmed(run)


def _outcome(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), id_type, pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["uid", "winner", "keep_id", "group_size", "sha"])
