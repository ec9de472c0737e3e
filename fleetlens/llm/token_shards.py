"""Training-order materialisation of token ids as fixed-stride binary shards.

All texts, each ended by ``end``, form one token stream, in the order of the input's tasks,
which is cut into sequences of ``length`` tokens.  A keyed Feistel network permutes the
sequence numbers 0 .. n - 1; values outside are walked along their cycle until they fall
inside, so every sequence gets a global slot and every slot one sequence.  Slots are dealt in
ranges: a task gets the rows of one shard, sorts them by slot, and writes a file of equal
strides, which a reader follows from any slot without an index.

The stream is tokenised once, in blocks, and written to the shared folder; block starts are
prefix sums over the tasks' token counts.  Shard files are written under a name of the
attempt and then moved, so a task that runs again leaves the same bytes.

Defined results: a null or empty text is its end token; the last sequence is filled with
``pad``, its row says how many tokens count; repeated rows are in the stream as often as
they occur; an empty table has no shard and no row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.llm import tokenise
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import mix, trimmed

LENGTH = 2048
#: sequences in a shard file
PER_SHARD = 4096
ROUNDS = 6


class Permutation:
    """A keyed bijection of 0 .. n - 1: Feistel network over an even number of bits, with cycle walking."""

    def __init__(self, n: int, key: str, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for k in self.keys:
            left, right = right, left ^ (mix(right ^ k) & self.mask)
        return (left << shift) | right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64))
        while (walk := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[walk] = self._once(out[walk])
        return out.astype(np.int64)


def _blocks(path: str, end: int):
    """Compressed blocks of the token stream with their places inside their task's part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, pack = tokenise.tokenizer(path), zstandard.ZstdCompressor(level=3)
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            for _, ids, off in t.encode(b.column("text")):
                whole = np.insert(ids, off[1:], end).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(whole)], pa.int64()),
                     pa.array([pack.compress(_narrow(whole).tobytes())], pa.binary()), pa.array([int(whole.max())], pa.int64())],
                    names=["part", "before", "n", "ids", "largest"])
                before += len(whole)

    return trimmed(run)


def _narrow(ids: np.ndarray) -> np.ndarray:
    """Ids in 16 bits where they fit, else in 32."""
    return ids.astype("<u2") if int(ids.max()) < 1 << 16 else ids.astype("<u4")


def _sequences(order: Permutation, length: int, kind: str):
    """Parts of sequences with their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for b in batches:
            for start, n, largest, blob in zip(*(b.column(c).to_pylist() for c in ("start", "n", "largest", "ids"))):
                ids = np.frombuffer(unpack.decompress(blob), "<u2" if largest < 1 << 16 else "<u4").astype(kind)
                sequence = np.arange(start // length, (start + n - 1) // length + 1)
                begin = np.maximum(sequence * length, start) - start
                stop = np.minimum((sequence + 1) * length, start + n) - start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order(sequence)), pa.array(sequence), pa.array((start + begin) % length, pa.int32()),
                     pa.array([pack.compress(ids[s:e].tobytes()) for s, e in zip(begin.tolist(), stop.tolist())], pa.binary())],
                    names=["slot", "sequence_id", "at", "ids"])

    return trimmed(run)


def _shards(folder: str, length: int, per_shard: int, kind: str, pad: int):
    """One file for each shard, and a row for each of its sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        store, path = fs.FileSystem.from_uri(folder)
        shard, out, name = -1, None, ""
        rows: list[tuple] = []
        slot, sequence, have = -1, -1, b""

        def put() -> None:
            """Write the sequence that is complete."""
            nonlocal have
            n = len(have) // np.dtype(kind).itemsize
            have += np.full(length - n, pad, kind).tobytes()
            out.write(have)
            rows.append((slot, sequence, shard, slot % per_shard * len(have), n, zlib.crc32(have)))
            have = b""

        def close() -> None:
            out.close()
            store.move(f"{path}/{name}", f"{path}/{file_name(shard)}")

        for b in batches:
            for s, q, blob in zip(b.column("slot").to_pylist(), b.column("sequence_id").to_pylist(), b.column("ids").to_pylist()):
                if s != slot:
                    if out:
                        put()
                    if s // per_shard != shard:
                        if out:
                            close()
                        shard = s // per_shard
                        name = f"_{file_name(shard)}.{uuid.uuid4().hex}"
                        out = store.open_output_stream(f"{path}/{name}")
                    slot, sequence = s, q
                have += unpack.decompress(blob)
            if rows:
                yield _manifest(rows)
                rows = []
        if out:
            put()
            close()
            yield _manifest(rows)

    return trimmed(run)


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["slot", "sequence_id", "shard", "byte_offset", "n_tokens", "ids_crc32"])


def file_name(shard: int) -> str:
    return f"shard-{shard:09d}.bin"


def read_slots(folder: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, kind: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences of ``count`` slots from ``first`` on, read one behind the other."""
    store, path = fs.FileSystem.from_uri(folder)
    stride = length * np.dtype(kind).itemsize
    slot, last = first, first + count
    while slot < last:
        n = min(last, (slot // per_shard + 1) * per_shard) - slot
        with store.open_input_file(f"{path}/{file_name(slot // per_shard)}") as f:
            f.seek(slot % per_shard * stride)
            for _ in range(n):
                yield np.frombuffer(f.read(stride), kind)
        slot += n


def write_shards(df: DataFrame, scratch: Scratch, folder: str, tokenizer: str, text_col: str = "text", key: str = "epoch-0",
                 length: int = LENGTH, per_shard: int = PER_SHARD, end: int = 0, pad: int = 0) -> DataFrame:
    """Write the shards to ``folder``; one row per sequence: slot, sequence_id, shard, byte_offset, n_tokens, ids_crc32."""
    manifest = "slot long, sequence_id long, shard long, byte_offset long, n_tokens int, ids_crc32 long"
    blocks = scratch.write(df.select(F.col(text_col).alias("text")).mapInArrow(
        _blocks(tokenizer, end), "part int, before long, n long, ids binary, largest long"), "blocks", "none")
    total = blocks.agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).first()
    if not total["n"]:
        return df.sparkSession.createDataFrame([], manifest)
    kind = "<u2" if max(total["largest"], pad) < 1 << 16 else "<u4"
    sequences = -(-total["n"] // length)
    starts = blocks.groupBy("part").agg(F.sum("n").alias("tokens"))
    # one row per task of the tokenising pass
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("first"))
    placed = blocks.join(F.broadcast(starts), "part").select((F.col("first") + F.col("before")).alias("start"), "n", "largest", "ids")
    parts = placed.mapInArrow(_sequences(Permutation(sequences, key), length, kind), "slot long, sequence_id long, at int, ids binary")
    shard = F.expr(f"cast(slot div {per_shard} as int)")
    dealt = parts.repartitionById(-(-sequences // per_shard), shard).sortWithinPartitions("slot", "at")
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    return dealt.mapInArrow(_shards(folder, length, per_shard, kind, pad), manifest)
