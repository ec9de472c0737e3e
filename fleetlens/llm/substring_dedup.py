"""Substring deduplication with an FM-index per shard.

A window is ``window`` consecutive words of a document; it is repeated if the same words start
in a document with a smaller id.  Shards are cut by content, so that a document visits only
the shards that can hold its windows:

1. Every window is anchored at one of its ``gram``-word grams, the first in the order of
   ``sketch`` (rare before common) and hash.  Consecutive windows with equal anchors are a run
   (of at most ``LONGEST_RUN`` windows; repetitive text has long ones).
   Equal windows have equal anchors, so only runs whose anchor occurs in two documents matter.
2. Those runs are read from the text as passages; equal passages are pre-aggregated to their
   smallest id, so that thousands of copies are one row.
3. A shard holds all passages of its anchors.  Its FM-index streams them through a backward
   search over a wavelet matrix, whose matching statistics give, for each window, the interval
   of its occurrences and with it the smallest id that has it.
4. Documents drop every word that a repeated window covers.

An anchor with more than ``split`` different passages is cut anew, window by window, with the
window's own hash as anchor, so that no shard grows with a common phrase.

Defined results: a null or empty text has no words and the digest of the empty text; a text
shorter than a window keeps all words; a document with a null id neither loses words nor makes
others lose any; rows that repeat an id are not compared with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm import sketch, words
from fleetlens.llm.fm_index import FMIndex
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import trimmed

WINDOW = 50
GRAM = 10
#: words of one FM-index; a shard's anchors are indexed together up to it
INDEX_WORDS = 1 << 20
SPLIT = 4096
LONGEST_RUN = 256


def _first_least(key: np.ndarray, width: int) -> np.ndarray:
    """For each i, the first place of the least key in [i, i + width)."""
    at = np.arange(len(key))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(key[left] <= key[right], left, right)
        have += step
    return at


def _joined(w: words.Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, each followed by one space, and words + 1 offsets into them."""
    start, end = (w.start, w.end) if keep is None else (w.start[keep], w.end[keep])
    off = np.concatenate([[0], np.cumsum(end - start + 1)])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], end - start + 1)
    out = w.data[np.minimum(at, len(w.data) - 1)] if len(at) else np.zeros(0, np.uint8)
    out[off[1:] - 1] = 32
    return out, off


def _runs(level, window: int, gram: int):
    """Rows of two kinds: every document (n_words, sha256 of all its words), and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = level.value
        width = window - gram + 1
        for b in batches:
            ids = b.column("id")
            for w in words.chunks(b.column("text")):
                docs = len(w.offset) - 1
                here = np.arange(w.first, w.first + docs)
                data, off = _joined(w)
                view = memoryview(data)
                cut = off[w.offset]
                sha = [hashlib.sha256(view[s:max(s, e - 1)]).hexdigest() for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield _runs_batch(b, here, n=np.diff(w.offset), sha=sha)
                h, goff = words.grams(w, gram)
                if len(h) < width:
                    continue
                key = (table[sketch.bucket(h)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                least = _first_least(key, width)
                doc = np.repeat(np.arange(docs), np.diff(goff))[:len(least)]
                starts = np.flatnonzero((np.arange(len(least)) + width <= goff[doc + 1]) & ids.is_valid().to_numpy(False)[doc + w.first])
                if not len(starts):
                    continue
                anchor, of = key[least[starts]], doc[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
                lead = np.flatnonzero(new)
                new |= (np.arange(len(starts)) - np.repeat(lead, np.diff(np.append(lead, len(starts))))) % LONGEST_RUN == 0
                lead = np.flatnonzero(new)
                of = of[lead]
                yield _runs_batch(b, of + w.first, anchor=anchor[lead].astype(np.int64),
                                  start=starts[lead] - goff[of], count=np.diff(np.append(lead, len(starts))))

    return trimmed(run)


def _runs_batch(b: pa.RecordBatch, rows: np.ndarray, n=None, sha=None, anchor=None, start=None, count=None) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    given = [(anchor, pa.int64()), (start, pa.int32()), (count, pa.int32()), (n, pa.int64()), (sha, pa.string())]
    return pa.RecordBatch.from_arrays(
        [b.column("id").take(at), b.column("sig").take(at), *(pa.nulls(len(at), t) if x is None else pa.array(x).cast(t) for x, t in given)],
        names=["id", "sig", "anchor", "start", "count", "n_words", "sha"])


def _passages(window: int):
    """Texts of the runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column("runs")
            row, anchor, start, count, text = [], [], [], [], []
            for w in words.chunks(b.column("text")):
                data, off = _joined(w)
                raw = data.tobytes()
                for d in range(len(w.offset) - 1):
                    base = int(w.offset[d])
                    for r in runs[w.first + d].as_py():
                        s = base + r["start"]
                        row.append(w.first + d), anchor.append(r["anchor"]), start.append(r["start"]), count.append(r["count"])
                        text.append(raw[off[s]:off[s + r["count"] + window - 1] - 1])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("sig").take(at), pa.array(anchor, pa.int64()), pa.array(start, pa.int32()),
                 pa.array([xxhash.xxh3_128_digest(t) for t in text], pa.binary()), pa.array(text, pa.binary()).cast(pa.string())],
                names=["id", "sig", "anchor", "start", "key", "passage"])

    return trimmed(run)


def _single_windows(window: int):
    """Passages cut into their windows, each anchored by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, text = [], [], []
            for i, (s, passage) in enumerate(zip(b.column("start").to_pylist(), b.column("passage").to_pylist())):
                w = passage.split(" ")
                for j in range(len(w) - window + 1):
                    row.append(i), start.append(s + j), text.append(" ".join(w[j:j + window]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("sig").take(at),
                 pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in text], pa.int64()), pa.array(start, pa.int32()),
                 pa.array([xxhash.xxh3_128_digest(t) for t in text], pa.binary()), pa.array(text, pa.string())],
                names=["id", "sig", "anchor", "start", "key", "passage"])

    return trimmed(run)


def _shard(window: int, most_words: int):
    """FM-indexes over whole anchors; passages with windows that a smaller id has, and those ids."""

    def index(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        w = next(words.chunks(rows.column("passage"), limit=1 << 62))
        plain, off = _joined(w)
        text = pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(plain))
        codes = text.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        owner = rows.column("first").to_numpy()
        fm = FMIndex(codes, np.diff(w.offset), owner, window)
        passage, at, least = fm.search()
        order = np.lexsort((at, passage))
        passage, least = passage[order], least[order]
        size = np.diff(w.offset) - window + 1
        cut = np.concatenate([[0], np.cumsum(size)])
        hit = np.minimum.reduceat(least, cut[:-1]) < rows.column("last").to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(least, pa.int64()))
        keep = pa.array(hit)
        return pa.RecordBatch.from_arrays([rows.column("key").combine_chunks().filter(keep), lists.filter(keep)], names=["key", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            anchor = b.column("anchor").to_numpy()
            size = np.cumsum(np.diff(words.buffers(b.column("passage"))[1]) // 6 + 1)
            heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            if parts and parts[-1].column("anchor")[-1].as_py() == anchor[0]:
                heads = heads[1:]
            taken = 0
            for h in heads.tolist():
                if held + (size[h - 1] if h else 0) - (size[taken - 1] if taken else 0) < most_words:
                    continue
                if h > taken:
                    parts.append(b.slice(taken, h - taken))
                if parts:
                    yield index(parts)
                parts, held, taken = [], 0, h
            if taken < len(b):
                parts.append(b.slice(taken))
                held += int(size[-1] - (size[taken - 1] if taken else 0))
        if parts:
            yield index(parts)

    return trimmed(run)


def _removed(window: int):
    """Documents without the words that their repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column("windows")
            n, sha, kept = [], [], []
            for w in words.chunks(b.column("text")):
                count = len(w.start)
                edge = np.zeros(count + 1, np.int64)
                for d in range(len(w.offset) - 1):
                    at = w.offset[d] + np.asarray(gone[w.first + d].values, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                keep = np.cumsum(edge[:count]) == 0
                data, off = _joined(w, keep)
                cut = off[np.concatenate([[0], np.cumsum(keep)])[w.offset]]
                raw = data.tobytes()
                for d, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    text = raw[s:max(s, e - 1)]
                    kept.append(text), sha.append(hashlib.sha256(text).hexdigest())
                    a, z = w.offset[d], w.offset[d + 1]
                    n.append(int(z - a - keep[a:z].sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("sig"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "sig", "n_removed", "sha", "kept"])

    return trimmed(run)


def substring_dedup(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    gram: int = GRAM, index_words: int = INDEX_WORDS, split: int = SPLIT) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, and kept_text where words were removed (else null)."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("sig", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    level = sketch.levels(docs, "text", gram, scratch)
    rows = scratch.write(docs.mapInArrow(
        _runs(level, window, gram), f"id {kind}, sig long, anchor long, start int, count int, n_words long, sha string"), "runs")
    runs = rows.where("anchor is not null").drop("n_words", "sha")

    # runs whose anchor occurs in two documents, with their texts
    shared = runs.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    per_doc = runs.join(shared, "anchor").groupBy("id", "sig").agg(
        F.collect_list(F.struct("anchor", "start", "count")).alias("runs"))
    suspects = scratch.write(docs.join(per_doc, ["id", "sig"]).dropDuplicates(["id", "sig"]), "suspects")
    fields = f"id {kind}, sig long, anchor long, start int, key binary, passage string"
    passages = scratch.write(suspects.mapInArrow(_passages(window), fields), "passages")
    same = ["anchor", "key", "passage"]
    distinct = scratch.write(passages.groupBy(*same).agg(F.min("id").alias("first"), F.max("id").alias("last")), "distinct")
    wide = scratch.write(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > split).select("anchor"), "wide")
    if not wide.isEmpty():
        cut = passages.join(wide, "anchor", "left_semi").select("id", "sig", "anchor", "start", "key", "passage").mapInArrow(_single_windows(window), fields)
        passages = scratch.write(passages.join(wide, "anchor", "left_anti").select(cut.columns).union(cut), "passages2")
        distinct = scratch.write(passages.groupBy(*same).agg(F.min("id").alias("first"), F.max("id").alias("last")), "distinct2")

    owners = scratch.write(distinct.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _shard(window, index_words), f"key binary, owners array<{kind}>"), "owners")
    hits = passages.select("id", "sig", "start", "key").join(owners, "key").select("id", "sig", F.filter(
        F.transform("owners", lambda o, j: F.when(o < F.col("id"), F.col("start") + j)), lambda x: x.isNotNull()).alias("windows"))
    gone = hits.where(F.size("windows") > 0).groupBy("id", "sig").agg(F.flatten(F.collect_list("windows")).alias("windows"))
    changed = scratch.write(suspects.select("id", "sig", "text").join(gone, ["id", "sig"]).mapInArrow(
        _removed(window), f"id {kind}, sig long, n_removed long, sha string, kept string"), "changed")
    every, c = rows.where("anchor is null").alias("e"), changed.alias("c")
    on = F.col("e.id").eqNullSafe(F.col("c.id")) & (F.col("e.sig") == F.col("c.sig"))
    return every.join(c, on, "left").select(
        F.col("e.id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("c.sha", "e.sha").alias("kept_sha256"), F.col("kept").alias("kept_text"))
