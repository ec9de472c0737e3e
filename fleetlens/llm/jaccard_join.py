"""N-gram Jaccard join by a grouped prefix join.

A document is the set of its distinct k-word shingles, ordered rare before common (see
``sketch``).  Two sets whose Jaccard similarity reaches num / den share a shingle in their
prefixes of n - ceil(n * num / den) + 1 shingles.

1. Documents with equal sets are one class, represented by its smallest id.
2. Classes with identical prefix and size are one *group*; groups are indexed by the
   shingles of their prefix.
3. Group pairs from an index list pass the size, position and prefix-overlap filters, which
   depend on prefix and size alone and hence decide for all members at once.
4. Members are verified on their whole sets.  What is sought is which documents hang
   together: a pair that is already connected needs no check.  So members are first
   verified against the leader of their group and groups by their leaders, and only pairs
   that are then still in different components are expanded member by member.

Near copies of one text that are not near enough to each other share most of their prefixes.
Every set therefore carries ``PARITY`` bits: the parity of the number of its shingles in each of as
many hash buckets.  Two sets differ in at least as many shingles as in bits, so pairs whose bits
differ in more than a link allows are dropped before prefixes are compared or sets are read.

Long index lists (more than ``hot`` groups) are treated the same way: first all against one
hub, then against several, while a list still spans many components; the rest is expanded
in full, so nothing is ever capped or dropped.

Defined results: null or empty text has no shingles, size 0, and links with nothing; a text
of fewer than k words is one shingle; repeated rows are equal sets, and rows that share an
id count as one document when links are followed; a null id links with nothing and has a
null component.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm import sketch, words
from fleetlens.llm.components import connected_components
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import trimmed


#: documents whose small rows (no texts, no whole sets) a task gets at least
ROWS_PER_TASK = 20_000
#: pairs across components that a long list may have, per entry, before it gets more hubs
CROSS = 500
#: bits of a set's parities, a multiple of 64
PARITY = 1024


class Similar(NamedTuple):
    """100 * intersection >= percent * union is ``num`` / ``den`` = percent / 100."""

    k: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n + (-n * self.num // self.den) + 1

    def sizes(self, a: Column, b: Column) -> Column:
        return self.num * F.greatest(a, b) <= self.den * F.least(a, b)

    def close(self, a: str, b: str) -> Column:
        """Whether the parities of two sets leave room for a link: |A xor B| is at most (1 - t) / (1 + t) of both sizes."""
        differ = sum((F.bit_count(F.get(f"{a}.parity", F.lit(i)).bitwiseXOR(F.get(f"{b}.parity", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
        return (self.den + self.num) * differ <= (self.den - self.num) * (F.col(f"{a}.n") + F.col(f"{b}.n"))

    def overlap(self, a: Column, b: Column) -> Column:
        """Least intersection of two linked sets of these sizes."""
        return F.ceil(self.num * (a + b) / F.lit(float(self.num + self.den)) - F.lit(1e-9))


def parities(shingles: np.ndarray) -> np.ndarray:
    """PARITY bits of a set of shingle hashes, as 64-bit integers."""
    odd = np.bincount((shingles >> np.uint64(44)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(level, how: Similar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = level.value
        for b in batches:
            size, digest, lead_digest, prefix, parity = [], [], [], [], []
            for w in words.chunks(b.column("text"), lower=True):
                h, off = words.grams(w, how.k, short=True)
                for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
                    if s == e:
                        size.append(0), digest.append(None), lead_digest.append(None), prefix.append(None), parity.append(None)
                        continue
                    u = np.unique(h[s:e])
                    # the rank of a shingle: its level, then its hash
                    rank = (table[sketch.bucket(u)].astype(np.uint64) << np.uint64(56)) | (u >> np.uint64(8))
                    p = how.prefix(len(u))
                    lead = np.sort(np.partition(rank, p - 1)[:p]) if p < len(u) else np.sort(rank)
                    size.append(len(u))
                    digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                    lead_digest.append(hashlib.blake2b(lead.tobytes(), digest_size=16).digest())
                    prefix.append(lead.astype(np.int64)), parity.append(parities(u))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(lead_digest, pa.binary()),
                 pa.array(prefix, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))],
                names=["id", "n", "digest", "lead", "prefix", "parity"])

    return trimmed(run)


def _sets(k: int, wanted):
    """Sets of the documents whose bucket is wanted: a byte per bucket stands for any number of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(wanted.value[b.column("bucket").to_numpy()]))
            if not len(b):
                continue
            out = []
            for w in words.chunks(b.column("text"), lower=True):
                h, off = words.grams(w, k, short=True)
                out += [np.unique(h[s:e]).tobytes() for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "shingles"])

    return trimmed(run)


class _SetStore:
    """Whole sets of the documents that have come up for verification so far.

    Documents are first told apart by one of 2 ** 22 buckets of their id, which every task
    looks up, so that texts are not shuffled for it; the exact join follows on the sets.
    """

    BUCKETS = 1 << 22

    def __init__(self, docs: DataFrame, scratch: Scratch, how: Similar, tasks: int):
        self.docs, self.scratch, self.how, self.tasks = docs, scratch, how, tasks
        self.tables: list[DataFrame] = []

    def _all(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.union(t)
        return out

    def linked(self, pairs: DataFrame, name: str) -> DataFrame | None:
        """The linked ones of ``pairs(a, b)``; None if there is no pair."""
        pairs = self.scratch.write(pairs.where("a <> b").distinct().coalesce(self.tasks), f"{name}-pairs")
        if pairs.isEmpty():
            return None
        new = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if self.tables:
            new = new.join(self._all().select("id").distinct(), "id", "left_anti")
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.BUCKETS)).alias("bucket")
        buckets = new.select(bucket).distinct().coalesce(self.tasks).toPandas()["bucket"].to_numpy(np.int64)  # at most BUCKETS rows
        if len(buckets):
            wanted = np.zeros(self.BUCKETS, bool)
            wanted[buckets] = True
            kind = self.docs.schema["id"].dataType.simpleString()
            found = self.docs.select("id", "text", bucket).where("id is not null").mapInArrow(
                _sets(self.how.k, self.docs.sparkSession.sparkContext.broadcast(wanted)), f"id {kind}, shingles binary")
            found = found.where("length(shingles) > 0")
            if 8 * len(buckets) > self.BUCKETS:  # else few other documents share a wanted bucket, and do no harm
                found = found.join(new, "id", "left_semi")
            self.tables.append(self.scratch.write(found, f"{name}-sets", "none"))
        kind = pairs.schema["a"].dataType.simpleString()
        sets = self._all()
        # whole sets are thousands of times larger than the other rows
        some = 4 * self.tasks
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").coalesce(some).join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").coalesce(some)
        return self.scratch.write(both.mapInArrow(_linked(self.how), f"a {kind}, b {kind}").distinct().coalesce(self.tasks), name)


def _linked(how: Similar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(how.den * common >= how.num * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return trimmed(run)


def near_groups(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                how: Similar = Similar(), hot: int = 64) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links, itself included)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    level = sketch.levels(docs, "text", how.k, scratch, lower=True)
    signed = scratch.write(docs.mapInArrow(
        _signatures(level, how), f"id {kind}, n long, digest binary, lead binary, prefix array<long>, parity array<long>"), "signed")
    usable = signed.where("n > 0 and id is not null")
    tasks = 1 + signed.count() // ROWS_PER_TASK  # few rows are not dealt over many tasks

    # classes of equal sets, then groups of identical prefix and size
    classes = scratch.write(usable.groupBy("digest").agg(F.min("id").alias("rep")).coalesce(tasks), "classes")
    reps = usable.select(F.col("id").alias("rep"), "digest", "n", "lead", "parity").join(classes, ["digest", "rep"]).distinct()
    reps = scratch.write(reps.select("rep", "n", "lead", "parity").coalesce(tasks), "reps")
    keys = scratch.write(reps.groupBy("n", "lead").agg(F.min("rep").alias("gid"), F.count("*").alias("members")).coalesce(tasks), "keys")
    member = scratch.write(reps.join(keys, ["n", "lead"]).select("rep", "gid", "members", "n", "parity").coalesce(tasks), "member")
    scratch.drop("reps")
    groups = scratch.write(usable.select(F.col("id").alias("gid"), "n", "lead", "prefix", "parity").join(
        keys, ["gid", "n", "lead"]).drop("lead").distinct().coalesce(4 * tasks), "groups")
    shared = member.where("members > 1")

    # index lists with at least two groups
    entries = groups.select("gid", "n", "members", F.posexplode("prefix").alias("pos", "token"))
    longer = entries.groupBy("token").agg(F.count("*").alias("length")).where("length > 1").coalesce(8 * tasks)
    lists = scratch.write(entries.join(longer, "token").coalesce(8 * tasks), "lists")
    prefixes = groups.select("gid", "n", "members", "prefix", "parity")

    def may_link(a: str, b: str) -> Column:
        """Whether parities leave room for a link between members of two groups: they are known of groups of one."""
        return (F.col(f"{a}.members") > 1) | (F.col(f"{b}.members") > 1) | how.close(a, b)

    def fits(a: str, b: str) -> Column:
        """Whether a shared shingle at these places can be the first common one of two linked sets.

        All common shingles then stand at or behind it, so what is left of either set from there
        on is at least the overlap that the two sizes ask for.
        """
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        least = how.overlap(na, nb)
        return how.sizes(na, nb) & (na - F.col(f"{a}.pos") >= least) & (nb - F.col(f"{b}.pos") >= least)

    def overlaps(a: str, b: str) -> Column:
        """Whether the overlap of two prefixes does not rule a link out.

        Common shingles up to the smaller of the two last ranks are all in both prefixes; past it,
        the intersection is at most what is left of either set.
        """
        na, nb, x, y = (F.col(f"{s}.{c}") for c in ("n", "prefix") for s in (a, b))
        cut = F.least(F.element_at(x, -1), F.element_at(y, -1))
        past = F.least(na - F.size(F.filter(x, lambda r: r <= cut)), nb - F.size(F.filter(y, lambda r: r <= cut)))
        return F.size(F.array_intersect(x, y)) + past >= how.overlap(na, nb)

    def filtered(pairs: DataFrame) -> DataFrame:
        """Group pairs that the overlap of their prefixes does not rule out."""
        p = pairs.alias("p").join(prefixes.alias("x"), F.col("p.g1") == F.col("x.gid")).coalesce(4 * tasks).join(
            prefixes.alias("y"), F.col("p.g2") == F.col("y.gid")).coalesce(4 * tasks)
        return p.where(may_link("x", "y") & overlaps("x", "y")).select("p.*").distinct()

    def against_hubs(entries: DataFrame, hubs_per_list: int, different: Column) -> DataFrame:
        """Pairs of each entry with the hubs of its list: of each of its parts, the largest group."""
        part = F.pmod(F.xxhash64("gid"), F.lit(hubs_per_list))
        weight = F.shiftleft(F.least("members", F.lit((1 << 14) - 1)), 48) + F.xxhash64("gid", "token").bitwiseAND(F.lit((1 << 48) - 1))
        e = entries.withColumn("part", part).withColumn("weight", weight)
        best = e.groupBy("token", "part").agg(F.max("weight").alias("weight")).coalesce(tasks)
        hubs = e.join(best, ["token", "part", "weight"]).drop("part", "weight").coalesce(tasks)
        return entries.alias("x").join(hubs.alias("y"), F.col("x.token") == F.col("y.token")).where(
            (F.col("x.gid") != F.col("y.gid")) & different & fits("x", "y")).select(
            F.least("x.gid", "y.gid").alias("g1"), F.greatest("x.gid", "y.gid").alias("g2")).distinct().coalesce(tasks)

    few, many = lists.where(F.col("length") <= hot), lists.where(F.col("length") > hot)
    near = few.alias("x").join(few.alias("y"), F.col("x.token") == F.col("y.token")).where(
        (F.col("x.gid") < F.col("y.gid")) & fits("x", "y")).select(F.col("x.gid").alias("g1"), F.col("y.gid").alias("g2")).distinct()
    pairs = scratch.write(filtered(near.coalesce(tasks).union(against_hubs(many, 1, F.lit(True))).distinct().coalesce(tasks)).coalesce(tasks), "pairs0")

    store = _SetStore(docs, scratch, how, tasks)

    def cells(component: DataFrame) -> DataFrame:
        """Connected members of one group; their leader is the smallest id."""
        c = member.join(component, member["rep"] == component["node"], "left").select(
            "gid", "rep", F.coalesce("component", "rep").alias("component")).coalesce(tasks)
        return c

    def by_leaders(pairs: DataFrame, cell: DataFrame) -> DataFrame:
        lead = cell.groupBy("gid", "component").agg(F.min("rep").alias("leader"))
        one = lead.coalesce(tasks).select(F.col("gid").alias("g1"), F.col("component").alias("c1"), F.col("leader").alias("a"))
        two = lead.coalesce(tasks).select(F.col("gid").alias("g2"), F.col("component").alias("c2"), F.col("leader").alias("b"))
        return pairs.select("g1", "g2").join(one, "g1").coalesce(tasks).join(two, "g2").where("c1 <> c2").select("a", "b").coalesce(tasks)

    # members against the leader of their group, and groups by their leaders
    first = shared.select(F.col("gid").alias("a"), F.col("rep").alias("b")).union(pairs.select(F.col("g1").alias("a"), F.col("g2").alias("b")))
    links = store.linked(first, "links1")

    def connected(name: str) -> DataFrame:
        """Components over all links so far; links are few against documents."""
        if links is None:
            return classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
        return connected_components(links.toDF("u", "v"), scratch, name)

    def add(more: DataFrame | None) -> None:
        nonlocal links
        links = more if links is None else links if more is None else links.union(more)

    component = connected("cc1-")

    place = F.struct("token", "pos", "length")

    def spanning(entries: DataFrame, cell: DataFrame) -> DataFrame:
        """Those of the entries whose lists span several components, one for each cell.

        A cell meets its group, and its prefix, in one row with all entries, which are told apart after that."""
        lead = cell.select("gid", "component").distinct().coalesce(tasks)
        e = entries.groupBy("gid", "n", "members").agg(F.collect_list(place).alias("places")).coalesce(tasks).join(lead, "gid").coalesce(tasks)
        e = e.select("gid", "n", "members", "component", F.inline("places"))
        open_ = e.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        e = e.join(open_.select("token").coalesce(tasks), "token").coalesce(tasks)
        e = e.groupBy("gid", "n", "members", "component").agg(F.collect_list(place).alias("places")).coalesce(tasks)
        return e.join(prefixes.drop("n", "members"), "gid").coalesce(tasks).select(
            "gid", "n", "members", "component", "prefix", "parity", F.inline("places"))

    cell = scratch.write(cells(component), "cells1")
    still = scratch.write(spanning(many, cell), "spanning1")
    for turn, hubs in enumerate((8, 32), 2):
        sizes = still.groupBy("token", "component").agg(F.count("*").alias("c")).coalesce(tasks).groupBy("token").agg(
            F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same")).coalesce(tasks)
        work = sizes.agg(F.sum(F.col("all") * F.col("all") - F.col("same")).alias("cross"), F.sum("all").alias("all")).first()
        if not work["all"] or work["cross"] <= CROSS * work["all"]:
            break
        more = against_hubs(still, hubs, (F.col("x.component") != F.col("y.component")) & may_link("x", "y") & overlaps("x", "y"))
        add(store.linked(by_leaders(more, cell), f"links{turn}"))
        component = connected(f"cc{turn}-")
        cell = scratch.write(cells(component), f"cells{turn}")
        # components only grow together: lists of one component stay so
        before = still.drop("component", "prefix", "parity").distinct().coalesce(tasks)
        still = scratch.write(spanning(before, cell), f"spanning{turn}")

    # whatever is left: pairs of cells in different components, member by member.  Cheap tests pick the
    # pairs, which are written; their prefixes are compared after that
    x, y = still.alias("x"), still.alias("y")
    rest = x.join(y, F.col("x.token") == F.col("y.token")).where(
        (F.col("x.gid") < F.col("y.gid")) & (F.col("x.component") != F.col("y.component")) & fits("x", "y") & may_link("x", "y")).select(
        F.col("x.gid").alias("g1"), F.col("y.gid").alias("g2"))
    rest = filtered(scratch.write(rest.distinct().coalesce(4 * tasks), "rest"))
    # a group whose members are all connected has one cell; others are paired with themselves
    torn = cell.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(
        F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    left = pairs.union(rest.coalesce(tasks)).union(torn.coalesce(tasks)).distinct().coalesce(tasks)
    each = cell.join(member.select("rep", "n", "parity"), "rep").coalesce(tasks)
    one = left.alias("l").join(each.alias("x"), F.col("l.g1") == F.col("x.gid")).select("l.g2", "x.*").coalesce(tasks)
    open_pairs = one.alias("x").join(each.alias("y"), (F.col("x.g2") == F.col("y.gid")) & (F.col("x.component") != F.col("y.component"))
                                     & ((F.col("x.gid") != F.col("y.gid")) | (F.col("x.rep") < F.col("y.rep"))) & how.close("x", "y"))
    open_pairs = open_pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    last = store.linked(open_pairs, "links-rest")
    if last is not None and not last.isEmpty():
        add(last)
        component = connected("cc-rest-")
    found = classes.join(component, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return signed.select("id", "n", "digest").join(found, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
