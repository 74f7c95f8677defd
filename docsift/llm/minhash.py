"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Every element of a document's shingle set deals its ranks to the signature's slots by a permutation of its own, drawn
step by step; in step j an element offers the value j + (a fraction) to one slot. Slots hold the least value offered.
A document is done as soon as every slot holds a value of a step already taken, after one or two steps for most.

Documents with equal sets share a representative, the smallest id, found by a combinable minimum. Representatives
that share a band of the signature are candidates; a bucket's hub is its smallest member, and all members of the
buckets of one hub form that hub's cell. Full sets are sent to the cells, once a cell, and compared there: first with
the hub, then with each other as far as they are still in different groups, by a running union-find. Only links that
join two groups leave a cell, fewer than it has members; pairs are never rows. Two members differ at least by the
shingles that each alone has in the cell, so in order of these, members that differ too much from all are done
without being compared. A hub with more shingles than BLOCK has several lanes, by hash of the member: every lane
gets the hub first, and if more than one group is left after that, every two lanes meet in a cell of their own, so
a task never holds more than two lanes (or one document, if that is larger).

Sets are made from the texts again, for the documents that a bitmap names (a wrong name costs only its set). They
hold 64-bit hashes of the shingles. Words are runs outside {0x20, 0x09-0x0D}, A-Z lower-cased.

Defined cases: a null or blank text has the empty set and is linked with nothing; with fewer words than a shingle has,
the whole sequence is the one shingle; rows without an id take part as copies but never name a group (a group of such
rows alone has the null component and none kept); repeated ids share a component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.bits import bitmap, enough, named, place
from docsift.llm.components import components
from docsift.llm.text import Words, blocks, distinct_per_row, mix
from docsift.session import partitions, prepare, stash

SLOTS = 128
MISS = 1e-6  # chance that a pair just similar enough shares no band
BLOCK, ROW = 1 << 19, 16  # shingles of a lane, 4 MB of hashes; a document counts as so many more
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


@dataclass(frozen=True)
class Plan:
    """Shingle length in words, similarity in percent, and the bands that fit it."""

    words: int = 5
    percent: int = 80

    @property
    def shape(self) -> tuple[int, int]:
        """Bands and slots a band: the longest bands that miss a pair at the limit with a chance below MISS."""
        s = self.percent / 100
        for r in range(16, 0, -1):
            for b in range(1, SLOTS // r + 1):
                if (1 - s**r) ** b < MISS:
                    return b, r
        return SLOTS, 1


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, concatenated, and their bounds."""
    h = w.hashes()
    counts = np.diff(w.first)
    n = np.maximum(counts - size + 1, 0)
    total = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for i in range(size):
        total += h[i : len(h) - size + 1 + i] * _K[i % len(_K)] if len(total) else total
    total = mix(total + np.uint64(size))
    row = np.repeat(np.arange(len(n)), n)
    begin = np.concatenate(([0], np.cumsum(n)))
    at = w.first[:-1][row] + np.arange(len(row)) - begin[:-1][row]
    values = total[at]
    short = np.flatnonzero((counts > 0) & (n == 0))
    if len(short):
        whole = []
        for r in short:
            own = h[w.first[r] : w.first[r + 1]]
            whole.append(mix(np.array([(own * np.array(_K)[: len(own)] if len(own) <= len(_K) else own).sum() + np.uint64(0x51ED270B + len(own))], np.uint64))[0])
        n = n.copy()
        n[short] = 1
        values = np.insert(values, begin[:-1][short], np.array(whole, np.uint64))
        begin = np.concatenate(([0], np.cumsum(n)))
    return distinct_per_row(values, begin)


def signatures(values: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set: row r, slot k holds step * 2**32 + fraction. Empty sets keep the largest value."""
    n = len(bounds) - 1
    out = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    deal = None
    for j in range(slots):
        x = mix(values + np.uint64(j * int(_K[1]) & 0xFFFFFFFFFFFFFFFF))
        pick = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            if deal is None:  # only what is left after the first step keeps its permutation
                deal = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
                np.put_along_axis(deal, first[:, None], np.zeros((len(values), 1), np.uint8), 1)
            at = np.arange(len(values))
            slot = deal[at, pick].astype(np.int64)
            deal[at, pick] = deal[:, j]
        np.minimum.at(out.reshape(-1), row * slots + slot, np.uint64(j << 32) | (x >> np.uint64(32)))
        done = out.max(axis=1) < np.uint64((j + 1) << 32)
        on = ~done[row]
        if not on.any():
            break
        values, row = values[on], row[on]
        if j == 0:
            first = pick[on]
        else:
            deal = deal[on]
    return out


def bands(signature: np.ndarray, count: int, width: int) -> np.ndarray:
    parts = signature[:, : count * width].reshape(-1, count, width)
    total = np.zeros(parts.shape[:2], np.uint64)
    for i in range(width):
        total += mix(parts[:, :, i] + _K[2]) * _K[i % len(_K)]
        total = mix(total)
    return mix(total + np.arange(count, dtype=np.uint64) * _K[0]).view(np.int64)


def digests(values: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A set's name; None for the empty set."""
    raw = values.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * z], digest_size=16).digest() if z > a else None for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def sketch(df: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """k, n (set size), digest (null for the empty set), bands."""
    count, width = plan.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in blocks(b.column(1), lower=True, size=1 << 19):
                values, bounds = shingle_sets(w, plan.words)
                keys = bands(signatures(values, bounds), count, width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bounds), dtype=np.int32) * count), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.row, len(w)), pa.array(np.diff(bounds)), pa.array(digests(values, bounds), pa.binary()), lists], names=["k", "n", "digest", "bands"])

    docs = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return docs.mapInArrow(run, "k long, n long, digest binary, bands array<long>")


def _sets(df: DataFrame, wanted: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """k, d, z: the sorted set, and its name, of every document that the bitmap of wanted.k names, and by chance of some more."""
    bits = enough(wanted)
    shared = bitmap(wanted, "k", bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.filter(pa.array(named(shared.value, b.column(2).to_numpy())))
            if part.num_rows:
                for w in blocks(part.column(1), lower=True, size=1 << 19):
                    values, bounds = shingle_sets(w, plan.words)
                    raw = values.tobytes()
                    z = [raw[8 * a : 8 * e] for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(w.row, len(w)), pa.array(digests(values, bounds), pa.binary()), pa.array(z, pa.binary())], names=["k", "d", "z"])

    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return docs.select("k", "t", place(F.col("k"), bits).alias("p")).mapInArrow(run, "k long, d binary, z binary")


def connect(sets: list[np.ndarray], group: np.ndarray, percent: int, hub: np.ndarray | None = None, rest: bool = True, lane: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (by position) that join groups: of the hubs with all, then, if `rest`, of all members of different groups; of different lanes only, if lanes are given.

    Of two sets similar enough the symmetric difference is at most (100 - percent) / (100 + percent) of both sizes, and it
    holds what each alone has here: with excess = (100 + percent) * alone - (100 - percent) * size, theirs add up to no
    more than 0.
    """
    size = np.array([len(x) for x in sets], np.int64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[code] > 1
    alone = np.bincount(row[~shared], minlength=len(sets))
    excess = (100 + percent) * alone - (100 - percent) * size
    first = np.zeros(len(sets), bool) if hub is None else hub
    order = np.lexsort((excess, ~first))
    order = order[alone[order] < size[order]]  # the others share nothing
    at = np.full(len(sets), -1)
    at[order] = np.arange(len(order))
    keep = shared & (at[row] >= 0)
    by = np.argsort(at[row[keep]], kind="stable")
    code = code[keep][by]
    bounds = np.concatenate(([0], np.cumsum((size - alone)[order])))
    size, excess, lanes = size[order], excess[order], None if lane is None else lane[order]
    group = np.unique(group, return_inverse=True)[1][order]
    hubs = int(first[order].sum())
    found, mark, names = [], np.zeros(len(count), bool), np.arange(len(sets))
    for r in range(len(order) - 1 if rest else hubs):
        last = len(order) if r < hubs else int(np.searchsorted(excess[hubs:], -excess[r], "right")) + hubs
        if last <= r + 1:
            continue
        a, b = size[r], size[r + 1 : last]
        ask = (group[r + 1 : last] != group[r]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        if lanes is not None:
            ask &= lanes[r + 1 : last] != lanes[r]
        met = np.flatnonzero(ask) + r + 1
        if not len(met):
            continue
        mark[code[bounds[r] : bounds[r + 1]]] = True
        if 4 * len(met) >= last - r:
            lo = met[0]
            common = np.add.reduceat(mark[code[bounds[lo] : bounds[last]]], bounds[lo:last] - bounds[lo], dtype=np.int64)[met - lo]
        else:
            n = bounds[met + 1] - bounds[met]
            begin = np.cumsum(n) - n
            common = np.add.reduceat(mark[code[np.repeat(bounds[met] - begin, n) + np.arange(n.sum())]], begin, dtype=np.int64)
        mark[code[bounds[r] : bounds[r + 1]]] = False
        hits = met[100 * common >= percent * (a + size[met] - common)]
        if len(hits):
            joined, one = np.unique(group[hits], return_index=True)
            found += [(int(order[r]), int(j)) for j in order[hits[one]]]
            names[joined] = group[r]
            group = names[group]
            names[joined] = joined
            if (group == group[0]).all():
                break
    return found


CELL = "h binary, lane long, k long, g long, hub boolean, part long, full boolean, z binary"


def _links(cells: DataFrame, plan: Plan) -> DataFrame:
    """u, v: the links found in each cell (h, lane). Members: k, g (group so far), hub, part (lane, to compare with other lanes only, or null), full (whether members that aren't hubs are compared), z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            k, part = t.column("k").to_numpy(), t.column("part")
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("z")]
            got = connect(sets, t.column("g").to_numpy(), plan.percent, t.column("hub").to_numpy(zero_copy_only=False), t.column("full")[0].as_py(), None if part[0].as_py() is None else part.to_numpy())
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(k[[a for a, _ in got]]), pa.array(k[[b for _, b in got]])], names=["u", "v"])

        last = None
        for b in batches:
            own = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            begin = 0
            for i in range(b.num_rows + 1):
                if i == b.num_rows or own[i] != last:
                    if i > begin:
                        held.append(b.slice(begin, i - begin))
                    if i < b.num_rows:
                        if held:
                            yield from flush()
                        begin, last = i, own[i]
        if held:
            yield from flush()

    dealt = cells.repartition(partitions(cells.sparkSession), "h", "lane").sortWithinPartitions("h", "lane")
    return dealt.mapInArrow(run, "u long, v long")


def _compare(df: DataFrame, members: DataFrame, wanted: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """Links of the members (as in CELL, d instead of z), whose sets are made and sent here; wanted: a table that has their k."""
    return _links(members.join(_sets(df, wanted, plan, key, text), ["k", "d"]).select("h", "lane", "k", "g", "hub", "part", "full", "z"), plan)


def link(df: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_shingles, component_id, kept."""
    spark = df.sparkSession
    prepare(spark)
    sketches = stash(sketch(df, plan, key, text), "sketches")
    with_set = sketches.where("digest IS NOT NULL AND k IS NOT NULL")
    reps = stash(with_set.groupBy("digest").agg(F.min("k").alias("k"), F.min_by(F.struct("n", "bands"), "k").alias("x")).select("digest", "k", "x.*"), "reps")
    members = reps.select(F.explode("bands").alias("b"), F.struct("k", F.col("digest").alias("d"), "n").alias("m"))
    hubs = members.groupBy("b").agg(F.min("m").alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1").select("b", F.col("c.d").alias("h"))
    crowd = stash(members.join(hubs, "b").select("h", "m.*").distinct(), "crowd")  # a member is often met in several buckets of one hub
    lanes = crowd.groupBy("h").agg(F.sum(F.col("n") + ROW).alias("n")).where(F.col("n") > BLOCK).select("h", F.ceil(F.col("n") / BLOCK).alias("lanes"))
    wide = stash(lanes, "wide")
    placed = crowd.join(wide, "h", "left").select("h", "k", "d", F.coalesce("lanes", F.lit(1)).alias("lanes"), (F.col("d") == F.col("h")).alias("hub"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("d"), F.col("lanes")))
    every = F.when(F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).otherwise(F.array("part"))
    star = placed.select("h", F.explode(every).alias("lane"), "k", "d", F.col("k").alias("g"), "hub", F.lit(None).cast("long").alias("part"), (F.col("lanes") == 1).alias("full"))
    links = stash(_compare(df, star, crowd, plan, key, text), "links")
    groups = stash(components(links), "groups")
    if not wide.isEmpty():
        grouped = placed.where("lanes > 1").join(groups.withColumnRenamed("node", "k"), "k", "left").withColumn("g", F.coalesce("component", "k"))
        mixed = grouped.groupBy("h").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("h")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1))
        met = grouped.join(mixed, "h").withColumn("other", other)
        pairs = met.select("h", (F.least("part", "other") * F.col("lanes") + F.greatest("part", "other")).alias("lane"), "k", "d", "g", F.lit(False).alias("hub"), F.when(F.col("part") != F.col("other"), F.col("part")).alias("part"), F.lit(True).alias("full"))
        pairs = stash(pairs, "lanes")
        more = _compare(df, pairs, pairs, plan, key, text)
        groups = stash(components(stash(links.union(more), "links")), "groups")
    near = groups.withColumnRenamed("node", "k")
    by_digest = reps.join(near, "k", "left").select(F.col("digest").alias("d"), F.coalesce("component", "k").alias("component"))
    out = sketches.join(by_digest, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("digest").isNull(), F.col("k")).otherwise(F.col("component"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"), Plan(3, 85))
