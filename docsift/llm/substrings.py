"""Repeated passages of 50 words, by super-k-mers.

A window is 50 consecutive words of a document. Its minimiser is the least hash among its runs of 8 words; windows that
follow each other mostly share it. Minimisers that occur in a single document end there: equal windows have equal
minimisers. For the others, consecutive windows of one minimiser travel as one packed string. Equal strings are merged
first (with their smallest document), then each goes to its minimiser's bucket, where its windows are sorted by 128-bit
hashes and every window learns the smallest document in which it starts. Buckets of very many different strings are
split into lanes by the windows' own hashes, in proportion to the strings, and each lane is sorted by itself: equal
windows are in one lane. Each document then loses the words covered by windows with a smaller first document.

Which minimisers are shared, and which documents lose words, travels to the workers as bitmaps of fixed size (8 MB); a
key named by chance costs only its own way.

Words are runs outside {0x20, 0x09-0x0D}, unchanged. Defined cases: a null text has no words; rows without an id keep
all words and are no one's first document; rows with equal ids never take words from each other; texts with fewer than
50 words are kept; an empty table gives no rows; other columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.bits import bitmap, named, place
from docsift.llm.text import Words, blocks, mix, randoms
from docsift.session import prepare, stash

WINDOW, GRAM = 50, 8
LONGEST = 256  # windows a packed string holds at most; longer stretches are sent as several
CROWD = 500  # different strings a bucket may hold; larger ones get a lane for every so many


class _Roll:
    """Hashes of all runs of n words, by prefix sums of word hash * B**i."""

    def __init__(self, seed: int):
        self.base = int(randoms(1, seed)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)

    def __call__(self, h: np.ndarray, n: int) -> np.ndarray:
        if len(h) < n:
            return np.zeros(0, np.uint64)
        powers, inverses = np.full(len(h), self.base, np.uint64), np.full(len(h), self.inverse, np.uint64)
        powers[0] = inverses[0] = 1
        powers, inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers)))
        return mix((sums[n:] - sums[:-n]) * inverses[: len(h) - n + 1])


_GRAM, _W0, _W1 = _Roll(11), _Roll(12), _Roll(13)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of x[i:i + n] for every i: running minima forwards and backwards in blocks of n."""
    size = len(x) - n + 1
    if size <= 0:
        return x[:0]
    pad = np.full(-len(x) % n, np.iinfo(x.dtype).max, x.dtype)
    b = np.concatenate((x, pad)).reshape(-1, n)
    fore = np.minimum.accumulate(b, axis=1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:size], fore[n - 1 : n - 1 + size])


def stretches(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows' windows, stretches that share a minimiser: row, first window within the row, how many, minimiser."""
    low = sliding_min(_GRAM(w.hashes(), GRAM), WINDOW - GRAM + 1)
    counts = np.maximum(np.diff(w.first) - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)))
    within = np.arange(len(row)) - begin[:-1][row]
    mini = low[w.first[:-1][row] + within]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (mini[1:] != mini[:-1])
    first = np.flatnonzero(new)
    since = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    first = np.flatnonzero(since % LONGEST == 0)
    return row[first], within[first], np.diff(np.append(first, len(row))), mini[first].view(np.int64)


def window_hashes(packed: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Some strings at a time: the first one's index, two hashes of every window, and bounds by string."""
    for w in blocks(packed):
        h = w.hashes()
        counts = np.maximum(np.diff(w.first) - WINDOW + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        begin = np.concatenate(([0], np.cumsum(counts)))
        at = w.first[:-1][row] + np.arange(len(row)) - begin[:-1][row]
        yield w.row, _W0(h, WINDOW)[at], _W1(h, WINDOW)[at], begin


def first_documents(w0: np.ndarray, w1: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each window, the least of `low` over all equal windows, by sorting."""
    order = np.lexsort((low, w1, w0))
    a, b = w0[order], w1[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty_like(low)
    out[order] = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _minimisers(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy()
            for w in blocks(b.column(1)):
                row, _, _, mini = stretches(w)
                order = np.lexsort((mini, row))
                row, mini = row[order], mini[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (mini[1:] != mini[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(mini[new]), pa.array(k[w.row + row[new]])], names=["mini", "k"])

    return docs.select("k", "t").mapInArrow(run, "mini long, k long")


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _packed(docs: DataFrame, shared) -> DataFrame:
    """mini, p (16 bytes naming the string), k, d (the text's hash), start, n (windows), packed."""

    def places(mini: np.ndarray) -> np.ndarray:
        return (mini.view(np.uint64) & np.uint64((1 << 26) - 1)).astype(np.int64) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.binary())
            for w in blocks(b.column(1)):
                row, start, n, mini = stretches(w)
                on = named(shared.value, places(mini))
                out: list[list] = [[], [], [], [], [], [], []]
                last, words, d = -1, [], 0
                for r, s, c, m in zip(row[on].tolist(), start[on].tolist(), n[on].tolist(), mini[on].tolist(), strict=True):
                    if r != last:
                        raw = texts[w.row + r].as_py() or b""
                        last, words, d = r, raw.split(), _digest(raw)
                    text = b" ".join(words[s : s + c + WINDOW - 1])
                    for column, value in zip(out, (m, hashlib.blake2b(text, digest_size=16).digest(), k[w.row + r], d, s, c, text), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["mini", "p", "k", "d", "start", "n", "packed"])

    return docs.select("k", "t").mapInArrow(run, "mini long, p binary, k long, d long, start long, n int, packed binary")


def _in_buckets(strings: DataFrame) -> DataFrame:
    """p, firsts (the first document of each window), for strings sorted by bucket within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            names, firsts = [p for _, p, _, _ in held], []
            low = np.array([x for _, _, x, _ in held], np.int64)
            parts = list(window_hashes(pa.array([t for _, _, _, t in held], pa.binary()).cast(pa.large_binary()).cast(pa.large_string())))
            w0, w1 = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            counts = np.concatenate([np.diff(p[3]) for p in parts])
            found = first_documents(w0, w1, np.repeat(low, counts))
            bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            firsts = pa.ListArray.from_arrays(pa.array(bounds), pa.array(found))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), firsts], names=["p", "firsts"])

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > 1 << 20 and x[0] != held[-1][0]:
                    yield flush()
                    size = 0
                held.append(x)
                size += len(x[3])
        if held:
            yield flush()

    return strings.select("mini", "p", "low", "packed").mapInArrow(run, "p binary, firsts array<long>")


def _in_lanes(strings: DataFrame) -> DataFrame:
    """p, firsts of the strings of crowded buckets. A string sends each of its bucket's lanes its windows there, packed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lanes = b.column(3).to_numpy()
            for at, w0, w1, begin in window_hashes(b.column(4).cast(pa.large_binary()).cast(pa.large_string())):
                row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
                lane = (w0 % lanes[at + row].astype(np.uint64)).astype(np.int64)
                order = np.lexsort((lane, row))
                row, lane = row[order], lane[order]
                edge = np.ones(len(row), bool)
                edge[1:] = (row[1:] != row[:-1]) | (lane[1:] != lane[:-1])
                first = np.flatnonzero(edge)
                cut = list(zip(first.tolist(), [*first[1:].tolist(), len(row)], strict=True))
                i = (order - begin[:-1][row]).astype("<u2")
                packed = [pa.array([x[a:z].tobytes() for a, z in cut], pa.binary()) for x in (i, w0[order], w1[order])]
                which = pa.array(at + row[first])
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array(lane[first]), b.column(1).take(which), b.column(2).take(which), *packed], names=["mini", "lane", "p", "low", "i", "w0", "w1"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w0, w1 = (np.frombuffer(b"".join(x[c] for x in held), np.uint64) for c in (5, 6))
            sizes = np.array([len(x[5]) // 8 for x in held], np.int64)
            found = first_documents(w0, w1, np.repeat(np.array([x[3] for x in held], np.int64), sizes)).tobytes()
            ends = np.cumsum(8 * sizes).tolist()
            out = pa.RecordBatch.from_arrays([pa.array([x[2] for x in held], pa.binary()), pa.array([x[4] for x in held], pa.binary()), pa.array([found[a:z] for a, z in zip([0, *ends], ends, strict=False)], pa.binary())], names=["p", "i", "f"])
            held.clear()
            return out

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > 1 << 22 and x[:2] != held[-1][:2]:
                    yield flush()
                    size = 0
                held.append(x)
                size += len(x[5])
        if held:
            yield flush()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                i = np.frombuffer(b"".join(x["i"] for x in parts), "<u2")
                f = np.frombuffer(b"".join(x["f"] for x in parts), np.int64)
                own = np.empty(len(i), np.int64)
                own[i] = f
                out.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["p", "firsts"])

    dealt = strings.select("mini", "p", "low", "lanes", "packed").mapInArrow(deal, "mini long, lane long, p binary, low long, i binary, w0 binary, w1 binary")
    sorted_ = dealt.repartition("mini", "lane").sortWithinPartitions("mini", "lane").mapInArrow(work, "p binary, i binary, f binary")
    return sorted_.groupBy("p").agg(F.collect_list(F.struct("i", "f")).alias("parts")).mapInArrow(whole, "p binary, firsts array<long>")


def _cuts(found: DataFrame) -> DataFrame:
    """k, d, a, b: words to remove, from windows whose first document is smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, d, start = (b.column(i).to_numpy() for i in range(3))
            firsts = b.column(3)
            bounds = firsts.offsets.to_numpy()
            values = firsts.values.to_numpy()[bounds[0] : bounds[-1]]
            counts = np.diff(bounds)
            row = np.repeat(np.arange(len(counts)), counts)
            hit = values < k[row]
            begin = bounds[:-1] - bounds[0]
            edge = np.ones(len(row), bool)
            edge[1:] = (row[1:] != row[:-1]) | (hit[1:] != hit[:-1])
            at = np.flatnonzero(edge)
            to = np.append(at[1:], len(row))
            at, to = at[hit[at]], to[hit[at]]
            r = row[at]
            a = start[r] + at - begin[r]
            yield pa.RecordBatch.from_arrays([pa.array(k[r]), pa.array(d[r]), pa.array(a), pa.array(a + (to - at) + WINDOW - 1)], names=["k", "d", "a", "b"])

    return found.select("k", "d", "start", "firsts").mapInArrow(run, "k long, d long, a long, b long")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, d (the text's hash), cuts: array of [a, b) word positions to remove, for documents that lose words."""
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    seen = _minimisers(docs).groupBy("mini").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select(F.col("mini").bitwiseAND(F.lit((1 << 26) - 1)).alias("p"))
    rows = stash(_packed(docs, bitmap(seen, "p", own=True)), "packed")
    strings = rows.groupBy("p").agg(F.min("k").alias("low"), F.first("mini").alias("mini"), F.first("n").alias("n"), F.first("packed").alias("packed"))
    strings = stash(strings, "strings")
    crowded = stash(strings.groupBy("mini").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).select("mini", F.ceil(F.col("c") / CROWD).cast("long").alias("lanes")), "crowded")
    small = strings.join(crowded, "mini", "left_anti").repartition("mini").sortWithinPartitions("mini")
    firsts = _in_buckets(small).union(_in_lanes(strings.join(crowded, "mini")))
    cuts = _cuts(rows.select("p", "k", "d", "start").join(firsts, "p"))
    return cuts.groupBy("k", "d").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cuts"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept (that text, where words were removed)."""
    prepare(df.sparkSession)
    cuts = stash(repeats(df, key, text), "cuts")
    shared = bitmap(cuts.select("k").distinct(), "k")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            touched = named(shared.value, b.column(2).to_numpy()) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            n, sha, texts, ds = [], [], [], []
            for raw, hit in zip(b.column(1).cast(pa.binary()).to_pylist(), touched.tolist(), strict=True):
                raw = raw or b""
                words = raw.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                texts.append(raw if hit else None)
                ds.append(_digest(raw) if hit else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ds, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(texts, pa.binary())], names=["k", "d", "n", "sha", "raw"])

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, shas, kept = [], [], []
            for raw, cut, sha in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not cut:
                    gone.append(0)
                    shas.append(sha)
                    kept.append(None)
                    continue
                words = raw.split()
                keep = np.ones(len(words), bool)
                for c in cut:
                    keep[c["a"] : c["b"]] = False
                text = b" ".join([x for x, on in zip(words, keep.tolist(), strict=True) if on])
                gone.append(int((~keep).sum()))
                shas.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "n_removed", "kept_sha256", "kept"])

    docs = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), place(F.coalesce(F.col(key).cast("long"), F.lit(0))).alias("p"))
    rows = docs.mapInArrow(whole, "k long, d long, n long, sha string, raw binary")
    both = rows.join(cuts, ["k", "d"], "left").select("k", "n", "sha", "raw", "cuts")
    return both.mapInArrow(trim, f"`{key}` long, n_words long, n_removed long, kept_sha256 string, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
