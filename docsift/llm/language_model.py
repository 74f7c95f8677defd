"""Scoring by a hierarchical Pitman-Yor model of two levels.

A token's context is the token before it, or the start of the text. Every context seen in training has a restaurant of
its own, whatever their number; they are children of one parent restaurant, whose base gives each of the V + 1
types (one stands for all unknown words) the same chance. A customer of a restaurant is a training token, a table it
opens is a customer of the parent. Seatings are sampled by Gibbs sweeps: all customers of one dish in one restaurant
leave and are seated again one after another given everyone else, a new table being chosen with the weight
(strength + discount * tables) * parent's probability against (customers - discount * tables); long runs of
customers are seated some at a time. The score averages the predictive probabilities of the sweeps after the burn-in.

Distribution. Texts become streams of numbers of (context, word) pairs within blocks of some MB; a block sends its
distinct pairs, as packed arrays, to buckets by hash of the word, so all customers of a dish in all restaurants, and
the parent's tables of the dish, are in one bucket, whatever the word's share of the corpus (a bucket holds a word's
pairs, not its tokens). After every sweep each bucket sends its tables by restaurant, as packed arrays, to the owners
of the restaurants by hash of the context, which add them up and send each bucket the sums of the restaurants it has
pairs of; the driver gets two sums a sweep. Draws are hashes of the sweep, word and context, so they are the same for
every number of buckets. Buckets return each block's probabilities as arrays. What is gathered grows with the distinct
pairs.

Defined cases: a null text is empty and has one token, the end; ids that are null are never in the training part and
are held out if the remainder of crc32('') says so (it doesn't); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.text import blocks, mix
from docsift.session import drop_path, new_path, partitions, prepare, stash, tidy, unstash

BURN, SAMPLES = 3, 4
DISCOUNT, STRENGTH = (0.75, 0.85), (50.0, 5.0)  # of the parent and of the children
RUN = 1 << 18  # pairs seated at a time
MEAN = 16  # most tables that a batch of customers is expected to open, or not to
SEED = 1000
BLOCK = 5 << 20  # words a block holds at least, unless there are no more
MOST, LEAST = 48 << 20, 4 << 20  # bytes of text a bucket serves at most; and at least where there are more buckets, for more tasks
END = 0x9AE16A3B2F90404F  # the end's hash, and that of the start as a context; words have others


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


STREAM = "block long, part int, k array<long>, train array<boolean>, sizes array<long>, stream binary, words binary, per binary, names binary, contexts binary, counts binary"


def _blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Two kinds of rows. part = -1: a block's documents and their streams of pair numbers.
    part >= 0: the block's pairs whose word falls in that bucket, in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            sizes, train = np.concatenate([x[3] for x in held]), np.concatenate([x[1] for x in held])
            keys = pa.concat_arrays([x[0] for x in held])
            words = [x[2] for x in held]
            held.clear()
            kinds, word = np.unique(_joined(words), return_inverse=True)
            bucket = (kinds % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            at = place[word]
            del word
            many = len(kinds)
            pair = at * np.int64(many)
            pair[1:] += at[:-1]
            pair[0] += at[-1]  # a text's first word comes after an end
            del at
            pair, number = np.unique(pair, return_inverse=True)
            counts = np.bincount(number, weights=np.repeat(train, sizes), minlength=len(pair)).astype(np.int64)
            w = kinds[order]
            per = np.bincount(pair // many, minlength=many)  # pairs of each word
            c = pair % many
            block = (task << 24) + seq
            seq += 1
            rows = [(block, -1, keys.to_pylist(), train.tolist(), sizes.tolist(), narrow(number), None, None, None, None, None)]
            cut = np.searchsorted(bucket[order], np.arange(parts + 1))
            at = np.searchsorted(pair // many, cut).tolist()
            cut = cut.tolist()
            for p in range(parts):
                if cut[p + 1] > cut[p]:
                    words_of, pairs_of = slice(cut[p], cut[p + 1]), slice(at[p], at[p + 1])
                    names, own = np.unique(c[pairs_of], return_inverse=True)
                    up = np.argsort(w[names])
                    rank = np.empty_like(up)
                    rank[up] = np.arange(len(up))
                    rows.append((block, p, None, None, None, None, hashes(w[words_of]), narrow(per[words_of]), hashes(w[names[up]]), narrow(rank[own], True), narrow(counts[pairs_of])))
            yield _batch(rows, STREAM_TYPES)

        for b in batches:
            for w in blocks(b.column(2), lower=True):
                h = w.hashes()
                n = np.diff(w.first)
                sizes = n + 1
                ends = np.cumsum(sizes) - 1
                words = np.empty(len(h) + len(n), np.uint64)
                inner = np.ones(len(words), bool)
                inner[ends] = False
                words[inner], words[ends] = h, END
                train = b.column(1).slice(w.row, len(w)).to_numpy(zero_copy_only=False)
                held.append((b.column(0).slice(w.row, len(w)), train, words, sizes))
                size += len(words)
                if size >= BLOCK:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.select("k", "train", "t").mapInArrow(run, STREAM)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Concatenated; the parts are let go."""
    out = np.concatenate(parts)
    parts.clear()
    return out


STREAM_TYPES = [("block", pa.int64()), ("part", pa.int32()), ("k", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("stream", pa.binary()), ("words", pa.binary()), ("per", pa.binary()), ("names", pa.binary()), ("contexts", pa.binary()), ("counts", pa.binary())]


def _batch(rows: list[tuple], types: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def narrow(x: np.ndarray, steps: bool = False) -> bytes:
    """Natural numbers in as few bytes each as the largest needs, compressed byte by byte of all; by their differences, if they mostly ascend."""
    top = int(x.max()) if len(x) else 0
    kind = next(f"<u{n}" for n in (1, 2, 4, 8) if top < 1 << 8 * n)
    x = x.astype(kind)
    if steps:
        x = np.diff(x, prepend=np.zeros(1, kind))  # modulo the type's range
    return _PACK(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")


def wide(raw: bytes, count: int, steps: bool = False) -> np.ndarray:
    """`count` natural numbers of any width."""
    return _as_packed(raw, count, steps).astype(np.int64)


def _as_packed(raw: bytes, count: int, steps: bool = False) -> np.ndarray:
    """The same in the type they were packed in."""
    if not count:
        return np.zeros(0, np.uint8)
    planes = np.frombuffer(_UNPACK(raw), np.uint8).reshape(-1, count)
    x = np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel()
    return np.cumsum(x, dtype=x.dtype) if steps else x


def hashes(x: np.ndarray) -> bytes:
    """Ascending hashes."""
    return _PACK(np.ascontiguousarray(np.diff(x, prepend=np.zeros(1, np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unhash(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPACK(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def gaps(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return narrow(np.diff(x, prepend=0))


def _customers(rows: DataFrame) -> DataFrame:
    """Two kinds of rows. block = -1: a bucket, its words, the contexts of its pairs, and its pairs with training customers, by word: how many, context's place, customers.
    Others: what a block asks of the bucket, its words (place and whether there is one) and contexts as places in the bucket's."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, words, contexts = [], [], []
        for b in batches:
            for block, x, m, f, y, z in zip(*(b.column(b.schema.get_field_index(f)).to_pylist() for f in ("block", "words", "per", "names", "contexts", "counts")), strict=True):
                asked.append((block, x, m, f, y, z))
                words.append(unhash(x))
                contexts.append(unhash(f))
        names, kinds = np.unique(_joined(contexts)), np.unique(_joined(words))
        pairs, count, known = [], [], np.zeros(len(kinds), bool)
        for _, x, m, f, y, z in asked:
            place = np.searchsorted(kinds, unhash(x))
            at = np.repeat(place, wide(m, len(place)))
            n = wide(z, len(at))
            on = np.flatnonzero(n)
            of = np.searchsorted(names, unhash(f))[wide(y, len(at), True)[on]]
            pairs.append(at[on] * len(names) + of)
            count.append(n[on].astype("<u4"))
            known[at[on]] = True
        pair, count = _joined(pairs), _joined(count)
        order = np.argsort(pair)
        count = count[order]
        pair = pair[order]
        del order
        new = np.flatnonzero(np.concatenate((pair[:1] >= 0, pair[1:] != pair[:-1])))
        pair, total = pair[new], np.add.reduceat(count, new, dtype=np.int64) if len(new) else count
        # Words that training doesn't have get no place.
        renamed = np.cumsum(known) - 1
        per, own = np.bincount(pair // max(len(names), 1), minlength=len(kinds))[known], kinds[known]
        yield _batch([(key[0].as_py(), hashes(own), hashes(names), narrow(per), narrow(pair % max(len(names), 1), True), narrow(total), int(total.sum()), len(own), len(pair), -1, None, None, None, None, None, None)], BUCKET_TYPES)
        del pair, count, total
        asked.reverse()
        while asked:
            block, x, m, f, y, _ = asked.pop()
            place = np.searchsorted(kinds, unhash(x))
            of = np.searchsorted(names, unhash(f))
            yield _batch([(key[0].as_py(), None, None, None, None, None, 0, 0, 0, block, gaps(renamed[place].clip(0)), known[place].tobytes(), m, gaps(of), len(of), y)], BUCKET_TYPES)

    return rows.groupBy("part").applyInArrow(run, BUCKET)


BUCKET_TYPES = [("part", pa.int32()), ("kinds", pa.binary()), ("names", pa.binary()), ("per", pa.binary()), ("context", pa.binary()), ("customers", pa.binary()), ("n_customers", pa.int64()), ("n_kinds", pa.int64()), ("n_pairs", pa.int64()), ("block", pa.int64()), ("at", pa.binary()), ("known", pa.binary()), ("asked", pa.binary()), ("of", pa.binary()), ("n_of", pa.int64()), ("contexts", pa.binary())]
BUCKET = "part int, kinds binary, names binary, per binary, context binary, customers binary, n_customers long, n_kinds long, n_pairs long, block long, at binary, known binary, asked binary, of binary, n_of long, contexts binary"


def _unpacked(row: dict) -> dict:
    """A bucket's words and contexts, and the word, the context and the customers of each pair."""
    kinds = unhash(row["kinds"])
    word = np.repeat(np.arange(len(kinds), dtype=np.int32), wide(row["per"], len(kinds)))
    return {"kinds": kinds, "names": unhash(row["names"]), "word": word, "context": wide(row["context"], len(word), True).astype(np.int32), "customers": wide(row["customers"], len(word))}


def uniform(keys: np.ndarray, *at: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the key and on the place in the sampling only."""
    for i in at:
        keys = mix(keys + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return (keys >> np.uint64(11)) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Inverse of the distribution function at u, for n * min(p, 1 - p) of no more than some dozens."""
    q = np.minimum(p, 1 - p)
    found = np.zeros(len(n), np.int64)
    odds, chance = q / (1 - q), (1 - q) ** n
    at = np.flatnonzero((u >= chance) & (n > 0))
    left, chance, odds = u[at] - chance[at], chance[at], odds[at]
    k = 0
    while len(at):
        k += 1
        found[at] = k
        chance = chance * ((n[at] - k + 1) / k * odds)
        on = (left >= chance) & (k < n[at]) & ((chance > 1e-18) | (k < n[at] * q[at]))
        at, left, chance, odds = at[on], left[on] - chance[on], chance[on], odds[on]
    return np.where(p > 0.5, n - found, found)


def seat(customers: np.ndarray, start: np.ndarray, gain: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables after seating each pair's customers anew. A new table weighs start + gain * tables (of the pair, so far)."""
    tables = np.ones(len(customers), np.int64)
    at = np.flatnonzero(customers > 1)
    seated = np.ones(len(at), np.int64)
    turn = 0
    while len(at):
        new = start[at] + gain[at] * tables[at]
        p = new / (new + seated - discount * tables[at])
        most = np.maximum(MEAN / np.maximum(np.minimum(p, 1 - p), 1e-12), 1).astype(np.int64)
        step = np.minimum(np.minimum(np.maximum(1, seated // 16), customers[at] - seated), most)
        u = uniform(keys[at], turn)
        opened = (u < p).astype(np.int64)
        more = np.flatnonzero(step > 1)
        if len(more):
            opened[more] = binomial(step[more], p[more], u[more])
        tables[at] += opened
        seated += step
        on = seated < customers[at]
        at, seated = at[on], seated[on]
        turn += 1
    return tables


class Restaurants:
    """The part of all restaurants that serves one bucket's words, and its sweeps.

    totals and tables are the customers and tables of each restaurant over all buckets; each pair starts with one table.
    """

    def __init__(self, row: dict, totals: np.ndarray, tables: np.ndarray, types: int, seed: int):
        self.kinds, self.names, self.word, self.context, self.customers = (row[x] for x in ("kinds", "names", "word", "context", "customers"))
        self.totals, self.all_tables, self.types, self.seed = totals, tables, types, seed
        self.tables = np.ones(len(self.word), np.int64)
        self.base = 1.0 / (types + 1)

    def below(self) -> np.ndarray:
        """The parent's customers by word."""
        return np.bincount(self.word, weights=self.tables, minlength=len(self.kinds)).astype(np.int64)

    def own(self) -> np.ndarray:
        """This bucket's tables by restaurant."""
        return np.bincount(self.context, weights=self.tables, minlength=len(self.names)).astype(np.int64)

    def sweep(self, turn: int, upper_customers: float, upper_tables: float) -> tuple[np.ndarray, np.ndarray]:
        """Seat everyone anew; tables by pair, and the parent's tables by word. all_tables are those of the sweep before."""
        d0, d1 = DISCOUNT
        s0, s1 = STRENGTH
        from_below = self.below()
        by_word = mix(self.kinds + np.uint64(self.seed))
        upper = seat(from_below, np.full(len(from_below), (s0 + d0 * upper_tables) * self.base), np.full(len(from_below), d0 * self.base), d0, by_word + np.uint64(2 * turn))
        parent = (from_below - d0 * upper + (s0 + d0 * upper_tables) * self.base) / (s0 + upper_customers)
        by_name, tables = mix(self.names), np.empty(len(self.word), np.int64)
        for at in range(0, len(self.word), RUN):  # some pairs at a time; they don't depend on each other
            own = slice(at, at + RUN)
            word, context = self.word[own], self.context[own]
            p = parent[word]
            others = np.maximum(self.all_tables[context] - self.tables[own], 0)
            keys = mix(by_word[word] ^ by_name[context]) + np.uint64(2 * turn + 1)
            tables[own] = seat(self.customers[own], (s1 + d1 * others) * p, d1 * p, d1, keys)
        self.tables = tables
        return self.tables, np.minimum(upper, self.below())

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All sweeps where this bucket is the only one. After the burn-in: tables by pair, customers and tables of the parent by word."""
        upper_tables = float(self.types)
        for i in range(BURN + SAMPLES):
            tables, upper = self.sweep(i, float(self.tables.sum()), upper_tables)
            self.all_tables = self.own()
            upper_tables = float(upper.sum())
            if i >= BURN:
                yield tables, self.below(), upper


#: To a bucket from itself (source -1): tables by pair and the parent's tables by word, in v and u, and their sums.
#: To a context's owner: names and this source's tables of them. From the owner: the sums, in the order of the source's names.
MAIL = "part int, source int, names binary, v binary, u binary, below long, upper long"
MAIL_TYPES = [("part", pa.int32()), ("source", pa.int32()), ("names", pa.binary()), ("v", pa.binary()), ("u", pa.binary()), ("below", pa.int64()), ("upper", pa.int64())]


def _send(part: int, names: np.ndarray, v: np.ndarray, parts: int) -> list[tuple]:
    """v's columns by name, to the owners of the names."""
    owner = (names % np.uint64(parts)).astype(np.int64)
    return [(q, part, hashes(names[at]), narrow(v[at].ravel()), None, None, None) for q in np.unique(owner).tolist() for at in [owner == q]]


def _add_up(mail: DataFrame, columns: int) -> DataFrame:
    """What owners of contexts answer to each source."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, names, v = [], [], []
        for b in batches:
            source += b.column(b.schema.get_field_index("source")).to_pylist()
            for x, y in zip(*(b.column(b.schema.get_field_index(f)).to_pylist() for f in ("names", "v")), strict=True):
                names.append(unhash(x))
                v.append(wide(y, len(names[-1]) * columns).reshape(-1, columns))
        kinds, at = np.unique(np.concatenate(names), return_inverse=True)
        v = np.concatenate(v)
        total = np.stack([np.bincount(at, weights=v[:, i], minlength=len(kinds)).astype(np.int64) for i in range(columns)], 1)
        ends = np.cumsum([len(x) for x in names]).tolist()
        for s, a, z in zip(source, [0, *ends[:-1]], ends, strict=True):
            yield _batch([(s, key[0].as_py(), None, narrow(total[at[a:z]].ravel()), None, None, None)], MAIL_TYPES)

    return mail.where("source >= 0").groupBy("part").applyInArrow(run, MAIL)


def _received(names: np.ndarray, mail: list[dict], parts: int, columns: int) -> np.ndarray:
    """The sums of each of the names."""
    out = np.zeros((len(names), columns), np.int64)
    owner = (names % np.uint64(parts)).astype(np.int64)
    for m in mail:
        if m["source"] >= 0:
            at = np.flatnonzero(owner == m["source"])
            out[at] = wide(m["v"], len(at) * columns).reshape(-1, columns)
    return out


def _first(buckets: DataFrame, parts: int) -> DataFrame:
    """Customers and tables of each restaurant, one table a pair: the sums, to every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                r = Restaurants(_unpacked(row), None, None, 0, 0)
                customers = np.bincount(r.context, weights=r.customers, minlength=len(r.names)).astype(np.int64)
                yield _batch(_send(row["part"], r.names, np.stack((customers, r.own()), 1), parts), MAIL_TYPES)

    return _add_up(buckets.mapInArrow(run, MAIL), 2)


def _sweep(buckets: DataFrame, begin: DataFrame, inbox: DataFrame | None, turn: int, parts: int, types: int, below: int, upper: int) -> DataFrame:
    """One sweep of all buckets: their mail to themselves and to the owners of contexts."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row, mail = left.to_pylist()[0], right.to_pylist()
        r = _unpacked(row)
        names = r["names"]
        start = _received(names, [m for m in mail if m["start"]], parts, 2)
        r = Restaurants(r, start[:, 0], start[:, 1], types, SEED)
        later = [m for m in mail if not m["start"]]
        if later:
            r.all_tables = _received(names, later, parts, 1)[:, 0]
            r.tables = wide(next(m["v"] for m in later if m["source"] < 0), len(r.word))
        tables, top = r.sweep(turn, float(below), float(upper))
        own = (row["part"], -1, None, narrow(tables), narrow(top), int(tables.sum()), int(top.sum()))
        return pa.Table.from_batches([_batch([own, *_send(row["part"], names, r.own()[:, None], parts)], MAIL_TYPES)])

    mail = begin.withColumn("start", F.lit(True)) if inbox is None else inbox.withColumn("start", F.lit(False))
    return buckets.groupBy("part").cogroup(mail.groupBy("part")).applyInArrow(run, MAIL)


def _predict(rows: DataFrame, buckets: DataFrame, begin: DataFrame, kept: list[tuple[DataFrame, int, int]], parts: int, types: int) -> DataFrame:
    """block, part, p (log10 of the averaged probability of each pair, in order), and of its words how many pairs they have (m) and their training counts (c)."""
    d0, d1 = DISCOUNT
    s0, s1 = STRENGTH
    sums = [(below, upper) for _, below, upper in kept]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.to_pylist()
        row = next(m for m in found if m["sample"] is None)
        r = _unpacked(row)
        names = r["names"]
        totals = _received(names, [m for m in found if m["sample"] == -1], parts, 2)[:, 0]
        r = Restaurants(r, totals, None, types, SEED)
        kinds, pair = r.kinds, r.word * np.int64(len(names)) + r.context
        count = np.bincount(r.word, weights=r.customers, minlength=len(kinds))
        own, backs, parents = np.zeros(len(pair)), [], []
        for i, (all_below, all_upper) in enumerate(sums):
            mail = [m for m in found if m["sample"] == i]
            state = next(m for m in mail if m["source"] < 0)
            r.tables, upper, all_tables = wide(state["v"], len(r.word)), wide(state["u"], len(kinds)), _received(names, mail, parts, 1)[:, 0]
            parent = (r.below() - d0 * upper + (s0 + d0 * all_upper) * r.base) / (s0 + all_below)
            parents.append(np.append(parent, (s0 + d0 * all_upper) * r.base / (s0 + all_below)))  # the last is that of unknown words
            backs.append((s1 + d1 * all_tables) / (s1 + totals))
            own += (r.customers - d1 * r.tables) / (s1 + totals[r.context])
        del found, r
        out = []
        for block, at, known, m, of, size, c in zip(*(left.column(x) for x in ("block", "at", "known", "asked", "of", "n_of", "contexts")), strict=True):
            known = np.frombuffer(known.as_buffer(), bool)
            at = np.where(known, np.cumsum(wide(at.as_py(), len(known))), len(kinds))
            m = wide(m.as_py(), len(known))
            w = np.repeat(at, m)
            c = np.cumsum(wide(of.as_py(), size.as_py()))[wide(c.as_py(), len(w), True)]
            p = sum(back[c] * parent[w] for back, parent in zip(backs, parents, strict=True))
            wanted = w * len(names) + c
            place = np.searchsorted(pair, wanted)
            place[place == len(pair)] = 0
            met = np.flatnonzero(pair[place] == wanted) if len(pair) else place[:0]
            p[met] += own[place[met]]
            out.append((block.as_py(), row["part"], np.log10(p / SAMPLES).astype("<f4").tobytes(), narrow(m), len(m), narrow(np.where(known, np.append(count, 0)[at], 0).astype(np.int64))))
        return pa.Table.from_batches([_batch(out, [("block", pa.int64()), ("part", pa.int32()), ("p", pa.binary()), ("m", pa.binary()), ("words", pa.int64()), ("c", pa.binary())])])

    state = buckets.withColumn("sample", F.lit(None).cast("int"))
    for i, mail in enumerate([begin, *(x for x, _, _ in kept)], -1):
        state = state.unionByName(mail.select("part", "source", "v", "u", F.lit(i).alias("sample")), allowMissingColumns=True)
    return rows.select("part", "block", "at", "known", "asked", "of", "n_of", "contexts").groupBy("part").cogroup(state.groupBy("part")).applyInArrow(run, "block long, part int, p binary, m binary, words long, c binary")


def score(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(key).cast("long").alias("k"), (F.col(key).isNotNull() & ~held_out(F.col(key))).alias("train"), F.col(text).alias("t"))
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // MOST), min(partitions(spark) // 3, -(-size // LEAST)))
    path = new_path(spark, "blocks")  # the streams and the pairs in folders of their own, since the pairs go first
    _blocks(docs, parts).withColumn("kind", F.when(F.col("part") < 0, "streams").otherwise("pairs")).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    table = spark.read.schema(STREAM + ", kind string").parquet(path)
    streams = table.where("kind = 'streams'").select("block", "k", "train", "sizes", "stream")
    pairs = table.where("kind = 'pairs'").select("part", "block", "words", "per", "names", "contexts", "counts")
    rows = stash(_customers(pairs), "buckets")
    drop_path(spark, f"{path}/kind=pairs")
    tidy(spark)
    buckets, asked = rows.where("block = -1").select("part", "kinds", "names", "per", "context", "customers", "n_customers", "n_kinds", "n_pairs"), rows.where("block >= 0")
    begin = stash(_first(buckets, parts), "totals")
    tidy(spark)
    sums = buckets.agg(F.sum("n_customers"), F.sum("n_kinds"), F.sum("n_pairs")).first()
    total, kinds, below = (int(x or 0) for x in sums)
    upper, inbox, kept = kinds, None, []
    for turn in range(BURN + SAMPLES):
        mail = stash(_sweep(buckets, begin, inbox, turn, parts, kinds, below, upper), "sweep")
        below, upper = (int(x or 0) for x in mail.where("source < 0").agg(F.sum("below"), F.sum("upper")).first())
        used = inbox if turn <= BURN else None
        inbox = stash(mail.where("source < 0").union(_add_up(mail, 1)), "inbox")
        unstash(mail)
        tidy(spark)
        if used is not None:
            unstash(used)
        if turn >= BURN:
            kept.append((inbox, below, upper))
    del mail, used
    tidy(spark)
    answers = stash(_predict(asked, buckets, begin, kept, parts, kinds), "answers")
    for used in (rows, begin, *(x for x, _, _ in kept)):
        unstash(used)
    del used, rows, asked, buckets, kept, inbox
    tidy(spark)
    name = key
    schema = f"`{name}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = sorted(zip(*(right.column(x).to_pylist() for x in ("part", "p", "words", "m", "c")), strict=True))
        p = np.frombuffer(b"".join(x[1] for x in found), "<f4")
        c = np.concatenate([wide(c, n) for _, _, n, _, c in found])  # by word
        word = np.repeat(np.arange(len(c), dtype=np.int32), np.concatenate([wide(m, n) for _, _, n, m, _ in found]))
        del found
        base, seen = np.log10((c + 1) / (total + 1.0 * (kinds + 1))), (c > 0).astype(np.int64)
        rows = []
        for ks, train, sizes, stream in zip(*(left.column(x) for x in ("k", "train", "sizes", "stream")), strict=True):
            ks, train, sizes = ks.as_py(), train.as_py(), np.array(sizes.as_py(), np.int64)
            ends = np.cumsum(sizes)
            at = _as_packed(stream.as_buffer(), int(ends[-1]))
            sums, i = [], 0
            while i < len(sizes):  # some documents at a time
                start = ends[i] - sizes[i]
                j = max(i + 1, int(np.searchsorted(ends, start + RUN, "right")))
                pairs = at[start : ends[j - 1]]
                words = word[pairs]
                sums.append([np.add.reduceat(x, ends[i:j] - sizes[i:j] - start) for x in (seen[words], base[words], p[pairs].astype(float))])
                i = j
            known, low, high = (np.concatenate(x).tolist() for x in zip(*sums, strict=True))
            rows += zip(ks, [k is not None and not t for k, t in zip(ks, train, strict=True)], sizes.tolist(), known, [total] * len(ks), low, high, strict=True)
        types = [(name, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        return pa.Table.from_batches([_batch(rows, types)])

    return streams.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """Per part (held out or not): perplexity of the model and of the base, by token."""
    def of(c: str) -> Column:
        return F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
