"""Token ids in files: frequency-ranked ids, byte-aligned variable-length coding, separate control bytes.

The file format. A folder holds two tables. `ranks`: id by rank, the most frequent id having rank 0 (ties by id).
`blocks`: one record for a run of documents in ascending id, named by (shard, seq): their ids, their numbers of
tokens, `start` (tokens of the shard before it), `control` and `data`. Every rank is written in 1 to 4 bytes, little
end first; a control byte holds four lengths, two bits each, low bits first, each document beginning a new one. Data
bytes hold nothing else, so a reader finds all offsets by one table lookup and one running sum.

The tables are written and read by Spark, so that the folder may be in any store and lost tasks are written again.

Defined cases: a null text gives just the end id; null ids come last; rows with equal ids in a fixed order of their
codes; an empty table gives files without records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.text import Words, blocks, hasher
from docsift.session import new_path, partitions, prepare, stash

PIECES = 1_000_000  # entries of a worker's cache, which is emptied when it is full
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True

#: lengths of the four values that a control byte stands for
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document, whose unsigned values stand one after another."""
    v = values.astype("<u2") if not len(values) or values.max() < 1 << 16 else values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8)
    if v.itemsize > 2:
        code += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF)
    controls = -(-sizes // 4)
    ends, control_ends = np.cumsum(sizes), np.cumsum(controls)
    padded = np.zeros(4 * int(controls.sum()), np.uint8)
    padded[np.arange(len(v)) + np.repeat(4 * (control_ends - controls) - (ends - sizes), sizes)] = code
    control = (padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6).tobytes()
    data = v.view(np.uint8).reshape(-1, v.itemsize)[np.arange(v.itemsize, dtype=np.uint8) <= code[:, None]].tobytes()
    data_ends = np.concatenate(([0], np.cumsum(code, dtype=np.int64)))[ends] + ends
    return _cut(control, control_ends), _cut(data, data_ends)


def _cut(raw: bytes, ends: np.ndarray) -> list[bytes]:
    to = ends.tolist()
    return [raw[a:b] for a, b in zip([0, *to], to, strict=False)]


def unpack(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The values of all documents of these sizes, one after another."""
    controls = -(-sizes // 4)
    ends, control_ends = np.cumsum(sizes), np.cumsum(controls)
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    lengths = lengths[np.arange(int(ends[-1])) + np.repeat(4 * (control_ends - controls) - (ends - sizes), sizes)]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for b in range(1, int(lengths.max())):
        more = np.flatnonzero(lengths > b)
        out[more] |= raw[at[more] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


class WordEncoder:
    """Whole texts by the tokenizers library, pieces of words that came before from a cache.

    Tokens never reach over white space, so words may be encoded alone. A word of letters (Latin-1, which normalising
    leaves composed, and whose case it ignores) with end marks is two pieces, the letters and the marks; any other word
    is one. Pieces are found, told apart (by 64-bit hashes) and put together over whole arrays; new pieces of letters
    are encoded many at a time, and told apart by the tokens' word ends.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.ending = np.zeros(self.size, bool)
        self.ending[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the cache: a piece's place by hash, and at its place where its ids begin and how many there are."""
        self.place: dict[int, int] = {}
        self.begin, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 14, self.kind), 0

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, new: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        groups = [new[i : i + 500] for i in range(0, len(new), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                cuts = [0, *ends.tolist()]
                out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:
                out += self._alone(group)
        return out

    def _keep(self, keys: list[int], found: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, top = len(self.place), len(self.place) + len(keys)
        while len(self.begin) < top:
            self.begin, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.count))
        total = int(sizes.sum())
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.begin[first:top], self.count[first:top] = self.used + np.cumsum(sizes) - sizes, sizes
        if total:
            self.ids[self.used : self.used + total] = np.concatenate(found)
        self.used += total
        self.place.update(zip(keys, range(first, top), strict=True))

    def _pieces(self, w: Words) -> tuple[np.ndarray, ...]:
        """Of all pieces in order: hash, first and last byte, whether it is of letters; the text with small letters; bounds by row."""
        data, low = w.data, _SMALL[w.data]
        lead = data[:-1] == 0xC3
        wide = lead & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        low[1:][wide & (data[1:] <= 0x9E)] += 0x20
        letter = _LETTER[data]
        letter[1:] |= wide
        letter[:-1] |= wide
        others = np.concatenate(([0], np.cumsum(~letter, dtype=np.int32)))
        to, at = w.ends.copy(), np.arange(len(w.ends))
        while len(at):
            at = at[(to[at] > w.starts[at]) & _MARK[data[to[at] - 1]]]
            to[at] -= 1
        plain = (to > w.starts) & (others[to] == others[w.starts])
        to = np.where(plain, to, w.ends)
        marked = to < w.ends
        first = np.arange(len(to)) + np.cumsum(marked) - marked
        n = len(to) + int(marked.sum())
        key, begin, end, letters = np.empty(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
        begin[first], end[first], letters[first] = w.starts, to, plain
        begin[first[marked] + 1], end[first[marked] + 1] = to[marked], w.ends[marked]
        key[letters] = hasher(21)(low, begin[letters], end[letters])
        key[~letters] = hasher(22)(data, begin[~letters], end[~letters])
        return key, begin, end, letters, low, np.append(first, n)[w.first]

    def encode(self, column: pa.Array, end: bytes = b"") -> Iterator[list[bytes]]:
        """The ids of each text, and `end`; some MB of rows at a time."""
        for w in blocks(column, size=1 << 21):
            if len(self.place) > PIECES:
                self.forget()
            key, begin, to, letters, low, bounds = self._pieces(w)
            kinds, one, which = np.unique(key, return_index=True, return_inverse=True)
            names = kinds.tolist()
            slot = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
            new = np.flatnonzero(slot < 0)
            if len(new):
                a, z, plain = begin[one[new]].tolist(), to[one[new]].tolist(), letters[one[new]]
                small, raw = low.tobytes(), w.data.tobytes()
                for wanted, source, encode in ((np.flatnonzero(plain).tolist(), small, self._letters), (np.flatnonzero(~plain).tolist(), raw, self._alone)):
                    self._keep([names[new[i]] for i in wanted], encode([source[a[i] : z[i]].decode() for i in wanted]))
                slot[new] = [self.place[names[i]] for i in new.tolist()]
            slot = slot[which]
            n = self.count[slot]
            ends = np.cumsum(n)
            raw = self.ids[np.repeat(self.begin[slot] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
            cuts = (np.concatenate(([0], ends))[bounds] * self.ids.itemsize).tolist()
            yield [raw[x:y] + end for x, y in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(spec: str) -> WordEncoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, spec: str, end_id: int) -> DataFrame:
    """k, ids (binary, two or four bytes an id by the vocabulary's size), from k and t."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(shared.value)
        end = np.array(end_id, enc.kind).tobytes()
        for b in batches:
            rows = [x for part in enc.encode(b.column(1), end) for x in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["k", "ids"])

    return docs.select("k", "t").mapInArrow(run, "k long, ids binary")


def frequencies(encoded: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs over all documents; at most one number an id comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            seen = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            if len(seen) > len(total):
                total, seen = seen.astype(np.int64), total
            total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([0, *(r.id for r in rows)]) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_ids(df: DataFrame, spec: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", block: int = 1 << 18) -> None:
    """Encode every document, append end_id, and write the folder `path`. spec: the tokenizer's JSON, of bounded size."""
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    kind = word_encoder(spec).kind
    encoded = stash(encode_documents(docs, spec, end_id), "encoded")
    counts = frequencies(encoded, kind)
    by_rank = np.argsort(-counts, kind="stable")
    by_rank = by_rank[: max(1, int((counts > 0).sum()))]
    ranks = np.zeros(len(counts), np.uint32)
    ranks[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    n = partitions(spark)
    q = encoded.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 20_000).alias("q")).first().q
    bounds = np.array(sorted(set(q or [])) if n > 1 else [], np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = b.column(1).to_pylist()
            ids = np.frombuffer(b"".join(raws), kind)
            sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // ids.itemsize
            control, data = pack(ranks[ids], sizes)
            k = b.column(0)
            shard = np.searchsorted(bounds, k.fill_null(0).to_numpy(zero_copy_only=False), "left")
            shard[k.is_null().to_numpy(zero_copy_only=False)] = len(bounds)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), k, pa.array(sizes), pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=["shard", "k", "n", "control", "data"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"shard": None, "seq": 0, "start": 0}
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            size = sum(r[1] for r in rows)
            out = pa.RecordBatch.from_arrays(
                [pa.array([state["shard"]], pa.int32()), pa.array([state["seq"]], pa.int64()), pa.array([state["start"]], pa.int64()), pa.array([size], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([b"".join(r[2] for r in rows)], pa.binary()), pa.array([b"".join(r[3] for r in rows)], pa.binary())],
                names=["shard", "seq", "start", "n", "keys", "sizes", "control", "data"],
            )
            state["seq"] += 1
            state["start"] += size
            rows.clear()
            return out

        held = 0
        for b in batches:
            for s, k, size, c, d in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if rows and (s != state["shard"] or held + size > block):
                    yield flush()
                    held = 0
                if s != state["shard"]:
                    state.update(shard=s, seq=0, start=0)
                rows.append((k, size, c, d))
                held += size
        if rows:
            yield flush()

    coded = encoded.mapInArrow(code, "shard int, k long, n long, control binary, data binary")
    dealt = coded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("k").asc_nulls_last(), "control", "data")
    dealt.mapInArrow(assemble, "shard int, seq long, start long, n long, keys array<long>, sizes array<long>, control binary, data binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """From the files: key, start, n_tokens, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit)."""
    prepare(spark, rows=16)
    by_rank = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = {r.shard: int(r.n) for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    base, before = {}, 0
    for s in sorted(sums):
        base[s], before = before, before + sums[s]
    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, start, keys, sizes, control, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                raw = by_rank[unpack(control, data, np.array(sizes, np.int64))].astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                raws = _cut(raw, 4 * ends)
                starts, sums_ = (base[s] + start + ends - sizes).tolist(), list(map(zlib.crc32, raws))
                columns = [pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums_)] + ([pa.array(raws, pa.binary())] if ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return blocks.select("shard", "start", "keys", "sizes", "control", "data").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = new_path(spark, "token-files")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), spec, path)
    return read_ids(spark, path, ids=False)
