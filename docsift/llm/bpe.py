"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece, the one token that ends the prefix's encoding is stored. A token can end a
prefix exactly if it is compatible with the token stored for the prefix before it, and one such token exists, so the
encoding of the whole is read back from the last prefix. Appending only adds prefixes, and after an edit only the
prefixes from the edit up to where the stored tokens agree again are computed.

Pieces are the matches of the tokenizer's pattern; they are encoded separately, as the usual library does.

Defined cases: a null text is encoded as the empty text (no ids, the hash of no bytes); texts may be of any length;
repeated rows and ids give repeated results; further columns of the input are ignored by the query and kept by
encode_documents unless named like its outputs, which replace them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.text import randoms
from docsift.session import prepare

#: White space of the pattern's engine (Unicode White_Space); Python's own \s also has 0x1C-0x1F.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of a worker's caches; they are emptied when full.
CACHE = 400_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from a rank file: lines of base64 and id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def compile_pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))


class Vocabulary:
    """Tokens, how each splits into the two tokens of its last merge, and which pairs may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens merged last to give this one; itself twice if it is a single byte."""
        found = self.split.get(token)
        if found is None:
            whole = self.bytes[token]
            found = self.split[token] = self._last_merge(whole) if len(whole) > 1 else (token, token)
        return found

    def _last_merge(self, whole: bytes) -> tuple[int, int]:
        ids = self.ids
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            _, at = min((ids.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ids[parts[0]], ids[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of left and right together are encoded as just these two tokens.

        Undo the merges of both tokens, latest first. A merge across the border that would have come before the
        one undone last would have been made instead.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2 * CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        ids, text = self.ids, self.bytes
        limit = 1 << 60
        while True:
            across = ids.get(text[left] + text[right])
            if across is not None and across < limit:
                return False
            # The merge made later is undone first; on equal ids the right one, as merges run from the left.
            order = [("l", left), ("r", right)] if left > right else [("r", right), ("l", left)]
            for side, token in order:
                if len(text[token]) > 1:
                    a, b = self.parts(token)
                    if side == "l":
                        left, limit = b, token
                    else:
                        right, limit = a, token + 1
                    break
            else:
                return True


class PrefixTable:
    """The encoding of a growing and editable byte string: last[i] is the token that ends prefix i + 1."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _at(self, end: int) -> int:
        """The token that ends the prefix of this length, from the tokens of the shorter ones."""
        v, data, last = self.vocabulary, self.data, self.last
        ids, pairs = v.ids, v.pairs
        for start in range(max(0, end - v.longest), end):
            token = ids.get(data[start:end])
            if token is not None:
                if not start:
                    return token
                before = last[start - 1]
                known = pairs.get(before << 32 | token)
                if known if known is not None else v.compatible(before, token):
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, data: bytes) -> None:
        n = len(self.data)
        self.data += data
        for end in range(n + 1, len(self.data) + 1):
            self.last.append(self._at(end))

    def truncate(self, n: int) -> None:
        self.data, self.last = self.data[:n], self.last[:n]

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Replace data[start:stop]; returns how many prefixes were computed anew.

        Once as many stored tokens in a row agree as the longest token has bytes, all later ones do.
        """
        old, shift = self.last, start + len(data) - stop
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[:start]
        agreed = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._at(end))
            before = end - 1 - shift
            agreed = agreed + 1 if before >= stop and old[before] == self.last[-1] else 0
            if agreed >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end, text = [], len(self.data), self.vocabulary.bytes
        while end:
            out.append(self.last[end - 1])
            end -= len(text[out[-1]])
        return out[::-1]


class _Table:
    """Unsigned 64-bit keys to small ids, by open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = int(8 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros((1 << bits) + 64, np.uint64)
        self.values = np.full((1 << bits) + 64, -1, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            at = slots[left] + self.probes - 1
            free = self.values[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            left = np.delete(left, put)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is missing."""
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], -1)
        for p in range(1, self.probes):
            more = np.flatnonzero((out < 0) & (self.values[slots + p - 1] >= 0))
            if not len(more):
                break
            at = slots[more] + p
            out[more] = np.where(self.keys[at] == keys[more], self.values[at], -1)
        return out


class BatchTable:
    """Prefix tables of many short pieces at once: column e of the table holds the last tokens of all prefixes of e bytes."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        size = max(v.bytes) + 1
        self.base, self.letters = np.uint64(0xD1342543DE82EF95), randoms(256, 5)
        self.powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(v.longest, self.base))))
        base, letters, full = int(self.base), self.letters.tolist(), (1 << 64) - 1
        self.length, hashes, pairs, merged = np.zeros(size, np.int32), [], [], []
        self.left, self.right = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for token, i in v.ids.items():
            h = 0
            for b in token:
                h = (h * base + letters[b]) & full
            hashes.append(h)
            self.length[i] = len(token)
            self.left[i], self.right[i] = v.parts(i)
            for cut in range(1, len(token)):
                a, b = v.ids.get(token[:cut]), v.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 24 | b)
                    merged.append(i)
        self.tokens = _Table(np.array(hashes, np.uint64), np.array(list(v.ids.values()), np.int32))
        self.merges = _Table(np.array(pairs, np.uint64), np.array(merged, np.int32))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Vocabulary.compatible for arrays."""
        ok, at, limit = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), 1 << 30, np.int64)
        while len(at):
            across = self.merges.get(left.astype(np.uint64) << np.uint64(24) | right.astype(np.uint64))
            bad = (across >= 0) & (across < limit)
            ok[at[bad]] = False
            a, b = self.length[left] > 1, self.length[right] > 1
            undo_left = a & ((left > right) | ~b)
            undo_right = b & ~undo_left
            limit = np.where(undo_left, left, right.astype(np.int64) + 1)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_right, self.left[right], right)
            on = ~bad & (undo_left | undo_right)
            at, left, right, limit = at[on], left[on], right[on], limit[on]
        return ok

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        pieces = sorted(pieces, key=len, reverse=True) if (given := pieces) else []
        lengths = np.array([len(p) for p in pieces], np.int64)
        n, width = len(pieces), int(lengths[0]) if len(pieces) else 0
        text = np.zeros((n, width), np.uint8)
        text[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        sums = np.zeros((width + 1, n), np.uint64)
        for e in range(width):
            sums[e + 1] = sums[e] * self.base + self.letters[text[:, e]]
        last = np.full((width + 1, n), -1, np.int32)
        for e in range(1, width + 1):
            open_ = np.arange(np.searchsorted(-lengths, -e, "right"))
            for size in range(min(e, self.vocabulary.longest), 0, -1):
                token = self.tokens.get(sums[e][open_] - sums[e - size][open_] * self.powers[size])
                hit = np.flatnonzero(token >= 0)
                if size < e:
                    hit = hit[self.compatible(last[e - size][open_[hit]], token[hit])]
                last[e][open_[hit]] = token[hit]
                open_ = np.delete(open_, hit)
                if not len(open_):
                    break
        ids, count = np.zeros((width, n), np.uint32), np.zeros(n, np.int64)
        ends, at = lengths.copy(), np.arange(n)
        while len(at):
            token = last[ends[at], at]
            count[at] += 1
            ids[width - count[at], at] = token
            ends[at] -= self.length[token]
            at = at[ends[at] > 0]
        raw, row = np.ascontiguousarray(ids.T).astype("<u4").tobytes(), 4 * width
        made = {p: raw[row * (i + 1) - 4 * c : row * (i + 1)] for i, (p, c) in enumerate(zip(pieces, count.tolist(), strict=True))}
        return [made[p] for p in given]


class Encoder:
    """Whole texts to ids. Stretches between blanks and pieces that came before are taken from caches of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.cache = CACHE
        self.vocabulary, self.pattern = Vocabulary(ranks), compile_pattern(pattern)
        self.batch = BatchTable(self.vocabulary)
        self.pieces: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}
        self.table = [self.vocabulary.bytes.get(i, b"") for i in range(max(self.vocabulary.bytes) + 1)]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Stretches; all but the first stand after a blank that isn't part of them.

        The pattern never joins what stands before and after a blank that a visible character follows, and looks
        no further than that blank, so a text may be cut there.
        """
        chunks = text.split(" ")
        if not _odd_blank(text):
            return chunks
        whole = chunks[:1]
        for c in chunks[1:]:
            if c and not c[0].isspace():
                whole.append(c)
            else:
                whole[-1] += " " + c
        return whole

    def _learn(self, known: dict[str, bytes], new: set[str], before: str) -> None:
        split = {s: self.pattern.findall(before + s) for s in new}
        ids = self.vocabulary.ids
        short: dict[str, bytes] = {}
        for p in {p for pieces in split.values() for p in pieces if p not in self.pieces}:
            raw = p.encode()
            token = ids.get(raw)
            if token is not None:
                self.pieces[p] = token.to_bytes(4, "little")
            elif len(raw) > 40:
                self.pieces[p] = np.array(PrefixTable(self.vocabulary, raw).tokens(), "<u4").tobytes()
            else:
                short[p] = raw
        self.pieces.update(zip(short, self.batch.encode(list(short.values())), strict=True))
        get = self.pieces.__getitem__
        known.update({s: get(pieces[0]) if len(pieces) == 1 else b"".join(map(get, pieces)) for s, pieces in split.items()})

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for cache in (self.pieces, self.first, self.after):
            if len(cache) > self.cache:
                cache.clear()
        cuts = [self.cut(t) for t in texts]
        self._learn(self.first, {c[0] for c in cuts}.difference(self.first), "")
        new: set[str] = set()
        for c in cuts:
            new.update(c[1:])
        self._learn(self.after, new.difference(self.after), " ")
        get = self.after.__getitem__
        out = [self.first[c[0]] + b"".join(map(get, c[1:])) for c in cuts]
        for cache in (self.pieces, self.first, self.after):  # very long entries are not kept
            for k in [k for k in cache if len(k) > 100]:
                del cache[k]
        return out

    def forget(self) -> None:
        """Empty the caches: a worker's next task may be another operator's."""
        for cache in (self.pieces, self.first, self.after):
            cache.clear()

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


_odd_blank = regex.compile(r" (?:\s|[\x1c-\x1f]|\Z)").search
_ENCODERS: dict[str, Encoder] = {}


def encoder(key: str, data: bytes, pattern: str) -> Encoder:
    """One encoder a worker and vocabulary; its caches serve all tasks of the worker."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(load_ranks(data), pattern)
    return _ENCODERS[key]


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: bool = True, rows: int = 1000, cache: int = CACHE) -> DataFrame:
    """df with `ids` (binary: little-endian uint32; left out where ids is false), `n_tokens`, `ids_sha256` and `decoded_sha256`.

    rows (texts encoded at once) and cache (entries of each of a worker's caches) weigh memory against time only.

    ranks_path is read by the driver and broadcast; a vocabulary is a file of bounded size.
    """
    spark = df.sparkSession
    prepare(spark, rows)
    with open(ranks_path, "rb") as f:
        raw = f.read()
    shared = spark.sparkContext.broadcast(raw)
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    kept = [c for c in df.columns if c != text and c not in made]
    df = df.select(*kept, F.col(text).alias("__text"))
    keep = [f for f in df.schema.fields if f.name != "__text"]
    schema = df.select(*kept).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *([("ids", "binary")] * ids)):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(key, shared.value, pattern)
        enc.cache = cache
        for batch in batches:
            n, a, b, raws = [], [], [], []
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for coded in enc.encode_batch(texts):
                back = enc.decode(np.frombuffer(coded, "<u4"))
                n.append(len(coded) // 4)
                a.append(hashlib.sha256(coded).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
                raws.append(coded)
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())] + ([pa.array(raws, pa.binary())] if ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
        enc.forget()

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, ids=False)
