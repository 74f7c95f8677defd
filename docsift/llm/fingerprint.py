"""Merkle fingerprints of documents over sections, paragraphs and short runs of words.

A text's paragraphs are its lines. Sections are stretches of paragraphs; one ends before a blank line, and after a
paragraph whose hash says so, so that long stretches of lines are cut by content. Below a paragraph stand its leaves,
runs of words that end where a word's hash says so. A parent's hash is that of its children's hashes; the root covers
every character. Equal texts have equal roots, and descending only where hashes differ locates an edit.

A fingerprint is written as  root/section:paragraph=leaves,paragraph=leaves/section:...  with 32 hex digits for the root
and 12 for each other node: of two unrelated texts of a million leaves, one leaf in 280 million is alike by chance.
It is about half as long as the text, since an edit can only be located among leaves that are there.

Two trees are compared by descending: equal roots end it; sections of equal hash are alike with all below them; only
among the others are paragraphs compared, and only among paragraphs that differ, leaves. Likeness is the share of
leaves that are alike (2 * alike / leaves of both), and the differing paragraphs are where the edit is. Two texts
without words are alike.

Order of documents: descending id, null ids last; rows with equal ids in a fixed order of their packed texts. Defined cases: a null text is
the empty one; a single document is its own next; an empty table gives no rows; other columns are ignored.

The documents are dealt to ranges of ids. The first document of each range also goes, as a guest, to the range before
it in the order, so neighbours always meet in one task; texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.text import blocks, buffers
from docsift.session import extend, partitions, prepare

LEAF, SECTION = 4, 8  # mean words a leaf and paragraphs a section
ROOT, NODE = 32, 12  # hex digits
_BLANK = b" \t\n\r\x0b\x0c"


def fingerprints(texts: pa.Array) -> list[str]:
    out: list[str] = []
    for w in blocks(texts):
        hashes = w.hashes()
        lines = np.flatnonzero(w.data == 10)
        raw, edges = w.data.tobytes(), _edges(texts, w)
        # A leaf ends with a word that says so, and with the last word of a line.
        line_of = np.searchsorted(lines, w.starts)
        end = hashes % np.uint64(LEAF) == 0
        if len(end):
            end[:-1] |= line_of[1:] != line_of[:-1]
            end[w.first[1:][w.first[1:] > 0] - 1] = True
        ends = np.flatnonzero(end)
        begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        order = np.arange(len(hashes)) - np.repeat(begins, ends - begins + 1) if len(ends) else ends
        mixed = hashes * (2 * order.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 | 1))
        sums = np.cumsum(mixed)
        values = (sums[ends] - sums[begins] + mixed[begins]) >> np.uint64(16) if len(ends) else ends
        leaf_hex = [f"{v:012x}" for v in values.tolist()]
        leaf_line = line_of[ends] if len(ends) else ends
        for r in range(len(w)):
            lo, hi = edges[r], edges[r + 1]
            a, b = np.searchsorted(ends, (w.first[r], w.first[r + 1]))
            first_line = int(np.searchsorted(lines, lo))
            of_line: dict[int, list[str]] = {}
            for x, ln in zip(leaf_hex[a:b], (leaf_line[a:b] - first_line).tolist(), strict=True):
                of_line.setdefault(ln, []).append(x)
            out.append(_tree(raw[lo:hi], of_line))
    return out


def _edges(texts: pa.Array, w) -> np.ndarray:
    offsets, _ = buffers(texts)
    return offsets[w.row : w.row + len(w) + 1] - offsets[w.row]


def _tree(raw: bytes, of_line: dict[int, list[str]]) -> str:
    sections: list[list[str]] = [[]]
    full: list[list[bytes]] = [[]]
    for i, line in enumerate(raw.split(b"\n")):
        digest = hashlib.blake2b(line, digest_size=16).digest()
        if not line.strip(_BLANK) and sections[-1]:
            sections.append([])
            full.append([])
        full[-1].append(digest)
        if leaves := of_line.get(i):
            sections[-1].append(f"{digest.hex()[:NODE]}={''.join(leaves)}")
        if digest[0] % SECTION == 0 and sections[-1]:
            sections.append([])
            full.append([])
    branches = [hashlib.blake2b(b"".join(f), digest_size=16).digest() for f in full]
    root = hashlib.blake2b(b"".join(branches), digest_size=ROOT // 2).hexdigest()
    return "/".join([root, *(f"{d.hex()[:NODE]}:{','.join(s)}" for d, s in zip(branches, sections, strict=True) if s)])


@dataclass
class Tree:
    """A fingerprint read back: sections are (hash, paragraphs), paragraphs (hash, leaves)."""

    root: str
    sections: list[tuple[str, list[tuple[str, str]]]]
    leaves: int

    @staticmethod
    def of(fingerprint: str) -> Tree:
        root, *rest = fingerprint.split("/")
        sections = []
        for s in rest:
            name, paragraphs = s.split(":", 1)
            sections.append((name, [(p[:NODE], p[NODE + 1 :]) for p in paragraphs.split(",")]))
        return Tree(root, sections, sum(len(x) for _, ps in sections for _, x in ps) // NODE)


def _unmatched(a: list[tuple], b: list[tuple]) -> tuple[list[tuple], list[int]]:
    """What of a, and which places of b, is left when nodes of equal hash are taken out in pairs."""
    have = Counter(x[0] for x in a)
    there = Counter(x[0] for x in b)
    common = have & there
    left, seen = [], Counter()
    for x in a:
        seen[x[0]] += 1
        if seen[x[0]] > common[x[0]]:
            left.append(x)
    seen.clear()
    places = []
    for i, x in enumerate(b):
        seen[x[0]] += 1
        if seen[x[0]] > common[x[0]]:
            places.append(i)
    return left, places


def descend(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """How many leaves of b are alike in a, and the paragraphs of b (section, place in it) that a doesn't have."""
    if a.root == b.root:
        return b.leaves, []
    old, places = _unmatched(a.sections, b.sections)
    old_paragraphs = [p for _, ps in old for p in ps]
    new = [(i, j, p) for i in places for j, p in enumerate(b.sections[i][1])]
    old, places = _unmatched(old_paragraphs, [p for _, _, p in new])
    found = [new[i] for i in places]
    x, y = (Counter(t[i : i + NODE] for t in texts for i in range(0, len(t), NODE)) for texts in ([t for _, t in old], [p[1] for _, _, p in found]))
    return b.leaves - y.total() + (x & y).total(), [(i, j) for i, j, _ in found]


def _likeness(a: Tree, b: Tree) -> float:
    both = a.leaves + b.leaves
    return 2 * descend(a, b)[0] / both if both and a.root != b.root else 1.0


def likeness(a: str, b: str) -> float:
    return _likeness(Tree.of(a), Tree.of(b))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Where b was edited: its paragraphs that a lacks, by section and place, counted from 0 among those with words."""
    return descend(Tree.of(a), Tree.of(b))[1]


def fingerprint_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `fingerprint`."""
    prepare(df.sparkSession)
    df = df.select(*[c for c in df.columns if c != "fingerprint"])
    at, schema = df.columns.index(text), extend(df.schema, ("fingerprint", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fingerprints(b.column(at)), pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def in_ranges(df: DataFrame, key: str, text: str) -> DataFrame:
    """shard, guest, k, z (the compressed text), dealt by shard and sorted in the order of documents."""
    n = partitions(df.sparkSession)
    ids = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    q = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 20_000).alias("q"), F.max("k").alias("top")).first()
    top, bounds = q.top, np.array(sorted(set((q.q or []) if n > 1 else []) - {q.top}), np.int64)
    last = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            k = b.column(0)
            values = k.fill_null(0).to_numpy(zero_copy_only=False)
            null = k.is_null().to_numpy(zero_copy_only=False)
            shard = np.where(null, 0, np.searchsorted(bounds, values, "left")).astype(np.int32)
            rows, guest = np.arange(len(k)), np.zeros(len(k), bool)
            more = np.flatnonzero(~null & np.isin(values, bounds))
            wrap = np.flatnonzero(~null & (values == top)) if last else rows[:0]
            shards = np.concatenate((shard, shard[more] + 1, np.zeros(len(wrap), np.int32)))
            guests = np.concatenate((guest, np.ones(len(more) + len(wrap), bool)))
            which = np.concatenate((rows, more, wrap))
            z = [pack((t or "").encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(guests), k.take(pa.array(which)), pa.array([z[i] for i in which], pa.binary())], names=["shard", "guest", "k", "z"])

    out = ids.mapInArrow(deal, "shard int, guest boolean, k long, z binary")
    return out.repartitionById(last + 1, "shard").sortWithinPartitions("shard", "guest", F.col("k").desc_nulls_last(), "z")


def edited_and_next(df: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = 256) -> DataFrame:
    """Per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    prepare(df.sparkSession)
    schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(rows: list[tuple], nxt: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [nxt]
        edited = []
        for a, b in zip(texts, texts[1:], strict=False):
            half = len(a) // 2
            edited.append(a[: len(a) - half] + b[:half])
        prints = fingerprints(pa.array(texts, pa.large_string()))
        changed = fingerprints(pa.array(edited, pa.large_string()))
        trees = [Tree.of(p) for p in prints]
        near = [_likeness(t, Tree.of(c)) for t, c in zip(trees, changed, strict=False)]
        following = [_likeness(t, u) for t, u in zip(trees, trees[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(prints[:-1]), pa.array(changed), pa.array(near, pa.float64()), pa.array(following, pa.float64())],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        shard, held, first, guest, size = None, [], None, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield work(held, guest if guest is not None else first)

        for b in batches:
            for s, g, k, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard:
                    yield from flush()
                    shard, held, first, guest, size = s, [], None, None, 0
                t = unpack(z).decode()
                if g:
                    guest = t if guest is None else guest
                    continue
                first = t if first is None else first
                if len(held) >= chunk or size > 1 << 21:
                    yield work(held, t)
                    held, size = [], 0
                held.append((k, t))
                size += len(t)
        yield from flush()

    return in_ranges(df, key, text).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
