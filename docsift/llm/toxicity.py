"""Toxicity by a classifier chain of linear models.

Categories are 0/1 columns of a table of labels, predicted one after another: each model sees the text's features and
the probabilities of all earlier categories. While training, those are out-of-fold predictions, so that a later model
learns from what an earlier one says of texts it hasn't seen. The tables at hand label low quality and toxicity, and the
chain runs in this order.

Features are whole words, the words' beginnings of four to eight bytes and runs of five bytes within words (A-Z
lower-cased), hashed; for each category the FEATURES with the largest deviation from independence are chosen. A feature counts once a text. Models are logistic regressions with a
quadratic penalty. They are fitted on the driver on at most `sample` labelled documents, chosen by hash of their id;
all documents are scored, whole.

Defined cases: a null text has no features and gets the probability of a text without any; a category without labelled
rows of both kinds gets the share of its ones (0 without labels) for every text; rows of labels with nulls are not
used; repeated rows are scored alike; an empty table gives no rows; columns named like the outputs are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.text import Words, blocks, mix, randoms
from docsift.session import extend, prepare

GRAM, PREFIXES = 5, (4, 5, 6, 7, 8)
SLOTS, FEATURES, SAMPLE, FOLDS = 1 << 21, 1536, 6000, 5
_LETTERS = randoms(256, 99)
_SPREAD = randoms(max(GRAM, *PREFIXES), 101) | np.uint64(1)
_KINDS = randoms(max(PREFIXES), 103)


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash slot of every run of GRAM bytes within a word, every word's beginnings of PREFIXES bytes, and every word."""
    size = w.ends - w.starts
    row_of = np.searchsorted(w.first, np.arange(len(size)), "right") - 1
    inside = np.zeros(len(w.data) + 1, np.int8)
    long = size >= GRAM
    inside[w.starts[long]] += 1
    np.subtract.at(inside, w.ends[long] - GRAM + 1, 1)
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int32) > 0)
    v = _LETTERS[w.data]
    total = np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        total += v[at + i] * _SPREAD[i]
    rows = [row_of[np.searchsorted(w.starts, at, "right") - 1], row_of]
    hashes = [total, w.hashes()]
    start = np.zeros(len(size), np.uint64)
    for i in range(max(PREFIXES)):
        on = np.flatnonzero(size > i)
        start[on] += v[w.starts[on] + i] * _SPREAD[i]
        if i + 1 in PREFIXES:
            rows.append(row_of[on])
            hashes.append(start[on] ^ _KINDS[i])
    return np.concatenate(rows), (mix(np.concatenate(hashes)) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Logistic:
    """Weights of the chosen features, of the earlier categories' probabilities, and the intercept."""

    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def probability(self, total: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        z = total + earlier @ self.chained + self.bias if len(self.chained) else total + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; the intercept isn't penalised."""
    n = len(y)
    mean = float(y.mean()) if n else 0.0
    if not 0 < mean < 1:
        return np.zeros(x.shape[1]), -60.0 if mean == 0 else 60.0
    v, c = np.ones(x.shape[1], np.float32), 1.0
    for _ in range(12):
        z = x @ v + np.float32(c)
        v, c = x.T @ z, float(z.sum())
        size = math.sqrt(float(v @ v) + c * c)
        v, c = v / np.float32(size), c / size
    rate = 1 / (0.25 * float(np.square(x @ v + np.float32(c)).sum()) * 1.05 + penalty)
    w, b = np.zeros(x.shape[1], np.float32), math.log(mean / (1 - mean))
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(x @ ahead + np.float32(ahead_b), -60, 60))) - y
        new, new_b = ahead - np.float32(rate) * (x.T @ off + np.float32(penalty) * ahead), ahead_b - rate * float(off.sum())
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / s
        ahead, ahead_b, w, b, t = new + np.float32(k) * (new - w), new_b + k * (new_b - b), new, new_b, s
    return w.astype(float), b


@dataclass
class Chain:
    """Fitted models in order; place gives each hash slot its feature, or -1."""

    categories: list[str]
    place: np.ndarray
    models: list[Logistic] = field(default_factory=list)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """A column for each category."""
        out = np.zeros((len(column), len(self.categories)))
        weights = [m.weights for m in self.models]
        for w in blocks(column, lower=True, size=1 << 19):
            row, slot = grams(w)
            f = self.place[slot]
            on = f >= 0
            pairs = np.unique(row[on] * (1 << 32) + f[on])
            row, f = pairs >> 32, pairs & 0xFFFFFFFF
            part = out[w.row : w.row + len(w)]
            for c, model in enumerate(self.models):
                part[:, c] = model.probability(np.bincount(row, weights=weights[c][f], minlength=len(w)), part[:, :c])
        return out


def _features(rows: DataFrame, text: str) -> DataFrame:
    """text replaced by `slots`: its distinct hash slots as little-endian unsigned 32-bit integers."""
    at = rows.columns.index(text)
    schema = extend(rows.drop(text).schema, ("slots", "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for w in blocks(b.column(at), lower=True, size=1 << 19):
                row, slot = grams(w)
                pairs = np.unique(row * SLOTS + slot)
                cut = np.searchsorted(pairs, np.arange(len(w) + 1) * SLOTS)
                own = (pairs % SLOTS).astype("<u4")
                out += [own[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], key: str = "doc_id", text: str = "text", sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """Fit the chain on at most `sample` labelled documents. labels: key and the categories."""
    prepare(docs.sparkSession)
    chosen = labels.select(F.col(key).alias("__k"), *[F.col(c).cast("double").alias(f"__y{i}") for i, c in enumerate(categories)]).dropna()
    chosen = chosen.orderBy(F.xxhash64("__k"), "__k").limit(sample)
    both = docs.select(F.col(key).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(chosen), F.col("__id") == F.col("__k"))
    ys = [f"__y{i}" for i in range(len(categories))]
    one = both.groupBy("__k", *ys).agg(F.min("__t").alias("__t"))  # a text an id, so no more than the sample reaches the driver
    rows = sorted(_features(one, "__t").collect(), key=lambda r: r["__k"])
    n = len(rows)
    y = np.array([[r[c] for c in ys] for r in rows], np.float32).reshape(n, len(ys))
    own = [np.frombuffer(r.slots, "<u4") for r in rows]
    df, seen = np.zeros(SLOTS, np.float32), np.zeros((len(ys), SLOTS), np.float32)
    for s, marks in zip(own, y, strict=True):
        df[s] += 1
        for c in np.flatnonzero(marks):
            seen[c, s] += 1
    wanted: set[int] = set()
    for c in range(len(ys)):
        ones = float(y[:, c].sum())
        if 0 < ones < n:
            at = np.flatnonzero(df >= 3)
            due = df[at] * (ones / n)
            z = np.abs(seen[c, at] - due) / np.sqrt(np.maximum(due * (1 - ones / n) * (1 - df[at] / n), 1e-9))
            wanted |= set(at[np.argsort(-z, kind="stable")[:FEATURES]].tolist())
    del df, seen
    features = np.array(sorted(wanted), np.int64)
    place = np.full(SLOTS, -1, np.int32)
    place[features] = np.arange(len(features))
    x = np.zeros((n, len(features) + len(ys)), np.float32)  # the last columns are for earlier categories
    for i, s in enumerate(own):
        f = place[s]
        x[i, f[f >= 0]] = 1
    del rows, own
    fold = np.arange(n) % folds
    chain = Chain(list(categories), place)
    for c in range(len(ys)):
        full = x[:, : len(features) + c]
        w, b = fit(full, y[:, c])
        chain.models.append(Logistic(w[: len(features)], w[len(features) :], b))
        if c + 1 < len(ys):
            for k in range(folds):
                test = fold == k
                w, b = fit(full[~test], y[~test, c])
                x[test, len(features) + c] = 1 / (1 + np.exp(-np.clip(full[test] @ w.astype(np.float32) + b, -60, 60)))
    return chain


def score(df: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """df with the probability of every category."""
    prepare(df.sparkSession)
    made = [prefix + c for c in chain.categories]
    df = df.select(*[c for c in df.columns if c not in made])
    at, schema = df.columns.index(text), extend(df.schema, *[(name, "double") for name in made])
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.probabilities(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, i].copy()) for i in range(p.shape[1]))], names=schema.names)

    return df.mapInArrow(run, schema)


CATEGORIES = ("low_quality", "toxic")


def chain_of(docs: DataFrame, labels: DataFrame) -> Chain:
    return train(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), CATEGORIES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = chain_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).drop("text").withColumn("rejected", F.col("p_toxic") >= 0.5)
