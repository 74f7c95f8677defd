"""From raw documents to token ids: five stages, each over all that the one before has kept.

Stages take (spark, docs, sf_dir), docs having the columns of `documents` (further columns of any name are passed on
as they are), and return those columns; the last returns token ids. Every stage's rows are written as Parquet and read
again by the next one.

Defined cases, all stages: a null or empty text is a text without words, which no stage but mixing drops (mixing takes
it as often as its source's other documents, by the hash of its id); rows without an id stay in all of them; repeated
rows share their fate, but copies of a text under different ids leave one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.bits import without
from docsift.llm.bpe import encode_documents
from docsift.llm.minhash import Plan, link
from docsift.llm.mixing import mix
from docsift.llm.pii import find_pii
from docsift.llm.toxicity import chain_of, score
from docsift.session import stash

TOXIC = 0.5  # documents of this probability and more go
NEAR = Plan(words=5, percent=80)


def _apart(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but `own` under names that no operator uses, and the columns that give docs back."""
    names = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in own}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = _apart(docs, "doc_id", "text")
    return score(rows, chain_of(rows, labels)).where(F.col("p_toxic") < TOXIC).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates. Rows without an id stay."""
    gone = link(docs, NEAR).where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return without(docs, stash(gone, "gone"), "doc_id")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars is counted anew."""
    rows, back = _apart(docs, "text", "n_chars")
    return find_pii(rows, masked=True).withColumn("n_chars", F.length("text").cast("long")).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: no, one or two rows each."""
    rows, back = _apart(docs, "doc_id", "text", "source")
    taken = mix(rows, carry=True).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the hashes of ids and of the bytes they decode to."""
    import public_tokenizers as public

    # The last of five stages in the same executors: less memory for somewhat more time.
    return encode_documents(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, rows=400, cache=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_pii),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifier, the signatures and the encoder have no SQL; tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
