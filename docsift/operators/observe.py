"""Observations: normalising raw findings and scoring their severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import classify as C
from docsift.functions import text as T


def _stop(t: str) -> Column:
    """T.sentence, the blanks of column t being collapsed already."""
    return T.stop(F.col(t))


def normalize(raw: DataFrame) -> DataFrame:
    """Canonical observations; `images` stays a list and n_images counts it.

    Two selects: what many rules look at is computed once, as a column.
    """
    ev = F.coalesce(F.nullif(F.col("supporting_evidence"), F.lit("")), F.col("evidence")) if "supporting_evidence" in raw.columns else F.col("evidence")
    flat = raw.select(
        "report_id", "ord", "id", "images", "severity", "confidence", F.col("observation").alias("__o"), F.lower("observation").alias("__low"),
        *[T.normalize_whitespace(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((F.col("area"), "__area"), (F.col("observation"), "__obs"), (ev, "__ev"))],
    )
    return flat.select(
        "report_id", "ord", "id", F.when(F.col("__area") == "", "General Area").otherwise(_stop("__area")).alias("area"), _stop("__obs").alias("observation"), C.category_of_lower(F.col("__low")).alias("category"),
        C.severity(F.col("severity")).alias("severity"), C.severity_score(F.col("severity")).alias("severity_score"),
        C.confidence(F.col("confidence")).alias("confidence"), C.confidence_score(F.col("confidence")).alias("confidence_score"),
        _stop("__ev").alias("evidence"), "images", F.size("images").alias("n_images"), T.dedup_key(F.col("__o")).alias("key"),
    )


def rescore(obs: DataFrame) -> DataFrame:
    """The severity given by words, category and evidence replaces the one that came with the finding."""
    score = C.rescored(F.col("observation"), F.col("category"), F.col("evidence"))
    return obs.withColumn("severity_score", score).withColumn("severity", C.band(F.col("severity_score")))
