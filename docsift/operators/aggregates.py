"""Aggregations over observations, by report: every one a single combinable group-by unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift import lexicon as lx
from docsift.functions.classify import first_rule
from docsift.functions.text import r3

S = "severity"


def count_of(level: str) -> Column:
    return F.count_if(F.col(S) == level)


def health(obs: DataFrame, by: str = "report_id") -> DataFrame:
    """100 less the penalties of all findings, within 0 and 100."""
    penalty = first_rule([(F.col(S) == k, F.lit(v)) for k, v in lx.HEALTH_PENALTY.items()], F.lit(0))
    return obs.groupBy(by).agg(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.sum(penalty))).cast("int").alias("health"))


def health_band(h: Column) -> Column:
    return F.when(h >= 90, "Excellent").when(h >= 75, "Good").when(h >= 60, "Fair").when(h >= 40, "Poor").otherwise("Critical")


def risk_level(critical: Column, high: Column, medium: Column) -> Column:
    return F.when(critical > 0, "Critical").when(high > 0, "High").when(medium > 0, "Medium").otherwise("Low")


def kpis(obs: DataFrame) -> DataFrame:
    a = obs.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total"), *[count_of(s).alias(f"n_{s.lower()}") for s in lx.LEVELS[:4]], F.count_distinct("area").alias("areas"))
    h = F.greatest(F.lit(0), 100 - 20 * F.col("n_critical") - 10 * F.col("n_high") - 5 * F.col("n_medium") - 2 * F.col("n_low"))
    return a.select("*", risk_level(F.col("n_critical"), F.col("n_high"), F.col("n_medium")).alias("risk"), (h / F.lit(100.0)).alias("confidence"))


def severity_assessment(obs: DataFrame, rounded: bool = True) -> DataFrame:
    """Most frequent severity (the one seen first where counts are equal), distribution and mean score."""
    per = obs.groupBy("report_id", S).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.sum("severity_score").alias("sum"))
    mean = F.sum("sum") / F.sum("n")
    rank = F.struct(F.col("n"), -F.col("first"))
    dist = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", S, "n"))), lambda x: F.concat_ws(":", x[S], x["n"])), ",")
    return per.groupBy("report_id").agg(F.max_by(S, rank).alias("overall"), dist.alias("distribution"), (r3(mean) if rounded else mean).alias("mean_score"))


def breakdown(obs: DataFrame) -> DataFrame:
    """All five levels of every report, also those that no finding has."""
    spark = obs.sparkSession
    dim = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(zip(lx.LEVELS, ["Severe", "Significant", "Moderate", "Minor", "Informational"], strict=True))], "pos int, severity string, impact string")
    counts = obs.groupBy("report_id").agg(*[count_of(s).alias(s) for s in lx.LEVELS])
    long = counts.select("report_id", F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in lx.LEVELS]), F.array(*[F.col(s) for s in lx.LEVELS]))).alias(S, "n"))
    return long.join(F.broadcast(dim), S).select("report_id", "pos", S, "n", "impact", F.when(F.col("n") == 0, "OK").otherwise("!").alias("status"))


def distribution(obs: DataFrame, least: int = 0) -> DataFrame:
    """Shares in percent of four levels; the total has all findings."""
    a = obs.groupBy("report_id").agg(F.count(F.lit(1)).alias("total"), *[count_of(s).alias(s) for s in lx.LEVELS[:4]])
    total = F.greatest(F.col("total"), F.lit(max(least, 1)))
    return a.select("report_id", *[(F.col(s) / total * F.lit(100.0)).alias(f"pct_{s.lower()}") for s in lx.LEVELS[:4]])


def by_category(obs: DataFrame) -> DataFrame:
    a = obs.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("k"), count_of("Critical").alias("c"), count_of("High").alias("h"))
    text = F.concat(F.format_string("Property assessment identified %d observations across %d categories. ", "n", "k"), F.when(F.col("c") > 0, F.format_string("%d critical issues require immediate attention. ", "c")).otherwise(""), F.when(F.col("h") > 0, F.format_string("%d high-priority issues need urgent assessment. ", "h")).otherwise(""))
    return a.select("report_id", F.rtrim(text).alias("summary"))


def ids_by(obs: DataFrame, column: str) -> DataFrame:
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]), ",")
    return obs.groupBy("report_id", column).agg(ids.alias("ids"))


def strategies(obs: DataFrame) -> DataFrame:
    """Plans for categories with three findings and more, as first seen, then three fixed ones; five at most."""
    per = obs.groupBy("report_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    text = F.format_string("Long-term %s maintenance plan needed based on %d observations", "category", "n")
    rows = per.groupBy("report_id").agg(F.sort_array(F.collect_list(F.when(F.col("n") >= 3, F.struct("first", text.alias("t"))))).alias("p"))
    fixed = F.array(*[F.lit(s) for s in lx.STRATEGIES[:3]])
    return rows.select("report_id", F.array_join(F.slice(F.concat(F.transform("p", lambda x: x["t"]), fixed), 1, 5), " | ").alias("strategies"))


def extraction_statistics(pages: DataFrame) -> DataFrame:
    """Per document, from its pages (doc_id, page_number, text, error)."""
    has = F.length("text") > 0
    a = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"), F.count_if(has).alias("pages_with_text"), F.count_if(F.col("error").isNotNull()).alias("failed_pages"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("heading")).alias("sections"))
    rate = F.coalesce(F.try_divide("pages_with_text", "total_pages"), F.lit(0.0))
    return a.select("*", F.round(rate, 3).alias("rate"), ((F.col("total_pages") > 0) & (rate < 0.2)).alias("likely_scanned"))


def document_quality(stats: DataFrame) -> DataFrame:
    s = (F.lit(1.0) - F.when(F.col("likely_scanned"), 0.5).otherwise(0.0) - F.least(F.lit(0.3), F.lit(0.05) * F.col("failed_pages")) - F.when((F.col("total_pages") > 0) & (F.col("rate") < 0.5), 0.2).otherwise(0.0)
         - F.when((F.col("sections") == 0) & (F.col("total_pages") > 1), 0.1).otherwise(0.0))
    reasons = F.array_compact(F.array(
        F.when(F.col("likely_scanned"), "scanned"), F.when(F.col("failed_pages") > 0, F.concat(F.col("failed_pages"), F.lit(" page(s) failed"))),
        F.when((F.col("total_pages") > 0) & (F.col("rate") < 0.5), "few pages with text"), F.when((F.col("sections") == 0) & (F.col("total_pages") > 1), "no sections")))
    return stats.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(s, 2))).alias("score"), F.when(F.size(reasons) == 0, "none").otherwise(F.array_join(reasons, "; ")).alias("reasons"))


def image_stats(images: DataFrame) -> DataFrame:
    """One row for a batch of images (width, height, score, format): mean size, histogram of scores, images by format. An empty batch has zeros."""
    q = F.col("score")
    a = images.agg(
        F.count(F.lit(1)).alias("images"), F.coalesce(F.concat(F.floor(F.avg("width")), F.lit("x"), F.floor(F.avg("height"))), F.lit("0x0")).alias("mean_size"),
        F.count_if(q > 0.8).alias("excellent"), F.count_if((q > 0.6) & (q <= 0.8)).alias("good"), F.count_if((q > 0.4) & (q <= 0.6)).alias("fair"), F.count_if(q <= 0.4).alias("poor"))
    per = images.groupBy("format").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "format", "n"))), ",").alias("formats"))
    return a.join(F.broadcast(per))  # one row each
