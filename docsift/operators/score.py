"""Confidence and quality scores of a report: means of per-finding scores, with defaults for empty sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift import lexicon as lx
from docsift.functions.text import r3, strip


def d(x: float) -> Column:
    return F.lit(float(x))


def when(test: Column, value: float, otherwise: float = 0.0) -> Column:
    return F.when(test, d(value)).otherwise(d(otherwise))


def observation_quality(evidence: Column, images: Column, confidence: Column, least: int = 0) -> Column:
    return when(F.length(evidence) > least, 0.3) + when(images > 0, 0.3) + when(confidence >= d(0.7), 0.4)


def conflict_score(n: Column) -> Column:
    return d(1.0) - F.least(d(1.0), d(0.1) * n)


def evidence_quality(texts: Column, sources: Column, confidences: Column) -> Column:
    """From arrays: length of the joined texts, variety of sources, mean confidence; 0 without evidence."""
    mean = F.aggregate(confidences, d(0.0), lambda a, x: a + x) / F.size(confidences)
    full = F.least(d(1.0), F.least(d(0.5), F.length(F.array_join(texts, " ")) / d(500)) + F.when(F.size(F.array_distinct(sources)) > 1, d(0.3)).otherwise(d(0.1)) + d(0.2) * mean)
    return F.when(F.size(texts) == 0, d(0.0)).otherwise(full)


def completeness(area: Column, observation: Column, category: Column, evidence: Column) -> Column:
    return when(area != "Unknown", 0.3) + when(F.length(observation) > 10, 0.3) + when(category != "General", 0.2) + when(evidence != "", 0.2)


def reasoning(mean_confidence: Column, conflicts: Column) -> Column:
    return F.coalesce(mean_confidence * (d(1.0) - F.least(d(1.0), d(0.05) * conflicts)), d(0.5))


def conflict_density(conflicts: Column, observations: Column) -> Column:
    return F.coalesce(F.least(d(1.0), F.try_divide(d(2.0) * conflicts, observations)), d(0.0))


def reasoning_quality(words: Column, evidence: Column, score: Column) -> Column:
    return F.least(d(1.0), F.least(d(0.4), words / d(20)) + when(evidence != "", 0.3) + when(score > 0, 0.3))


def property_summary(c: Column) -> Column:
    """The given summary without blanks around it, which may leave nothing; the default where none is given."""
    return F.when(F.coalesce(c, F.lit("")) == "", lx.NO_SUMMARY).otherwise(strip(c))


def root_cause(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(lx.NO_ROOT_CAUSE))


def missing_information(c: Column) -> Column:
    """The given list without blanks and blank entries; the default where none is given."""
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.array(F.lit(lx.NOTHING_MISSING))).otherwise(F.filter(F.transform(c, strip), lambda x: x != ""))


def sections(obs: DataFrame, conflicts: DataFrame, recs: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """What the scores of a report look at, one row a report. inputs: report_id, property_summary; without it, the reports that have findings, none with a summary of its own."""
    urgent = F.col("severity").isin("Critical", "High")
    q = [observation_quality(F.col("evidence"), F.col("n_images"), F.col("confidence_score"), least) for least in (0, 10)]
    o = obs.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(urgent).alias("keys"), F.count_if(F.col("confidence_score") < 0.4).alias("unsure"),
        F.avg(q[0]).alias("q"), F.avg(q[1]).alias("strict"), F.avg("confidence_score").alias("certainty"))
    parts = when(F.col("priority") != "", 0.3) + when(F.col("category") != "", 0.3) + when(F.col("ids") != "", 0.4)
    r = recs.groupBy("report_id").agg(F.count(F.lit(1)).alias("recs"), F.count_if(F.length("action") < 20).alias("weak"), F.avg(parts).alias("rec_quality"))
    c = conflicts.groupBy("report_id").agg(F.count(F.lit(1)).alias("conflicts"))
    base = o.select("report_id", F.lit(lx.NO_SUMMARY).alias("summary")) if inputs is None else inputs.select("report_id", property_summary(F.col("property_summary")).alias("summary"))
    j = base.join(o, "report_id", "left").join(r, "report_id", "left").join(c, "report_id", "left")
    return j.fillna(0, ["n", "keys", "unsure", "recs", "weak", "conflicts", "q", "strict", "rec_quality"]).fillna(0.5, ["certainty"])


def completeness_of(parts: int) -> Column:
    """Share of sections that are there: summary, findings, recommendations, key findings, and the overview of risks, which always is."""
    there = sum(((F.col("summary") != "").cast("int"), (F.col("n") > 0).cast("int"), (F.col("recs") > 0).cast("int"), (F.col("keys") > 0).cast("int")), F.lit(parts - 4))
    return there / F.lit(float(parts))


def deterministic(of: DataFrame) -> DataFrame:
    """Confidence of the rule engine, from sections: completeness, quality of findings, certainty, conflicts, rounded to 3 places."""
    full = of.withColumn("completeness", completeness_of(4)).withColumn("conflict_score", conflict_score(F.col("conflicts")))
    total = d(0.3) * F.col("completeness") + d(0.3) * F.col("q") + d(0.2) * F.col("certainty") + d(0.2) * F.col("conflict_score")
    return full.select("report_id", "n", "conflicts", r3(F.col("completeness")).alias("completeness"), r3(F.col("q")).alias("quality"), r3(F.col("certainty")).alias("certainty"), r3(F.col("conflict_score")).alias("conflict_score"), r3(total).alias("confidence"))


def overall_quality(of: DataFrame) -> DataFrame:
    """From sections: completeness of five parts, quality of findings and of recommendations, their mean, and the issues."""
    texts = [F.when(F.col("summary") == "", lx.SECTION_ISSUES[0]), F.when(F.col("n") == 0, lx.SECTION_ISSUES[1]), F.when(F.col("recs") == 0, lx.SECTION_ISSUES[2])]
    texts += [F.when(F.col("weak") > 0, F.concat(F.col("weak"), F.lit(" weak recommendations detected"))), F.when(F.col("unsure") > 0, F.concat(F.col("unsure"), F.lit(" observations with low confidence")))]
    return of.select("report_id", completeness_of(5).alias("completeness"), F.col("strict").alias("observation_quality"), F.col("rec_quality").alias("recommendation_quality"),
                     r3((completeness_of(5) + F.col("strict") + F.col("rec_quality")) / 3).alias("overall"), F.concat_ws("; ", *texts).alias("issues"))
