"""The flagship: observations to one report a report id, and to the lines of its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift import lexicon as lx
from docsift.operators import aggregates as A
from docsift.operators import observe, recommend, relations, score
from docsift.session import dealt, stash

ROWS = 100_000  # findings of a shuffle's partition: a task of the last join holds all parts of its reports at once


def deduplicated(obs: DataFrame) -> DataFrame:
    return relations.merge_groups(relations.leaders(obs, relations.duplicate_pairs(obs))).drop("leader")


def _whole(obs: DataFrame, make, name: str) -> DataFrame:
    """What make() gives. Where it needs more partitions than are set, it is stored while they are, so that a task's memory doesn't grow with the input."""
    with dealt(obs.sparkSession, obs.count(), ROWS) as more:
        return stash(make(), name) if more else make()


def report(obs: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """One row a report: all parts by report_id. inputs: report_id, property_summary, root_cause; reports without findings are left out."""
    return _whole(obs, lambda: _report(obs, inputs), "reports")


def _report(obs: DataFrame, inputs: DataFrame | None) -> DataFrame:
    """Duplicates are found by the severity that came with the findings; then severity is scored anew, and conflicts,
    recommendations, summary and scores follow from that. What several parts read is stored once."""
    o = stash(observe.rescore(deduplicated(obs)), "findings")
    conflicts = stash(relations.conflicts(o), "conflicts")
    recs = stash(recommend.recommendations(o, conflicts), "recommendations")
    of = score.sections(o, conflicts, recs, inputs)
    parts = [
        A.kpis(o).drop("confidence", "risk"), A.health(o), A.severity_assessment(o),
        recommend.joined(recommend.key_findings(o), ["rank"], "finding", "key_findings"),
        recommend.joined(recommend.major_concerns(o), ["rank"], "concern", "major_concerns"),
        recommend.joined(recommend.quick_wins(o), ["rank"], "win", "quick_wins"),
        recommend.joined(recommend.missing_information(o), ["rank"], "missing", "missing_information"),
        A.strategies(o),
        recommend.joined(recommend.first_n(recs, 5, "bucket", "pos", "pos2"), ["rank"], "action", "overall_recommendations"),
        recommend.joined(conflicts, ["a_ord", "b_ord"], "description", "conflict_list"),
        score.deterministic(of).drop("n"), score.overall_quality(of).select("report_id", F.col("overall").alias("quality_overall"), "issues"),
        of.select("report_id", F.col("summary").alias("property_summary"), F.col("recs").alias("n_recommendations")),
    ]
    if inputs is not None:
        parts.append(inputs.select("report_id", score.root_cause(F.col("root_cause")).alias("root_cause")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "report_id", "left")
    return out.withColumn("risk_overview", recommend.risk_overview(F.col("n_critical"), F.col("n_high")))


#: Order of the sections, and whether a new page begins with one.
SECTIONS = [("summary", False), ("findings", True), ("recommendations", True), ("missing", False)]


def report_lines(obs: DataFrame, most: int = 10) -> DataFrame:
    """What a renderer prints, in order: (report_id, section, name, hard_break, seq, text). Sections without lines are left out."""
    return _whole(obs, lambda: _report_lines(obs, most), "lines")


def _report_lines(obs: DataFrame, most: int) -> DataFrame:
    spark = obs.sparkSession
    o = stash(observe.rescore(deduplicated(obs)), "findings")
    recs = recommend.recommendations(o, relations.conflicts(o))
    head = A.kpis(o).select("report_id", F.lit(0).alias("section"), F.lit(0).alias("seq"), F.format_string("%d findings, risk %s", "total", "risk").alias("text"))
    ranked = recommend.top_findings(o, most).select("report_id", F.lit(1).alias("section"), F.col("rank").alias("seq"), F.format_string("[%s] %s: %s", "severity", "area", "observation").alias("text"))
    more = A.kpis(o).where(F.col("total") > most).select("report_id", F.lit(1), F.lit(most + 1), F.format_string("… and %d more", F.col("total") - most))
    actions = recommend.prioritized(recs).select("report_id", F.lit(2), "rank", F.format_string("[%s] %s", "priority", "action"))
    gaps = recommend.missing_information(o).select("report_id", F.lit(3), "rank", "missing")
    names = spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(SECTIONS)], "section int, name string, hard_break boolean")
    return head.union(ranked).union(more).union(actions).union(gaps).join(F.broadcast(names), "section")


def record(obs: DataFrame, inputs: DataFrame) -> DataFrame:
    """The reasoning stage's final record, one for every report of inputs (report_id, errors): texts, lists and status. obs are scored findings.

    A report without findings and with errors has the failed record's texts, one without either says that there is nothing.
    """
    n = obs.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("k"), A.count_of("Critical").alias("c"), A.count_of("High").alias("h"))
    urgent = obs.where(F.col("severity").isin("Critical", "High")).withColumn("low", (F.col("severity") == "High").cast("int"))
    top = urgent.withColumn("rank", F.row_number().over(Window.partitionBy("report_id", "severity").orderBy("ord"))).where("rank <= 3").withColumn("finding", F.concat(F.upper("severity"), F.lit(": "), F.col("observation")))
    j = inputs.select("report_id", "errors").join(n, "report_id", "left").fillna(0, ["n", "k", "c", "h"])
    j = j.join(recommend.joined(top, ["low", "rank"], "finding", "key_findings"), "report_id", "left").join(recommend.joined(recommend.missing_information(obs), ["rank"], "missing", "missing_information"), "report_id", "left")
    c, h, none, failed = F.col("c"), F.col("h"), F.col("n") == 0, F.size("errors") > 0
    text = F.concat(F.format_string("Property assessment identified %d observations across %d categories.", "n", "k"), F.when(c > 0, F.format_string(" %d critical issues require immediate attention.", c)).otherwise(""), F.when(h > 0, F.format_string(" %d high-priority issues need urgent assessment.", h)).otherwise(""))
    return j.select(
        "report_id", F.when(none & failed, "failed").when(failed, "partial").otherwise("ok").alias("status"), F.col("n").alias("n_observations"),
        F.when(none & failed, lx.FAILED_SUMMARY).when(none, lx.NO_OBSERVATIONS).otherwise(text).alias("property_summary"),
        recommend.reasoning_overview(F.col("n"), c, h, F.col("errors")).alias("risk_overview"), F.greatest(F.lit(0), 100 - 20 * c - 10 * h).alias("health"),
        F.coalesce("key_findings", F.lit("")).alias("key_findings"), F.coalesce("missing_information", F.lit("")).alias("missing_information"), F.array_join("errors", "; ").alias("errors"))


def error_record(inputs: DataFrame) -> DataFrame:
    """What stands in for a report whose pipeline has failed: report_id, status, texts, scores of 0 and the errors."""
    return inputs.where(F.size("errors") > 0).select(
        "report_id", F.lit("failed").alias("status"), F.lit("Error occurred during processing").alias("property_summary"), F.lit("Processing error").alias("primary_cause"),
        F.array_join("errors", "; ").alias("contributing_factors"), F.lit("Complete data unavailable").alias("missing_information"), F.lit(0.0).alias("overall_confidence"))
