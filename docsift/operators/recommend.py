"""Rankings, recommendations and the texts of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift import lexicon as lx
from docsift.functions.classify import lookup


def first_n(df: DataFrame, n: int, *order: Column | str, by: str = "report_id") -> DataFrame:
    """The first n rows of each group, with their rank; Spark keeps n rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def top_findings(obs: DataFrame, n: int = 5) -> DataFrame:
    return first_n(obs.withColumn("w", lookup(F.col("severity"), lx.SEVERITY_RANK)), n, F.col("w").desc(), "ord")


def key_findings(obs: DataFrame, n: int = 10) -> DataFrame:
    urgent = obs.where(F.col("severity").isin("Critical", "High"))
    return first_n(urgent.withColumn("finding", F.concat(F.upper("severity"), F.lit(": "), F.col("observation"))), n, F.col("severity") != "Critical", "ord")


def joined(df: DataFrame, order: list[str], text: str, out: str, sep: str = " | ", by: str = "report_id") -> DataFrame:
    return df.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("t")))), lambda x: x["t"]), sep).alias(out))


def keep_first_action(recs: DataFrame, *order: str) -> DataFrame:
    """One row an action of a report, the first; blanks at the ends and case don't tell actions apart."""
    w = Window.partitionBy("report_id", F.lower(F.trim("action"))).orderBy(*order)
    return recs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def recommendations(obs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Actions for findings by severity, by template where there is one, then for conflicts; the first of equal ones stays."""
    spark = obs.sparkSession
    levels = spark.createDataFrame(lx.ACTION_PRIORITY, "severity string, priority string, bucket int")
    templates = spark.createDataFrame([(c, s, t) for (c, s), t in lx.TEMPLATES.items()], "category string, severity string, template string")
    own = obs.join(F.broadcast(levels), "severity").join(F.broadcast(templates), ["category", "severity"], "left")
    a = own.select("report_id", "bucket", F.col("ord").alias("pos"), F.lit(0).alias("pos2"), F.coalesce("template", F.concat(F.lit("Address: "), F.col("observation"))).alias("action"), "priority", "category", F.col("id").alias("ids"))
    b = conflicts.select(
        "report_id", F.lit(4).alias("bucket"), F.col("a_ord").alias("pos"), F.col("b_ord").alias("pos2"),
        F.concat(F.lit("Resolve conflict: "), F.col("description")).alias("action"),
        F.when(F.col("impact") > 0.7, "Immediate").otherwise("Short-Term").alias("priority"), F.lit("Conflict Resolution").alias("category"), F.concat_ws(",", "a_id", "b_id").alias("ids"))
    return keep_first_action(a.unionByName(b), "bucket", "pos", "pos2")


def prioritized(recs: DataFrame, n: int = 20) -> DataFrame:
    ranked = recs.withColumn("prank", lookup(F.col("priority"), lx.PRIORITY_RANK, 4))
    return first_n(keep_first_action(ranked, "prank", "bucket", "pos", "pos2"), n, "prank", "bucket", "pos", "pos2")


def risk_overview(c: Column, h: Column) -> Column:
    return F.when(c > 0, F.format_string("Immediate attention required: %d critical issue(s) identified requiring emergency action.", c)).when(
        h > 0, F.format_string("%d high severity issue(s) identified requiring professional assessment within 48 hours.", h)).otherwise("No critical or high severity issues identified. Property appears to be in generally good condition.")


def reasoning_overview(n: Column, c: Column, h: Column, errors: Column) -> Column:
    """The reasoning stage's wording; a report without findings and with errors says so."""
    return F.when((n == 0) & (F.size(errors) > 0), lx.FAILED_OVERVIEW).when(c > 0, F.format_string("Immediate action required: %d critical issues.", c)).when(
        h > 0, F.format_string("Urgent attention needed: %d high severity issues.", h)).otherwise("No critical or high severity issues identified.")


def summary_lists(recs: DataFrame) -> DataFrame:
    """The reasoning summary's lists: the first three immediate and the first three short-term actions, the immediate ones alone, and the first three long-term ones."""
    low = F.lower("priority")
    kind = F.when(low == "immediate", 0).when(F.contains(low, F.lit("short")), 1).when(F.contains(low, F.lit("long")), 2)
    k = recs.withColumn("kind", kind).where("kind IS NOT NULL")
    top = k.withColumn("rank", F.row_number().over(Window.partitionBy("report_id", "kind").orderBy("bucket", "pos", "pos2"))).where("rank <= 3")

    def listed(test: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("kind", "rank", "action")))), lambda x: x["action"]), " | ")

    return top.groupBy("report_id").agg(listed(F.col("kind") < 2).alias("overall"), listed(F.col("kind") == 0).alias("quick_wins"), listed(F.col("kind") == 2).alias("long_term"))


def quick_wins(obs: DataFrame, n: int = 5) -> DataFrame:
    low = F.lower("observation")
    easy = obs.where(F.col("severity").isin("Low", "Medium") & (F.contains(low, F.lit("clean")) | F.contains(low, F.lit("repair"))))
    return first_n(easy.withColumn("win", F.concat(F.lit("Quick fix: "), F.col("observation"))), n, "ord")


def major_concerns(obs: DataFrame, n: int = 5) -> DataFrame:
    return first_n(obs.where(F.col("severity").isin("Critical", "High")).withColumn("concern", F.concat_ws(": ", "category", "observation")), n, "ord")


def missing_information(obs: DataFrame, n: int = 10) -> DataFrame:
    return first_n(obs.where("evidence = ''").withColumn("missing", F.concat(F.lit("No evidence: "), F.left("observation", F.lit(40)), F.lit("..."))), n, "ord")
