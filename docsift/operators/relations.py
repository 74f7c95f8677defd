"""Pairs of observations of one report: duplicates, relations and contradictions.

All are equi-joins on the report and a further key, with what else is asked as a filter; never all pairs of a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift import lexicon as lx


def _sides(obs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    keep = ["report_id", "ord", "id", *columns]
    return tuple(obs.select(*[F.col(c).alias(f"{side}_{c}") for c in keep]) for side in "ab")


def _on(*columns: str) -> Column:
    out = F.col("a_report_id") == F.col("b_report_id")
    for c in columns:
        out = out & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return out


def jaccard(a: Column, b: Column) -> Column:
    x, y = (F.filter(F.split(c, " "), lambda w: w != "") for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def duplicate_pairs(obs: DataFrame, limit: float = 0.8) -> DataFrame:
    """Earlier and later finding with equal keys, or of one area and severity with similar token sets."""
    a, b = _sides(obs, "key", "area", "severity")
    order = F.col("a_ord") < F.col("b_ord")
    same = a.join(b, _on("key") & order)
    close = a.join(b, _on("area", "severity") & order & (F.col("a_key") != F.col("b_key")) & (jaccard(F.col("a_key"), F.col("b_key")) >= limit))
    cols = [F.col("a_report_id").alias("report_id"), F.col("a_ord"), F.col("b_ord"), F.col("a_id"), F.col("b_id")]
    return same.select(*cols).union(close.select(*cols))


def leaders(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy groups in order: a finding that no earlier leader has taken leads, and takes what is similar to it.

    By rounds: a finding whose earlier partners have all been taken leads, one with a leading partner is taken by the
    first such. The fold runs over the pairs of a report's findings that have any.
    """
    ties = pairs.groupBy("report_id", F.col("b_ord").alias("ord")).agg(F.sort_array(F.collect_list("a_ord")).alias("before"))
    rows = ties.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("ord", "before"))).alias("rows"))
    # `taken` maps a finding that isn't a leader to its leader.
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))

    def step(taken: Column, row: Column) -> Column:
        lead = F.filter(row["before"], lambda x: ~F.map_contains_key(taken, x))
        return F.when(F.size(lead) > 0, F.map_concat(taken, F.map_from_arrays(F.array(row["ord"]), F.array(F.get(lead, 0))))).otherwise(taken)

    found = rows.select("report_id", F.explode(F.aggregate("rows", empty, step)).alias("ord", "leader"))
    return obs.join(found, ["report_id", "ord"], "left").withColumn("leader", F.coalesce("leader", "ord"))


def merge_groups(led: DataFrame) -> DataFrame:
    """Of each group the finding with the most evidence and images; the first of equals."""
    w = Window.partitionBy("report_id", "leader").orderBy((F.length("evidence") + F.col("n_images")).desc(), "ord")
    return led.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_by_area_category(obs: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.lower("area"), F.lower("category"))
    ev = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "evidence"))), lambda x: x["evidence"]), "; ")
    return obs.groupBy("report_id", key.alias("merge_key")).agg(F.min_by("id", "ord").alias("id"), ev.alias("evidence"), F.sum("n_images").alias("n_images"))


def same_area(obs: DataFrame) -> DataFrame:
    a, b = _sides(obs, "area")
    return a.join(b, _on("area") & (F.col("a_ord") != F.col("b_ord"))).select(F.col("a_report_id").alias("report_id"), F.col("a_id").alias("id"), F.col("b_ord").alias("other_ord"), F.col("b_id").alias("other"))


def same_or_causal(obs: DataFrame) -> DataFrame:
    """Pairs of one category, or whose earlier one's category causes the later one's; both directions are listed."""
    rules = obs.sparkSession.createDataFrame(lx.CAUSES + [(c, c) for c in [*lx.CATEGORIES, lx.OTHER_CATEGORY]], "cause string, effect string")
    a, b = _sides(obs, "category")
    ahead = a.join(F.broadcast(rules), F.col("a_category") == F.col("cause"))
    pairs = ahead.join(b, _on() & (F.col("effect") == F.col("b_category")) & (F.col("a_ord") < F.col("b_ord")))
    there = pairs.select(F.col("a_report_id").alias("report_id"), F.col("a_id").alias("id"), F.col("b_ord").alias("other_ord"), F.col("b_id").alias("other"))
    return there.union(pairs.select("a_report_id", "b_id", "a_ord", "a_id"))


def related(obs: DataFrame) -> DataFrame:
    """Both kinds of relations, repeats kept, counted and listed by finding."""
    both = same_area(obs).withColumn("kind", F.lit(0)).union(same_or_causal(obs).withColumn("kind", F.lit(1)))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "other_ord", "other"))), lambda x: x["other"]), ",")
    return both.groupBy("report_id", "id").agg(F.count(F.lit(1)).alias("n"), ids.alias("related"))


def discrepancies(obs: DataFrame) -> DataFrame:
    a, b = _sides(obs, "area", "category", "severity")
    pairs = a.join(b, _on("area", "category") & (F.col("a_ord") < F.col("b_ord")) & (F.col("a_severity") != F.col("b_severity")))
    text = F.concat(F.lit("Different severity assessments for same area: "), F.col("a_severity"), F.lit(" vs "), F.col("b_severity"))
    return _conflict(pairs, "Discrepancy", "High", 0.7, text)


def contradictions(obs: DataFrame) -> DataFrame:
    """An earlier finding has a rule's word, a later one of the report one of its opposites; the first rule counts."""
    low = F.lower("observation")
    words = [F.when(F.contains(low, F.lit(w)), F.struct(F.lit(i).alias("rule"), F.lit(w).alias("word"))) for i, (w, _) in enumerate(lx.CONTRADICTIONS)]
    against = []
    for i, (_, opposites) in enumerate(lx.CONTRADICTIONS):
        first = F.coalesce(*[F.when(F.contains(low, F.lit(o)), F.lit(o)) for o in opposites])
        against.append(F.when(first.isNotNull(), F.struct(F.lit(i).alias("rule"), first.alias("word"))))
    a, b = (obs.select(*[F.col(c).alias(f"{s}_{c}") for c in ("report_id", "ord", "id")], F.explode(F.array_compact(F.array(*x))).alias(s)) for s, x in (("a", words), ("b", against)))
    pairs = a.join(b, _on() & (F.col("a.rule") == F.col("b.rule")) & (F.col("a_ord") < F.col("b_ord")))
    found = pairs.groupBy("a_report_id", "a_ord", "b_ord", "a_id", "b_id").agg(F.min(F.struct("a.rule", F.col("a.word").alias("w"), F.col("b.word").alias("o"))).alias("r"))
    text = F.concat(F.lit("Contradictory findings: '"), F.col("r.w"), F.lit("' vs '"), F.col("r.o"), F.lit("'"))
    return _conflict(found, "Contradiction", "Very High", 0.9, text)


def _conflict(pairs: DataFrame, kind: str, confidence: str, impact: float, text: Column) -> DataFrame:
    return pairs.select(F.col("a_report_id").alias("report_id"), "a_ord", "b_ord", "a_id", "b_id", F.lit(kind).alias("kind"), text.alias("description"), F.lit(confidence).alias("confidence"), F.lit(impact).alias("impact"))


def conflicts(obs: DataFrame) -> DataFrame:
    """One conflict a pair: a discrepancy if it is one, else a contradiction."""
    a = discrepancies(obs)
    return a.unionByName(contradictions(obs).join(a.select("report_id", "a_id", "b_id"), ["report_id", "a_id", "b_id"], "left_anti"))


def banded_hamming(df: DataFrame, key: str = "vec_id", most: int = 3) -> DataFrame:
    """Pairs whose 64-bit hashes (hi, lo: 32 bits each) differ in `most` bits or fewer.

    With most + 1 bands, two such hashes agree in one band at least, so the equi-join on (band, value) loses none.
    """
    bands = most + 1
    width = -(-64 // bands)
    bits = F.concat(*[F.lpad(F.bin(F.col(c)), 32, "0") for c in ("hi", "lo")])
    values = F.array(*[F.substring(bits, 1 + i * width, width) for i in range(bands)])
    rows = df.select(F.col(key).alias("k"), "hi", "lo", values.alias("values")).select("*", F.posexplode("values").alias("band", "value"))
    a, b = rows.alias("a"), rows.alias("b")
    far = F.bit_count(F.col("a.hi").bitwiseXOR(F.col("b.hi"))) + F.bit_count(F.col("a.lo").bitwiseXOR(F.col("b.lo")))
    first = F.array_position(F.zip_with("a.values", "b.values", lambda x, y: x == y), True) == F.col("a.band") + 1  # so that a pair is met once
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.k") < F.col("b.k")) & (far <= most) & first)
    return met.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), far.alias("distance"))
