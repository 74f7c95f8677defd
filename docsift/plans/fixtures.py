"""Inputs of the report operators, derived from the star schema in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift import lexicon as lx

PHRASES = [
    "critical beam failure near the stair", "severe moisture stain on lower wall", "moderate damp patch behind cabinet",
    "slight leak under window", "dry and sealed, no leak found", "significant wiring fault in loft", "minor outlet wear",
    "moderate duct corrosion", "furnace filter needs cleaning", "pipe joint dripping, repair needed", "minor drain blockage",
    "settlement of the slab, moderate", "base plate shows significant movement", "loose shingle, minor", "gutter detached",
    "fence paint peeling", "carpet worn", "fire hazard with risk to occupants", "danger sign missing", "moderate crack in render",
    "no crack, solid render", "finish undamaged and intact", "visible damage to trim", "all good here",
    "minor stain, clean the grille", "moderate wear, repair the sill", "minor rip",
]
SHORT = len(PHRASES) - 1  # the last phrase stands alone
CONFIDENCE = ["very high", "high", "moderate", "low", "very low", "n/a"]
EVIDENCE = ["", "seen", "photo and thermal scan agree", "photo and thermal scan agree"]


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")

    def pick(values: list[str]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))

    return o.select(
        F.col("o_custkey").alias("report_id"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ord"),
        k.cast("string").alias("id"),
        F.concat(F.lit("Area "), k % 5).alias("area"),
        F.concat(pick(PHRASES), F.when(k % len(PHRASES) == SHORT, "").otherwise(F.concat(F.lit(" lower east service corridor unit "), k % 7))).alias("observation"),
        F.col("o_orderpriority").alias("severity"),
        pick(CONFIDENCE).alias("confidence"),
        pick(EVIDENCE).alias("evidence"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("img/"), k, F.lit(".jpg")))).alias("images"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


RAW_SQL = f"""raw_obs AS (SELECT o_custkey AS report_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS ord, o_orderkey::VARCHAR AS id,
 'Area ' || (o_orderkey % 5) AS area, ({_list(PHRASES)})[o_orderkey % {len(PHRASES)} + 1] || CASE WHEN o_orderkey % {len(PHRASES)} = {SHORT} THEN '' ELSE ' lower east service corridor unit ' || (o_orderkey % 7) END AS observation,
 o_orderpriority AS severity, ({_list(CONFIDENCE)})[o_orderkey % 6 + 1] AS confidence, ({_list(EVIDENCE)})[o_orderkey % 4 + 1] AS evidence,
 CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS n_images, o_orderkey FROM orders)"""

# SQL text for the ordered rules ------------------------------------------------------------------------------------


def s_case(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in rules) + f" ELSE {default} END"


def s_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def s_category(c: str, table=lx.CATEGORIES) -> str:
    return s_case([(s_any(f"lower({c})", w), f"'{n}'") for n, w in table.items()], "'General'")


def s_severity(c: str, score: bool = False) -> str:
    return s_case([(f"contains(lower({c}), '{w}')", f"{s}::DOUBLE" if score else f"'{n}'") for w, n, s in lx.SEVERITIES], "0::DOUBLE" if score else "'Not Available'")


def s_confidence(c: str, score: bool = False) -> str:
    return s_case([(f"contains(lower({c}), '{w}')", f"{s}::DOUBLE" if score else f"'{n}'") for w, n, s in lx.CONFIDENCES], "0.5::DOUBLE" if score else "'Moderate'")


def s_sentence(c: str) -> str:
    t = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {t} = '' THEN '' ELSE upper({t}[1:1]) || {t}[2:] || CASE WHEN regexp_matches({t}, '[.!?]$') THEN '' ELSE '.' END END"


def s_key(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({', '.join(repr(w) for w in lx.STOP_WORDS)})), ' ')"


def s_base(c: str) -> str:
    return s_case([(f"contains(lower({c}), '{w}')", f"{s}::DOUBLE") for w, s in lx.SEVERITY_WORDS], "0::DOUBLE")


def s_rescored(obs: str, cat: str, ev: str) -> str:
    w = s_case([(f"{cat} = '{n}'", f"{x}::DOUBLE") for n, x in lx.CATEGORY_WEIGHTS.items()], "1::DOUBLE")
    base = f"least(1::DOUBLE, ({s_base(obs)}) * ({w}))"
    return f"CASE WHEN len({ev}) > 20 THEN least(1::DOUBLE, {base} * 1.1::DOUBLE) ELSE {base} END"


def s_band(x: str) -> str:
    return s_case([(f"{x} >= {v}::DOUBLE", f"'{n}'") for v, n in lx.SEVERITY_BANDS], "'Information'")


def s_lookup(c: str, table: dict, default: str = "0") -> str:
    return s_case([(f"{c} = '{k}'", str(v)) for k, v in table.items()], default)


OBS_SQL = RAW_SQL + f""", obs AS (SELECT report_id, ord, id, {s_sentence('area')} AS area, {s_sentence('observation')} AS observation, {s_category('observation')} AS category,
 {s_severity('severity')} AS severity, {s_severity('severity', True)} AS severity_score, {s_confidence('confidence')} AS confidence, {s_confidence('confidence', True)} AS confidence_score,
 {s_sentence('evidence')} AS evidence, n_images, {s_key('observation')} AS key FROM raw_obs)"""
SCORED_SQL = OBS_SQL + f""", scored AS (SELECT * REPLACE ({s_rescored('observation', 'category', 'evidence')} AS severity_score, {s_band('(' + s_rescored('observation', 'category', 'evidence') + ')')} AS severity) FROM obs)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.operators.observe import normalize

    return normalize(raw_observations(spark, sf_dir))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes with each report; every tenth customer has a second report without findings."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    two = c.select("*", F.explode(F.when(k % 10 == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))).alias("sign"))
    return two.select(
        F.when(F.col("sign") > 0, k).otherwise(-k - 1).alias("report_id"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "   ").otherwise(F.concat(F.lit(" House of "), F.col("c_name"), F.lit(" "))).alias("property_summary"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("Leak near "), F.col("c_name"))).alias("root_cause"),
        F.when(k % 3 == 0, none).otherwise(F.array(F.lit(" roof plan "), F.lit(" "), F.concat(F.lit("age of "), F.col("c_name")))).alias("missing"),
        F.when(k % 7 < 3, F.array(F.lit("observation_extraction: time-out"), F.concat(F.lit("severity: "), k % 7))).otherwise(none).alias("errors"))


INPUTS_SQL = """inp AS (SELECT CASE WHEN sign > 0 THEN c_custkey ELSE -c_custkey - 1 END AS report_id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE ' House of ' || c_name || ' ' END AS property_summary,
 CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Leak near ' || c_name END AS root_cause, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE [' roof plan ', ' ', 'age of ' || c_name] END AS missing,
 CASE WHEN c_custkey % 7 < 3 THEN ['observation_extraction: time-out', 'severity: ' || (c_custkey % 7)] ELSE [] END AS errors FROM (SELECT *, unnest(CASE WHEN c_custkey % 10 = 0 THEN [1, -1] ELSE [1] END) AS sign FROM customer))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.operators.observe import rescore

    return rescore(observations(spark, sf_dir))
