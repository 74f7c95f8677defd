"""Queries of aggregations, relations, scores, rankings and the report."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift import lexicon as lx
from docsift.functions import classify as C
from docsift.functions import text as T
from docsift.operators import aggregates as A
from docsift.operators import recommend as K
from docsift.operators import relations as J
from docsift.operators import report as R
from docsift.operators import score as S
from docsift.plans import fixtures as X
from docsift.registry import query
from docsift.session import stash

o = F.col
HEALTH = "greatest(0, least(100, 100 - 20 * c - 10 * h - 5 * m - 2 * l))"
COUNTS = "SELECT report_id, count(*) AS n, count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m, count(*) FILTER (severity = 'Low') AS l, count(DISTINCT area) AS areas, count(DISTINCT category) AS k FROM scored GROUP BY report_id"


#: Queries that read the findings several times: they are stored first.
STORED = {"j10_conflicts", "sc3_certainty_conflicts", "sc5_reasoning_confidence", "sc8_reasoning", "sc9_conflict_density", "k6_recommendations", "k4_prioritized", "k9_summary_lists"}


def _q(name: str, sql: str | None, make, with_: str = X.SCORED_SQL):
    """A query over the scored observations."""
    @query(name, None if sql is None else f"WITH {with_} {sql}")
    def run(spark, d):
        return make(stash(X.scored(spark, d), "findings") if name in STORED else X.scored(spark, d))

    return run


def _with_recs(x, make):
    """make(findings, conflicts, recommendations), each stored."""
    c = stash(J.conflicts(x), "conflicts")
    return make(x, c, stash(K.recommendations(x, c), "recommendations"))


def _counts(sql: str) -> str:
    return f", t AS ({COUNTS}) {sql}"


RISK = "CASE WHEN c > 0 THEN 'Critical' WHEN h > 0 THEN 'High' WHEN m > 0 THEN 'Medium' ELSE 'Low' END"
ASSESS = "SELECT report_id, arg_max(severity, n * 1000000000 - first) AS overall, string_agg(severity || ':' || n, ',' ORDER BY first) AS distribution, {} AS mean_score FROM (SELECT report_id, severity, count(*) AS n, min(ord) AS first, sum(severity_score) AS s FROM scored GROUP BY ALL) GROUP BY report_id"
_q("a3_severity_assessment", ASSESS.format("round((sum(s) / sum(n))::DECIMAL(18, 9), 3)::DOUBLE"), A.severity_assessment)
_q("a4_severity_assessment_exact", ASSESS.format("sum(s) / sum(n)"), lambda x: A.severity_assessment(x, False))
_q("a5_kpis", _counts(f"SELECT report_id, n AS total, c AS n_critical, h AS n_high, m AS n_medium, l AS n_low, areas, {RISK} AS risk, greatest(0, 100 - 20 * c - 10 * h - 5 * m - 2 * l) / 100::DOUBLE AS confidence FROM t"), A.kpis)
_q("a6_health", _counts(f"SELECT report_id, {HEALTH}::INT AS health FROM t"), A.health)
_q("a7_health_reasoning", _counts("SELECT report_id, greatest(0, 100 - 20 * c - 10 * h)::BIGINT AS health FROM t"), lambda x: x.groupBy("report_id").agg(F.greatest(F.lit(0), 100 - 20 * A.count_of("Critical") - 10 * A.count_of("High")).alias("health")))
_q("a8_health_band", _counts(f"SELECT report_id, CASE WHEN {HEALTH} >= 90 THEN 'Excellent' WHEN {HEALTH} >= 75 THEN 'Good' WHEN {HEALTH} >= 60 THEN 'Fair' WHEN {HEALTH} >= 40 THEN 'Poor' ELSE 'Critical' END AS band FROM t"), lambda x: A.health(x).select("report_id", A.health_band(o("health")).alias("band")))
_q("a9_breakdown", ", dim AS (SELECT * FROM (VALUES (0, 'Critical', 'Severe'), (1, 'High', 'Significant'), (2, 'Medium', 'Moderate'), (3, 'Low', 'Minor'), (4, 'Information', 'Informational')) v(pos, severity, impact)), r AS (SELECT DISTINCT report_id FROM scored) SELECT r.report_id, pos, dim.severity, count(s.id) AS n, impact, CASE WHEN count(s.id) = 0 THEN 'OK' ELSE '!' END AS status FROM r CROSS JOIN dim LEFT JOIN scored s ON s.report_id = r.report_id AND s.severity = dim.severity GROUP BY ALL", A.breakdown)
PCT = ", ".join(f"{x} / n * 100::DOUBLE AS pct_{s}" for x, s in (("c", "critical"), ("h", "high"), ("m", "medium"), ("l", "low")))
_q("a10_distribution", _counts(f"SELECT report_id, {PCT} FROM t"), A.distribution)
_q("a11_client_bars", _counts(f"SELECT report_id, {PCT.replace('/ n', '/ greatest(n, 1)')} FROM t"), lambda x: A.distribution(x, 1))
_q("a12_areas", "SELECT report_id, count(DISTINCT area) AS areas FROM scored GROUP BY report_id", lambda x: x.groupBy("report_id").agg(F.count_distinct("area").alias("areas")))
_q("a12_areas_approx", "SELECT report_id, count(DISTINCT area) AS areas FROM scored GROUP BY report_id", lambda x: x.groupBy("report_id").agg(F.approx_count_distinct("area").alias("areas")))
_q("a13_category_summary", _counts("SELECT report_id, rtrim('Property assessment identified ' || n || ' observations across ' || k || ' categories. ' || CASE WHEN c > 0 THEN c || ' critical issues require immediate attention. ' ELSE '' END || CASE WHEN h > 0 THEN h || ' high-priority issues need urgent assessment. ' ELSE '' END) AS summary FROM t"), A.by_category)
_q("a14_ids_by_area", "SELECT report_id, area, string_agg(id, ',' ORDER BY ord) AS ids FROM scored GROUP BY ALL", lambda x: A.ids_by(x, "area"))
_q("a15_ids_by_severity", "SELECT report_id, severity, string_agg(id, ',' ORDER BY ord) AS ids FROM scored GROUP BY ALL", lambda x: A.ids_by(x, "severity"))
FIXED = ", ".join(f"'{s}'" for s in lx.STRATEGIES[:3])
_q("a16_strategies", f"SELECT report_id, array_to_string(list_concat(coalesce(list('Long-term ' || category || ' maintenance plan needed based on ' || n || ' observations' ORDER BY first) FILTER (n >= 3), []), [{FIXED}])[1:5], ' | ') AS strategies FROM (SELECT report_id, category, count(*) AS n, min(ord) AS first FROM scored GROUP BY ALL) GROUP BY report_id", A.strategies)
_q("a22_mean_scores", "SELECT report_id, avg(severity_score) AS severity, avg(confidence_score) AS confidence FROM scored GROUP BY report_id", lambda x: x.groupBy("report_id").agg(F.avg("severity_score").alias("severity"), F.avg("confidence_score").alias("confidence")))
_q("rollup_area_category_severity", "SELECT area, category, severity, count(*) AS n FROM scored GROUP BY ROLLUP (area, category, severity)", lambda x: x.rollup("area", "category", "severity").agg(F.count(F.lit(1)).alias("n")))
_q("cube_area_severity", "SELECT area, severity, count(*) AS n FROM scored GROUP BY CUBE (area, severity)", lambda x: x.cube("area", "severity").agg(F.count(F.lit(1)).alias("n")))
_q("pivot_severity", _counts("SELECT report_id, nullif(c, 0) AS critical, nullif(h, 0) AS high FROM t WHERE c + h > 0 OR n > 0"), lambda x: x.groupBy("report_id").pivot("severity", ["Critical", "High"]).count().select("report_id", o("Critical").alias("critical"), o("High").alias("high")))
_q("c13_client_severity", _counts("SELECT report_id, CASE WHEN c > 0 THEN 'Critical' WHEN h > 0 THEN 'High' ELSE 'Medium' END AS severity FROM t"), lambda x: A.kpis(x).select("report_id", F.when(o("n_critical") > 0, "Critical").when(o("n_high") > 0, "High").otherwise("Medium").alias("severity")))

# Documents as lists of pages: their lines -------------------------------------------------------------------------
PAGES_SQL = "pg AS (SELECT doc_id, i AS page_number, CASE WHEN len(p) % 17 = 0 THEN '' ELSE p END AS text, CASE WHEN len(p) % 17 = 0 THEN 'unreadable' END AS error, len(p) BETWEEN 1 AND 60 AS heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
STATS_SQL = PAGES_SQL + ", st AS (SELECT doc_id, count(*) AS total_pages, count(*) FILTER (len(text) > 0) AS pages_with_text, count(error) AS failed_pages, sum(len(text))::BIGINT AS chars, count(*) FILTER (heading) AS sections, round(count(*) FILTER (len(text) > 0) / count(*), 3) AS rate, count(*) FILTER (len(text) > 0) / count(*) < 0.2 AS likely_scanned FROM pg GROUP BY doc_id)"


def _line_pages(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "p"))
    bad = F.length("p") % 17 == 0
    return x.select("doc_id", (o("i") + 1).alias("page_number"), F.when(bad, "").otherwise(o("p")).alias("text"), F.when(bad, "unreadable").alias("error"), F.length("p").between(1, 60).alias("heading"))


@query("a1_extraction_statistics", f"WITH {STATS_SQL} SELECT * FROM st")
def a1(spark, d):
    return A.extraction_statistics(_line_pages(spark, d))


@query("a2_document_quality", f"""WITH {STATS_SQL} SELECT doc_id, greatest(0::DOUBLE, least(1::DOUBLE, round(1::DOUBLE - CASE WHEN likely_scanned THEN 0.5::DOUBLE ELSE 0 END - least(0.3::DOUBLE, 0.05::DOUBLE * failed_pages) - CASE WHEN rate < 0.5 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN sections = 0 AND total_pages > 1 THEN 0.1::DOUBLE ELSE 0 END, 2))) AS score,
 coalesce(nullif(array_to_string(list_filter([CASE WHEN likely_scanned THEN 'scanned' END, CASE WHEN failed_pages > 0 THEN failed_pages || ' page(s) failed' END, CASE WHEN rate < 0.5 THEN 'few pages with text' END, CASE WHEN sections = 0 AND total_pages > 1 THEN 'no sections' END], lambda x: x IS NOT NULL), '; '), ''), 'none') AS reasons FROM st""")
def a2(spark, d):
    return A.document_quality(A.extraction_statistics(_line_pages(spark, d)))


@query("a17_actions_by_priority", f"WITH {X.RAW_SQL} SELECT report_id, priority, count(*) AS n, string_agg(id, ',' ORDER BY ord) AS ids FROM (SELECT *, {X.s_case([(X.s_any('lower(severity)', w), repr(p)) for w, p in lx.PRIORITY_WORDS], repr('Preventive'))} AS priority FROM raw_obs) GROUP BY ALL")
def a17(spark, d):
    raw = X.raw_observations(spark, d).withColumn("priority", C.priority_of_text(o("severity")))
    return raw.groupBy("report_id", "priority").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]), ",").alias("ids"))


IMG_SQL = "im AS (SELECT p_size AS width, floor(p_retailprice)::BIGINT AS height, p_size / 50::DOUBLE AS score, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'gif' END AS format FROM part{})"
IMG_STATS = " SELECT count(*) AS images, coalesce(floor(avg(width))::BIGINT || 'x' || floor(avg(height))::BIGINT, '0x0') AS mean_size, count(*) FILTER (score > 0.8::DOUBLE) AS excellent, count(*) FILTER (score > 0.6::DOUBLE AND score <= 0.8::DOUBLE) AS good, count(*) FILTER (score > 0.4::DOUBLE AND score <= 0.6::DOUBLE) AS fair, count(*) FILTER (score <= 0.4::DOUBLE) AS poor, coalesce((SELECT string_agg(format || ':' || n, ',' ORDER BY format) FROM (SELECT format, count(*) AS n FROM im GROUP BY format)), '') AS formats FROM im"


def _images(spark, d):
    k = o("p_partkey") % 3
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", o("p_size").alias("width"), F.floor("p_retailprice").alias("height"), (o("p_size") / F.lit(50.0)).alias("score"), F.when(k == 0, "png").when(k == 1, "jpg").otherwise("gif").alias("format"))


@query("a18_image_stats", "WITH " + IMG_SQL.format("") + IMG_STATS)
def a18(spark, d):
    return A.image_stats(_images(spark, d))


@query("a18_image_stats_empty", "WITH " + IMG_SQL.format(" WHERE p_size < 0") + IMG_STATS)
def a18_empty(spark, d):
    return A.image_stats(_images(spark, d).where("width < 0"))


@query("a19_extraction_report", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 2) AS mean_chars, round(avg(n_chars / 1024::DOUBLE), 2) AS mean_kb FROM documents")
def a19(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.round(F.avg(o("n_chars") / F.lit(1024.0)), 2).alias("mean_kb"))


@query("a20_metrics_summary", "SELECT event_type, count(*) AS n, avg(value) AS mean, min(value) AS least, max(value) AS most, sum(value) AS total FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY event_type")
def a20(spark, d):
    last = spark.read.parquet(f"{d}/events.parquet").orderBy(o("ts").desc(), o("event_id").desc()).limit(1000)
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("total"))


@query("a21_running_average", "SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mean FROM events")
def a21(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.avg("value").over(w).alias("mean"))


# Relations ----------------------------------------------------------------------------------------------------------
TOK = "list_filter(string_split({}.key, ' '), lambda w: w <> '')"
JAC = f"len(list_intersect({TOK.format('a')}, {TOK.format('b')})) / len(list_distinct(list_concat({TOK.format('a')}, {TOK.format('b')})))::DOUBLE"
DUP_SQL = X.OBS_SQL + f", dup AS (SELECT a.report_id, a.ord AS a_ord, b.ord AS b_ord, a.id AS a_id, b.id AS b_id FROM obs a JOIN obs b ON a.report_id = b.report_id AND a.ord < b.ord WHERE a.key = b.key OR (a.area = b.area AND a.severity = b.severity AND {JAC} >= 0.8))"


@query("j1_duplicate_pairs", f"WITH {DUP_SQL} SELECT * FROM dup")
def j1(spark, d):
    return J.duplicate_pairs(X.observations(spark, d))


LEAD_SQL = "WITH RECURSIVE " + DUP_SQL + """, step AS (
 SELECT report_id, 1 AS ord, [1] AS leaders, 1 AS leader FROM obs WHERE ord = 1
 UNION ALL
 SELECT s.report_id, s.ord + 1, CASE WHEN f.lead IS NULL THEN list_append(s.leaders, s.ord + 1) ELSE s.leaders END, coalesce(f.lead, s.ord + 1)
 FROM step s JOIN obs o ON o.report_id = s.report_id AND o.ord = s.ord + 1
 LEFT JOIN LATERAL (SELECT min(a_ord) AS lead FROM dup WHERE dup.report_id = s.report_id AND dup.b_ord = s.ord + 1 AND list_contains(s.leaders, a_ord)) f ON true)"""


@query("j2_leader_groups", LEAD_SQL + " SELECT o.id, o.ord, s.leader FROM step s JOIN obs o ON o.report_id = s.report_id AND o.ord = s.ord")
def j2(spark, d):
    obs = X.observations(spark, d)
    return J.leaders(obs, J.duplicate_pairs(obs)).select("id", "ord", "leader")


@query("j3_merge_groups", LEAD_SQL + " SELECT id, leader FROM (SELECT o.id, s.leader, row_number() OVER (PARTITION BY o.report_id, s.leader ORDER BY len(o.evidence) + o.n_images DESC, o.ord) AS r FROM step s JOIN obs o ON o.report_id = s.report_id AND o.ord = s.ord) WHERE r = 1")
def j3(spark, d):
    obs = X.observations(spark, d)
    return J.merge_groups(J.leaders(obs, J.duplicate_pairs(obs))).select("id", "leader")


_q("j4_merge_area_category", "SELECT report_id, lower(area) || ':' || lower(category) AS merge_key, arg_min(id, ord) AS id, string_agg(evidence, '; ' ORDER BY ord) AS evidence, sum(n_images)::BIGINT AS n_images FROM scored GROUP BY ALL", J.merge_by_area_category)
AREA_SQL = "SELECT a.report_id, a.id, b.ord AS other_ord, b.id AS other FROM scored a JOIN scored b ON a.report_id = b.report_id AND a.area = b.area AND a.ord <> b.ord"
CAUSE = " OR ".join(f"(a.category = '{x}' AND b.category = '{y}')" for x, y in lx.CAUSES)
CAUSE_SQL = f", fwd AS (SELECT a.report_id, a.id AS aid, b.id AS bid, a.ord AS ao, b.ord AS bo FROM scored a JOIN scored b ON a.report_id = b.report_id AND a.ord < b.ord AND (a.category = b.category OR {CAUSE})), caus AS (SELECT report_id, aid AS id, bo AS other_ord, bid AS other FROM fwd UNION ALL SELECT report_id, bid, ao, aid FROM fwd)"
_q("j5_same_area", AREA_SQL, J.same_area)
_q("j6_same_or_causal", CAUSE_SQL + " SELECT * FROM caus", J.same_or_causal)
_q("j7_related", CAUSE_SQL + f", bth AS (SELECT *, 0 AS kind FROM ({AREA_SQL}) UNION ALL SELECT *, 1 FROM caus) SELECT report_id, id, count(*) AS n, string_agg(other, ',' ORDER BY kind, other_ord) AS related FROM bth GROUP BY ALL", J.related)
DISC = "SELECT a.report_id, a.ord AS a_ord, b.ord AS b_ord, a.id AS a_id, b.id AS b_id, 'Discrepancy' AS kind, 'Different severity assessments for same area: ' || a.severity || ' vs ' || b.severity AS description, 'High' AS confidence, 0.7::DOUBLE AS impact FROM scored a JOIN scored b ON a.report_id = b.report_id AND a.ord < b.ord AND a.area = b.area AND a.category = b.category AND a.severity <> b.severity"
RULE = X.s_case([(f"contains(lower(a.observation), '{w}') AND contains(lower(b.observation), '{x}')", f"'''{w}'' vs ''{x}'''") for w, xs in lx.CONTRADICTIONS for x in xs], "NULL")
CONTRA = f"SELECT a.report_id, a.ord AS a_ord, b.ord AS b_ord, a.id AS a_id, b.id AS b_id, 'Contradiction' AS kind, 'Contradictory findings: ' || {RULE} AS description, 'Very High' AS confidence, 0.9::DOUBLE AS impact FROM scored a JOIN scored b ON a.report_id = b.report_id AND a.ord < b.ord WHERE {RULE} IS NOT NULL"
CONF_SQL = f", disc AS ({DISC}), contra AS ({CONTRA}), conf AS (SELECT * FROM disc UNION ALL SELECT * FROM contra c WHERE NOT EXISTS (SELECT 1 FROM disc d WHERE d.a_id = c.a_id AND d.b_id = c.b_id))"
_q("j8_discrepancies", DISC, J.discrepancies)
_q("j9_contradictions", CONTRA, J.contradictions)
_q("j10_conflicts", CONF_SQL + " SELECT * FROM conf", J.conflicts)


@query("j11_exact_duplicates", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def j11(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("j13_two_source_pairing", "SELECT d.doc_id, d.n_chars AS inspection, l.quality AS thermal FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j13(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", o("n_chars").alias("inspection"), o("quality").alias("thermal"))


@query("j14_image_lists", "SELECT 'i' AS src, p_partkey AS id FROM part WHERE p_size > 25 UNION ALL SELECT 't', s_suppkey FROM supplier")
def j14(spark, d):
    a = spark.read.parquet(f"{d}/part.parquet").where("p_size > 25").select(F.lit("i").alias("src"), o("p_partkey").alias("id"))
    return a.union(spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("t"), "s_suppkey"))


@query("j15_same_name_size", "SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.source = b.source AND a.n_chars = b.n_chars AND a.doc_id < b.doc_id")
def j15(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars")
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, (o("a.source") == o("b.source")) & (o("a.n_chars") == o("b.n_chars")) & (o("a.doc_id") < o("b.doc_id"))).select(o("a.doc_id").alias("a"), o("b.doc_id").alias("b"))


# Scores -------------------------------------------------------------------------------------------------------------
OQ = "(CASE WHEN len(evidence) > {} THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN n_images > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN confidence_score >= 0.7::DOUBLE THEN 0.4::DOUBLE ELSE 0 END)"
CN = CONF_SQL + ", nc AS (SELECT report_id, count(*) AS conflicts FROM conf GROUP BY report_id)"
_q("sc2_observation_quality", f"SELECT report_id, avg({OQ.format(0)}) AS quality, avg({OQ.format(10)}) AS strict FROM scored GROUP BY report_id", lambda x: x.groupBy("report_id").agg(F.avg(S.observation_quality(o("evidence"), o("n_images"), o("confidence_score"))).alias("quality"), F.avg(S.observation_quality(o("evidence"), o("n_images"), o("confidence_score"), 10)).alias("strict")))
_q("sc3_certainty_conflicts", CN + " SELECT s.report_id, avg(confidence_score) AS certainty, 1 - least(1::DOUBLE, 0.1::DOUBLE * coalesce(max(conflicts), 0)) AS conflict_score FROM scored s LEFT JOIN nc USING (report_id) GROUP BY s.report_id",
   lambda x: x.groupBy("report_id").agg(F.coalesce(F.avg("confidence_score"), F.lit(0.5)).alias("certainty")).join(J.conflicts(x).groupBy("report_id").agg(F.count(F.lit(1)).alias("n")), "report_id", "left").select("report_id", "certainty", S.conflict_score(F.coalesce("n", F.lit(0))).alias("conflict_score")))
COMP = "(CASE WHEN area <> 'Unknown' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN len(observation) > 10 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN category <> 'General' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN evidence <> '' THEN 0.2::DOUBLE ELSE 0 END)"
WC = "len(string_split(observation, ' '))"
RQ = f"least(1::DOUBLE, least(0.4::DOUBLE, {WC} / 20::DOUBLE) + CASE WHEN evidence <> '' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN severity_score > 0 THEN 0.3::DOUBLE ELSE 0 END)"
EQ = "CASE WHEN evidence = '' THEN 0::DOUBLE ELSE least(1::DOUBLE, least(0.5::DOUBLE, len(evidence) / 500::DOUBLE) + 0.1::DOUBLE + 0.2::DOUBLE * confidence_score) END"


def _evidence(x):
    has = o("evidence") != ""
    none = F.array().cast("array<string>")
    return S.evidence_quality(F.when(has, F.array("evidence")).otherwise(none), F.when(has, F.array(C.evidence_source(o("evidence")))).otherwise(none), F.when(has, F.array("confidence_score")).otherwise(F.array().cast("array<double>")))


_q("sc6_evidence_quality", f"SELECT id, {EQ} AS quality FROM scored", lambda x: x.select("id", _evidence(x).alias("quality")))
_q("sc7_completeness", f"SELECT report_id, avg({COMP}) AS completeness FROM scored GROUP BY report_id", lambda x: x.groupBy("report_id").agg(F.avg(S.completeness(o("area"), o("observation"), o("category"), o("evidence"))).alias("completeness")))
_q("sc10_reasoning_quality", f"SELECT report_id, avg({RQ}) AS quality FROM scored GROUP BY report_id", lambda x: x.groupBy("report_id").agg(F.avg(S.reasoning_quality(T.word_count(o("observation")), o("evidence"), o("severity_score"))).alias("quality")))


def _reasoning(x):
    a = x.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence_score").alias("mc"), F.avg(_evidence(x)).alias("evidence_quality"), F.avg(S.completeness(o("area"), o("observation"), o("category"), o("evidence"))).alias("completeness"), F.avg(S.reasoning_quality(T.word_count(o("observation")), o("evidence"), o("severity_score"))).alias("quality"))
    c = J.conflicts(x).groupBy("report_id").agg(F.count(F.lit(1)).alias("k"))
    j = a.join(c, "report_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return j.withColumn("reasoning", S.reasoning(o("mc"), o("k"))).withColumn("density", S.conflict_density(o("k"), o("n")))


RS = CN + f", rs AS (SELECT s.report_id, count(*) AS n, avg(confidence_score) * (1 - least(1::DOUBLE, 0.05::DOUBLE * coalesce(max(conflicts), 0))) AS reasoning, least(1::DOUBLE, 2::DOUBLE * coalesce(max(conflicts), 0) / count(*)) AS density, avg({EQ}) AS eq, avg({COMP}) AS comp, avg({RQ}) AS q FROM scored s LEFT JOIN nc USING (report_id) GROUP BY s.report_id)"
_q("sc5_reasoning_confidence", RS + " SELECT report_id, least(1::DOUBLE, 0.2::DOUBLE * eq + 0.2::DOUBLE * comp + 0.25::DOUBLE * reasoning + 0.15::DOUBLE * (1 - density) + 0.2::DOUBLE * q) AS confidence FROM rs",
   lambda x: _reasoning(x).select("report_id", F.least(F.lit(1.0), F.lit(0.2) * o("evidence_quality") + F.lit(0.2) * o("completeness") + F.lit(0.25) * o("reasoning") + F.lit(0.15) * (1 - o("density")) + F.lit(0.2) * o("quality")).alias("confidence")))
_q("sc8_reasoning", RS + " SELECT report_id, reasoning FROM rs", lambda x: _reasoning(x).select("report_id", "reasoning"))
_q("sc9_conflict_density", RS + " SELECT report_id, density FROM rs", lambda x: _reasoning(x).select("report_id", "density"))

# Rankings -----------------------------------------------------------------------------------------------------------
RANK = X.s_lookup("severity", lx.SEVERITY_RANK)
K1_SQL = "(SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY {} DESC, ord)::INT AS rank FROM scored)".format(RANK)
_q("k1_top_findings", f"SELECT report_id, id, rank FROM {K1_SQL} WHERE rank <= 5", lambda x: K.top_findings(x).select("report_id", "id", "rank"))
_q("k2_key_findings", "SELECT report_id, rank, finding FROM (SELECT report_id, upper(severity) || ': ' || observation AS finding, row_number() OVER (PARTITION BY report_id ORDER BY severity <> 'Critical', ord)::INT AS rank FROM scored WHERE severity IN ('Critical', 'High')) WHERE rank <= 10", lambda x: K.key_findings(x).select("report_id", "rank", "finding"))
_q("k3_three_each", "SELECT report_id, severity, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY report_id, severity ORDER BY ord)::INT AS rank FROM scored WHERE severity IN ('Critical', 'High')) WHERE rank <= 3",
   lambda x: x.where(o("severity").isin("Critical", "High")).withColumn("rank", F.row_number().over(Window.partitionBy("report_id", "severity").orderBy("ord"))).where("rank <= 3").select("report_id", "severity", "id", "rank"))
TEMPLATE = X.s_case([(f"category = '{c}' AND severity = '{s}'", f"'{t}'") for (c, s), t in lx.TEMPLATES.items()], "'Address: ' || observation")
RECS = CONF_SQL + f""", rec0 AS (SELECT report_id, {X.s_lookup('severity', {s: b for s, _, b in lx.ACTION_PRIORITY}, 'NULL')} AS bucket, ord AS pos, 0 AS pos2, {TEMPLATE} AS action, {X.s_lookup('severity', {s: repr(p) for s, p, _ in lx.ACTION_PRIORITY}, 'NULL')} AS priority, category, id AS ids FROM scored WHERE severity IN ('Critical', 'High', 'Medium', 'Low')
 UNION ALL SELECT report_id, 4, a_ord, b_ord, 'Resolve conflict: ' || description, CASE WHEN impact > 0.7::DOUBLE THEN 'Immediate' ELSE 'Short-Term' END, 'Conflict Resolution', a_id || ',' || b_id FROM conf),
 rec AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY report_id, lower(trim(action)) ORDER BY bucket, pos, pos2) AS r FROM rec0) WHERE r = 1)"""
REC_COLS = ["report_id", "bucket", "pos", "pos2", "action", "priority", "category", "ids"]
_q("k6_recommendations", RECS + " SELECT * FROM rec", lambda x: K.recommendations(x, J.conflicts(x)).select(*REC_COLS))
PR = X.s_lookup("priority", lx.PRIORITY_RANK, "4")
_q("k4_prioritized", RECS + f" SELECT report_id, action, rank FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY {PR}, bucket, pos, pos2)::INT AS rank FROM rec) WHERE rank <= 20", lambda x: K.prioritized(K.recommendations(x, J.conflicts(x))).select("report_id", "action", "rank"))
_q("k5_first_actions", f"SELECT report_id, id FROM (SELECT report_id, id, row_number() OVER (PARTITION BY report_id, lower(trim({TEMPLATE})) ORDER BY ord) AS r FROM scored) WHERE r = 1",
   lambda x: K.keep_first_action(x.withColumn("action", F.coalesce(*[F.when((o("category") == c) & (o("severity") == s), F.lit(t)) for (c, s), t in lx.TEMPLATES.items()], F.concat(F.lit("Address: "), o("observation")))), "ord").select("report_id", "id"))
_q("k7_heuristic", "SELECT report_id, id, 'Immediate inspection and repair of ' || area AS action FROM scored WHERE ord <= 5 AND severity IN ('Critical', 'High')", lambda x: x.where((o("ord") <= 5) & o("severity").isin("Critical", "High")).select("report_id", "id", F.concat(F.lit("Immediate inspection and repair of "), o("area")).alias("action")))
_q("k8_concerns", "SELECT report_id, rank, concern FROM (SELECT report_id, category || ': ' || observation AS concern, row_number() OVER (PARTITION BY report_id ORDER BY ord)::INT AS rank FROM scored WHERE severity IN ('Critical', 'High')) WHERE rank <= 5", lambda x: K.major_concerns(x).select("report_id", "rank", "concern"))
_q("k8_quick_wins", "SELECT report_id, rank, win FROM (SELECT report_id, 'Quick fix: ' || observation AS win, row_number() OVER (PARTITION BY report_id ORDER BY ord)::INT AS rank FROM scored WHERE severity IN ('Low', 'Medium') AND (contains(lower(observation), 'clean') OR contains(lower(observation), 'repair'))) WHERE rank <= 5", lambda x: K.quick_wins(x).select("report_id", "rank", "win"))
KIND = "CASE WHEN lower(priority) = 'immediate' THEN 0 WHEN contains(lower(priority), 'short') THEN 1 WHEN contains(lower(priority), 'long') THEN 2 END"
_q("k9_summary_lists", RECS + f""", kl AS (SELECT *, row_number() OVER (PARTITION BY report_id, kind ORDER BY bucket, pos, pos2) AS r FROM (SELECT *, {KIND} AS kind FROM rec) WHERE kind IS NOT NULL)
 SELECT report_id, coalesce(string_agg(action, ' | ' ORDER BY kind, r) FILTER (kind < 2), '') AS overall, coalesce(string_agg(action, ' | ' ORDER BY r) FILTER (kind = 0), '') AS quick_wins, coalesce(string_agg(action, ' | ' ORDER BY r) FILTER (kind = 2), '') AS long_term FROM kl WHERE r <= 3 GROUP BY report_id""",
   lambda x: K.summary_lists(K.recommendations(x, J.conflicts(x))))
_q("k9_critical_observations", "SELECT report_id, string_agg(id, ',' ORDER BY ord) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS r FROM scored WHERE severity = 'Critical') WHERE r <= 5 GROUP BY report_id", lambda x: K.joined(K.first_n(x.where("severity = 'Critical'"), 5, "ord"), ["rank"], "id", "ids", ","))
OVERVIEW = "CASE WHEN c > 0 THEN 'Immediate attention required: ' || c || ' critical issue(s) identified requiring emergency action.' WHEN h > 0 THEN h || ' high severity issue(s) identified requiring professional assessment within 48 hours.' ELSE 'No critical or high severity issues identified. Property appears to be in generally good condition.' END"
_q("k10_risk_overview", _counts(f"SELECT report_id, {OVERVIEW} AS overview FROM t"), lambda x: A.kpis(x).select("report_id", K.risk_overview(o("n_critical"), o("n_high")).alias("overview")))
MISSING = "SELECT report_id, rank, missing FROM (SELECT report_id, 'No evidence: ' || left(observation, 40) || '...' AS missing, row_number() OVER (PARTITION BY report_id ORDER BY ord)::INT AS rank FROM scored WHERE evidence = '') WHERE rank <= 10"
_q("k11_missing_information", MISSING, lambda x: K.missing_information(x).select("report_id", "rank", "missing"))
_q("k12_input_caps", "SELECT report_id, id, left(observation, 30) AS text FROM scored WHERE ord <= 20", lambda x: K.first_n(x, 20, "ord").select("report_id", "id", F.left("observation", F.lit(30)).alias("text")))
_q("k13_renderer_caps", "SELECT report_id, count(*) FILTER (ord <= 10) AS shown, CASE WHEN count(*) > 10 THEN '… and ' || (count(*) - 10) || ' more' END AS more FROM scored GROUP BY report_id", lambda x: x.groupBy("report_id").agg(F.count_if(o("ord") <= 10).alias("shown"), F.when(F.count(F.lit(1)) > 10, F.concat(F.lit("… and "), F.count(F.lit(1)) - 10, F.lit(" more"))).alias("more")))
_q("k14_urgent", "SELECT id FROM scored WHERE severity IN ('Critical', 'High')", lambda x: x.where(o("severity").isin("Critical", "High")).select("id"))
T_A, T_B = (f"list_distinct(list_filter(string_split({x}.key, ' '), lambda w: w <> ''))" for x in "ab")
_q("k15_token_sets", f"SELECT a.id, array_to_string(list_sort(list_intersect({T_A}, {T_B})), ' ') AS both, array_to_string(list_sort(list_distinct(list_concat({T_A}, {T_B}))), ' ') AS either, array_to_string(list_sort(list_filter({T_A}, lambda w: NOT list_contains({T_B}, w))), ' ') AS only FROM scored a JOIN scored b ON b.report_id = a.report_id AND b.ord = a.ord + 1", lambda x: _sets(x))


def _sets(x):
    tok = F.array_distinct(F.filter(F.split("key", " "), lambda w: w != ""))
    nxt = x.withColumn("t", tok).withColumn("u", F.lead("t").over(Window.partitionBy("report_id").orderBy("ord"))).where("u IS NOT NULL")
    return nxt.select("id", *[F.array_join(F.sort_array(f("t", "u")), " ").alias(n) for n, f in (("both", F.array_intersect), ("either", F.array_union), ("only", F.array_except))])


# What comes with a report, and its sections --------------------------------------------------------------------------
SUMMARY = f"CASE WHEN coalesce(property_summary, '') = '' THEN '{lx.NO_SUMMARY}' ELSE trim(property_summary) END"
CAUSE_TEXT = f"CASE WHEN coalesce(root_cause, '') = '' THEN '{lx.NO_ROOT_CAUSE}' ELSE root_cause END"


def _inputs(name: str, sql: str, make):
    @query(name, f"WITH {X.INPUTS_SQL} SELECT {sql} FROM inp")
    def run(spark, d):
        return make(X.inputs(spark, d))

    return run


_inputs("k17_defaults", f"report_id, {SUMMARY} AS summary, {CAUSE_TEXT} AS root_cause", lambda i: i.select("report_id", S.property_summary(o("property_summary")).alias("summary"), S.root_cause(o("root_cause")).alias("root_cause")))
_inputs("k11_given_missing", f"report_id, CASE WHEN len(missing) = 0 THEN '{lx.NOTHING_MISSING}' ELSE array_to_string(list_filter(list_transform(missing, lambda x: trim(x)), lambda x: x <> ''), '; ') END AS missing", lambda i: i.select("report_id", F.array_join(S.missing_information(o("missing")), "; ").alias("missing")))


@query("x4_error_record", f"WITH {X.INPUTS_SQL} SELECT report_id, 'failed' AS status, 'Error occurred during processing' AS property_summary, 'Processing error' AS primary_cause, array_to_string(errors, '; ') AS contributing_factors, 'Complete data unavailable' AS missing_information, 0::DOUBLE AS overall_confidence FROM inp WHERE len(errors) > 0")
def x4(spark, d):
    return R.error_record(X.inputs(spark, d))


SECTIONS_SQL = f"""nc AS (SELECT report_id, count(*) AS conflicts FROM conf GROUP BY report_id),
 ob AS (SELECT report_id, count(*) AS n, avg({OQ.format(0)}) AS q, avg({OQ.format(10)}) AS strict, avg(confidence_score) AS certainty, count(*) FILTER (severity IN ('Critical', 'High')) AS keys, count(*) FILTER (confidence_score < 0.4::DOUBLE) AS unsure FROM scored GROUP BY report_id),
 rc AS (SELECT report_id, count(*) AS recs, count(*) FILTER (len(action) < 20) AS weak, avg(CASE WHEN priority <> '' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN category <> '' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN ids <> '' THEN 0.4::DOUBLE ELSE 0 END) AS rq FROM rec GROUP BY report_id),
 se AS (SELECT inp.report_id, {SUMMARY} AS summary, coalesce(n, 0) AS n, coalesce(recs, 0) AS recs, coalesce(keys, 0) AS keys, coalesce(weak, 0) AS weak, coalesce(unsure, 0) AS unsure, coalesce(conflicts, 0) AS conflicts, coalesce(q, 0) AS q, coalesce(strict, 0) AS strict, coalesce(certainty, 0.5::DOUBLE) AS certainty, coalesce(rq, 0) AS rq,
  (({SUMMARY} <> '')::INT + (coalesce(n, 0) > 0)::INT + (coalesce(recs, 0) > 0)::INT + (coalesce(keys, 0) > 0)::INT) AS filled, 1 - least(1::DOUBLE, 0.1::DOUBLE * coalesce(conflicts, 0)) AS cs
  FROM inp LEFT JOIN ob USING (report_id) LEFT JOIN rc USING (report_id) LEFT JOIN nc USING (report_id))"""
R3 = "round(({})::DECIMAL(18, 9), 3)::DOUBLE"
CONFIDENCE = "0.3::DOUBLE * (filled / 4::DOUBLE) + 0.3::DOUBLE * q + 0.2::DOUBLE * certainty + 0.2::DOUBLE * cs"
ISSUES = "array_to_string(list_filter([CASE WHEN summary = '' THEN 'Missing property summary' END, CASE WHEN n = 0 THEN 'No area observations provided' END, CASE WHEN recs = 0 THEN 'No recommendations provided' END, CASE WHEN weak > 0 THEN weak || ' weak recommendations detected' END, CASE WHEN unsure > 0 THEN unsure || ' observations with low confidence' END], lambda x: x IS NOT NULL), '; ')"
OVERALL = R3.format("((filled + 1) / 5::DOUBLE + strict + rq) / 3")


def _sections(name: str, sql: str, make):
    """A query over all reports of the inputs, with or without findings: se has what the scores look at."""
    @query(name, f"WITH {X.SCORED_SQL} {RECS}, {X.INPUTS_SQL}, {SECTIONS_SQL} {sql}")
    def run(spark, d):
        return _with_recs(stash(X.scored(spark, d), "findings"), lambda f, c, r: make(S.sections(f, c, r, X.inputs(spark, d))))

    return run


_sections("sc1_confidence", f"SELECT report_id, n, conflicts, {R3.format('filled / 4::DOUBLE')} AS completeness, {R3.format('q')} AS quality, {R3.format('certainty')} AS certainty, {R3.format('cs')} AS conflict_score, {R3.format(CONFIDENCE)} AS confidence FROM se", S.deterministic)
_sections("sc4_quality_overall", f"SELECT report_id, strict AS observation_quality, rq AS recommendation_quality, {OVERALL} AS overall FROM se", lambda x: S.overall_quality(x).drop("issues", "completeness"))
_sections("a23_completeness", "SELECT report_id, filled / 4::DOUBLE AS of_four, (filled + 1) / 5::DOUBLE AS of_five FROM se", lambda x: x.select("report_id", S.completeness_of(4).alias("of_four"), S.completeness_of(5).alias("of_five")))
_sections("a24_quality_issues", f"SELECT report_id, weak, unsure, {ISSUES} AS issues FROM se", lambda x: S.overall_quality(x).select("report_id", "issues").join(x.select("report_id", "weak", "unsure"), "report_id"))


@query("k16_degraded", f"WITH {X.SCORED_SQL}, {X.INPUTS_SQL}, t AS (SELECT report_id, count(*) AS n FROM scored GROUP BY report_id) SELECT report_id, len(errors) > 0 AND coalesce(n, 0) = 0 AS degraded FROM inp LEFT JOIN t USING (report_id)")
def k16(spark, d):
    return R.record(stash(X.scored(spark, d), "findings"), X.inputs(spark, d)).select("report_id", (o("status") == "failed").alias("degraded"))


REC_TEXT = f"CASE WHEN n = 0 AND len(errors) > 0 THEN '{lx.FAILED_SUMMARY}' WHEN n = 0 THEN '{lx.NO_OBSERVATIONS}' ELSE 'Property assessment identified ' || n || ' observations across ' || k || ' categories.' || CASE WHEN c > 0 THEN ' ' || c || ' critical issues require immediate attention.' ELSE '' END || CASE WHEN h > 0 THEN ' ' || h || ' high-priority issues need urgent assessment.' ELSE '' END END"
REC_RISK = f"CASE WHEN n = 0 AND len(errors) > 0 THEN '{lx.FAILED_OVERVIEW}' WHEN c > 0 THEN 'Immediate action required: ' || c || ' critical issues.' WHEN h > 0 THEN 'Urgent attention needed: ' || h || ' high severity issues.' ELSE 'No critical or high severity issues identified.' END"


@query("x20_final_record", f"""WITH {X.SCORED_SQL}, {X.INPUTS_SQL}, t0 AS ({COUNTS}), t AS (SELECT inp.report_id, errors, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(c, 0) AS c, coalesce(h, 0) AS h FROM inp LEFT JOIN t0 USING (report_id)),
 kf AS (SELECT report_id, string_agg(upper(severity) || ': ' || observation, ' | ' ORDER BY severity = 'High', ord) AS key_findings FROM (SELECT *, row_number() OVER (PARTITION BY report_id, severity ORDER BY ord) AS r FROM scored WHERE severity IN ('Critical', 'High')) WHERE r <= 3 GROUP BY report_id),
 mi AS (SELECT report_id, string_agg('No evidence: ' || left(observation, 40) || '...', ' | ' ORDER BY ord) AS missing FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS r FROM scored WHERE evidence = '') WHERE r <= 10 GROUP BY report_id)
 SELECT t.report_id, CASE WHEN n = 0 AND len(errors) > 0 THEN 'failed' WHEN len(errors) > 0 THEN 'partial' ELSE 'ok' END AS status, n AS n_observations, {REC_TEXT} AS property_summary, {REC_RISK} AS risk_overview, greatest(0, 100 - 20 * c - 10 * h)::BIGINT AS health,
 coalesce(key_findings, '') AS key_findings, coalesce(missing, '') AS missing_information, array_to_string(errors, '; ') AS errors FROM t LEFT JOIN kf USING (report_id) LEFT JOIN mi USING (report_id)""")
def x20(spark, d):
    return R.record(stash(X.scored(spark, d), "findings"), X.inputs(spark, d))


# The report ---------------------------------------------------------------------------------------------------------
MERGED = LEAD_SQL + f""", obs2 AS (SELECT * EXCLUDE (r) FROM (SELECT o.*, row_number() OVER (PARTITION BY o.report_id, s.leader ORDER BY len(o.evidence) + o.n_images DESC, o.ord) AS r FROM step s JOIN obs o ON o.report_id = s.report_id AND o.ord = s.ord) WHERE r = 1),
 scored AS (SELECT * REPLACE ({X.s_rescored('observation', 'category', 'evidence')} AS severity_score, {X.s_band('(' + X.s_rescored('observation', 'category', 'evidence') + ')')} AS severity) FROM obs2)"""


def _joined(inner: str, text: str, out: str) -> str:
    return f"(SELECT report_id, string_agg({text}, ' | ' ORDER BY rank) AS {out} FROM ({inner}) GROUP BY report_id)"


KEYF = "SELECT * FROM (SELECT report_id, upper(severity) || ': ' || observation AS finding, row_number() OVER (PARTITION BY report_id ORDER BY severity <> 'Critical', ord) AS rank FROM scored WHERE severity IN ('Critical', 'High')) WHERE rank <= 10"
CONC = "SELECT * FROM (SELECT report_id, category || ': ' || observation AS concern, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS rank FROM scored WHERE severity IN ('Critical', 'High')) WHERE rank <= 5"
WINS = "SELECT * FROM (SELECT report_id, 'Quick fix: ' || observation AS win, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS rank FROM scored WHERE severity IN ('Low', 'Medium') AND (contains(lower(observation), 'clean') OR contains(lower(observation), 'repair'))) WHERE rank <= 5"
OVER = "SELECT * FROM (SELECT report_id, action, row_number() OVER (PARTITION BY report_id ORDER BY bucket, pos, pos2) AS rank FROM rec) WHERE rank <= 5"
STRAT = f"(SELECT report_id, array_to_string(list_concat(coalesce(list('Long-term ' || category || ' maintenance plan needed based on ' || n || ' observations' ORDER BY first) FILTER (n >= 3), []), [{FIXED}])[1:5], ' | ') AS strategies FROM (SELECT report_id, category, count(*) AS n, min(ord) AS first FROM scored GROUP BY ALL) GROUP BY report_id)"
REPORT_SQL = MERGED + RECS + f""", {X.INPUTS_SQL}, {SECTIONS_SQL}, t AS ({COUNTS})
 SELECT t.report_id, t.n AS total, c AS n_critical, h AS n_high, m AS n_medium, l AS n_low, areas, {HEALTH}::INT AS health, a.overall, a.distribution, a.mean_score, key_findings, major_concerns, quick_wins, missing_information, strategies, overall_recommendations, conflict_list, recs AS n_recommendations,
 conflicts, {R3.format('filled / 4::DOUBLE')} AS completeness, {R3.format('q')} AS quality, {R3.format('certainty')} AS certainty, {R3.format('cs')} AS conflict_score, {R3.format(CONFIDENCE)} AS confidence, {OVERALL} AS quality_overall, issues, summary AS property_summary, {CAUSE_TEXT} AS root_cause, {OVERVIEW} AS risk_overview
 FROM t JOIN (SELECT *, {ISSUES} AS issues FROM se) s2 ON s2.report_id = t.report_id JOIN inp ON inp.report_id = t.report_id JOIN ({ASSESS.format('round((sum(s) / sum(n))::DECIMAL(18, 9), 3)::DOUBLE')}) a ON a.report_id = t.report_id
 LEFT JOIN {_joined(KEYF, 'finding', 'key_findings')} x1 ON x1.report_id = t.report_id LEFT JOIN {_joined(CONC, 'concern', 'major_concerns')} x2 ON x2.report_id = t.report_id LEFT JOIN {_joined(WINS, 'win', 'quick_wins')} x3 ON x3.report_id = t.report_id
 LEFT JOIN {_joined(MISSING, 'missing', 'missing_information')} x4 ON x4.report_id = t.report_id LEFT JOIN {STRAT} x5 ON x5.report_id = t.report_id LEFT JOIN {_joined(OVER, 'action', 'overall_recommendations')} x6 ON x6.report_id = t.report_id
 LEFT JOIN (SELECT report_id, string_agg(description, ' | ' ORDER BY a_ord, b_ord) AS conflict_list FROM conf GROUP BY report_id) x7 ON x7.report_id = t.report_id"""


@query("report", REPORT_SQL)
def report(spark, d):
    return R.report(X.observations(spark, d), X.inputs(spark, d))


@query("report_lines", MERGED + RECS + f""", t AS ({COUNTS}), li AS (SELECT report_id, 0 AS section, 0 AS seq, n || ' findings, risk ' || {RISK} AS text FROM t
 UNION ALL SELECT report_id, 1, rank, '[' || severity || '] ' || area || ': ' || observation FROM {K1_SQL} WHERE rank <= 10
 UNION ALL SELECT report_id, 1, 11, '… and ' || (n - 10) || ' more' FROM t WHERE n > 10
 UNION ALL SELECT report_id, 2, rank, '[' || priority || '] ' || action FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY {PR}, bucket, pos, pos2)::INT AS rank FROM rec) WHERE rank <= 20
 UNION ALL SELECT report_id, 3, rank, missing FROM ({MISSING})) SELECT report_id, section, (['summary', 'findings', 'recommendations', 'missing'])[section + 1] AS name, section IN (1, 2) AS hard_break, seq, text FROM li""")
def report_lines(spark, d):
    return R.report_lines(X.observations(spark, d))


JSON_FIELDS = ["total", "n_critical", "n_high", "n_medium", "n_low", "areas", "health"]


@query("snk2_report_json", f"WITH {X.SCORED_SQL}, t AS ({COUNTS}) SELECT report_id, '{{\"report_id\":' || report_id || ',\"total\":' || n || ',\"n_critical\":' || c || ',\"n_high\":' || h || ',\"n_medium\":' || m || ',\"n_low\":' || l || ',\"areas\":' || areas || ',\"health\":' || {HEALTH} || ',\"risk\":\"' || {RISK} || '\",\"risk_overview\":\"' || {OVERVIEW} || '\"}}' AS json FROM t")
def snk2(spark, d):
    x = X.scored(spark, d)
    full = A.kpis(x).join(A.health(x), "report_id").withColumn("risk_overview", K.risk_overview(o("n_critical"), o("n_high")))
    return full.select("report_id", F.to_json(F.struct("report_id", *JSON_FIELDS, "risk", "risk_overview")).alias("json"))
