"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id. Words are summed by source and hash bucket; the bucket in which a source's
budget ends is found from running sums over buckets, and only that bucket is summed again over the next bits, until it
holds one hash. Thresholds are nested: a larger budget takes the same documents and more. The documents themselves are
never sorted, and each is decided by comparing its hash with its source's threshold.

The targets, thresholds and weights are the mix's own configuration, one row a source. Up to FEW sources they are
broadcast; beyond it they are joined by source, hot sources being split by salt.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows
with equal ids share a hash and are taken alike; a source without words gets target 0; an empty table gives no rows;
columns of the input named like the outputs are replaced.

What reaches the driver is one row a source; never rows of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.session import stash

BITS, STEP = 60, 12
FEW, SALT = 10_000, 64  # sources whose rows are broadcast; parts of a source where they are more
OWN = ("size", "source_size", "target", "taken", "copies")  # columns that mix makes


def word_count(text: Column) -> Column:
    """Number of maximal runs outside {0x20, 0x09-0x0D}; null: 0. Each run with the blanks after it becomes one letter."""
    ws = r"\x20\x09-\x0D"
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{ws}]+", "")
    return F.length(F.regexp_replace(bare, f"[^{ws}]++[{ws}]*+", "x")).cast("long")


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """share * sum(sizes) dealt by weight; none above most * its size, what is above dealt again to the others."""
    caps = [most * s for s in sizes]
    left, rest = share * sum(sizes), sum(weights)
    level = 0.0
    for cap, w in sorted(zip(caps, weights, strict=True), key=lambda x: x[0] / x[1]):
        level = left / rest
        if cap >= w * level:
            break
        left, rest = left - cap, rest - w
    return [min(c, w * level) for c, w in zip(caps, weights, strict=True)]


def mix(df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """One row a document: key, source, size, source_size, target, taken; with carry, all of df's columns besides.

    weights are dealt to the sources in order of code points, repeating. taken is size times the number of copies.
    """
    sized = stash(df.select(F.col(key).alias("k"), F.col(source).alias("s"), word_count(F.col(text)).alias("n"), hash60(F.col(key)).alias("h")), "mix")
    plan = budgets(sized, weights, share, most)
    table = df.sparkSession.createDataFrame(plan, "__source string, __source_size long, __target double, __copies long, __below long")
    if carry:
        rows = df.select(*[c for c in df.columns if c not in OWN], F.col(source).alias("__s"), word_count(F.col(text)).alias("__n"), hash60(F.col(key)).alias("__h"))
    else:
        rows = sized.select(F.col("k").alias(key), F.col("s").alias(source), F.col("s").alias("__s"), F.col("n").alias("__n"), F.col("h").alias("__h"))
    kept = [c for c in rows.columns if c not in ("__s", "__n", "__h")]
    if len(plan) <= FEW:
        out = rows.join(F.broadcast(table), F.col("__s").eqNullSafe(F.col("__source")))
    else:
        salted = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.col("__h"), F.lit(SALT)).cast("int"))
        out = rows.join(salted, F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__part")))
    copies = F.col("__copies") + (F.col("__h") < F.col("__below")).cast("long")
    made = {"size": F.col("__n"), "source_size": F.col("__source_size"), "target": F.col("__target"), "taken": F.col("__n") * copies, "copies": copies}
    return out.select(*kept, *[c.alias(n) for n, c in made.items()])


def budgets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> list[tuple]:
    """A row a source: name, size, target, whole copies of all its documents, and the hash below which one more is taken."""
    totals = [(r.s, int(r.n)) for r in sized.groupBy("s").agg(F.sum("n").alias("n")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    w = [float(weights[i % len(weights)]) for i in range(len(totals))]
    goal = targets([n for _, n in totals], w, share, most)
    rows, pending = {}, {}
    for (s, n), t in zip(totals, goal, strict=True):
        copies = int(t // n) if n else 0
        rest = t - copies * n
        rows[s] = [s, n, t, copies, 0]
        if rest > 0:
            pending[s] = (0, rest)
    for level in range(STEP, BITS + 1, STEP):
        if not pending:
            break
        low = BITS - level
        state = sized.sparkSession.createDataFrame([(s, p, r) for s, (p, r) in pending.items()], "ss string, prefix long, rest double")
        inside = sized.join(state, sized["s"].eqNullSafe(state["ss"]) & (F.shiftright("h", low + STEP) == state["prefix"]))
        hist = inside.groupBy("ss", "prefix", "rest", F.shiftright("h", low).alias("b")).agg(F.sum("n").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("ss").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
        edge = run.where(F.col("upto") >= F.col("rest")).groupBy("ss").agg(F.min_by(F.struct("b", "n", "upto", "h0", "h1"), "b").alias("e"))
        found = {r.ss: r.e for r in edge.collect()}
        nxt = {}
        for s, (_, rest) in pending.items():
            e = found.get(s)
            if e is None:  # rounding has left a budget above all of the sizes
                rows[s][4] = 1 << BITS
            elif e.h0 == e.h1 or low == 0:
                before = e.upto - e.n
                rows[s][4] = e.h1 + 1 if 2 * rest >= before + e.upto else e.h0
            else:
                nxt[s] = (e.b, rest - (e.upto - e.n))
        pending = nxt
    return [tuple(r) for r in rows.values()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS n, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w
  FROM sized GROUP BY source),
ord AS (
  SELECT *, 2.0::DOUBLE * n AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, w) AS i,
         1.5::DOUBLE * sum(n) OVER () AS total, sum(w) OVER () AS all_w FROM src),
run AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cap_before,
         coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS w_before FROM ord),
lev AS (SELECT *, (total - cap_before) / (all_w - w_before) AS level FROM run),
pick AS (SELECT coalesce(min_by(level, i) FILTER (WHERE cap >= w * level), max_by(level, i)) AS level FROM lev),
goal AS (
  SELECT source, n, least(cap, w * pick.level) AS target,
         CASE WHEN n > 0 THEN floor(least(cap, w * pick.level) / n) ELSE 0 END::BIGINT AS copies FROM lev, pick),
grp AS (
  SELECT s.source, s.h, g.target - g.copies * g.n AS rest,
         sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.h) AS upto, sum(s.size) AS n
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source GROUP BY s.source, s.h, g.target, g.copies, g.n)
SELECT s.doc_id, s.size, g.n AS source_size, g.target,
       (s.size * (g.copies + CASE WHEN p.rest > 0 AND 2 * p.rest >= p.upto - p.n + p.upto THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
JOIN grp p ON s.source IS NOT DISTINCT FROM p.source AND s.h = p.h
"""
