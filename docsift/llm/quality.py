"""Quality rules with adaptive thresholds, by DataFrame functions only.

Each document's measures are computed within its row. Per language and source, a mergeable quantile sketch of each
measure is built (KLL, combined on the map side, so a hot source needs no more than others); sketches of a language
are merges of its sources' ones. A source's quartiles are averaged with its language's, with the weights n and FEW for
a source of n documents, so that thresholds follow the size of a group without a step. A document is dropped if a
measure lies far outside its group: above the upper quartile (for LOW measures also below the lower one) by more than
SPREAD interquartile ranges, which are taken as no less than the measure's floor. The thresholds are then joined to
the measures; Spark decides by size how.

Defined cases: a null text has no words; a null language or source is a group of its own; repeated rows are judged
alike; an empty table gives no rows; other columns are ignored by the query and kept by filter_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import stash

WS = r"\x20\x09-\x0D"
#: measure: least interquartile range that counts.
MEASURES = {"symbol_share": 0.02, "dup_line_share": 0.08, "repeat_share": 0.06, "upper_share": 0.02, "word_length": 0.5}
LOW = ("word_length",)
SPREAD = 5.0
#: A language's quartiles count in its sources' ones like so many documents.
FEW = 200


def _long(c: Column) -> Column:
    return c.cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper."""
    t = F.coalesce(F.col(text), F.lit(""))
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
    keep = [c for c in df.columns if c != text and c not in made]
    words = F.filter(F.split(t, f"[{WS}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(f"[^{WS}]"))
    a = df.select(
        *keep,
        F.length(F.regexp_replace(t, f"[{WS}]+", "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).alias("n_symbols"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).alias("n_upper"),
        lines.alias("__lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("__w"),
    )
    b = a.withColumn("n_words", F.size("__w")).withColumn("__n3", F.greatest(F.size("__w") - 2, F.lit(0)))
    b = b.withColumn("__t", F.slice(F.transform("__w", lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2))), F.lit(1), F.col("__n3")))
    # Only texts in which some window comes again are looked at further.
    b = b.withColumn("__s", F.when(F.size(F.array_distinct("__t")) < F.col("__n3"), F.sort_array("__t")))
    b = b.withColumn("__d", F.array_distinct(F.filter("__s", lambda x, i: (i > 0) & (x == F.get("__s", i - 1)))))
    few = F.filter(F.transform("__t", lambda x, i: F.when(F.array_contains("__d", x), i)), lambda p: p.isNotNull())
    pairs = F.sort_array(F.transform("__t", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    c = b.withColumn("__p", F.when(F.size("__d") > 200, pairs))
    many = F.sort_array(F.transform(F.filter("__p", lambda x, i: ((i > 0) & (x["h"] == F.get("__p", i - 1)["h"])) | (x["h"] == F.get("__p", i + 1)["h"])), lambda x: x["i"]))
    c = c.withColumn("__at", F.when(F.col("__s").isNull(), F.array().cast("array<int>")).when(F.col("__p").isNull(), few).otherwise(many))
    # Each place covers three words, less what the next place covers again.
    covered = F.aggregate(F.transform("__at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1), p + 3) - p)), F.lit(0), lambda x, y: x + y)
    return c.select(
        *keep, _long(F.col("n_words")).alias("n_words"), _long(F.col("word_chars")).alias("word_chars"), _long(F.col("n_symbols")).alias("n_symbols"),
        _long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"), _long(covered).alias("n_repeat_words"),
        _long(F.size("__lines")).alias("n_lines"), _long(F.col("n_upper")).alias("n_upper"),
    )


def shares() -> dict[str, Column]:
    """The measures that are compared, as doubles; 0 where there is nothing to divide by."""
    def over(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {"symbol_share": over("n_symbols", "word_chars"), "dup_line_share": over("n_dup_lines", "n_lines"), "repeat_share": over("n_repeat_words", "n_words"), "upper_share": over("n_upper", "word_chars"), "word_length": over("word_chars", "n_words")}


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", spread: float = SPREAD, few: int = FEW) -> DataFrame:
    """One row a language and source (`__l`, `__s`): `__most_<measure>`, for LOW ones also `__least_<measure>`."""
    by = measured.where(~F.col("base_failed")).groupBy(F.col(lang).alias("__l"), F.col(source).alias("__s"))
    own = by.agg(*[F.kll_sketch_agg_double(c, F.lit(400)).alias(m) for m, c in shares().items()], F.count(F.lit(1)).alias("n"))
    wide = own.groupBy("__l").agg(*[F.kll_merge_agg_double(m).alias(f"w_{m}") for m in MEASURES]).withColumnRenamed("__l", "wl")
    both = own.join(wide, F.col("__l").eqNullSafe(F.col("wl")))
    out = []
    share = F.col("n") / (F.col("n") + F.lit(few))
    for m, floor in MEASURES.items():
        lo, hi = (share * F.kll_sketch_get_quantile_double(m, F.lit(q)) + (1 - share) * F.kll_sketch_get_quantile_double(f"w_{m}", F.lit(q)) for q in (0.25, 0.75))
        far = F.lit(spread) * F.greatest(hi - lo, F.lit(floor))
        out.append((hi + far).alias(f"__most_{m}"))
        if m in LOW:
            out.append((lo - far).alias(f"__least_{m}"))
    return both.select("__l", "__s", *out)


def judge(measured: DataFrame, lang: str = "lang", source: str = "source", spread: float = SPREAD, few: int = FEW) -> DataFrame:
    """measured (a stored table: it is read twice) with `kept`. Groups without a document that passes the base have no thresholds and keep none."""
    measured = measured.drop("kept")
    limits = thresholds(measured, lang, source, spread, few)
    joined = measured.join(limits, measured[lang].eqNullSafe(limits["__l"]) & measured[source].eqNullSafe(limits["__s"]), "left")
    inside = F.lit(True)
    for m, c in shares().items():
        inside = inside & (c <= F.coalesce(F.col(f"__most_{m}"), F.lit(float("inf"))))
        if m in LOW:
            inside = inside & (c >= F.coalesce(F.col(f"__least_{m}"), F.lit(float("-inf"))))
    return joined.select(*[measured[c] for c in measured.columns], (~F.col("base_failed") & inside).alias("kept"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def filter_documents(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of df that are kept. Rows of equal key are kept if one of them is."""
    measured = stash(measure(df.select(key, lang, source, text), text).withColumn("base_failed", base_failed()), "quality")
    good = judge(measured, lang, source).where("kept").select(F.col(key).alias("__k"))
    return df.join(good, df[key].eqNullSafe(good["__k"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    measured = stash(measure(docs).withColumn("base_failed", base_failed()), "quality")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


__all__ = ["filter_documents", "judge", "measure", "query", "thresholds"]
