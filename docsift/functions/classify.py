"""Ordered rules as CASE chains: the first rule that is met decides."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift import lexicon as lx


def any_of(c: Column, words) -> Column:
    return reduce(or_, (F.contains(c, F.lit(w)) for w in words))


def first_rule(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def category(c: Column, table: dict[str, list[str]] = lx.CATEGORIES) -> Column:
    return category_of_lower(F.lower(c), table)


def category_of_lower(low: Column, table: dict[str, list[str]] = lx.CATEGORIES) -> Column:
    return first_rule([(any_of(low, words), F.lit(name)) for name, words in table.items()], F.lit(lx.OTHER_CATEGORY))


def severity(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return first_rule([(F.contains(low, F.lit(w)), F.lit(name)) for w, name, _ in lx.SEVERITIES], F.lit("Not Available"))


def severity_score(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return first_rule([(F.contains(low, F.lit(w)), F.lit(s)) for w, _, s in lx.SEVERITIES], F.lit(0.0))


def confidence(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return first_rule([(F.contains(low, F.lit(w)), F.lit(name)) for w, name, _ in lx.CONFIDENCES], F.lit("Moderate"))


def confidence_score(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return first_rule([(F.contains(low, F.lit(w)), F.lit(s)) for w, _, s in lx.CONFIDENCES], F.lit(0.5))


def base_severity(observation: Column) -> Column:
    low = F.lower(observation)
    return first_rule([(F.contains(low, F.lit(w)), F.lit(s)) for w, s in lx.SEVERITY_WORDS], F.lit(0.0))


def rescored(observation: Column, cat: Column, evidence: Column) -> Column:
    weight = first_rule([(cat == n, F.lit(w)) for n, w in lx.CATEGORY_WEIGHTS.items()], F.lit(1.0))
    weighted = F.least(F.lit(1.0), base_severity(observation) * weight)
    return F.when(F.length(evidence) > 20, F.least(F.lit(1.0), weighted * F.lit(1.1))).otherwise(weighted)


def band(score: Column) -> Column:
    return first_rule([(score >= F.lit(x), F.lit(n)) for x, n in lx.SEVERITY_BANDS], F.lit("Information"))


def one_of(c: Column, allowed, default: str) -> Column:
    return F.when(F.lower(c).isin(list(allowed)), F.lower(c)).otherwise(F.lit(default))


def evidence_source(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(low, F.lit("thermal")), "thermal").when(F.contains(low, F.lit("both")), "both").otherwise("inspection")


def fallback_severity(cat: Column) -> Column:
    return F.when(cat.isin("Structural", "Water Intrusion", "Safety"), "high").when(cat.isin("Electrical", "HVAC", "Roofing"), "medium").otherwise("low")


def fallback_score(cat: Column) -> Column:
    return F.when(cat.isin("Structural", "Water Intrusion", "Safety"), 0.7).when(cat.isin("Electrical", "HVAC", "Roofing"), 0.5).otherwise(0.3)


def priority_of_text(c: Column) -> Column:
    low = F.lower(c)
    return first_rule([(any_of(low, words), F.lit(p)) for words, p in lx.PRIORITY_WORDS], F.lit("Preventive"))


def lookup(c: Column, table: dict[str, int], default: int = 0) -> Column:
    return first_rule([(c == k, F.lit(v)) for k, v in table.items()], F.lit(default))
