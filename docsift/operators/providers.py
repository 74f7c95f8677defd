"""Model providers as plug-ins: prompts, a fallback chain, and a rule provider that is always there.

A provider takes prompts and returns texts or raises. None that calls a network is bundled.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift import lexicon as lx
from docsift.functions import classify as C
from docsift.functions.json_ops import extract

Provider = Callable[[Sequence[str]], Sequence[str]]

PROMPTS = {
    "observations": "List the findings of these reports as JSON.\nInspection:\n%s\nThermal:\n%s",
    "conflicts": "Name findings that contradict each other, as JSON.\n%s",
    "root_cause": "Name the primary cause and the evidence for it, as JSON.\n%s",
    "severity": "Give each finding's id a severity and a score, as JSON.\n%s",
    "recommendations": "List actions with priority and category, as JSON.\n%s",
}


@dataclass(frozen=True)
class Named:
    name: str
    call: Provider


def rule_provider(prompts: Sequence[str]) -> list[str]:
    """Findings by the reasoning lexicon: every line but headings that has one of its words, with its category."""
    out = []
    for p in prompts:
        found = []
        for line in p.splitlines():
            low = line.lower()
            cat = next((c for c, ws in lx.REASONING_CATEGORIES.items() if any(w in low for w in ws)), None)
            if cat and not line.endswith(":"):
                found.append({"area": "General Area", "observation": line.strip(), "category": cat, "evidence": []})
        out.append(json.dumps({"observations": found}))
    return out


def ordered(providers: Sequence[Named], primary: str) -> list[Named]:
    """The primary one first, the others in their order."""
    return sorted(providers, key=lambda p: p.name != primary)


def ask(provider: Named, prompts: Sequence[str], attempts: int = 2, wait: float = 0.0) -> list[tuple[str | None, str | None]]:
    """(answer's JSON, error) of each prompt. All are sent at once; if that fails, one by one, each so often, waiting twice as long every time."""
    try:
        return [(j, None if j is not None else "no JSON") for j in map(extract, provider.call(list(prompts)))]
    except Exception:  # noqa: BLE001  a provider may fail in any way
        pass
    out: list[tuple[str | None, str | None]] = []
    for text in prompts:
        error = ""
        for turn in range(attempts):
            try:
                answer = extract(provider.call([text])[0])
                out.append((answer, None if answer is not None else "no JSON"))
                break
            except Exception as x:  # noqa: BLE001
                error = str(x)
                if turn + 1 < attempts:
                    time.sleep(wait * 2**turn)
        else:
            out.append((None, error))
    return out


def generate(df: DataFrame, prompt: str, providers: Sequence[Named], attempts: int = 2, wait: float = 0.0) -> DataFrame:
    """df with answer, provider and errors. The next provider is asked for what the one before it failed at or answered without JSON."""
    columns, chain = df.columns, list(providers)
    schema = df.withColumn("answer", F.lit("")).withColumn("provider", F.lit("")).withColumn("errors", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[prompt].tolist()
            answer, name, errors = [None] * len(texts), [None] * len(texts), [[] for _ in texts]
            open_ = list(range(len(texts)))
            for p in chain:
                if not open_:
                    break
                for i, (found, error) in zip(open_, ask(p, [texts[i] for i in open_], attempts, wait), strict=True):
                    if error is None:
                        answer[i], name[i] = found, p.name
                    else:
                        errors[i].append(f"{p.name}: {error}")
                open_ = [i for i in open_ if name[i] is None]
            yield b[columns].assign(answer=answer, provider=name, errors=["; ".join(e) for e in errors])

    return df.mapInPandas(run, schema)


def fallback(obs: DataFrame) -> DataFrame:
    """What the rules say where no model answered: category and severity."""
    cat = C.category(F.col("observation"), lx.REASONING_CATEGORIES)
    return obs.select("id", cat.alias("category"), C.fallback_severity(cat).alias("severity"), C.fallback_score(cat).alias("severity_score"))
