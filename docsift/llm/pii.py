"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text: at-signs, plus signs, digits, "://" and
identifier cues. From each anchor a deterministic local parser reads outwards, so that all work but that pass is in
proportion to what the anchors touch, and validates the boundaries it finds.

Kinds, in order: email, ip, card, phone (the base), then url (a scheme with a host and what follows) and account: an
identifier of four digits or more after a cue such as "iban" or "account no", a value with a digit after "password =",
"api_key:" and the like, or a key of a known form (PREFIXES), such as twenty capitals and digits from "AKIA" on. Spans of
the last two that lie within a base span, or overlap an earlier one of their kind, are left out. Offsets are code
points, end exclusive.

Defined cases: a null text has no spans; texts of any length are read whole; repeated rows give repeated results;
an empty table gives no rows; columns named like the outputs are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.session import extend, prepare

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SECRETS = ("token", "password", "passwd", "api_key", "apikey", "api-key", "secret", "bearer")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport", *SECRETS)
#: How keys of known forms begin, and how many characters they have at least (of letters, digits, "_" and "-").
PREFIXES = {"AKIA": 20, "ASIA": 20, "ghp_": 40, "gho_": 40, "github_pat_": 40, "glpat-": 26, "sk_live_": 24, "xoxb-": 24, "xoxp-": 24, "AIza": 39, "eyJhbGci": 40}

_DIGITS = frozenset("0123456789")
_ALNUM = _DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_KEY = _ALNUM | frozenset("_-")
_VALUE = _ALNUM | frozenset("_-+/.!#%&*~")
_SCHEME = _ALNUM | frozenset("+.-")
_PHONE = _DIGITS | frozenset(" ().-")
_STOPS = frozenset("<>\"'`{}|\\^")

Span = tuple[str, int, int]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in _DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.title(), cue.upper()}:
            a.add_word(form, ("secret" if cue in SECRETS else "cue", len(form)))
    for form in PREFIXES:
        a.add_word(form, ("key", len(form)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def _right(text: str, at: int, allowed: frozenset[str]) -> int:
    """End of the run of allowed characters from at on."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, sign: int, least: int) -> tuple[int, int] | None:
    """Around the at-sign: a local part not before least, and two labels or more joined by dots."""
    start = sign
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    end = _right(text, sign + 1, _LABEL)
    if start == sign or end == sign + 1:
        return None
    labels = 1
    while text[end : end + 1] == "." and (to := _right(text, end + 1, _LABEL)) > end + 1:
        end, labels = to, labels + 1
    return (start, end) if labels > 1 else None


def phone(text: str, plus: int) -> tuple[int, int] | None:
    """From a plus: a digit, then digits and their usual separators up to the last digit."""
    if text[plus + 1 : plus + 2] not in _DIGITS or plus + 1 >= len(text):
        return None
    end = _right(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 else None


def url(text: str, sign: int) -> tuple[int, int] | None:
    """Around "://": a scheme before it and a host with a dot, a port or a path after it."""
    start = sign
    while start and text[start - 1] in _SCHEME:
        start -= 1
    while start < sign and not text[start].isalpha():
        start += 1
    end = sign + 3
    while end < len(text) and text[end] not in _STOPS and not text[end].isspace():
        end += 1
    while end > sign + 3 and text[end - 1] in ".,;:!?)]":
        end -= 1
    host = text[sign + 3 : end].split("/", 1)[0]
    return (start, end) if start < sign and ("." in host.strip(".") or ":" in host or host == "localhost") else None


def key(text: str, start: int) -> tuple[int, int] | None:
    """A key of a known form: no letter or digit before it, and long enough."""
    if start and text[start - 1] in _ALNUM:
        return None
    to = _right(text, start, _KEY)
    form = next(f for f in PREFIXES if text.startswith(f, start))
    return (start, to) if to - start >= PREFIXES[form] else None


def secret(text: str, end: int) -> tuple[int, int] | None:
    """After a cue of secrets and "=" or ":": six characters or more, with a digit; otherwise as an account."""
    at = end
    while at < len(text) and at < end + 6 and text[at] in " \t:=\"'":
        at += 1
    to = _right(text, at, _VALUE)
    if to - at >= 6 and set("=:") & set(text[end:at]) and any(c in _DIGITS for c in text[at:to]):
        return at, to
    return account(text, end)


def account(text: str, end: int) -> tuple[int, int] | None:
    """After a cue: a few filler characters, then an identifier with four digits or more."""
    at, fill = end, 0
    for word in (" number", " no.", " no", " nr.", " nr", " key", " id"):
        if text[at : at + len(word)].lower() == word:
            at += len(word)
            break
    while at < len(text) and fill < 6 and text[at] in " \t:=#\"'":
        at, fill = at + 1, fill + 1
    if not fill:
        return None
    to, digits = at, 0
    while to < len(text) and (text[to] in _LABEL or text[to] == " " and text[to + 1 : to + 2] in _DIGITS and to + 1 < len(text)):
        digits += text[to] in _DIGITS
        to += 1
    return (at, to) if digits >= 4 and to - at >= 6 else None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digit_runs(text: str, at: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    start = last = -2
    for p in at:
        if p != last + 1:
            if start >= 0:
                runs.append((start, last + 1))
            start = p
        last = p
    if start >= 0:
        runs.append((start, last + 1))
    return runs


def _addresses(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Four runs of digits joined by single dots, each 255 at most."""
    out, i = [], 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            values = [text[a:b].lstrip("0") for a, b in four]
            if all(len(v) < 3 or len(v) == 3 and int(v) < 256 for v in values):
                out.append(("ip", four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return out


def _cards(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Chains of digit runs joined by single blanks or hyphens, of 13 to 19 digits with a right check digit."""
    out, i = [], 0
    while i < len(runs):
        j, count = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            count += runs[j][1] - runs[j][0]
        if 13 <= count <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            out.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    return out


def find(text: str) -> list[Span]:
    """All spans of a text, by kind in order and then by start."""
    anchors: dict[str, list[int]] = {"digit": [], "at": [], "plus": [], "scheme": []}
    cues: list[tuple[int, Callable[[str, int], tuple[int, int] | None]]] = []
    for last, (kind, size) in _AUTOMATON.iter(text):
        if kind in anchors:
            anchors[kind].append(last + 1 - size)
        elif kind == "key":
            cues.append((last + 1 - size, key))
        else:
            cues.append((last + 1, secret if kind == "secret" else account))
    out: list[Span] = []
    end = 0
    for p in anchors["at"]:
        if p >= end and (s := email(text, p, end)):
            out.append(("email", *s))
            end = s[1]
    runs = _digit_runs(text, anchors["digit"])
    out += _addresses(text, runs) + _cards(text, runs)
    end = 0
    for p in anchors["plus"]:
        if p >= end and (s := phone(text, p)):
            end = s[1]
            if 9 <= sum(c in _DIGITS for c in text[s[0] : s[1]]) <= 15:
                out.append(("phone", *s))
    base = sorted((a, b) for _, a, b in out)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for kind, places in (("url", [(p, url) for p in anchors["scheme"]]), ("account", cues)):
        end = 0
        for p, parser in places:
            if p >= end and (s := parser(text, p)) and s[0] >= end:
                end = s[1]
                i = bisect_right(starts, s[0])
                if not i or reach[i - 1] < s[1]:
                    out.append((kind, *s))
    return out


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind in square brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_pii(df: DataFrame, text: str = "text", masked: bool = False) -> DataFrame:
    """df with `spans` (all spans of the whole text); with masked, the text column has them replaced."""
    prepare(df.sparkSession)
    df = df.select(*[c for c in df.columns if c != "spans"])
    at = df.columns.index(text)
    schema = extend((df if masked else df.drop(text)).schema, ("spans", SPANS))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [find(t) if t else [] for t in texts]
            columns = list(batch.columns)
            if masked:
                columns[at] = pa.array([mask(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
            else:
                del columns[at]
            columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def of(kind):
        return lambda s: s["kind"] == kind

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), F.size("spans").cast("long").alias("n_spans"), joined(F.col("spans")).alias("spans"))
