"""String functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.lexicon import STOP_WORDS

#: White space as Python's str.strip and str.split see it.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same, as a list of characters.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without a regular expression, which would look at every blank inside, and at long runs of them again and again."""
    return F.trim(c, F.lit(BLANKS))


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def remove_control_characters(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", "")


def clean_text(c: Column) -> Column:
    return strip(remove_control_characters(normalize_whitespace(c)))


def structure_clean(c: Column) -> Column:
    """Control characters go, blanks collapse, lines are stripped, three line ends and more become two."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r"[ \t]+", " ")
    lines = F.transform(F.split(bare, r"\r\n|[\n\r\x85  ]"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def truncate_text(c: Column, most: int = 1000, suffix: str = "...") -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix)))


def safe_string(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def wrap_paragraphs(c: Column, width: int = 80) -> Column:
    """Greedy wrapping of every paragraph, an empty line after each; a line holds words while their lengths and gaps fit."""
    def wrap(p: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"), F.lit(0).alias("size"))

        def step(s: Column, w: Column) -> Column:
            fits = s["size"] + F.length(w) + 1 <= width
            first = s["line"] == ""
            return F.struct(
                F.when(fits | first, s["done"]).otherwise(F.concat(s["done"], s["line"], F.lit("\n"))).alias("done"),
                F.when(first, w).when(fits, F.concat(s["line"], F.lit(" "), w)).otherwise(w).alias("line"),
                F.when(fits, s["size"] + F.length(w) + 1).otherwise(F.length(w)).alias("size"),
            )

        return F.aggregate(words(p), start, step, lambda s: F.concat(s["done"], s["line"]))

    return F.array_join(F.transform(F.filter(F.split(c, "\n\n"), lambda p: strip(p) != ""), lambda p: F.concat(wrap(p), F.lit("\n"))), "\n")


#: Letters that F.upper turns into several, and the one letter that stands for each (itself, where there is none).
MANY = "".join(x for x in map(chr, range(0x110000)) if len(x.upper()) > 1)
ONE = "".join("ẞ" if x == "ß" else x.title() if len(x.title()) == 1 else x for x in MANY)


def upper_first(c: Column) -> Column:
    """The first letter in upper case, as one letter always."""
    first = F.substring(c, 1, 1)
    return F.concat(F.when(F.contains(F.lit(MANY), first), F.translate(first, MANY, ONE)).otherwise(F.upper(first)), F.substring(c, 2, 1 << 30))


def stop(c: Column) -> Column:
    """Sentence, where blanks are collapsed already."""
    up = upper_first(c)
    return F.when(c == "", c).when(c.rlike(r"[.!?]\z"), up).otherwise(F.concat(up, F.lit(".")))


def sentence(c: Column) -> Column:
    """Blanks collapsed, first letter in upper case, a full stop at the end if no mark is there."""
    return stop(normalize_whitespace(F.coalesce(c, F.lit(""))))


def dedup_key(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", "")
    return F.array_join(F.filter(words(bare), lambda w: ~w.isin(STOP_WORDS)), " ")


def sanitize_input(c: Column, strict: bool = False) -> Column:
    """Tags and script hooks removed; strict also removes what scripts contain, before their tags go."""
    t = F.regexp_replace(c, r"(?is)<script.*?</script>", "") if strict else c
    t = F.regexp_replace(t, "<[^>]*>", "")
    for literal in ("javascript:", "onerror=", "onload="):
        t = F.replace(t, F.lit(literal), F.lit(""))
    return t


def sanitize_path_name(c: Column) -> Column:
    """Separators, control characters and reserved signs replaced; 255 characters at most, the extension kept."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[/\\]", "_"), r"[\x00-\x1f]", ""), r'[<>:"|?*]', "_")
    ext = F.regexp_extract(t, r"(\.[^.]*)$", 1)
    return F.when(F.length(t) <= 255, t).otherwise(F.concat(F.left(F.substring(t, F.lit(1), F.length(t) - F.length(ext)), F.lit(255) - F.length(ext)), ext))


def upload_name(c: Column) -> Column:
    base = F.regexp_extract(c, r"([^/]*)/*$", 1)
    t = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_.\-]", "_"), "_+", "_")
    return F.when(t == "", F.lit("upload.pdf")).otherwise(t)


def filename_error(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("empty")).when(F.length(c) > 255, F.lit("too long")).when(c.rlike(r'[/\\:*?"<>|]'), F.lit("invalid characters"))


def has_parent_part(c: Column) -> Column:
    return F.array_contains(F.split(c, "/"), "..")


def has_dots(c: Column) -> Column:
    return F.contains(c, F.lit(".."))


def format_bytes(c: Column) -> Column:
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, F.format_string("%.1f KB", c / F.lit(1024.0))).otherwise(F.format_string("%.2f MB", c / F.lit(1048576.0)))


def escape_html(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def document_date(c: Column) -> Column:
    """A document's date (D:YYYYMMDDHHmmSS...) as text, or null; days up to 31 are let pass in any month."""
    p = r"^D?:?(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})"
    part = [F.regexp_extract(c, p, i) for i in range(1, 7)]
    n = [F.coalesce(x.try_cast("int"), F.lit(-1)) for x in part]
    ok = n[0].between(1900, 2200) & n[1].between(1, 12) & n[2].between(1, 31) & n[3].between(0, 23) & n[4].between(0, 59) & n[5].between(0, 59)
    text = F.concat(F.concat_ws("-", *part[:3]), F.lit(" "), F.concat_ws(":", *part[3:]))
    return F.when(ok, text)


def short_id(*parts: Column, size: int = 8) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, size)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def confidence_value(c: Column) -> Column:
    return clamp(F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0)))


def r3(c: Column) -> Column:
    """Rounded to three places; what summing in another order changes is rounded away first."""
    return F.round(F.round(c, 9), 3)
