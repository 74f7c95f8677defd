"""Queries of structure analysis, JSON, images, sources, admission and what the service adds."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from docsift import lexicon as lx
from docsift.functions import json_ops as JS
from docsift.functions import text as T
from docsift.operators import images as I
from docsift.operators import providers as U
from docsift.operators import relations as J
from docsift.operators import structure as ST
from docsift.plans import fixtures as X
from docsift.registry import query
from docsift.sources import files as SRC
from docsift.streaming import admission as W

o = F.col
WS = r"[\s\x1c-\x1f\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# Text pages, two a document: lines that end a sentence end a paragraph, bars are column gaps; by id, a list, a table or a
# numbered heading follows; the text of every eleventh document is blank.
TAILS = ["\n\n- first item\n* second item\nnot an item\n(a) third item", "\n\nname   size\tunit\nwall   12   m\nroof only\ndoor   3   m", "\n\n1.2 Roof And Walls\n\nas seen from the yard", ""]


def _pages(spark, d):
    k = o("doc_id")
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (k % 4 + 1).cast("int"))
    t = F.when(k % 11 == 0, " ").otherwise(F.concat(F.replace(F.replace(o("text"), F.lit(" | "), F.lit("   ")), F.lit(".\n"), F.lit(".\n\n")), tail))
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.alias("t"))
    half = F.floor(F.length("t") / F.lit(2)).cast("int")
    return x.select("doc_id", F.posexplode(F.array(F.substring(o("t"), F.lit(1), half), F.substring(o("t"), half + 1, F.length("t")))).alias("p", "text")).select("doc_id", (o("p") + 1).alias("page_number"), "text")


def _blocks(spark, d):
    return ST.blocks(ST.paragraphs(_pages(spark, d)))


SQL_TAILS = "[" + ", ".join("'" + t.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for t in TAILS) + "]"
PG = r"""t0 AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE regexp_replace(replace(text, ' | ', '   '), '\.\n', '.' || chr(10) || chr(10), 'g') || (""" + SQL_TAILS + r""")[doc_id % 4 + 1] END AS t FROM documents),
 pg AS (SELECT doc_id, unnest([1, 2]) AS page_number, unnest([left(t, len(t) // 2), substr(t, len(t) // 2 + 1)]) AS text FROM t0),
 pa0 AS (SELECT doc_id, page_number, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10) || chr(10))) AS paragraph FROM pg),
 pa AS (SELECT * FROM pa0 WHERE """ + _strip("paragraph") + " <> '')"
WD = f"list_filter(string_split_regex(l1, '{WS}+'), lambda w: w <> '')"
CELLS = f"len(list_filter(string_split_regex({_strip('s')}, '\\s{{2,}}|\\t'), lambda c: c <> ''))"
BL = PG + f""", b1 AS (SELECT *, list_filter(list_transform(string_split(paragraph, chr(10)), lambda s: {_strip('s')}), lambda s: s <> '') AS lines,
  list_filter(list_transform(string_split(paragraph, chr(10)), lambda s: {CELLS}), lambda n: n >= 2) AS wide FROM pa),
 b2 AS (SELECT *, lines[1] AS l1, list_transform(list_filter(lines, lambda s: regexp_matches(s, '{ST.ITEM}')), lambda s: regexp_extract(s, '{ST.ITEM}', 1)) AS items,
  (SELECT struct_pack(n := count(*), v := w) FROM (SELECT unnest(wide) AS w) GROUP BY w ORDER BY count(*) DESC, w LIMIT 1) AS md FROM b1),
 b3 AS (SELECT *, CASE WHEN len(wide) >= 2 THEN 'table' WHEN len(items) >= 2 THEN 'list' WHEN len(lines) = 1 AND len({WD}) BETWEEN 1 AND 12 AND NOT regexp_matches(l1, '[.,;]$') AND (regexp_matches(l1, '{ST.NUMBERED}') OR (regexp_matches(l1, '{ST.CAPS}') AND regexp_matches(l1, '[A-Z]')) OR ends_with(l1, ':') OR len(list_filter({WD}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 0.7::DOUBLE * len({WD})) THEN 'heading' ELSE 'paragraph' END AS block_type FROM b2),
 bl AS (SELECT doc_id, page_number, pos, paragraph, block_type, lines, items AS items0, CASE WHEN block_type = 'heading' THEN CASE WHEN regexp_matches(l1, '{ST.NUMBERED}') AND contains(split_part(l1, ' ', 1), '.') THEN 2 ELSE 1 END END AS level,
  CASE WHEN block_type = 'list' THEN len(items) END AS n_items, CASE WHEN block_type = 'table' THEN len(lines) END AS n_rows, CASE WHEN block_type = 'table' THEN md.v END AS n_columns,
  CASE WHEN block_type = 'table' THEN round(least(0.95::DOUBLE, 0.4::DOUBLE + 0.5::DOUBLE * md.n / len(wide)), 2) END AS confidence FROM b3)"""


@query("st1_paragraphs", f"WITH {PG} SELECT doc_id, page_number, pos::INT AS pos, paragraph FROM pa")
def st1(spark, d):
    return ST.paragraphs(_pages(spark, d))


@query("st2_blocks", f"WITH {BL} SELECT doc_id, page_number, pos, block_type, level, n_items, n_rows, n_columns, confidence FROM bl")
def st2(spark, d):
    return _blocks(spark, d).select("doc_id", "page_number", "pos", "block_type", "level", F.when(o("items").isNotNull(), F.size("items")).alias("n_items"), "n_rows", "n_columns", "confidence")


@query("st3_headings", f"WITH {BL} SELECT doc_id, page_number, pos, paragraph FROM bl WHERE block_type = 'heading'")
def st3(spark, d):
    return _blocks(spark, d).where("block_type = 'heading'").select("doc_id", "page_number", "pos", "paragraph")


@query("st4_heading_level", f"WITH {BL} SELECT level, count(*) AS n FROM bl WHERE block_type = 'heading' GROUP BY level")
def st4(spark, d):
    return _blocks(spark, d).where("block_type = 'heading'").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("st5_list_items", f"WITH {BL} SELECT doc_id, page_number, pos, array_to_string(items0, '|') AS items FROM bl WHERE block_type = 'list'")
def st5(spark, d):
    return _blocks(spark, d).where("block_type = 'list'").select("doc_id", "page_number", "pos", F.array_join("items", "|").alias("items"))


HTML_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '</h1>|</p>|</ul>', chr(10) || chr(10), 'g'), '<li>', '- ', 'g'), '</li>', chr(10), 'g'), '<[^>]*>', '', 'g')"


@query("html_to_text", f"SELECT page_id, {HTML_SQL} AS text FROM pages")
def html_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", ST.html_to_text(o("html")).alias("text"))


@query("st6_tables", f"WITH {BL} SELECT doc_id, page_number, pos, n_rows, n_columns, confidence FROM bl WHERE block_type = 'table'")
def st6(spark, d):
    return _blocks(spark, d).where("block_type = 'table'").select("doc_id", "page_number", "pos", "n_rows", "n_columns", "confidence")


SEC = BL + """, s1 AS (SELECT *, sum((block_type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY page_number, pos ROWS UNBOUNDED PRECEDING) AS section FROM bl),
 s2 AS (SELECT doc_id, section, max(paragraph) FILTER (block_type = 'heading') AS title, max(level) AS level, min(page_number) AS start_page, max(page_number) AS last, string_agg(paragraph, chr(10) || chr(10) ORDER BY page_number, pos) AS text, count(*) AS n_blocks FROM s1 GROUP BY ALL)"""


@query("st7_sections", f"WITH {SEC} SELECT doc_id, section::BIGINT AS section, coalesce(title, 'Document Start') AS title, coalesce(level, 0) AS level, start_page, coalesce(lead(start_page) OVER (PARTITION BY doc_id ORDER BY section), last) AS end_page, text, n_blocks FROM s2")
def st7(spark, d):
    return ST.sections(_blocks(spark, d))


BODY = f"CASE block_type WHEN 'heading' THEN repeat('#', level) || ' ' || paragraph WHEN 'list' THEN array_to_string(list_transform(items0, lambda i: '- ' || i), chr(10)) WHEN 'table' THEN array_to_string(list_transform(string_split(paragraph, chr(10)), lambda s: array_to_string(list_filter(string_split_regex({_strip('s')}, '\\s{{2,}}|\\t'), lambda c: c <> ''), ' | ')), chr(10)) ELSE paragraph END"


@query("st8_render", f"WITH {BL} SELECT doc_id, string_agg('[Page ' || page_number || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY page_number) AS rendered FROM (SELECT doc_id, page_number, string_agg({BODY}, chr(10) ORDER BY pos) AS t FROM bl GROUP BY ALL) GROUP BY doc_id")
def st8(spark, d):
    return ST.render(_blocks(spark, d))


@query("st9_document_status", f"WITH {BL} SELECT d.doc_id, count(bl.pos) AS n_blocks, CASE WHEN count(bl.pos) > 0 THEN 'ok' ELSE 'no text' END AS status FROM documents d LEFT JOIN bl ON d.doc_id = bl.doc_id GROUP BY d.doc_id")
def st9(spark, d):
    b = ST.paragraphs(_pages(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))  # a block each
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id").join(b, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_blocks"), F.when(o("n") > 0, "ok").otherwise("no text").alias("status"))


# JSON ---------------------------------------------------------------------------------------------------------------
def _answers(spark, d):
    """Model answers in the shapes that occur: fenced, with prose, a list, an object, no JSON, two objects, cut off."""
    k = o("event_id") % 7
    one = F.concat(F.lit('{"area":"A'), o("event_id") % 7, F.lit('","observation":"'), o("event_type"), F.lit('"}'))
    full = F.concat(F.lit('{"observations":['), one, F.lit("]}"))
    a = F.when(k == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), full, F.lit(" done"))).when(k == 2, F.concat(F.lit("["), one, F.lit("]"))).when(k == 3, one).when(k == 4, F.lit("no answer")).when(k == 5, F.concat(F.lit("x "), one, F.lit(' or {"b":2} y'))).otherwise(F.concat(F.lit('Well: {"observations":['), one))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", a.alias("answer"))


ANS = """a AS (SELECT event_id, event_id % 7 AS k, '{"area":"A' || (event_id % 7) || '","observation":"' || event_type || '"}' AS one FROM events),
 b AS (SELECT event_id, k, one, '{"observations":[' || one || ']}' AS whole FROM a),
 ans AS (SELECT event_id, CASE k WHEN 0 THEN '```json' || chr(10) || whole || chr(10) || '```' WHEN 1 THEN 'Here: ' || whole || ' done' WHEN 2 THEN '[' || one || ']' WHEN 3 THEN one WHEN 4 THEN 'no answer' WHEN 5 THEN 'x ' || one || ' or {"b":2} y' ELSE 'Well: {"observations":[' || one END AS answer FROM b)"""
FENCE = r"regexp_replace(regexp_replace(answer, '^\s*```(?:json)?\s*', ''), '\s*```\s*$', '')"
GREEDY = f"coalesce(CASE WHEN json_valid({FENCE}) THEN {FENCE} END, CASE WHEN json_valid(regexp_extract({FENCE}, '(?s)\\{{.*\\}}')) THEN regexp_extract({FENCE}, '(?s)\\{{.*\\}}') END, CASE WHEN json_valid(regexp_extract({FENCE}, '(?s)\\[.*\\]')) THEN regexp_extract({FENCE}, '(?s)\\[.*\\]') END)"


@query("js1_strip_fences", f"WITH {ANS} SELECT event_id, {FENCE} AS out FROM ans")
def js1(spark, d):
    return _answers(spark, d).select("event_id", JS.strip_fences(o("answer")).alias("out"))


@query("js2_greedy_json", f"WITH {ANS} SELECT event_id, {GREEDY} AS out FROM ans")
def js2(spark, d):
    return _answers(spark, d).select("event_id", JS.greedy_object(o("answer")).alias("out"))


@query("js2_balanced_json", f"WITH {ANS} SELECT event_id, CASE WHEN k IN (0, 1) THEN whole WHEN k = 2 THEN '[' || one || ']' WHEN k IN (3, 5) THEN one WHEN k = 6 THEN '{{\"observations\":[' || one || ']}}' END AS out FROM b")
def js2b(spark, d):
    return _answers(spark, d).select("event_id", JS.extract_json(o("answer")).alias("out"))


@query("js3_items", "SELECT event_id, 'A' || (event_id % 7) AS area, event_type AS observation FROM events WHERE event_id % 7 < 4")
def js3(spark, d):
    return _answers(spark, d).select("event_id", F.explode(JS.items(JS.greedy_object(o("answer")))).alias("i")).select("event_id", "i.area", "i.observation")


SCHEMA = {"k": "number", "s": "string", "z": "array", "o": "object"}


@query("js4_schema_errors", """SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'Field k must be number' WHEN 2 THEN 'Data must be a dictionary' WHEN 3 THEN 'Missing required field: k' WHEN 5 THEN 'Field s must be string'
 WHEN 6 THEN 'Field z must be array' WHEN 7 THEN 'Field o must be object' WHEN 8 THEN 'Data must be a dictionary' ELSE '' END AS error FROM events""")
def js4(spark, d):
    shapes = [None, '{"k":"12"}', "[1]", '{"z":1}', '{"k":1.5,"z":[1],"s":"a","o":{"a":1}}', '{"k":true,"s":3}', '{"k":1,"z":{}}', '{"k":1,"z":[],"o":null}', "not json"]
    made = F.element_at(F.array(*[F.lit(x) for x in shapes]), (o("event_id") % 9 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", JS.schema_error(F.coalesce(made, o("props")), ["k"], SCHEMA).alias("error"))


@query("js5_required_keys", "SELECT event_id, array_to_string(list_filter(['k', 'z'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing FROM events")
def js5(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.array_join(JS.missing_keys(o("props"), ["k", "z"]), ",").alias("missing"))


@query("js6_prompt_json", "SELECT o_orderkey, '{\"id\":' || o_orderkey || ',\"severity\":\"' || o_orderpriority || '\"}' AS json FROM orders")
def js6(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_json(F.struct(o("o_orderkey").alias("id"), o("o_orderpriority").alias("severity"))).alias("json"))


@query("js7_envelope", "SELECT doc_id, CASE WHEN n_chars > 5000 THEN '{\"success\":false,\"error\":\"too long\"}' ELSE '{\"success\":true,\"data\":' || n_chars || '}' END AS json FROM documents")
def js7(spark, d):
    long = o("n_chars") > 5000
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", JS.envelope(F.when(~long, o("n_chars")), F.when(long, "too long")).alias("json"))


# Images: 64 values stand for an 8 x 8 grey image ---------------------------------------------------------------------
def _hashes(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px"))
    hi, lo = I.average_hash(o("px"))
    return e.select("vec_id", hi.alias("hi"), lo.alias("lo"))


MEAN = "(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64)"
BITS = f"array_to_string(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > {MEAN} THEN '1' ELSE '0' END), '')"
HASH = f"h AS (SELECT vec_id, {BITS} AS bits FROM embeddings)"


@query("i4_average_hash", f"WITH {HASH} SELECT vec_id, lower(printf('%08x%08x', ('0b' || bits[1:32])::BIGINT, ('0b' || bits[33:64])::BIGINT)) AS hash FROM h")
def i4(spark, d):
    return _hashes(spark, d).select("vec_id", I.hash_hex(o("hi"), o("lo")).alias("hash"))


NEAR = 3  # bits: similarity of more than 0.95
PLANT = 1000000


def _planted(spark, d):
    """The hashes, and for each a copy of which the last 0 to 5 bits are turned."""
    x = _hashes(spark, d)
    turned = F.element_at(F.array(*[F.lit((1 << n) - 1) for n in range(6)]), (o("vec_id") % 6 + 1).cast("int"))
    return x.union(x.select(o("vec_id") + PLANT, "hi", o("lo").bitwiseXOR(turned)))


PLANTED = HASH + f", p AS (SELECT * FROM h UNION ALL SELECT vec_id + {PLANT}, left(bits, 64 - vec_id % 6) || translate(right(bits, vec_id % 6), '01', '10') FROM h)"


@query("i5_hamming", f"WITH {PLANTED} SELECT a.vec_id AS a, b.vec_id AS b, 1 - hamming(a.bits, b.bits) / 64::DOUBLE AS similarity FROM p a JOIN p b ON b.vec_id = a.vec_id + {PLANT}")
def i5(spark, d):
    x = _planted(spark, d)
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, o("b.vec_id") == o("a.vec_id") + PLANT).select(o("a.vec_id").alias("a"), o("b.vec_id").alias("b"), I.similarity(o("a.hi"), o("a.lo"), o("b.hi"), o("b.lo")).alias("similarity"))


@query("j12_near_images", f"WITH {PLANTED} SELECT a.vec_id AS a, b.vec_id AS b, hamming(a.bits, b.bits)::INT AS distance FROM p a JOIN p b ON a.vec_id < b.vec_id AND hamming(a.bits, b.bits) <= {NEAR}")
def j12(spark, d):
    return J.banded_hamming(_planted(spark, d), "vec_id", NEAR)


@query("j12_survivors", f"""WITH RECURSIVE {PLANTED}, n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, bits FROM p), w AS (
 SELECT 1::BIGINT AS i, [vec_id] AS ids, [bits] AS kept FROM n WHERE i = 1 UNION ALL
 SELECT w.i + 1, CASE WHEN len(list_filter(w.kept, lambda k: hamming(k, n.bits) <= {NEAR})) = 0 THEN list_append(w.ids, n.vec_id) ELSE w.ids END, CASE WHEN len(list_filter(w.kept, lambda k: hamming(k, n.bits) <= {NEAR})) = 0 THEN list_append(w.kept, n.bits) ELSE w.kept END
 FROM w JOIN n ON n.i = w.i + 1) SELECT unnest(ids) AS vec_id FROM (SELECT ids FROM w ORDER BY i DESC LIMIT 1)""")
def j12_survivors(spark, d):
    x = _planted(spark, d)
    return I.survivors(J.banded_hamming(x, "vec_id", NEAR), x)


HEADS = ["plain", "a onLoad=x", "b ONERROR=y", "c exec(1)", "d system(1)", "e <% f", "<?php"]


@query("i2_suspicious", f"SELECT page_id, page_id % {len(HEADS)} IN (1, 2, 3, 5, 6) AS suspicious FROM pages")
def i2(spark, d):
    head = F.element_at(F.array(*[F.lit(x) for x in HEADS]), (o("page_id") % len(HEADS) + 1).cast("int"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", I.suspicious(F.encode(F.concat(head, F.lit("." * 1024), F.left("html", F.lit(100))), "UTF-8")).alias("suspicious"))


def _png(spoilt: bool = False) -> bytes:
    out = b"\x89PNG\r\n\x1a\n"
    for kind, data in ((b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0"), (b"IDAT", zlib.compress(b"\0\7")), (b"IEND", b"")):
        out += len(data).to_bytes(4, "big") + kind + data + (zlib.crc32(kind + data) ^ (spoilt and kind == b"IDAT")).to_bytes(4, "big")
    return out


IMAGES = [
    (_png(), "png", None), (_png(True), "png", "corrupted"), (_png()[:-6], "png", "corrupted"), (b"\xff\xd8\xff\xe0\0\2\xff\xda\0\2\7\xff\xd9", "jpg", None), (b"\xff\xd8\xff\xe0\0\2", "jpg", "corrupted"),
    (b"GIF89a" + b"\0" * 8 + b";", "gif", None), (b"BM" + (30).to_bytes(4, "little") + b"\0" * 24, "bmp", None), (b"BM\xff\xff\0\0", "bmp", "corrupted"), (b"II*\0\x08\0\0\0\1\0" + b"\0" * 16, "tiff", None),
    (b"MM\0*\xff\0\0\0", "tiff", "corrupted"), (b"RIFF\x04\0\0\0WEBP", "webp", None), (b"RIFF\x04\0\0\0WAVE", "webp", "corrupted"), (b"\x89PNG<Script>", "png", "suspicious content"), (b"\0\x11", None, "unknown format"), (b"", None, "unknown format"), (b"BM" + b"\0" * 99, "bmp", "too large"),
]


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][p_partkey % {len(IMAGES)} + 1]"


@query("i1_i9_validation", f"SELECT p_partkey, {_sql_list([e for _, _, e in IMAGES])} AS error, {_sql_list([f for _, f, _ in IMAGES])} AS format FROM part")
def i9(spark, d):
    c = F.unhex(F.element_at(F.array(*[F.lit(x.hex()) for x, _, _ in IMAGES]), (o("p_partkey") % len(IMAGES) + 1).cast("int")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", c.alias("c")).select("p_partkey", I.validation_error(o("c"), 90).alias("error"), I.image_format(o("c")).alias("format"))


@query("i10_hash_pair", f"WITH {HASH} SELECT vec_id, md5('image ' || vec_id) AS hash_md5, CASE WHEN vec_id % 3 = 0 THEN '' ELSE lower(printf('%08x%08x', ('0b' || bits[1:32])::BIGINT, ('0b' || bits[33:64])::BIGINT)) END AS hash_phash FROM h")
def i10(spark, d):
    x = _hashes(spark, d)
    pair = I.hash_pair(F.encode(F.concat(F.lit("image "), "vec_id"), "UTF-8"), F.when(o("vec_id") % 3 != 0, I.hash_hex(o("hi"), o("lo"))))
    return x.select("vec_id", pair.alias("h")).select("vec_id", o("h.md5").alias("hash_md5"), o("h.phash").alias("hash_phash"))


@query("i8_i11_image_record", """SELECT p_partkey, '{"image_id":"' || p_partkey || '","page_number":' || (p_partkey % 9 + 1) || ',"format":"' || (CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'gif' END) || '","width":' || p_size || ',"height":' || floor(p_retailprice)::BIGINT || ',"is_duplicate":' || (p_partkey % 4 = 0) || ',"extracted_at":"2026-01-' || printf('%02d', p_partkey % 28 + 1) || 'T00:00:00"}' AS record FROM part""")
def i8(spark, d):
    k = o("p_partkey")
    fields = [k.cast("string").alias("image_id"), (k % 9 + 1).alias("page_number"), F.when(k % 3 == 0, "png").when(k % 3 == 1, "jpg").otherwise("gif").alias("format"), o("p_size").alias("width"), F.floor("p_retailprice").alias("height"), (k % 4 == 0).alias("is_duplicate"),
              F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 28).cast("int")), "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at")]
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.to_json(F.struct(*fields)).alias("record"))


@query("sc11_i7_image_quality")
def sc11(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) * 127).alias("px"))
    eight = F.lit(8)
    return e.select("vec_id", I.quality("px", eight, eight).alias("q"), I.image_kind("px", eight, eight).alias("kind")).select("vec_id", "q.*", "kind")


# Admission, retention, windows ---------------------------------------------------------------------------------------
ADMIT = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), w AS (
 SELECT user_id, i, event_id, [t] AS held, true AS admitted FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, e.event_id, CASE WHEN len(list_filter(w.held, lambda x: x > e.t - 86400)) < 2 THEN list_append(list_filter(w.held, lambda x: x > e.t - 86400), e.t) ELSE list_filter(w.held, lambda x: x > e.t - 86400) END, len(list_filter(w.held, lambda x: x > e.t - 86400)) < 2
 FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) SELECT event_id, user_id, admitted FROM w"""


@query("w1_admission", ADMIT)
def w1(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts")
    return W.admitted(e, "user_id", "ts", "event_id", 86400.0, 2).select("event_id", "user_id", "admitted")


@query("w2_skip_list", ADMIT.replace("FROM events)", "FROM events WHERE event_type <> 'view')").replace("SELECT event_id, user_id, admitted FROM w", "SELECT event_id, CASE WHEN admitted THEN 200 ELSE 429 END AS status, CASE WHEN NOT admitted THEN 86400 END AS retry_after FROM w UNION ALL SELECT event_id, 200, NULL FROM events WHERE event_type = 'view'"))
def w2(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    return W.responses(e, o("event_type") == "view", "user_id", "ts", "event_id", 86400.0, 2).select("event_id", "status", "retry_after")


KIND_OF = {"click": "temp", "view": "report", "purchase": "image"}


@query("w3_retention", "SELECT event_id FROM events WHERE CASE event_type WHEN 'click' THEN ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR WHEN 'purchase' THEN ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY WHEN 'view' THEN ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY ELSE true END")
def w3(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    as_of = e.agg(F.max(o("ts").cast("timestamp"))).first()[0]  # one value: the moment of the clean-up
    kind = F.coalesce(*[F.when(o("event_type") == t, k) for t, k in KIND_OF.items()])
    return W.retained(e.withColumn("kind", kind), "ts", "kind", lx.RETENTION, F.lit(as_of)).select("event_id")


@query("w4_metric_buffer", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100")
def w4(spark, d):
    return W.last_rows(spark.read.parquet(f"{d}/events.parquet"), "event_type", 100, o("ts").desc(), o("event_id").desc()).select("event_id")


@query("w5_stage_timings", "SELECT user_id, sum(value) AS total, string_agg(event_type, ',' ORDER BY event_type) AS stages FROM (SELECT user_id, event_type, sum(value) AS value FROM events GROUP BY ALL) GROUP BY user_id")
def w5(spark, d):
    per = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return per.groupBy("user_id").agg(F.sum("v").alias("total"), F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("stages"))


@query("w8_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def w8(spark, d):
    return W.windowed(spark.read.parquet(f"{d}/events.parquet")).withColumn("start", o("start").cast("timestamp_ntz"))


@query("w8_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def w8s(spark, d):
    return W.sessions(spark.read.parquet(f"{d}/events.parquet")).withColumn("start", o("start").cast("timestamp_ntz"))


# Sources and checks ---------------------------------------------------------------------------------------------------
@query("src4_size_extension", "SELECT page_id, CASE WHEN strlen(html) > 3000 THEN 'too large' END AS size_error, regexp_extract(lower(url), '(\\.[^./]*)$', 1) IN ('.html', '.pdf') AS allowed FROM pages")
def src4(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", SRC.size_error(F.octet_length("html"), 3000).alias("size_error"), SRC.extension_allowed(o("url"), [".html", ".pdf"]).alias("allowed"))


NAMES = ["", "x" * 300, "a|b.html", "scan 1.pdf", "c:d", "y" * 255]


@query("src5_filename_error", f"SELECT page_id, (['empty', 'too long', 'invalid characters', NULL, 'invalid characters', NULL])[page_id % {len(NAMES)} + 1] AS error FROM pages")
def src5(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (o("page_id") % len(NAMES) + 1).cast("int"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.filename_error(name).alias("error"))


@query("src7_page_text", "SELECT doc_id, left(t, 200000) AS text, len(t) > 200000 AS cut FROM (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN repeat('a page ', 30000) ELSE text END AS t FROM documents)")
def src7(spark, d):
    t = F.when(o("doc_id") % 100 == 0, F.repeat(F.lit("a page "), F.lit(30000))).otherwise(o("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.alias("t")).select("doc_id", F.left("t", F.lit(SRC.MOST_PAGE_CHARS)).alias("text"), (F.length("t") > SRC.MOST_PAGE_CHARS).alias("cut"))


@query("src8_metadata", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE c_name END AS title FROM customer")
def src8(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", SRC.metadata_field(F.when(o("c_custkey") % 3 == 0, " \t\n").when(o("c_custkey") % 3 == 1, F.concat(F.lit("\n\t"), o("c_name"), F.lit("\u00a0"))).otherwise(F.concat(F.lit(" "), o("c_name")))).alias("title"))


#: name, content, and the answers of the three checks where files of more than 40 bytes are too large.
FILES = [
    ("A.PDF", "%PDF-1.7 x", None, None, None), ("a.txt", "%PDF-1.7 x", "NOT_PDF_SUFFIX", "NOT_PDF_SUFFIX", None), ("a.pdf", "text", "NO_MAGIC", "NO_MAGIC", "NO_MAGIC"), ("a.pdf", "junk %PDF-1.4", None, "NO_MAGIC", "NO_MAGIC"),
    ("a.pdf", "%PDFx", "NO_MAGIC", None, "NO_MAGIC"), ("a.pdf", "", "EMPTY", "EMPTY", "EMPTY"), ("a.txt", "", "EMPTY", "NOT_PDF_SUFFIX", "EMPTY"), ("a.pdf", "%PDF-" + "x" * 50, "TOO_LARGE", "TOO_LARGE", "TOO_LARGE"),
]


def _by_id(values) -> str:
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[doc_id % {len(FILES)} + 1]"


@query("src1_src3_pdf_checks", f"SELECT doc_id, {_by_id([f[2] for f in FILES])} AS path_error, {_by_id([f[3] for f in FILES])} AS upload_error, {_by_id([f[4] for f in FILES])} AS file_error FROM documents")
def src1(spark, d):
    at = (o("doc_id") % len(FILES) + 1).cast("int")
    name, text = (F.element_at(F.array(*[F.lit(f[i]) for f in FILES]), at) for i in (0, 1))
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", name.alias("name"), F.encode(text, "UTF-8").alias("c"))
    n = F.length("c")
    return x.select("doc_id", SRC.pdf_error(o("name"), o("c"), n, 40).alias("path_error"), SRC.upload_error(o("name"), o("c"), n, 40).alias("upload_error"), SRC.file_error(o("c"), n, 40).alias("file_error"))


@query("src10_image_source", "SELECT doc_id, (['MISSING', 'EMPTY', 'TOO_LARGE', 'NO_PAGES', NULL])[doc_id % 5 + 1] AS error FROM documents")
def src10(spark, d):
    k = o("doc_id") % 5
    c = F.when(k == 1, "").when(k == 2, "x" * 50).when(k > 2, "%PDF-")
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.encode(c, "UTF-8").alias("c"), F.when(k == 4, 3).otherwise(0).alias("pages"))
    return x.select("doc_id", SRC.image_source_error(o("c"), F.length("c"), o("pages"), 40).alias("error"))


@query("x8_upload_safety", r"""SELECT page_id, page_id % 3 <> 0 AND strlen(html) <= 3000 AS safe FROM pages""")
def x8(spark, d):
    name = F.when(o("page_id") % 3 == 0, "a/b.html").otherwise("page.html")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", (T.filename_error(name).isNull() & SRC.size_error(F.octet_length("html"), 3000).isNull()).alias("safe"))


# What the service and its client add -----------------------------------------------------------------------------------
def _busy(prompts):
    """Fails for all that it is sent if a prompt speaks of unit 3."""
    if any("unit 3" in p for p in prompts):
        raise TimeoutError("time-out")
    return ['{"observations":[]}' if "unit 1" in p else "I cannot say" for p in prompts]


CHAIN = [U.Named("rules", U.rule_provider), U.Named("busy", _busy)]


@query("u3_fallback_chain", f"""WITH {X.RAW_SQL}, c AS (SELECT id, observation, {X.s_category('observation', lx.REASONING_CATEGORIES)} AS category FROM raw_obs)
 SELECT id, CASE WHEN contains(observation, 'unit 1') THEN 'busy' ELSE 'rules' END AS provider, CASE WHEN contains(observation, 'unit 3') THEN 'busy: time-out' WHEN contains(observation, 'unit 1') THEN '' ELSE 'busy: no JSON' END AS errors,
 CASE WHEN NOT contains(observation, 'unit 1') AND category <> 'General' THEN category END AS category FROM c""")
def u3(spark, d):
    x = U.generate(X.raw_observations(spark, d).select("id", "observation"), "observation", U.ordered(CHAIN, "busy"), attempts=1)
    found = F.get_json_object("answer", "$.observations[0].category")
    return x.select("id", "provider", "errors", found.alias("category"))


@query("u3_rules_alone", f"WITH {X.RAW_SQL} SELECT id, {X.s_category('observation', lx.REASONING_CATEGORIES)} AS category FROM raw_obs")
def u3_rules(spark, d):
    return U.fallback(X.raw_observations(spark, d)).select("id", "category")


@query("u1_rule_provider", f"""WITH {X.RAW_SQL} SELECT id, CASE WHEN category = 'General' THEN 0 ELSE 1 END AS n, CASE WHEN category <> 'General' THEN category END AS category, 'rules' AS provider FROM (SELECT id, {X.s_category('observation', lx.REASONING_CATEGORIES)} AS category FROM raw_obs)""")
def u1(spark, d):
    x = X.raw_observations(spark, d).select("id", F.format_string(U.PROMPTS["observations"], "observation", F.lit("")).alias("prompt"))
    out = U.generate(x, "prompt", U.ordered([U.Named("rules", U.rule_provider)], "rules"))
    return out.select("id", F.size(F.from_json("answer", "observations array<struct<category:string>>")["observations"]).alias("n"), F.get_json_object("answer", "$.observations[0].category").alias("category"), "provider")


@query("x5_generation_metrics", f"WITH {X.SCORED_SQL} SELECT report_id, count(*) AS n_observations, count(*) FILTER (evidence <> '') AS with_evidence, sum(n_images)::BIGINT AS images FROM scored GROUP BY report_id")
def x5(spark, d):
    return X.scored(spark, d).groupBy("report_id").agg(F.count(F.lit(1)).alias("n_observations"), F.count_if(o("evidence") != "").alias("with_evidence"), F.sum("n_images").alias("images"))


@query("x11_observation_card", f"WITH {X.SCORED_SQL} SELECT id, printf('%.0f%%', CASE WHEN confidence_score <= 1 THEN confidence_score * 100 ELSE confidence_score END) AS confidence, CASE WHEN evidence = '' THEN 'none' ELSE evidence END AS evidence FROM scored")
def x11(spark, d):
    c = F.when(o("confidence_score") <= 1, o("confidence_score") * 100).otherwise(o("confidence_score"))
    return X.scored(spark, d).select("id", F.format_string("%.0f%%", c).alias("confidence"), F.when(o("evidence") == "", "none").otherwise(o("evidence")).alias("evidence"))


RUNGS = ['{"property_summary":"A house"}', '{"summary":"As text"}', '{"key_findings":["One","Two"]}', '{"risk_overview":"Some risk"}', '{"recommendations":["Do this","Do that"]}', "{}", '{"property_summary":"","summary":"Later"}']


@query("x14_summary_chain", f"SELECT event_id, (['A house', 'As text', 'One. Two', 'Some risk', 'Do this. Do that', 'No summary available.', 'Later'])[event_id % {len(RUNGS)} + 1] AS summary FROM events")
def x14(spark, d):
    c = F.element_at(F.array(*[F.lit(x) for x in RUNGS]), (o("event_id") % len(RUNGS) + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", JS.summary(c).alias("summary"))


@query("x15_client_priority", "SELECT o_orderkey, CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'urgent' THEN 'immediate' WHEN 'low' THEN 'long-term' ELSE 'short-term' END AS priority FROM orders")
def x15(spark, d):
    p = F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.when(p == "urgent", "immediate").when(p == "low", "long-term").otherwise("short-term").alias("priority"))


@query("x16_conflict_badge", "SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderpriority), 'critical') THEN 'high' ELSE 'medium' END AS badge FROM orders")
def x16(spark, d):
    low = F.lower("o_orderpriority")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.when(F.contains(low, F.lit("high")) | F.contains(low, F.lit("critical")), "high").otherwise("medium").alias("badge"))


@query("x10_readiness", "SELECT source, bool_and(text IS NOT NULL) AND count(*) > 0 AS ready FROM documents GROUP BY source")
def x10(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("source").agg((F.bool_and(o("text").isNotNull()) & (F.count(F.lit(1)) > 0)).alias("ready"))


@query("x24_file_record", "SELECT doc_id, strlen(text) AS size, sha256(text) AS checksum FROM documents")
def x24(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("checksum"))
