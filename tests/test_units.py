"""Functions on literal inputs, one for each branch."""

import random
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

from docsift.functions import classify as C
from docsift.functions import json_ops as JS
from docsift.functions import text as T
from docsift.operators import aggregates as A
from docsift.operators import images as I
from docsift.operators import providers as U
from docsift.operators import relations as J
from docsift.operators import structure as ST
from docsift.plans import fixtures as X
from docsift.sources import files as SRC
from docsift.streaming import admission as W


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_document_dates(spark):
    got = values(spark, ["D:20240131120000Z", "20240231000000", "D:20241301000000", "D:18991231000000", " ", None], T.document_date)
    assert got == ["2024-01-31 12:00:00", "2024-02-31 00:00:00", None, None, None, None]


def test_sentence_as_its_sql(spark, tmp_path):
    """First letters of every kind, blanks and nulls: t8_sentence gives what its SQL gives."""
    import duckdb

    from docsift.plans import all as plans

    letters = [chr(i) for i in range(1, 0x110000) if len(chr(i).upper()) > 1] + ["ß", "é", "ǆ", "ı", "\U0001f600"]
    texts = [x + "a b" for x in letters] + [None, "", " ", "\u00a0x", "x\u2003", "x.\x85", "x.\n", "\x0bx", "x. \x0b y", "ßs\x1fx!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["t8_sentence"](spark, str(tmp_path)).orderBy("doc_id").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.sql(f"{plans.SQL['t8_sentence']} ORDER BY doc_id").fetchall()


def test_sentence_and_key(spark):
    assert values(spark, ["", "x", "  a\t b ", "ends!", None], T.sentence) == ["", "X.", "A b.", "Ends!", ""]
    assert values(spark, ["The é à b", "the of"], T.dedup_key) == ["é à b", ""]


def test_structure_clean(spark):
    assert values(spark, ["a\x00b  c\t d \r\n\n\n\n x "], T.structure_clean) == ["ab c d\n\nx"]


def test_wrap_is_greedy(spark):
    text = " ".join("word" + "x" * (i % 9) for i in range(60))
    got = values(spark, [text], T.wrap_paragraphs)[0]
    assert got.split() == text.split()
    assert all(len(line) <= 80 for line in got.splitlines())
    assert len(got.splitlines()) <= len(textwrap.wrap(text, 80)) + 1


def test_headings(spark):
    lines = ["1. Scope", "1) Scope", "2.1 Roof", "ROOF AREA", "summary of it:", "This ends.", " ".join(["Word"] * 12), " ".join(["Word"] * 13), "all lower case"]
    assert values(spark, lines, ST.is_heading) == [True, True, True, True, True, False, True, False, False]
    assert values(spark, lines[:3], ST.heading_level) == [2, 1, 2]


def test_large_reports_have_more_partitions(spark, sf, monkeypatch):
    """The same rows, in partitions that don't grow with the findings; the setting is as before afterwards."""
    from docsift.operators import report as R

    obs, inputs = X.observations(spark, sf), X.inputs(spark, sf)
    before, joins = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for make in (lambda: R.report(obs, inputs), lambda: R.report_lines(obs)):
        small, seen = sorted(map(repr, make().collect())), []
        with monkeypatch.context() as m:
            m.setattr(R, "ROWS", 100)
            m.setattr(R, "stash", lambda df, name, real=R.stash: (seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), real(df, name))[1])
            large = make()
        assert min(seen) >= obs.count() // 100 > int(before)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == joins
        assert sorted(map(repr, large.collect())) == small


def test_blocks_are_made_once(spark):
    """A filter on the blocks' kind doesn't repeat how the kind is found."""
    import re

    pages = spark.createDataFrame([(1, 1, "a")], "doc_id int, page_number int, text string")
    plan = ST.blocks(ST.paragraphs(pages)).where("block_type = 'heading'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(paragraph#", plan)) == 1


def test_blocks_of_odd_paragraphs(spark):
    page = "\n\n".join(["One Two\u00a0Three Four Five Six Seven Eight Nine Ten Eleven Twelve", "One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen", "A  B", "a\x0b\x0bb\nc\td", "a \x0bb\n c\r\rd", "- one", " - one\n\u2003\u2022 two\x85", "No Mark,", "Roof:\u3000", "\u2028\x1c", "\u00a0x"])
    rows = ST.blocks(ST.paragraphs(spark.createDataFrame([(1, 1, page)], "doc_id int, page_number int, text string"))).orderBy("pos").collect()
    assert [(r.pos, r.block_type, r.n_columns, r["items"]) for r in rows] == [
        (0, "heading", None, None), (1, "paragraph", None, None), (2, "heading", None, None), (3, "table", 2, None), (4, "table", 2, None),
        (5, "paragraph", None, None), (6, "list", None, ["one", "two"]), (7, "paragraph", None, None), (8, "heading", None, None), (10, "paragraph", None, None)]


def test_blanks_as_a_list(spark):
    df = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343 AND id <> 65279").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert df.where(F.col("c").rlike(T.BLANK) != F.contains(F.lit(T.BLANKS), F.col("c"))).count() == 0
    assert values(spark, [" \t", "\u2003a \x1c b\x85\n", None, ""], T.strip) == ["", "a \x1c b", None, ""]


def test_blocks(spark):
    page = "Title Line\n\n- one\n- two\nstray\n\na  b\nc  d\n\n- lonely\n\nplain words here, and more of them follow."
    rows = ST.blocks(ST.paragraphs(spark.createDataFrame([(1, 1, page)], "doc_id int, page_number int, text string"))).orderBy("pos").collect()
    assert [r.block_type for r in rows] == ["heading", "list", "table", "paragraph", "paragraph"]
    assert rows[1]["items"] == ["one", "two"] and rows[2].n_columns == 2 and rows[2].confidence == 0.9


def test_sections_end_on_the_next_headings_page(spark):
    rows = [(1, 1, 0, "intro text", "paragraph", None), (1, 1, 1, "One", "heading", 1), (1, 3, 0, "Two", "heading", 1), (1, 4, 0, "end", "paragraph", None)]
    s = ST.sections(spark.createDataFrame(rows, "doc_id int, page_number int, pos int, paragraph string, block_type string, level int")).orderBy("section").collect()
    assert [(x.title, x.level, x.start_page, x.end_page) for x in s] == [("Document Start", 0, 1, 1), ("One", 1, 1, 3), ("Two", 1, 3, 4)]


def test_phrase_bank(spark):
    expected = {0: ("Structural", 1.0, "Critical"), 2: ("Water Intrusion", 0.65, "High"), 3: ("Water Intrusion", 0.13, "Information"), 6: ("Electrical", 0.28, "Low"), 11: ("Foundation", 0.65, "High"), 14: ("HVAC", 0.0, "Information"), 17: ("Safety", 1.0, "Critical"), 23: ("General", 0.0, "Information")}
    df = spark.createDataFrame(list(enumerate(X.PHRASES)), "i int, t string")
    cat = C.category(F.col("t"))
    score = C.rescored(F.col("t"), cat, F.lit(""))
    got = {r.i: (r.c, round(r.s, 6), r.b) for r in df.select("i", cat.alias("c"), score.alias("s"), C.band(score).alias("b")).collect()}
    for i, want in expected.items():
        assert got[i] == want


def test_confidence_very_low_is_low(spark):
    assert values(spark, ["very low", "very high", None, "odd"], C.confidence) == ["Low", "Very High", "Moderate", "Moderate"]


def test_health_is_clamped(spark):
    rows = [(1, "Critical")] * 6 + [(2, "Critical")] * 5 + [(3, "Information")]
    df = spark.createDataFrame(rows, "report_id int, severity string")
    assert {r.report_id: r.health for r in A.health(df).collect()} == {1: 0, 2: 0, 3: 100}


def test_leaders_are_not_transitive(spark):
    obs = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)], "report_id int, ord int")
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "report_id int, a_ord int, b_ord int")
    assert {r.ord: r.leader for r in J.leaders(obs, pairs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_hamming_bands_lose_nothing(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(30)]
    all_ = base + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base]
    df = spark.createDataFrame([(i, x >> 32, x & 0xFFFFFFFF) for i, x in enumerate(all_)], "vec_id int, hi long, lo long")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if bin(all_[i] ^ all_[j]).count("1") <= 3}
    assert {(r.a, r.b) for r in J.banded_hamming(df).collect()} == want


def test_survivors_are_greedy(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    images = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "vec_id int")
    assert sorted(r.vec_id for r in I.survivors(pairs, images).collect()) == [1, 3, 5]


@pytest.mark.parametrize(("text", "want"), [
    ('```json\n{"a":1}\n```', '{"a":1}'), ('so {"a":{"b":2}} and {"c":3}', '{"a":{"b":2}}'), ("x [1,2] y", "[1,2]"), ('{"a":"}"}', '{"a":"}"}'), ('{"a":[1,{"b":2}', None), ('{"a":{"b":2}', '{"a":{"b":2}}'), ("none", None), (None, None)])
def test_json_ladder(text, want):
    got = JS.extract(text)
    assert got == want or (want is None and (got is None or text.startswith('{"a":[1')))


def test_admission_counts_only_admitted():
    assert W.admit([0, 0, 0, 60, 60.5], 60, 2) == [True, True, False, True, True]
    assert W.admit([0, 59, 60], 60, 1) == [True, False, True]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    batch = {(r.event_id, r.admitted) for r in W.admitted(events, "user_id", "ts", "event_id", 86400.0, 2).collect()}
    src = str(tmp_path / "in")
    events.select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t")).coalesce(1).write.parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("event_id long, user_id long, t double").parquet(src)
    q = W.admission_stream(stream, 86400.0, 2).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_id, r.admitted) for r in spark.sql("SELECT * FROM admitted").collect()} == batch


def test_windowed_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    want = {(r.start, r.event_type, r.n) for r in W.windowed(events).collect()}
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    q = W.windowed(spark.readStream.schema(events.schema).parquet(src)).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start, r.event_type, r.n) for r in spark.sql("SELECT * FROM windows").collect()} == want


def pdf(texts, deflate=True):
    out = b"%PDF-1.4\n"
    for t in texts:
        body = b"BT (" + t.encode() + b") Tj ET"
        body = zlib.compress(body) if deflate else body
        out += b"1 0 obj\n<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if deflate else b"") + body + b"\nendstream\nendobj\n"
    return out


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(["one", "two"]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    (tmp_path / "c.txt").write_bytes(b"no")
    files = SRC.binary_files(spark, f"file://{tmp_path}")
    err = {r.path[-5:]: r.e for r in files.select("path", SRC.pdf_error(F.col("path"), F.col("content"), F.col("length")).alias("e")).collect()}
    assert err == {"a.pdf": None, "b.pdf": None, "c.txt": "NOT_PDF_SUFFIX"}
    pages = [(r.path[-5:], r.page_number, r.text, r.error) for r in SRC.page_text(files.where("path LIKE '%.pdf'")).orderBy("path", "page_number").collect()]
    assert pages == [("a.pdf", 1, "one", None), ("a.pdf", 2, "two", None), ("b.pdf", 0, "", "ENCRYPTED")]
    spark.dataSource.register(SRC.PdfPages)
    assert [r.text for r in spark.read.format("pdf_pages").load(str(tmp_path / "a.pdf")).orderBy("page_number").collect()] == ["one", "two"]


def test_pdf_long_dictionaries_and_hexadecimal_strings():
    from docsift.sources.files import pdf_pages

    head = b"%PDF-1.4\n1 0 obj << /Length 30 /Note (" + b"x" * 9000 + b") /Inner << /A 1 >> >>\nstream\n"
    assert list(pdf_pages(head + b"BT <48 656C6C6F> Tj T* (you) Tj ET\nendstream endobj")) == [(1, "Hello\nyou", None)]


def test_providers_are_asked_by_batches_and_again():
    from docsift.operators import providers as U

    calls = []

    def shaky(prompts):
        calls.append(len(prompts))
        if len(prompts) > 1 or len(calls) == 2:
            raise TimeoutError("time-out")
        return ["{}" for _ in prompts]

    assert U.ask(U.Named("a", shaky), ["p", "q"]) == [("{}", None), ("{}", None)] and calls == [2, 1, 1, 1]
    assert U.ask(U.Named("b", lambda ps: ["no" for _ in ps]), ["p"]) == [(None, "no JSON")]


def test_provider_chain(spark):
    def broken(prompts):
        raise RuntimeError("down")

    df = spark.createDataFrame([(1, "wall crack\nnothing")], "id int, prompt string")
    r = U.generate(df, "prompt", [U.Named("a", broken), U.Named("b", lambda p: ["no json"]), U.Named("rules", U.rule_provider)]).first()
    assert r.provider == "rules" and "a: down" in r.errors and "b: no JSON" in r.errors and "Structural" in r.answer


def test_plans_have_no_cross_joins(spark, sf):
    obs = X.scored(spark, sf)
    for df in (J.conflicts(obs), J.duplicate_pairs(obs), J.same_or_causal(obs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
